"""Exact top-k by inner product with Fagin's threshold algorithm over sorted per-dimension lists.

Rows are cut into shards of `SHARD` rows and queries into blocks of `BLOCK` queries; each (block, shard) pair is
one group of one Spark task (two packed rows, a few megabytes), found by an equality join on both numbers. A
shard keeps one list per dimension, sorted by value. For a query the lists are read from the end its sign
favours, some entries at a time; rows met for the first time are scored in full; reading stops when the sum of
the weighted values at the reading depth, the most an unread row can score, is below the kth best score. The best k of
each pair are then merged, so at most k rows for each query and shard are shuffled.

Defined cases: a null vector, or one with a null, NaN or infinite component, takes no part; so does an empty one.
Vectors meet only vectors of the same length. A query never meets its own id (repeated ids included). Ties go
to the smaller id, then nothing else; fewer than k candidates are all returned; an empty table gives an empty
result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD, BLOCK = 8192, 1024
#: Entries read from every list before the bound is tried again.
STEP = 64


def _best(ids: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best, ties to the smaller id."""
    if len(score) > 4 * k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= kth)
        return some[np.lexsort((ids[some], -score[some]))[:k]]
    return np.lexsort((ids, -score))[:k]


def threshold_search(query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, order: np.ndarray,
                     k: int, step: int = STEP) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and scores of the k best rows, and the entries read of each list. order[:, d]: rows by falling d."""
    n, seen = len(rows), np.zeros(len(rows), bool)
    best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
    used = np.flatnonzero(query)
    up = query[used] < 0
    depth = 0
    while depth < n:
        end = min(n, depth + step)
        at = np.where(up[None, :], order[n - 1 - np.arange(depth, end)][:, used], order[depth:end, used]) if len(used) else np.arange(n)[:, None]
        new = np.zeros(n, bool)
        new[at] = True
        met = np.flatnonzero(new & ~seen)
        seen |= new
        met = met[ids[met] != own]
        cand_id, cand = np.concatenate([best_id, ids[met]]), np.concatenate([best, rows[met] @ query])
        keep = _best(cand_id, cand, k)
        best_id, best = cand_id[keep], cand[keep]
        if not len(used):
            break
        last = at[-1]
        depth, step = end, 2 * step
        bound = int((rows[last, used] * query[used]).sum())
        if len(best) == k and best[-1] > bound:  # an unread row of equal score might have a smaller id
            break
    return best_id, best, depth


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null if the vector takes no part."""
    ok = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.when(ok & (F.size(vector) > 0), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _packed(df: DataFrame, group: Column, name: str) -> DataFrame:
    """One row for each length of vector and group: ids and vectors as bytes."""
    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["v"].to_numpy()).astype("<i8")
        return pd.DataFrame([(*key, pdf["vec_id"].to_numpy("<i8").tobytes(), m.tobytes())])

    return df.withColumn(name, group).groupBy("dim", name).applyInPandas(
        pack, f"dim int, {name} int, ids binary, vectors binary")


def top_k(df: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 10,
          scale: int = 1024, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row that is_query (a condition on vec_id)."""
    rows = (df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").alias("_v"))
            .withColumn("v", whole(F.col("_v"), scale)).where("v is not null and vec_id is not null")
            .select("vec_id", "v", F.size("v").alias("dim"), is_query.alias("_q")))
    n, nq = rows.agg(F.count("*"), F.count_if("_q")).first()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-nq // block))
    spread = lambda seed, count: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(count)).cast("int")
    all_shards = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    data = _packed(rows.where("vec_id is not null"), spread(1, shards), "shard").select("*", all_blocks)
    asked = _packed(rows.where("_q"), spread(2, blocks), "block").select("*", all_shards)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> Iterator[pd.DataFrame] | pd.DataFrame:
        out: list[tuple] = []
        if len(left) and len(right):
            dim = int(left["dim"][0])
            unpack = lambda f: (np.frombuffer(f["ids"][0], "<i8"), np.frombuffer(f["vectors"][0], "<i8").reshape(-1, dim))
            (ids, m), (qids, q) = unpack(left), unpack(right)
            order = np.argsort(-m, axis=0, kind="stable")
            for own, x in zip(qids.tolist(), q, strict=True):
                found, score, _ = threshold_search(x, own, ids, m, order, k)
                out += zip([own] * len(found), found.tolist(), score.tolist(), strict=True)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    part = data.groupBy("dim", "block", "shard").cogroup(asked.groupBy("dim", "block", "shard")).applyInPandas(
        search, "query_id long, vec_id long, score long")
    ranked = part.withColumn("rank", F.row_number().over(
        Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as q from embeddings
           where embedding is not null and len(embedding) > 0
             and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))),
s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2]))::bigint as score
      from v a join v b on a.vec_id % 100 = 0 and b.vec_id <> a.vec_id and len(a.q) = len(b.q)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10"""
