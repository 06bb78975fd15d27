"""Prefix trie of conversations by truncation peeling.

Every conversation is a sequence of turns; every distinct sequence of its first d turns is a node. The trie is found
from its deepest level upwards: the nodes of a level are the conversations that end there, merged with the nodes of the
level below after these have lost their last turn, grouped again by what is left. Members, children, leaves and saved
tokens are summed in the same grouping that finds a node, so each level is read once and only one row a node goes on.
Depth costs nothing by itself: a subtree of at most `GROUP` conversations is peeled by one task, which holds one level at
a time; only nodes with more members, whose depth is that of very common prefixes, take one small job for each level.

* A prefix is named by a chained SHA-256 of its turns (role and text, with their lengths). Texts are read once; what is
  moved afterwards is 80 bytes a turn.
* A node that survives is represented by its smallest member; stripping a turn is an equality join on that member with
  the next level's turns. Groups are summed before the shuffle, so a prefix that a third of all conversations share is
  no task of its own. Work is linear in the number of turns.
* The digest of the members that end in a node needs them in order in one stream: ids are range-partitioned by (node,
  id), written into pieces of text, and one pass over a node's pieces feeds the hash (constant memory, any group size).

Defined results: rows without conv_id are left out; null role or text is empty; equal turn numbers follow role, then
text; repeated rows are repeated turns; a conversation in `ids` without turns is a member of the root only; no
conversations give no node, not even the root.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import kept

#: Turns taken from the first conversation of a block of this many, fewer than TAKEN of them.
BLOCK, TAKEN = 20, 4
#: Conversations whose common subtree one task peels.
GROUP = 20_000
#: Bytes of one piece of a node's id list.
PIECE = 1 << 16
_SPACE = r"[^\x20\x09-\x0D]+"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, k (1, 2, ...), role, text: the turns of each conversation in order."""
    rows = conversations.where("conv_id is not null").select(
        "conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("k"), "role", "text")


def hashed(turns: DataFrame) -> DataFrame:
    """conv_id, k, turn (hash of role and text), words: what the trie needs of each turn."""
    return turns.select("conv_id", "k", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)).alias("turn"),
                        F.regexp_count("text", F.lit(_SPACE)).cast("long").alias("words"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hashed turns and ids after each conversation's first h turns are those of the first conversation of its block."""
    own = kept(hashed(ordered_turns(conversations)), "trie-turns")
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % TAKEN).alias("h")
    ids = own.select("conv_id").distinct().select("conv_id", (F.col("conv_id") - F.col("conv_id") % BLOCK).alias("base"), h)
    first = own.where(F.col("k") < TAKEN).withColumnRenamed("conv_id", "base")
    taken = ids.join(first, "base").where("k <= h").select("conv_id", F.lit(0).alias("part"), "k", "turn", "words")
    rest = own.where(F.col("k") > h).select("conv_id", F.lit(1).alias("part"), "k", "turn", "words")
    return taken.unionByName(rest), ids.select("conv_id")


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Prefix of every depth of every conversation; rows come by conversation, in order, from a row without a turn."""
    schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int32()), ("node", pa.binary()), ("parent", pa.binary()),
                        ("words", pa.int64()), ("ends", pa.bool_())])
    now, depth, node, waiting = None, 0, b"", None
    for batch in batches:
        out: list[tuple] = []
        for conv, turn, words in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "turn", "words")], strict=True):
            if waiting is not None:
                out.append((*waiting, conv != now))
            if conv != now:
                now, depth, parent, node = conv, 0, None, b""
            if turn is not None:
                depth, parent, node = depth + 1, node, hashlib.sha256(node + turn).digest()
            waiting = (conv, depth, node, parent, words)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)], schema=schema)
    if waiting is not None:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*waiting, True), schema, strict=True)], schema=schema)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Comma-joined runs of ids of one node, in order, of about PIECE bytes."""
    node, first, ids, size = None, 0, [], 0

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(ids)])],
                                          names=["node", "first", "ids"])

    for batch in batches:
        for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if ids and (n != node or size > PIECE):
                yield done()
                ids, size = [], 0
            if not ids:
                node, first = n, c
            ids.append(str(c))
            size += len(ids[-1]) + 1
    if ids:
        yield done()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's pieces, joined in order."""
    node, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()])], names=["node", "ends_sha256"])

    for batch in batches:
        for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if state is not None and n == node:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                yield done()
            node, state = n, hashlib.sha256(ids.encode())
    if state is not None:
        yield done()


def prefixes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """conv_id, depth, node, parent, words, ends: one row for each depth of each conversation, written once."""
    order = [c for c in ("part", "k") if c in turns.columns]
    tops = ids.where("conv_id is not null").distinct().select(
        "conv_id", *[F.lit(-1).alias(c) for c in order], F.lit(None).cast("binary").alias("turn"), F.lit(0).cast("long").alias("words"))
    rows = tops.unionByName(turns.select("conv_id", *order, "turn", "words"))
    chained = (rows.repartition("conv_id").sortWithinPartitions("conv_id", *order)
               .mapInArrow(_chain, "conv_id long, depth int, node binary, parent binary, words long, ends boolean"))

    return kept(chained, "trie-prefixes")


NODE = "node binary, parent binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"


def _peel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Peel whole subtrees: rows come by subtree, deepest level first. One level is held at a time."""
    names = [c.split()[0] for c in NODE.split(", ")]
    types = [pa.binary(), pa.binary(), *[pa.int64()] * 6, pa.bool_()]
    now, level, below = (None, None), {}, {}

    def strip() -> Iterator[tuple]:
        """The level is complete: merge it with what the level below left, strip the last turn."""
        nonlocal below
        above: dict[bytes, list[int]] = {}
        for node, (parent, words, conv, n) in level.items():
            first, more, children, leaves, saved = below.get(node, (conv, 0, 0, 0, 0))
            conv, n, leaves = min(conv, first) if n else first, n + more, leaves or 1
            saved += (n - 1) * words
            yield node, parent, now[1], conv, n, children, leaves, saved, node == now[0]
            up = above.setdefault(parent, [conv, 0, 0, 0, 0])
            up[0], up[1], up[2], up[3], up[4] = min(up[0], conv), up[1] + n, up[2] + 1, up[3] + leaves, up[4] + saved
        below = above

    for batch in batches:
        out: list[tuple] = []
        for row in zip(*[batch.column(c).to_pylist() for c in ("subtree", "depth", "node", "parent", "words", "conv_id", "ends")], strict=True):
            subtree, depth, node, parent, words, conv, ends = row
            if (subtree, depth) != now:
                out.extend(strip())
                if subtree != now[0]:
                    below = {}
                now, level = (subtree, depth), {}
            own = level.setdefault(node, [parent, words, conv, 0])
            if ends:
                own[2], own[3] = min(own[2], conv) if own[3] else conv, own[3] + 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)
    if out := list(strip()):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)


def peel(chains: DataFrame) -> DataFrame:
    """node, parent, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens.

    Subtrees of at most GROUP conversations are peeled whole, each in one task that holds one level of it. What is above
    them is the few nodes with more members: these are peeled level by level, each level one grouping.
    """
    large = kept(chains.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > GROUP).select("node"), "trie-large")
    upper = kept(chains.join(large, "node"), "trie-upper")
    cuts = upper.groupBy("conv_id").agg((F.max("depth") + 1).alias("cut"))
    lower = chains.join(cuts, "conv_id", "left").withColumn("cut", F.coalesce("cut", F.lit(0))).where("depth >= cut")
    heads = lower.where("depth = cut").select("conv_id", F.col("node").alias("subtree"))
    small = (lower.join(heads, "conv_id").repartition("subtree").sortWithinPartitions("subtree", F.col("depth").desc())
             .mapInArrow(_peel, NODE))
    levels = [kept(small, "trie-subtrees")]
    deepest = upper.agg(F.max("depth")).first()[0]
    heads, below = levels[0].where("top"), None
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        level = upper.where(F.col("depth") == depth)
        ended = level.where("ends").select("node", "parent", "words", "conv_id", one.alias("n"), zero.alias("child"), zero.alias("leaves"), zero.alias("saved"))
        # The surviving nodes of the level below, represented by their smallest members, lose their last turn.
        surviving = heads.where(F.col("depth") == depth + 1)
        surviving = (surviving.unionByName(below) if below is not None else surviving).select("conv_id", "n_convs", "n_leaves", "saved_tokens")
        stripped = level.where("not ends").join(surviving, "conv_id").select(
            "node", "parent", "words", "conv_id", F.col("n_convs").alias("n"), one.alias("child"),
            F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
        nodes = ended.unionByName(stripped).groupBy("node").agg(
            F.max("parent").alias("parent"), F.lit(depth).cast("long").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"),
            F.sum("child").alias("n_children"), F.greatest(F.sum("leaves"), F.lit(1)).alias("n_leaves"),
            (F.sum("saved") + (F.sum("n") - 1) * F.max("words")).alias("saved_tokens"), F.lit(False).alias("top"))
        below = kept(nodes, "trie-level")
        levels.append(below)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def endings(chains: DataFrame) -> DataFrame:
    """node, ends_sha256 of the nodes in which conversations end."""
    ends = chains.where("ends").select("node", "conv_id")
    pieces = (ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
              .mapInArrow(_pieces, "node binary, first long, ids string"))
    return (pieces.repartition("node").sortWithinPartitions("node", "first")
            .mapInArrow(_digests, "node binary, ends_sha256 string"))


def prefix_trie(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    `turns` has conv_id, k and optionally part (their order), turn (a hash) and words; `ids` all conversations.
    """
    chains = prefixes(turns, ids)
    nodes = peel(chains)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    above = nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    none = hashlib.sha256(b"").hexdigest()
    return (nodes.join(above, "parent", "left").join(endings(chains), "node", "left")
            .withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(none))).select(*out))


def trie_of(conversations: DataFrame) -> DataFrame:
    """The trie of plain conversations (conv_id, turn, role, text)."""
    turns = hashed(ordered_turns(conversations))
    return prefix_trie(turns, conversations.select("conv_id"))


#: crc32 of a string of ASCII characters: a table made by its rule, then one step for each character.
CRC_TABLE = """list_transform(range(256), lambda i: list_reduce(list_concat([i::UBIGINT], list_transform(range(8), lambda z: 0::UBIGINT)),
    lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END))"""


def crc_sql(codes: str, table: str) -> str:
    """SQL of the crc32 of a list of byte values, given the table."""
    return (f"xor(list_reduce(list_concat([4294967295::UBIGINT], {codes}), "
            f"lambda a, b: xor(a >> 8, {table}[(xor(a, b) % 256)::INT + 1])), 4294967295::UBIGINT)")


SQL = f"""
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
    PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
tab AS (SELECT {CRC_TABLE} AS t),
ids AS (
  SELECT c, c - c % {BLOCK} AS b, {crc_sql("list_transform(string_split(c::VARCHAR, ''), lambda x: ord(x)::UBIGINT)", "t")} % {TAKEN} AS h
  FROM (SELECT DISTINCT conv_id AS c FROM o), tab),
r AS (
  SELECT c, 0 AS part, k, role, text FROM ids JOIN o ON o.conv_id = b AND k <= h
  UNION ALL SELECT c, 1, k, role, text FROM ids JOIN o ON o.conv_id = c AND k > h),
s AS (SELECT c, list({{'role': role, 'text': text}} ORDER BY part, k) FILTER (k IS NOT NULL) AS s FROM ids LEFT JOIN r USING (c) GROUP BY c),
p AS (SELECT c, len(coalesce(s, [])) AS n, unnest(range(0, len(coalesce(s, [])) + 1)) AS d, coalesce(s, []) AS s FROM s),
nodes AS (
  SELECT list_slice(s, 1, d) AS p, d, min(c) AS conv_id, count(*) AS n_convs,
         coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '') AS ends
  FROM p GROUP BY 1, 2),
worth AS (
  SELECT *, CASE WHEN d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(p[d].text, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM nodes),
kids AS (SELECT list_slice(p, 1, d - 1) AS p, d - 1 AS d, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1, 2),
up AS (
  SELECT list_slice(w.p, 1, k) AS p, k AS d, sum(saved) AS saved_tokens, count(*) FILTER (kids.n IS NULL) AS n_leaves
  FROM (SELECT p, d, saved, unnest(range(0, d + 1)) AS k FROM worth) w LEFT JOIN kids ON kids.d = w.d AND kids.p = w.p GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs, coalesce(kids.n, 0)::BIGINT AS n_children,
       up.n_leaves::BIGINT AS n_leaves, up.saved_tokens::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN nodes q ON q.d = n.d - 1 AND q.p = list_slice(n.p, 1, n.d - 1)
LEFT JOIN kids ON kids.d = n.d AND kids.p = n.p JOIN up ON up.d = n.d AND up.p = n.p
"""
