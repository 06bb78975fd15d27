"""URL filter: host rules, then a weighted vocabulary searched with an Aho-Corasick automaton.

One narrow pass over (id, url); nothing is shuffled and nothing but the fixed vocabulary travels.

Defined cases: a null url, or one without ``://``, has an empty host and path and no rule; the vocabulary
still reads whatever text there is. Repeated rows are judged each for itself; an empty table gives an empty
result; other columns are ignored.
"""
from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    text: str  # host and path, as in "example.com/en/"

    @property
    def host(self) -> str:
        return self.text.split("/", 1)[0]

    @property
    def path(self) -> str:
        return "/" + self.text.split("/", 1)[1]


RULES = (Rule("allow", "com/"), Rule("block", "example.com/en/"), Rule("allow", "www.example.com/en/"),
         Rule("block", "net/es/"), Rule("block", "net/fr/"))
#: One of these is enough.
STRICT = ("casino", "malware", "phishing", "porn", "spam", "viagra", "warez", "xxx")
#: So many different ones of these are needed.
SOFT = ("adult", "ads", "bet", "cheap", "click", "crack", "download", "farm", "free", "nude", "offer", "pills",
        "poker", "promo", "sale", "sex", "torrent", "track", "win")
SOFT_NEEDED = 2


@lru_cache(maxsize=8)
def automaton(strict: tuple[str, ...], soft: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, terms in ((0, strict), (1, soft)):
        for t in terms:
            found.add_word(t, (kind, t))
    found.make_automaton()
    return found


def term_hits(url: str, strict: tuple[str, ...], soft: tuple[str, ...]) -> tuple[int, int]:
    """Different strict and soft terms of a lowered url that stand between ASCII non-letters and non-digits."""
    inside = lambda i: 0 <= i < len(url) and url[i].isascii() and url[i].isalnum()
    seen = {(kind, t) for end, (kind, t) in automaton(strict, soft).iter(url)
            if not inside(end + 1) and not inside(end - len(t))}
    n = sum(kind for kind, _ in seen)
    return len(seen) - n, n


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.lit(""))
    at = F.instr(rest, "/")
    host = F.when(at > 0, F.substring(rest, F.lit(1), at - 1)).otherwise(rest)
    path = F.when(at > 0, F.substring(rest, at, F.length(rest))).otherwise("")
    return F.translate(host, UPPER, LOWER), path


def filter_urls(df: DataFrame, key: str = "page_id", url: str = "url", *, rules: Sequence[Rule] = RULES,
                strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT,
                soft_needed: int = SOFT_NEEDED) -> DataFrame:
    """Key, host, path, the rule that decided (null: none), verdict, and the vocabulary's counts."""
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("strict bigint, soft bigint")
    def hits(urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([term_hits(u or "", strict, soft) for u in urls], columns=["strict", "soft"])

    host, path = host_and_path(F.col("_url"))
    rows = (df.select(F.col(f"`{key}`").alias("page_id"), F.col(f"`{url}`").alias("_url"))
            .withColumns({"host": host, "path": path, "_hits": hits(F.translate("_url", UPPER, LOWER))}))
    chosen, verdict = None, None
    for r in sorted(rules, key=lambda r: -len(r.text)):
        fits = ((F.col("host") == r.host) | F.endswith("host", F.lit("." + r.host))) & F.startswith("path", F.lit(r.path))
        chosen = F.when(fits, r.text) if chosen is None else chosen.when(fits, r.text)
        verdict = F.when(fits, r.verdict) if verdict is None else verdict.when(fits, r.verdict)
    bad = (F.col("_hits.strict") >= 1) | (F.col("_hits.soft") >= soft_needed)
    own = F.when(bad, "block").otherwise("allow")
    return rows.select("page_id", "host", "path",
                       (F.lit(None).cast("string") if chosen is None else chosen).alias("rule"),
                       (own if verdict is None else F.coalesce(verdict, own)).alias("verdict"),
                       F.col("_hits.strict").alias("n_strict"), F.col("_hits.soft").alias("n_soft"))


def sql(rules: Sequence[Rule] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT,
        soft_needed: int = SOFT_NEEDED) -> str:
    """The same over the table ``pages``, in DuckDB's SQL."""
    count = lambda terms: " + ".join(
        f"regexp_matches(low, '(^|[^a-z0-9]){t}([^a-z0-9]|$)')::bigint" for t in terms)
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    longest = sorted(rules, key=lambda r: -len(r.text))
    case = lambda f: "case " + " ".join(f"when {fits(r)} then '{f(r)}'" for r in longest) + " end"
    return f"""
with raw as (select page_id, coalesce(translate(url, '{UPPER}', '{LOWER}'), '') as low,
                    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
cut as (select page_id, low, regexp_extract(rest, '^([^?#]*)', 1, 's') as rest from raw),
parts as (select page_id, low, translate(regexp_extract(rest, '^([^/]*)', 1, 's'), '{UPPER}', '{LOWER}') as host,
                 case when strpos(rest, '/') > 0 then substr(rest, strpos(rest, '/')) else '' end as path from cut),
hits as (select *, {count(strict)} as n_strict, {count(soft)} as n_soft, {case(lambda r: r.text)} as rule,
                {case(lambda r: r.verdict)} as ruled from parts)
select page_id, host, path, rule, n_strict, n_soft,
       coalesce(ruled, case when n_strict >= 1 or n_soft >= {soft_needed} then 'block' else 'allow' end) as verdict
from hits"""
