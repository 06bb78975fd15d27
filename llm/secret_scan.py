"""Secret scan: fixed patterns, and strings that a public vocabulary cannot shorten.

Prose and identifiers reach several characters a token; random strings do not. A run of key characters that mixes
letters and digits is a secret when it has fewer characters a token than `RATIO`, unless it is a digest (hex of a
known digest's length), a UUID or an identifier made of words and numbers. So that readable text around a random string
does not hide it, a run is cut where fixed patterns match, and what is no secret as a whole is judged by its parts
between separators and by its stretches of consecutive tokens, `SHORTEST` characters or more. Each text is one row of one narrow pass;
nothing is shuffled.

Defined cases: a null text is empty and has no span (the digest is that of the empty string); equal starts are
ordered by kind; repeated rows are scanned each for itself; an empty table gives an empty result; other columns
are ignored.
"""
from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import pieces

KINDS = ("assign", "access", "hex", "token")
# Fixed patterns of the base scan.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}

RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
RATIO = 2.0
SHORTEST = 20
PART = re.compile(r"[A-Za-z0-9+]+")
#: Hex lengths of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words joined by separators or capitals, each with at most a few digits after it.
#: Each alternative takes all it can: split in several ways, a long word would take exponential time.
IDENTIFIER = re.compile(r"(?:[_+/=-]*(?:[A-Z]?[a-z]{3,}(?![a-z])|[A-Z]{3,}(?![A-Z])|[0-9]{1,4}(?![0-9])))+[_+/=-]*")
BULK_HEX = re.compile(r"[0-9a-fA-F]+")


@lru_cache(maxsize=2)
def vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def is_random(run: str, vocab, ratio: float = RATIO) -> bool:
    core = run.strip("=-_/+")
    if not (any(c.isdigit() for c in core) and any(c.isalpha() for c in core)):
        return False
    if UUID.fullmatch(core) or BULK_HEX.fullmatch(core) and len(core) in DIGESTS or IDENTIFIER.fullmatch(core):
        return False
    return len(core) < ratio * len(vocab.encode_ordinary(core))


def stretch(sizes: list[int], ratio: float) -> tuple[int, int] | None:
    """First and last token (excluded) of the stretch of SHORTEST characters or more with most tokens beyond
    characters / ratio; None if none has any."""
    at, value = [0], [0.0]
    for n in sizes:
        at.append(at[-1] + n)
        value.append(value[-1] + ratio - n)
    best, most, low, j = None, 0.0, 0, 0
    for e in range(1, len(at)):
        while at[j] <= at[e] - SHORTEST:
            if value[j] < value[low]:
                low = j
            j += 1
        if j and value[e] - value[low] > most:
            best, most = (low, e), value[e] - value[low]
    return best


def random_parts(run: str, vocab, ratio: float = RATIO) -> list[tuple[int, int]]:
    """Where the run is random: as a whole, else in parts between separators, else in stretches of tokens."""
    if len(run) < SHORTEST:
        return []
    if is_random(run, vocab, ratio):
        return [(0, len(run))]
    if UUID.fullmatch(run.strip("=-_/+")):
        return []
    cuts, found = [], []  # cuts: parts that are judged already
    for m in [*UUID.finditer(run), *PART.finditer(run)]:
        if m.end() - m.start() >= SHORTEST and not any(a <= m.start() and m.end() <= b for a, b in cuts):
            known = UUID.fullmatch(m[0]) or BULK_HEX.fullmatch(m[0]) and len(m[0]) in DIGESTS
            if not known and is_random(m[0], vocab, ratio):
                found.append(m.span())
            if known or found and found[-1] == m.span():
                cuts.append(m.span())
    todo, at = [], 0
    for a, b in [*sorted(cuts), (len(run), len(run))]:
        todo.append((at, a))
        at = max(at, b)
    while todo:
        a, b = todo.pop()
        if b - a < SHORTEST:
            continue
        sizes = [len(x) for x in vocab.decode_tokens_bytes(vocab.encode_ordinary(run[a:b]))]
        best = stretch(sizes, ratio)
        if best is None:
            continue
        x, y = a + sum(sizes[:best[0]]), a + sum(sizes[:best[1]])
        if is_random(run[x:y], vocab, ratio):
            found.append((x, y))
        todo += [(a, x), (y, b)]
    return sorted(found)


def outside(a: int, b: int, base: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """What the sorted spans leave of a to b."""
    for x, y in base:
        if x < b and a < y:
            if a < x:
                yield a, x
            a = y
    if a < b:
        yield a, b


def spans(text: str, vocab, ratio: float = RATIO) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets, by start, then kind as in KINDS. The base scan's spans are all there."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    runs = [(m.start(), m.end()) for m in RUN.finditer(text)]
    for a, b in runs:  # longer ones of these two kinds lie in such runs
        for kind, pattern in (("access", ACCESS), ("hex", HEX)):
            found += [(m.start(), m.end(), kind) for m in pattern.finditer(text, a, b) if m.end() - m.start() >= LEAST[kind]]
    base = sorted((a, b) for a, b, _ in found)
    for a, b in runs:
        for x, y in outside(a, b, base):
            found += [(x + i, x + j, "token") for i, j in random_parts(text[x:y], vocab, ratio)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def said(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def scan(df: DataFrame, *, key: str = "doc_id", text: str = "text", vocab: str = "byte_bpe_50k.tiktoken",
         ratio: float = RATIO) -> DataFrame:
    """Counts of each kind, the digest of the base spans and all spans, for each row."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(pieces.vocabulary(vocab))
        for b in batches:
            rows = []
            for t in b.column(1):
                found = spans(t.as_py() or "", v, ratio)
                kinds = [k for _, _, k in found]
                base = said([s for s in found if s[2] != "token"])
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(base.encode()).hexdigest(), said(found)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])],
                ["doc_id", "n_assign", "n_access", "n_hex", "n_token", "base_sha256", "spans"])

    return df.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(
        task, "doc_id long, n_assign long, n_access long, n_hex long, n_token long, base_sha256 string, spans string")


def redact(df: DataFrame, *, text: str = "text", mark: str = "[secret]", vocab: str = "byte_bpe_50k.tiktoken",
           ratio: float = RATIO) -> DataFrame:
    """The same rows and columns, with every secret in the text replaced by the mark (a null text stays null)."""
    @F.pandas_udf("string")
    def cleaned(texts):
        v = vocabulary(pieces.vocabulary(vocab))
        return texts.map(lambda t: t if t is None else hide(t, spans(t, v, ratio), mark))

    return df.withColumn(text, cleaned(F.col(f"`{text}`")))


def hide(text: str, found: list[tuple[int, int, str]], mark: str) -> str:
    out, at = [], 0
    for a, b, _ in found:
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])
