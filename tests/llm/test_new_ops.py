"""Conversation trie, class language model and spelling variants against brute force."""
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from llm import class_lm, prefix_trie, spelling

LETTERS = r"[^\x20\x09-\x0D]+"
ODD = "doc_id long, text string, word string, n long, key long, held_out boolean"


# -- conversation trie -------------------------------------------------------------------------
def brute_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    turns = {c: [(r, t) for _, r, t in sorted(v)] for c, v in own.items()}
    full = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = turns.get(c - int(math.fmod(c, 20)), [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in full.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    kids = Counter(p[:-1] for p in nodes if p)
    leaves, saved = Counter(), Counter()
    for p, members in nodes.items():
        words = len(re.findall(LETTERS, p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(members) - 1) * words
            leaves[p[:d]] += not kids[p]
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(
        ",".join(str(c) for c in sorted(m) if len(full[c]) == len(p)).encode()).hexdigest()) for p, m in nodes.items())


def trie_rows(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumnRenamed("missing", "x")
    out = prefix_trie.prefix_trie(*prefix_trie.rebuilt(df))
    return sorted((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out.collect())


@pytest.mark.parametrize("group", [20_000, 5, 0])
def test_trie_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(prefix_trie, "GROUP", group)
    rng = random.Random(4)
    rows = []
    for c in [*range(45), 400, -7, 10**12]:
        for t in range(rng.choice([0, 1, 2, 3, 5])):
            rows.append((c, rng.choice([t, t, 1, None]), rng.choice(["user", "assistant", None]), rng.choice(["a b", " a\tb\x0bc ", "", None, "ü x", "hello"])))
    rows += [(90 + c, t, "user", f"deep {t}") for c in range(6) for t in range(40)]      # copies of a deep conversation
    rows += [(110 + c, t, "user", f"deep {t}") for c in range(9) for t in range(4 * c)]  # its prefixes
    rows += [(None, 0, "user", "nobody"), *rows[:9], (60, 0, "user", "word " * 50_000)]
    assert trie_rows(spark, rows) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie_rows(spark, [(None, 1, "user", "x")]) == []
    turns = prefix_trie.hashed(prefix_trie.ordered_turns(spark.createDataFrame([(1, 0, "u", "x")], "conv_id long, turn long, role string, text string")))
    out = prefix_trie.prefix_trie(turns, spark.createDataFrame([(1,), (2,), (2,), (None,)], "conv_id long")).collect()
    assert sorted((r.conv_id, r.depth, r.n_convs, r.n_leaves) for r in out) == [(1, 0, 2, 1), (1, 1, 1, 1)]


# -- spelling variants -------------------------------------------------------------------------
def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(words):
    out = {}
    for w, n in words.items():
        links = [v for v in words if v != w and near(w, v)]
        form = min(links, key=lambda v: (-words[v], v), default=None)
        out[w] = (form if form and words[form] >= 10 * n else None, n, len(links))
    rows = []
    for w, (form, n, k) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.append((w, form, root, n, k, words[form] if form else None))
    return sorted(rows)


def brute_words(rows):
    total = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            total[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    return {w: n for w, n in total.items() if n >= 2 and len(w) >= 7}


def variant_rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(df).collect())


@pytest.mark.parametrize("leaf,cell,small", [(20_000, 80_000, 12), (40, 30, 2), (25, 80_000, 1)])
def test_variants_equal_brute_force(spark, monkeypatch, leaf, cell, small):
    for name, value in (("LEAF", leaf), ("CELL", cell), ("SMALL", small), ("AT_ONCE", 64)):
        monkeypatch.setattr(spelling, name, value)
    rng = random.Random(7)
    words = {}
    for _ in range(60):
        base = "".join(rng.choice("abcdé") for _ in range(rng.randint(7, 10)))
        words[base] = rng.choice([3000, 40, 7])
        for _ in range(5):
            i, c = rng.randrange(len(base)), rng.choice("abcdßé")
            base = rng.choice([base[:i] + c + base[i + 1:], base[:i] + base[i + 1:], base[:i] + c + base[i:]])
            words[base] = rng.choice([300, 30, 2])
    for _ in range(150):  # anagrams: the same letter counts in many orders
        words["".join(rng.sample("abcdabcd", 8))] = rng.choice([2, 20])
    words["x" * 5000], words["x" * 4999 + "y"] = 50, 2
    df = spark.createDataFrame([(w.encode("latin-1"), n) for w, n in words.items()], "word binary, n long")
    assert variant_rows(df) == brute_variants(words)


def test_words_of_documents(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE", 200)
    rng = random.Random(3)
    some = ["Straße", "GROSSARTIG", "naïveté", "übermäßig", "international", "Internationale", "ÀÉÎÕÜaaa", "x÷y×zzzzz", "abc", "日本語テキスト", "wörter" * 30]
    rows = [(i, rng.choice([" ", "-", "1"]).join(rng.choices(some, k=rng.randint(0, 40)))) for i in range(60)]
    rows += [(None, "international naïveté"), (5, None), (6, ""), *rows[:20], (7, "lang" * 30_000), (8, "lang" * 30_000)]
    df = spark.createDataFrame([(d, t, "w", 1, 2, True) for d, t in rows], ODD)
    got = {bytes(r.word).decode("latin-1"): r.n for r in spelling.words_of(df).collect()}
    assert got == brute_words(rows)
    assert spelling.variants(spelling.words_of(df.where("doc_id < 0"))).collect() == []


# -- class language model ----------------------------------------------------------------------
def lm_rows():
    rng = random.Random(5)
    zipf = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(rng.choices(zipf, k=rng.randint(0, 60)))) for i in range(150)]
    rows += [(None, "w1 w2 new\tw1\x0bW2"), (3, None), (4, ""), (9, "W1  w9"), (9, "W1  w9"), (1000, "lone " * 3000 + "é x Ärger"), (1001, "y" * 70_000)]
    return rows


def lower(t):
    return "".join(c.lower() if c < "\x80" else c for c in t or "")


@pytest.fixture(params=[32_768, 8])
def small_lm(spark, monkeypatch, request):
    for name, value in (("CORE", request.param), ("SLICE", 3000), ("SWEEPS", 3)):
        monkeypatch.setattr(class_lm, name, value)
    rows = lm_rows()
    return rows, spark.createDataFrame([(d, t, "w", 1, 2, None) for d, t in rows], ODD).repartition(3)


def test_scores_equal_brute_force(small_lm):
    rows, df = small_lm
    model, _, _ = class_lm.fit(df)
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.held_out, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in class_lm.score(df).collect())
    end = len(model.core)
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    count = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in [*re.findall(LETTERS, lower(t)), None])
    total, distinct = sum(count.values()), len(count)
    core = {w.decode(): i for i, w in enumerate(model.core)}
    other = {bytes(r.word).decode(): (r.n, r["class"]) for r in model.vocabulary.collect()}
    assert {w: n for w, n in count.items() if w is not None and w not in core} == {w: n for w, (n, _) in other.items()}
    assert (model.tokens, model.distinct) == (total, distinct)
    want = []
    for (d, t), h in zip(rows, held, strict=True):
        g, score, base, known, words = class_lm.END, 0.0, 0.0, 0, re.findall(LETTERS, lower(t))
        for w in [*words, None]:
            n = count.get(w, 0)
            c = class_lm.END if w is None else model.classes[core[w]] if w in core else other[w][1] if w in other else class_lm.UNKNOWN
            emit = n / model.class_counts[c] if n else 1 / (distinct + 1)
            score += model.transitions[g, c] + math.log10(emit)
            base += math.log10((n + 1) / (total + distinct + 1))
            known += n > 0
            g = c if w in core else g
        want.append((d is not None, d or 0, len(words) + 1, h, known, total, round(base, 6), round(score, 6)))
    assert got == sorted(want)
    # All words, and the unknown kind as often as it counts, make up the whole probability after every history.
    mass = defaultdict(float)
    for w, n in count.items():
        c = class_lm.END if w is None else model.classes[core[w]] if w in core else other[w][1]
        mass[c] += n / model.class_counts[c]
    p = 10 ** model.transitions
    full = [c for c in range(class_lm.CLASSES + 1) if c in mass]
    assert all(abs(mass[c] - 1) < 1e-9 for c in full) and np.allclose(p.sum(1), 1)
    assert max(model.likelihoods) >= model.likelihoods[0] and model.counts[end] == held.count(False)


def test_exchange_gain_is_the_change_of_likelihood():
    rng = np.random.default_rng(2)
    n, k = 30, class_lm.CLASSES + 1
    pairs = rng.integers(0, 6, (n, n))
    classes = rng.integers(0, 4, n)

    def table(c):
        m = np.zeros((k, k))
        np.add.at(m, (c[:, None].repeat(n, 1), c[None].repeat(n, 0)), pairs)
        return m

    # Each word as often before as after another, as in texts that begin and end with the same token.
    pairs = pairs + pairs.T
    m = table(classes)
    left = np.stack([np.bincount(classes, pairs[:, w], k) for w in range(n)])
    right = np.stack([np.bincount(classes, pairs[w], k) for w in range(n)])
    best, gain = class_lm.best_class(m, classes, left, right, np.diag(pairs))
    for w in range(n):
        changes = []
        for c in range(class_lm.CLASSES):
            other = classes.copy()
            other[w] = c
            changes.append(class_lm.likelihood(table(other)) - class_lm.likelihood(m))
        assert gain[w] == pytest.approx(max(changes), abs=1e-6) and changes[best[w]] == pytest.approx(max(changes), abs=1e-6)


def test_empty_and_untrained_tables(spark):
    empty = spark.createDataFrame([], ODD)
    assert class_lm.score(empty).collect() == []
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r, = class_lm.score(spark.createDataFrame([(held, "a b", "w", 1, 2, None)], ODD)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (3, 0, 0, True) and math.isfinite(r.score) and r.base_score == 0


def test_core_words_are_counted_in_all_slices():
    # More words than the core, all of them twice; the common word comes once in each slice.
    n, found = class_lm.CORE + 10, Counter()
    for c in "abc":
        text = " ".join(f"{c}{i} {c}{i}" for i in range(n)) + " everywhere"
        for batch in class_lm._counted(iter([pa.RecordBatch.from_arrays([pa.array([text])], names=["text"])])):
            found.update(dict(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)))
    assert found[b"everywhere"] == 3 and len(found) == 3 * n + 1
