"""Brown class-based n-gram language model of a corpus, with classes found by exchange clustering.

P(word | history) = P(class | class of the history) * P(word | class). Words go into classes so that the class bigrams'
likelihood is largest; the history is the class of the nearest earlier word of the clustered vocabulary in the document
(or its begin). A document ends with an end token, which is a class of its own.

1. The `CORE` most frequent words (a bound of the model's broadcast parts; step 3 takes all others) are found from the
   counts of all words of all slices of text. Texts are read a second time into two tables: core word numbers of each document in order, and its
   other words with the core word before them. Nothing else reads texts.
2. Exchange clustering of the core: each word's neighbours with counts are one row (at most CORE entries). In a sweep
   every word finds the class that raises the likelihood of class bigrams most, given the class matrix of the sweep
   before; half of the words (by a hash) may move at once. The best assignment met is kept.
3. All other words, a table that grows with the corpus, take the same step by what precedes them: the class under which
   their histories are likeliest. One shuffle by word counts them, assigns them and adds up the class transitions.
4. Scores: core words from the first table in one pass; other words through a join with the vocabulary.

Smoothing: transitions are mixed with class frequencies (`MASS` pseudo-counts); a history's share of words seen once
in training goes to unknown words, evenly over as many of them as there are known ones. Probabilities of all words and
one unknown kind times their number sum to 1 for every history.

Defined results: null texts are empty and consist of the end token; a null doc_id is no held-out one; repeated rows are
counted and scored one by one; without training rows every known count is 0 and scores stay finite.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stillvalid.session import scratch_path, write_parquet

from .pieces import flat_bytes
from .store import kept
from .words import by_size, mix

#: Words with a number (under 65,535), classes, sweeps, pseudo-counts of a history, bytes of text worked on at a time.
CORE, CLASSES, SWEEPS, MASS, SLICE = 32_768, 64, 8, 5.0, 1 << 22
#: Classes beside those of words: the end token (and a document's begin), and unknown words.
END, UNKNOWN = CLASSES, CLASSES + 1
_OTHER = 65_535

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


# -- tokens ------------------------------------------------------------------------------------
def _tokens(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Slices of the texts: the text of each token, its number in the slice's vocabulary, and that vocabulary; long
    texts are cut between tokens."""
    raw, off = flat_bytes(texts)
    raw = np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)
    black = ~_SPACE[raw]
    i = 0
    while i < len(raw):
        j = min(len(raw), i + SLICE)
        while j < len(raw) and black[j]:
            j += 1
        part, word = raw[i:j], black[i:j]
        inner = off[(off > i) & (off < j)] - i
        first = word.copy()
        first[1:] &= ~word[:-1]
        first[inner] |= word[inner]
        starts = np.flatnonzero(first)
        if len(starts):
            flat = np.ascontiguousarray(part[word])
            bounds = np.append(np.cumsum(word)[starts] - 1, len(flat)).astype(np.int64)
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(flat)]).dictionary_encode()
            yield np.searchsorted(off, starts + i, side="right") - 1, words.indices.to_numpy(), words.dictionary
        i = j


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, code, vocabulary in _tokens(batch.column("text")):
            n = np.bincount(code, minlength=len(vocabulary))
            yield pa.RecordBatch.from_arrays([vocabulary.cast(pa.binary()), pa.array(n)], names=["word", "n"])


def core_words(docs: DataFrame) -> list[bytes]:
    """The most frequent words of the training texts, most frequent first; at most CORE."""
    counted = docs.where(~held_out()).select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [bytes(r["word"]) for r in counted.orderBy(F.col("n").desc(), "word").limit(CORE).collect()]


SEQUENCE, OTHER = 0, 1


def _numbered(core: list[bytes]):
    """Two kinds of rows: a document's tokens as core numbers, and its other words with the core word before them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, end = {w: i for i, w in enumerate(core)}, len(core)
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            schema = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("held", pa.bool_()), ("doc_id", id_type), ("tokens", pa.binary()),
                                ("word", pa.binary()), ("before", pa.int32()), ("n", pa.int64())])
            for part in by_size(batch, batch.schema.get_field_index("text"), SLICE):
                key, held = part.column("key").to_numpy(), part.column("held").to_numpy(zero_copy_only=False)
                docs, ids, last_doc, last = [np.zeros(0, np.int64)], [np.zeros(0, np.uint16)], -1, end
                for doc, code, vocabulary in _tokens(part.column("text")):
                    look = np.array([number.get(w, -1) for w in vocabulary.to_pylist()], np.int64)
                    own = look[code]
                    # The nearest core word before each token in its text; at the begin the end token.
                    at = np.maximum.accumulate(np.where(own >= 0, np.arange(len(own)), -1))
                    at = np.append(-1, at[:-1])
                    begin = np.searchsorted(doc, doc, side="left")
                    before = np.where(at >= begin, own[at], np.where(doc == last_doc, last, end))
                    tail = own[np.searchsorted(doc, doc[-1]):]
                    tail = tail[tail >= 0]
                    last = int(tail[-1]) if len(tail) else int(before[-1])
                    last_doc = int(doc[-1])
                    docs.append(doc)
                    ids.append(np.where(own >= 0, own, _OTHER).astype(np.uint16))
                    rare = np.flatnonzero(own < 0)
                    pairs, n = np.unique((doc[rare] * len(vocabulary) + code[rare]) * (end + 1) + before[rare], return_counts=True)
                    pairs, hist = np.divmod(pairs, end + 1)
                    which, word = np.divmod(pairs, len(vocabulary))
                    if len(n):
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(len(n), OTHER, np.int32)), pa.array(key[which]), pa.array(held[which]), pa.nulls(len(n), id_type),
                            pa.nulls(len(n), pa.binary()), vocabulary.take(pa.array(word)).cast(pa.binary()), pa.array(hist.astype(np.int32)), pa.array(n)], schema=schema)
                bounds = np.searchsorted(np.concatenate(docs), np.arange(part.num_rows + 1)) * 2
                tokens = pa.Array.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.concatenate(ids))])
                m = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, SEQUENCE, np.int32)), part.column("key"), part.column("held"), part.column("doc_id"),
                                                  tokens.cast(pa.binary()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.int64())], schema=schema)

    return run


def tokenised(docs: DataFrame, core: list[bytes]) -> tuple[DataFrame, DataFrame]:
    """Sequences (key, held, doc_id, tokens) and other words (key, held, word, before, n), written in one job."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), held_out().alias("held"), F.monotonically_increasing_id().alias("key"))
    path, schema = scratch_path(spark, "class-lm"), f"key long, held boolean, doc_id {kind}, tokens binary, word binary, before int, n long"
    out = rows.mapInArrow(_numbered(core), f"kind int, {schema}")
    write_parquet(out, path, partition_by=("kind",))
    both = spark.read.schema(f"{schema}, kind int").parquet(path)
    return (both.where(F.col("kind") == SEQUENCE).select("key", "held", "doc_id", "tokens"),
            both.where(F.col("kind") == OTHER).select("key", "held", "word", "before", "n"))


# -- exchange clustering -----------------------------------------------------------------------
def _joined(tokens: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Core words of the texts with an end token after each text, and the place of each text's end."""
    raw, off = flat_bytes_binary(tokens)
    ids = raw.view(np.uint16).astype(np.int64)
    ends = off[1:] // 2 + np.arange(len(off) - 1)
    out = np.empty(len(ids) + len(ends), np.int64)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner], out[ends] = ids, end
    return out, ends


def flat_bytes_binary(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    values = values.cast(pa.large_binary())
    if not len(values):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    raw = np.frombuffer(values.buffers()[2], np.uint8) if values.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw[off[0]:off[-1]].copy(), off - off[0]


def _bigrams(end: int):
    """Counts of neighbours among core words; the other words are passed over."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, _ = _joined(batch.column("tokens"), end)
            ids = ids[ids != _OTHER]
            pairs, n = np.unique(np.append(end, ids[:-1]) * (end + 1) + ids, return_counts=True) if len(ids) else (np.zeros(0, np.int64),) * 2
            a, b = np.divmod(pairs, end + 1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n)], names=["a", "b", "n"])

    return run


def neighbours(sequences: DataFrame, end: int) -> DataFrame:
    """word, left, left_n, right, right_n: what stands before and after each core word, at most CORE entries each."""
    pairs = kept(sequences.where(~F.col("held")).select("tokens").mapInArrow(_bigrams(end), "a long, b long, n long")
                 .groupBy("a", "b").agg(F.sum("n").alias("n")), "class-lm-pairs")

    def side(word: str, other: str, name: str) -> DataFrame:
        return pairs.groupBy(F.col(word).alias("word")).agg(F.collect_list(F.struct(F.col(other).alias("w"), "n")).alias("s")).select(
            "word", F.col("s.w").alias(name), F.col("s.n").alias(f"{name}_n"))

    return kept(side("b", "a", "left").join(side("a", "b", "right"), "word", "full"), "class-lm-neighbours")


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def likelihood(m: np.ndarray) -> float:
    """Log-likelihood of class bigrams, up to what does not depend on the classes."""
    return float(_x_log_x(m).sum() - _x_log_x(m.sum(1)).sum() - _x_log_x(m.sum(0)).sum())


def _vectors(batch: pa.RecordBatch, classes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Word, class counts to the left and right, pairs with itself: of each word of a batch."""
    word, out = batch.column("word").to_numpy(), []
    for side in ("left", "right"):
        lists, counts = batch.column(side), batch.column(f"{side}_n")
        n = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
        row = np.repeat(np.arange(len(word)), n)
        others, times = lists.flatten().to_numpy(), counts.flatten().to_numpy()
        out.append(np.bincount(row * (CLASSES + 1) + classes[others], times, len(word) * (CLASSES + 1)).reshape(len(word), -1))
    own = np.bincount(row[others == word[row]], times[others == word[row]], len(word))
    return word, out[0], out[1], own


def class_matrix(words: DataFrame, classes: np.ndarray) -> np.ndarray:
    """Counts of class bigrams, histories in rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((CLASSES + 1, CLASSES + 1))
        for batch in batches:
            word, _, right, _ = _vectors(batch, classes)
            np.add.at(m, classes[word], right)
        a, b = np.nonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(m[a, b])], names=["a", "b", "n"])

    out = np.zeros((CLASSES + 1, CLASSES + 1))
    for r in words.mapInArrow(run, "a long, b long, n double").groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        out[r["a"], r["b"]] = r["n"]
    return out


def best_class(m: np.ndarray, word_class: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The class in which each word raises the likelihood most, others staying where they are, and by how much."""
    k, rows = len(m), np.arange(len(word_class))
    left, right = left.astype(float), right.astype(float)
    n = right.sum(1)
    left[rows, word_class] -= own
    right[rows, word_class] -= own
    # The matrix without the word.
    rest = np.repeat(m[None], len(rows), 0)
    rest[rows, word_class, :] -= right
    rest[rows, :, word_class] -= left
    rest[rows, word_class, word_class] -= own
    rest = np.maximum(rest, 0)
    diagonal = rest[:, np.arange(k), np.arange(k)]
    gain = (_x_log_x(rest + right[:, None, :]) - _x_log_x(rest)).sum(2) + (_x_log_x(rest + left[:, :, None]) - _x_log_x(rest)).sum(1)
    gain -= _x_log_x(diagonal + right) + _x_log_x(diagonal + left) - 2 * _x_log_x(diagonal)
    gain += _x_log_x(diagonal + right + left + own[:, None]) - _x_log_x(diagonal)
    for axis in (0, 1):
        totals = np.repeat(m.sum(axis)[None], len(rows), 0)
        totals[rows, word_class] -= n
        gain -= _x_log_x(totals + n[:, None]) - _x_log_x(totals)
    gain[:, END] = -np.inf
    best = gain.argmax(1)
    return best, gain[rows, best] - gain[rows, word_class]


def exchange(words: DataFrame, end: int, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Class of each core word (and of the end token), the class matrix, and the likelihoods of the sweeps."""
    classes = np.append(np.arange(end) % CLASSES, END)
    kept_classes, kept_matrix, seen = classes, class_matrix(words, classes), []
    m = kept_matrix
    seen.append(likelihood(m))
    for sweep in range(sweeps):
        def run(batches: Iterator[pa.RecordBatch], classes=classes, m=m, sweep=sweep) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                turn = mix(batch.column("word").to_numpy().astype(np.uint64) + np.uint64(1)) % np.uint64(2) == np.uint64(sweep % 2)
                batch = batch.filter(pa.array(turn & (batch.column("word").to_numpy() != end)))
                for i in range(0, batch.num_rows, 128):
                    word, left, right, own = _vectors(batch.slice(i, 128), classes)
                    best, gain = best_class(m, classes[word], left, right, own)
                    moves = gain > 1e-9
                    yield pa.RecordBatch.from_arrays([pa.array(word[moves]), pa.array(best[moves])], names=["word", "class"])

        moved = words.mapInArrow(run, "word long, class long").toArrow()
        if not moved.num_rows and sweep % 2:
            break
        classes = classes.copy()
        classes[moved.column("word").to_numpy()] = moved.column("class").to_numpy()
        m = class_matrix(words, classes)
        seen.append(likelihood(m))
        if seen[-1] > likelihood(kept_matrix):
            kept_classes, kept_matrix = classes, m
    return kept_classes, kept_matrix, seen


# -- all other words ---------------------------------------------------------------------------
def _assign(history: np.ndarray, evidence: np.ndarray):
    """Words come with all their rows together. Rows out: words with count and class (before -1), and, without a word,
    counts of (history, class) and of (history, unknown) for words seen once."""
    schema = pa.schema([("word", pa.binary()), ("before", pa.int64()), ("class", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, left = np.zeros((CLASSES + 1, UNKNOWN + 1), np.int64), None

        def done(table: pa.Table) -> pa.RecordBatch:
            words, n, g = table.column("word").combine_chunks(), table.column("n").to_numpy(), history[table.column("before").to_numpy()]
            code = words.dictionary_encode()
            number = code.indices.to_numpy()
            order = np.argsort(number, kind="stable")
            begin = np.searchsorted(number[order], np.arange(len(code.dictionary)))
            score = np.add.reduceat(evidence[g[order]] * n[order, None], begin)
            best, total = score.argmax(1), np.bincount(number, n, len(code.dictionary)).astype(np.int64)
            np.add.at(seen, (g, best[number]), n)
            once = total[number] == 1
            np.add.at(seen[:, UNKNOWN], g[once], 1)
            return pa.RecordBatch.from_arrays([code.dictionary.cast(pa.binary()), pa.array(np.full(len(best), -1)), pa.array(best), pa.array(total)], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if left is not None:
                table = pa.concat_tables([left, table])
            # The last word may go on in the next batch.
            words = table.column("word").combine_chunks()
            same = pa.compute.equal(words, words[-1]).to_numpy(zero_copy_only=False)
            cut = int(same.argmax())
            if cut:
                yield done(table.slice(0, cut))
            left = table.slice(cut)
            if left.num_rows > 1 << 16:  # a frequent word: add up its histories
                left = left.group_by(["word", "before"]).aggregate([("n", "sum")]).select(["word", "before", "n_sum"]).rename_columns(["word", "before", "n"])
        if left is not None:
            yield done(left)
        g, c = np.nonzero(seen)
        if len(g):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(g), pa.binary()), pa.array(g), pa.array(c), pa.array(seen[g, c])], schema=schema)

    return run


# -- the model ---------------------------------------------------------------------------------
@dataclass
class Model:
    core: list[bytes]
    classes: np.ndarray      # of core words and the end token
    counts: np.ndarray       # of core words and the end token, in training
    vocabulary: DataFrame    # word, n, class of all other words
    transitions: np.ndarray  # log10 P(class | history), unknown words in the last column
    class_counts: np.ndarray
    tokens: int
    distinct: int
    likelihoods: list[float]


def transition_table(m: np.ndarray, once: np.ndarray) -> np.ndarray:
    """log10 of class probabilities after each history; the last column is that of an unknown word's kind."""
    total = m.sum(1)
    frequency = (m.sum(0) + 1) / (m.sum() + len(m))
    unknown = (once + 1) / (total + 2)
    known = (m + MASS * frequency) / (total + MASS)[:, None]
    return np.log10(np.column_stack([known * (1 - unknown)[:, None], unknown]))


def fit(docs: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model, and the two tables of tokens of all documents."""
    core = core_words(docs)
    end = len(core)
    sequences, others = tokenised(docs, core)
    words = neighbours(sequences, end)
    classes, m, likelihoods = exchange(words, end)
    counts = np.zeros(end + 1, np.int64)
    for r in words.select("word", F.aggregate("left_n", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).collect():
        counts[r["word"]] = r["n"] or 0  # at most CORE rows
    total = m.sum()
    smooth = m[:, :CLASSES] + np.outer(m.sum(1), m.sum(0)[:CLASSES] + 1) / max(total, 1) / 100 + 1e-9
    evidence = np.log(smooth) - np.log(smooth.sum(0))
    made = kept(others.where(~F.col("held")).select("word", "before", "n").repartition("word").sortWithinPartitions("word")
                .mapInArrow(_assign(classes, evidence), "word binary, before long, class long, n long"), "class-lm-words")
    once = np.zeros(CLASSES + 1)
    for r in made.where("word is null").groupBy("before", "class").agg(F.sum("n").alias("n")).collect():
        if r["class"] == UNKNOWN:
            once[r["before"]] = r["n"]
        else:
            m[r["before"], r["class"]] += r["n"]
    vocabulary = made.where("before = -1").select("word", "n", "class")
    more = vocabulary.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    return (Model(core, classes, counts, vocabulary, transition_table(m, once), m.sum(0), int(counts.sum() + more["n"]),
                  int((counts > 0).sum() + more["v"]), likelihoods), sequences, others)


def _core_scores(model: Model):
    end = len(model.core)
    classes, transitions = model.classes, model.transitions
    emission = np.log10(np.maximum(model.counts, 1) / np.maximum(model.class_counts[classes], 1))
    base = np.log10((model.counts + 1) / (model.tokens + model.distinct + 1))
    known = model.counts > 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, ends = _joined(batch.column("tokens"), end)
            doc = np.zeros(len(ids), np.int64)
            doc[ends[:-1] + 1] = 1
            doc = np.cumsum(doc)
            tokens = np.bincount(doc, minlength=batch.num_rows)
            doc, ids = doc[ids != _OTHER], ids[ids != _OTHER]
            before = np.append(end, ids[:-1])
            score = transitions[classes[before], classes[ids]] + emission[ids]
            add = lambda x: pa.array(np.bincount(doc, x, batch.num_rows))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), batch.column("held"), pa.array(tokens), add(known[ids]).cast(pa.int64()),
                                              add(base[ids]), add(score)], names=["key", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def _other_scores(model: Model):
    classes, transitions, counts = model.classes, model.transitions, model.class_counts
    all_ = model.tokens + model.distinct + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g = classes[batch.column("before").to_numpy()]
            n, c, times = [pa.compute.fill_null(batch.column(x), 0).to_numpy() for x in ("n_words", "class", "n")]
            new = n == 0
            score = np.where(new, transitions[g, UNKNOWN] - np.log10(model.distinct + 1),
                             transitions[g, c] + np.log10(np.maximum(n, 1) / np.maximum(counts[c], 1)))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(times * ~new), pa.array(times * np.log10((n + 1) / all_)), pa.array(times * score)],
                                             names=["key", "known", "base", "own"])

    return run


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    model, sequences, others = fit(docs)
    vocabulary, kind = model.vocabulary, docs.schema["doc_id"].dataType.simpleString()
    light = Model([b""] * len(model.core), model.classes, model.counts, None, model.transitions, model.class_counts, model.tokens, model.distinct, [])
    first = sequences.mapInArrow(_core_scores(light), f"key long, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    rest = (others.select("key", "word", "before", "n").join(vocabulary.withColumnRenamed("n", "n_words"), "word", "left").select("key", "before", "n", "n_words", "class")
            .mapInArrow(_other_scores(light), "key long, known long, base double, own double")
            .groupBy("key").agg(*[F.sum(c).alias(c) for c in ("known", "base", "own")]))
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("known", "base", "own")}
    return first.join(rest, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero["known"]).cast("long").alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero["base"]).alias("base_score"), (F.col("score") + zero["own"]).alias("score"))
