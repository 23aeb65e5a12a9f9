"""Quality classifier by co-training.

Two views of a document are classified apart: its text (shares of bytes, repetition, and words that labelled documents
tie to one class) and its page metadata (source, language and length). Over a few rounds each view labels the documents
of a fresh unlabelled pool that it is sure of, for the other view's next training. Then each view is calibrated on
labelled documents that it did not see, and a logistic combination of both is fitted on others; it scores all documents.

Good means: quality 1 and not toxic. Training reads at most about ``LABELLED`` labelled documents and in each round about
``POOL`` others, chosen by hashes of ids and texts at rates found from the counts; this is the documented bound. Words
are chosen in Spark, so of each of these documents the driver gets some thousand bits, however long it is. Every document
is scored on its whole text, within its own task, without a shuffle.

Defined cases: null text counts as empty; null metadata is a value of its own; of repeated labels the worse counts; equal
texts of one id train once; with fewer than ``LEAST`` labelled documents of either class everything scores the share of
good ones (1 without labels) and is kept; repeated rows each keep a row; columns of the input pass through unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.common import buffer_of, slices, strings, word_hashes
from quern.llm.line_dedup import _LOWER, words_of
from quern.plans.lineage import written
from quern.session import ship

LABELLED, POOL, LEAST = 6_000, 1_000, 5
ROUNDS, SURE, PSEUDO_WEIGHT = 3, 0.95, 0.5
WORDS, WORD_DOCS, WORD_G = 2_000, 4, 12.0
META, DENSE = 256, 134
THRESHOLD = 0.5
_NO_WORD = np.array([not (97 <= c <= 122 or 65 <= c <= 90 or c >= 128) for c in range(256)])


def text_view(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, last row, dense features, row of each distinct word, hash of it), slice by slice."""
    raw, offsets = buffer_of(strings(column))
    for i, j in slices(np.diff(offsets)):
        own = offsets[i : j + 1] - offsets[i]
        part = raw[offsets[i] : offsets[j]]
        n = j - i
        size = np.diff(own)
        dense = np.zeros((n, DENSE), np.float32)
        if not len(part):
            dense[:, 0] = 1
            yield i, j, dense, np.empty(0, np.int64), np.empty(0, np.uint32)
            continue
        counts = np.stack([np.bincount(part[a:b], minlength=256) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)])
        shares = counts / np.maximum(size, 1)[:, None]
        dense[:, 0] = 1
        dense[:, 1:129] = np.sqrt(shares[:, :128])
        dense[:, 129] = np.log1p(size) / 10
        starts, ends = words_of(part, own[:-1][own[:-1] < len(part)], _NO_WORD)
        words = (word_hashes(_LOWER[part], starts, ends) >> np.uint64(32)).astype(np.int64)
        of = np.searchsorted(own, starts, side="right") - 1
        number = np.bincount(of, minlength=n)
        pairs = np.unique(of << 32 | words)
        row = pairs >> 32
        distinct = np.bincount(row, minlength=n)
        dense[:, 130] = distinct / np.maximum(number, 1)
        dense[:, 131] = np.log1p(number) / 10
        dense[:, 132] = np.minimum(size / np.maximum(number, 1), 30) / 10
        # Lines that repeat within a document.
        breaks = np.flatnonzero(part == 10)
        cuts = np.unique(np.concatenate((own[:-1][own[:-1] < len(part)], breaks + 1)))
        cuts = cuts[cuts < len(part)]
        stops = np.append(cuts[1:], len(part))
        lines = word_hashes(part, cuts, np.maximum(cuts, stops - (part[stops - 1] == 10)))
        of_line = np.searchsorted(own, cuts, side="right") - 1
        table = np.unique(np.stack((of_line.astype(np.uint64), lines)), axis=1)
        all_lines = np.bincount(of_line, minlength=n)
        dense[:, 133] = 1 - np.bincount(table[0].astype(np.int64), minlength=n) / np.maximum(all_lines, 1)
        yield i, j, dense, row, (pairs & 0xFFFFFFFF).astype(np.uint32)


def meta_view(source: list, lang: list, n_bytes: np.ndarray) -> np.ndarray:
    """Hashed indicators: source, language, both, and the size in powers of two."""
    out = np.zeros((len(source), META), np.float32)
    out[:, 0] = 1
    for i, (s, g, n) in enumerate(zip(source, lang, n_bytes.tolist(), strict=True)):
        for text in (f"s{s}", f"l{g}", f"b{s}/{g}", f"n{int(n).bit_length()}"):
            out[i, 1 + int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "little") % (META - 1)] = 1
    return out


class Logistic:
    """L2-regularised logistic regression by gradient descent with momentum; inputs are scaled here."""

    def __init__(self, penalty: float, steps: int = 250):
        self.penalty, self.steps = penalty, steps

    def fit(self, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Logistic:
        self.scale = 1 / np.maximum(np.sqrt((x * x).mean(0)), 1e-3)
        self.scale[0] = 1
        x = x * self.scale
        w = w * np.where(y > 0, 0.5 / max(1e-9, w[y > 0].sum()), 0.5 / max(1e-9, w[y == 0].sum()))  # classes count alike
        top = float(np.linalg.norm((x * np.sqrt(w)[:, None]).astype(np.float32) @ _direction(x, w)) ** 2)
        rate = 1 / (0.25 * 1.2 * top + self.penalty)
        b = np.zeros(x.shape[1], np.float32)
        ahead, t = b.copy(), 1.0
        ridge = np.full(x.shape[1], self.penalty, np.float32)
        ridge[0] = 0
        for _ in range(self.steps):
            g = x.T @ (w * (_sigmoid(x @ ahead) - y)).astype(np.float32) + ridge * ahead
            new, u = ahead - rate * g, (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead, b, t = new + (t - 1) / u * (new - b), new, u
        self.weights = (b * self.scale).astype(np.float32)
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights


def _direction(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The direction in which x, weighted, is longest, by power iteration."""
    v = np.ones(x.shape[1], np.float32) / np.sqrt(x.shape[1])
    for _ in range(15):
        v = x.T @ (w * (x @ v)).astype(np.float32)
        v /= max(1e-12, float(np.linalg.norm(v)))
    return v


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Platt:
    """p = sigmoid(z @ a + c), fitted by Newton steps with a small penalty."""

    def fit(self, z: np.ndarray, y: np.ndarray) -> Platt:
        x = np.column_stack((np.ones(len(z)), z))
        b = np.zeros(x.shape[1])
        target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
        for _ in range(30):
            p = _sigmoid(x @ b)
            h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
            b = b - np.linalg.solve(h, x.T @ (p - target) + 1e-3 * b)
        self.b = b
        return self

    def probability(self, z: np.ndarray) -> np.ndarray:
        return _sigmoid(np.column_stack((np.ones(len(z)), z)) @ self.b)


class Model:
    """Both views' classifiers, their calibrations and their combination; without classifiers a constant share."""

    def __init__(self, share: float = 1.0):
        self.share, self.text = share, None

    def words(self, row: np.ndarray, words: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros((n, len(self.chosen)), np.float32)
        if len(self.chosen) and len(words):
            at = np.minimum(np.searchsorted(self.chosen, words), len(self.chosen) - 1)
            hit = self.chosen[at] == words
            out[row[hit], at[hit]] = 1
        return out

    def score(self, dense: np.ndarray, row: np.ndarray, words: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of being good: by text, by metadata, by both."""
        if self.text is None:
            flat = np.full(len(dense), self.share)
            return flat, flat, flat
        t = self.text.logit(np.hstack((dense, self.words(row, words, len(dense)))))
        m = self.meta.logit(meta)
        pt, pm = self.of_text.probability(t[:, None]), self.of_meta.probability(m[:, None])
        both = np.column_stack((_logit(pt), _logit(pm)))
        return pt, pm, self.both.probability(both)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def _chosen(sample: DataFrame) -> np.ndarray:
    """Hashes of the words whose presence and class are most dependent by the G statistic, sorted, of sample(text, good)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = batch.column(1).to_numpy()
            for i, _, _, row, words in text_view(batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(words.astype(np.int64)), pa.array(good[i + row])], ["word", "good"])

    words = sample.select("text", "good").mapInArrow(each, "word long, good int").groupBy("word").agg(F.sum("good").alias("k1"), F.count("*").alias("k"))
    totals = sample.agg(F.sum("good").alias("n1"), F.count("*").alias("n"))  # one row
    k1, k, n1, n = (F.col(c) for c in ("k1", "k", "n1", "n"))
    cells = ((k1, k, n1), (k - k1, k, n - n1), (n1 - k1, n - k, n1), (n - n1 - k + k1, n - k, n - n1))
    g = sum((F.when(have > 0, 2 * have * F.log(have * n / (of_word * of_class))).otherwise(0.0) for have, of_word, of_class in cells), F.lit(0.0))
    best = words.filter(k >= WORD_DOCS).crossJoin(F.broadcast(totals)).withColumn("g", g).filter(F.col("g") >= WORD_G)
    return np.sort(np.array([r["word"] for r in best.orderBy(F.desc("g"), "word").limit(WORDS).select("word").collect()], np.uint32))


def _features(docs: DataFrame, model: Model) -> DataFrame:
    """id, good (null: unlabelled), round, and the views as bytes of docs(doc_id, text, source, lang, good, round)."""

    def packed(bits: np.ndarray) -> pa.Array:
        return pa.array([x.tobytes() for x in np.packbits(bits > 0, axis=1)], pa.binary())

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = buffer_of(strings(batch.column(1)))
            source, lang = (batch.column(c).to_pylist() for c in (2, 3))
            for i, j, dense, row, words in text_view(batch.column(1)):
                part = batch.slice(i, j - i)
                views = [pa.array([x.tobytes() for x in dense], pa.binary()), packed(model.words(row, words, j - i)), packed(meta_view(source[i:j], lang[i:j], np.diff(offsets)[i:j]))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(6), part.column(4), part.column(5), *views], ["doc_id", "key", "good", "round", "dense", "words", "meta"])

    columns = docs.select("doc_id", "text", "source", "lang", "good", "round", "key")
    return columns.mapInArrow(each, "doc_id long, key long, good int, round int, dense binary, words binary, meta binary")


def _sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that training reads: labelled ones (good is 0 or 1) and the rounds' pools of others."""
    good = F.min(((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).cast("int"))
    labels = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(good.alias("good"))
    unit = 1 << 30
    drawn = lambda salt, rate: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(unit)) < rate * float(unit)
    n_labels, n_docs = labels.count(), docs.count()
    some = labels.filter(drawn(1, min(1.0, LABELLED / max(1, n_labels))))
    # The labelled sample is bounded by LABELLED, so it may be broadcast.
    known = docs.join(F.broadcast(some), "doc_id").withColumn("round", F.lit(None).cast("int"))
    place = F.pmod(F.xxhash64("doc_id", "key", F.lit(2)), F.lit(unit))
    rate = min(1.0, ROUNDS * POOL / max(1, n_docs)) * unit
    other = docs.filter(place < rate).join(labels.select("doc_id"), "doc_id", "left_anti").withColumn("good", F.lit(None).cast("int"))
    other = other.withColumn("round", F.floor(place * ROUNDS / max(1.0, rate)).cast("int"))
    return known.unionByName(other).dropDuplicates(["doc_id", "key"])


def _enough(y: np.ndarray, use: np.ndarray) -> bool:
    return min(y[use].sum(), (1 - y[use]).sum()) >= LEAST


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of docs(doc_id, text, source, lang) and labels(doc_id, quality, toxic)."""
    ship(docs.sparkSession)
    key = F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), key)
    sample = written(_sample(docs, labels), "sample")
    # A quarter of the labelled documents is held back, in three parts: for the rounds, for the views, for both together.
    fold = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(12))
    model = Model()
    model.chosen = _chosen(sample.filter(F.col("good").isNotNull() & (fold > 2)))
    got = _features(sample, model).withColumn("fold", fold).toArrow().combine_chunks()
    got = got.take(pa.array(np.lexsort((got.column("key").to_numpy(), got.column("doc_id").to_numpy()))))  # the same rows, however they came
    good_of = got.column("good").to_numpy(zero_copy_only=False).astype(float)
    labelled = ~np.isnan(good_of)
    y = np.where(labelled, good_of, 0)
    if min(y[labelled].sum(), (1 - y[labelled]).sum()) < 2 * LEAST:
        return Model(float(y[labelled].mean()) if labelled.any() else 1.0)
    folds, rounds = got.column("fold").to_numpy(), np.nan_to_num(got.column("round").to_numpy(zero_copy_only=False).astype(float), nan=-1)
    first, held = labelled & (folds > 2), [labelled & (folds == f) for f in range(3)]
    if not all(_enough(y, x) for x in (first, *held)):  # too few to part them
        first, held = labelled, [labelled] * 3

    def bits(name: str, n: int) -> np.ndarray:
        flat = np.frombuffer(b"".join(got.column(name).to_pylist()), np.uint8).reshape(len(y), -1)
        return np.unpackbits(flat, axis=1)[:, :n].astype(np.float32)

    dense = np.frombuffer(b"".join(got.column("dense").to_pylist()), np.float32).reshape(len(y), DENSE)
    text, meta = np.hstack((dense, bits("words", len(model.chosen)))), bits("meta", META)
    views = {"text": (text, 1e-4), "meta": (meta, 1e-2)}
    marks = {v: (first.copy(), y.copy(), np.ones(len(y))) for v in views}
    fitted = {}
    for round_ in range(ROUNDS + 1):
        for v, (x, penalty) in views.items():
            use, target, weight = marks[v]
            fitted[v] = Logistic(penalty).fit(x[use], target[use], weight[use])
        if round_ == ROUNDS:
            break
        pool = rounds == round_
        for v, to in (("text", "meta"), ("meta", "text")):
            z = fitted[v].logit(views[v][0])[:, None]
            sure = Platt().fit(z[held[0]], y[held[0]]).probability(z)
            use, target, weight = marks[to]
            fresh = pool & ((sure >= SURE) | (sure <= 1 - SURE))
            use[fresh], target[fresh], weight[fresh] = True, sure[fresh] >= SURE, PSEUDO_WEIGHT
    model.text, model.meta = fitted["text"], fitted["meta"]
    t, m = model.text.logit(text)[:, None], model.meta.logit(meta)[:, None]
    model.of_text, model.of_meta = Platt().fit(t[held[1]], y[held[1]]), Platt().fit(m[held[1]], y[held[1]])
    both = np.column_stack((_logit(model.of_text.probability(t[held[2]])), _logit(model.of_meta.probability(m[held[2]]))))
    model.both = Platt().fit(both, y[held[2]])
    return model


SCORES = ("__q_text", "__q_meta", "__q_score")


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs with the three scores added; no shuffle."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    at = {c: names.index(c) for c in ("text", "source", "lang")}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            n = batch.num_rows
            out = [np.zeros(n) for _ in SCORES]
            column = strings(batch.column(at["text"]))
            _, offsets = buffer_of(column)
            source, lang = (batch.column(at[c]).cast(pa.string()).to_pylist() for c in ("source", "lang"))
            for i, j, dense, row, words in text_view(column):
                for a in range(0, j - i, 2_000):
                    e = min(a + 2_000, j - i)
                    lo, hi = np.searchsorted(row, (a, e))
                    meta = meta_view(source[i + a : i + e], lang[i + a : i + e], np.diff(offsets)[i + a : i + e])
                    for o, p in zip(out, m.score(dense[a:e], row[lo:hi] - a, words[lo:hi], meta), strict=True):
                        o[i + a : i + e] = p
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(o) for o in out)], [*names, *SCORES])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in SCORES)])
    return docs.mapInArrow(each, schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, p_text, p_meta, score (probabilities of being good) and keep (score >= threshold) of each document."""
    docs = docs.select("doc_id", "text", "source", "lang")
    out = scored(docs, train(docs, labels))
    return out.select("doc_id", F.col(SCORES[0]).alias("p_text"), F.col(SCORES[1]).alias("p_meta"), F.col(SCORES[2]).alias("score"), (F.col(SCORES[2]) >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rejected rows."""
    return scored(docs, train(docs, labels)).filter(F.col(SCORES[2]) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
