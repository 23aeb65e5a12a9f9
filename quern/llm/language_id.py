"""Language identification by error-correcting output codes.

Each language gets a codeword: a row of a Hadamard matrix without its constant column, so that any two differ in half of
their bits. A bit's binary classifier weighs hashed byte trigrams and 4-grams by the log ratio of their shares in the
languages whose bit is 1 and in the others (every language counts alike). A text's output for a bit is the mean weight
of its grams; decoding adds the logistic losses of all bits against each codeword, each weighted by how well its bit
separates the languages in training, and takes the least. A text whose two best losses are close is flagged ambiguous.

Training reads at most about ``TRAIN_DOCS`` documents of each language, chosen by a hash of id and text at a rate found
from the languages' counts; this is the documented bound of the sample. Gram counts are summed in the tasks, so only one
vector a language reaches the driver. Prediction reads every whole text, and nothing but the text.

Defined cases: null text and text without a letter give ``und`` with score 0; without any training row everything is
``und``; with one language every text with a letter gets it; repeated rows each keep a row; a null id is held out by the
checksum of the text "null" and trains under it too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import SLICE_BYTES, buffer_of, slices, strings
from quern.session import ship

TRAIN_DOCS, DIMENSIONS, MIN_BITS = 10_000, 1 << 13, 15
FOLDS, HELD_OUT, UNKNOWN = 4, 2, "und"
#: Losses of a text in one language lie some 4 apart; these are of one whose parts differ by an eighth at most.
CLOSE = 0.5
#: Texts whose gram counts are held at once.
ROWS = 100
#: Bytes as classifiers see them: letters in lower case, all other ASCII a space.
_FOLD = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)], np.uint8)
_GRAM = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def gram_counts(part: np.ndarray, offsets: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Counts of the hashed grams of each text at these offsets, a row a text; runs of spaces count as one."""
    n = len(offsets) - 1
    shift = np.uint32(32 - (dimensions.bit_length() - 1))
    b = _FOLD[part]
    owner = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets))
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 32) | (b[:-1] != 32) | (owner[1:] != owner[:-1])
    b, owner = b[keep], owner[keep]
    out = np.zeros(n * dimensions, np.int64)
    for size in (3, 4):
        for a in range(0, len(b) - size + 1, SLICE_BYTES):
            m = min(SLICE_BYTES, len(b) - size + 1 - a)
            h = np.full(m, size, np.uint32)
            for i in range(size):
                h = (h ^ b[a + i : a + i + m]) * _GRAM[i]
                h ^= h >> np.uint32(15)
            h *= _GRAM[0]
            of = owner[a : a + m]
            whole = of == owner[a + size - 1 : a + size - 1 + m]
            # A gram of one letter's bytes says something; one of spaces only can't occur.
            out += np.bincount((of.astype(np.int64) * dimensions + (h >> shift))[whole], minlength=n * dimensions)
    return out.reshape(n, dimensions)


def hadamard_codes(n: int, least_bits: int = MIN_BITS) -> np.ndarray:
    """n codewords of +1 and -1, any two of which differ in half of their bits (and one more)."""
    size = 2
    while size - 1 < max(least_bits, n):
        size *= 2
    h = np.ones((1, 1), np.int8)
    while len(h) < size:
        h = np.block([[h, h], [h, -h]])
    return h[1 : n + 1, 1:] if n < size else h[:n, 1:]


class Model:
    """Bit classifiers and codewords of the learned languages."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        self.codes = hadamard_codes(len(self.languages)).astype(np.float32)
        shares = np.array([(counts[x] + 0.5) / (counts[x].sum() + 0.5 * len(counts[x])) for x in self.languages])
        useful = [i for i in range(self.codes.shape[1]) if len(set(self.codes[:, i].tolist())) == 2]
        self.codes = self.codes[:, useful]
        weights, bit_weights = [], []
        for bit in self.codes.T:
            w = np.log(shares[bit > 0].mean(0)) - np.log(shares[bit < 0].mean(0))
            margins = (shares @ w) * bit
            scale = 4.0 / max(1e-9, float(np.mean(margins)))
            weights.append(w * scale)
            bit_weights.append(max(0.05, float(np.min(margins)) * scale))
        self.weights = np.array(weights, np.float32).T if weights else np.zeros((len(shares[0]), 0), np.float32)
        self.bit_weights = np.array(bit_weights, np.float32) / max(1e-9, sum(bit_weights)) if bit_weights else np.zeros(0, np.float32)

    def decode(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, score and ambiguity of each row of gram counts."""
        n = counts.sum(1, keepdims=True)
        outputs = (counts.astype(np.float32) @ self.weights) / np.maximum(n, 1)
        losses = np.logaddexp(0, -outputs[:, None, :] * self.codes[None]) @ self.bit_weights if len(self.bit_weights) else np.zeros((len(counts), len(self.languages)), np.float32)
        best = losses.argmin(1)
        if len(self.languages) < 2:
            return best, np.ones(len(counts)), np.zeros(len(counts), bool)
        low = np.partition(losses, 1, axis=1)[:, :2]
        odds = np.exp(-(losses - low[:, :1]) * 4)
        return best, 1 / odds.sum(1), (low[:, 1] - low[:, 0]) < CLOSE


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("null"))) % FOLDS == HELD_OUT


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, dimensions: int = DIMENSIONS) -> Model | None:
    """The model of docs(text, lang, doc_id); None without any usable row."""
    ship(docs.sparkSession)
    use = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    numbers = {r["lang"]: r["count"] for r in use.groupBy("lang").count().collect()}
    if not numbers:
        return None
    rate = F.create_map(*[F.lit(x) for lang, n in numbers.items() for x in (lang, min(1.0, train_docs / n))])
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(5)), F.lit(1 << 30)) < rate[F.col("lang")] * float(1 << 30)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            raw, offsets = buffer_of(strings(batch.column(0)))
            langs = np.array(batch.column(1).to_pylist(), object)
            for i, j in slices(np.diff(offsets)):
                for a in range(i, j, ROWS):
                    e = min(a + ROWS, j)
                    found = gram_counts(raw[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a], dimensions)
                    for lang in set(langs[a:e]):
                        sums[lang] = sums.get(lang, 0) + found[langs[a:e] == lang].sum(0)
        rows = [{"lang": lang, "gram": g, "n": int(c)} for lang, v in sums.items() for g, c in enumerate(v) if c]
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("lang", pa.string()), ("gram", pa.int32()), ("n", pa.int64())]))

    grams = use.filter(drawn).select("text", "lang").mapInArrow(each, "lang string, gram int, n long")
    counts = {lang: np.zeros(dimensions) for lang in numbers}
    for r in grams.groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        counts[r["lang"]][r["gram"]] = r["n"]
    counts = {lang: v for lang, v in counts.items() if v.sum()}
    return Model(counts) if counts else None


def predict(docs: DataFrame, model: Model | None, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, lang_pred, score and ambiguous of each row of docs(doc_id, text)."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    letters = np.isin(np.arange(256), [*range(65, 91), *range(97, 123)])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            text = strings(batch.column(1))
            raw, offsets = buffer_of(text)
            n = len(text)
            found = np.concatenate(([0], np.cumsum(letters[raw])))
            lettered = found[offsets[1:]] > found[offsets[:-1]]
            for i in np.flatnonzero(~lettered & (np.diff(offsets) > 0)).tolist():
                lettered[i] = any(c.isalpha() for c in text[i].as_py())
            best, score, close = np.full(n, -1), np.zeros(n), np.zeros(n, bool)
            if m is not None:
                for i, j in slices(np.diff(offsets)):
                    for a in range(i, j, ROWS):
                        e = min(a + ROWS, j)
                        best[a:e], score[a:e], close[a:e] = m.decode(gram_counts(raw[offsets[a] : offsets[e]], offsets[a : e + 1] - offsets[a], dimensions))
            known = lettered & (best >= 0)
            names = np.array([*(m.languages if m is not None else []), UNKNOWN], object)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[np.where(known, best, -1)], pa.string()), pa.array(np.where(known, score, 0.0)), pa.array(close & known)],
                ["doc_id", "lang_pred", "score", "ambiguous"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(each, "doc_id long, lang_pred string, score double, ambiguous boolean")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and ambiguous: a model of the documents that aren't held out, over all of them."""
    model = train(docs.select("doc_id", "text", "lang").filter(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
