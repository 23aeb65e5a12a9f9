"""Language detection by out-of-place distance of trigram ranks; profiles are learned, not shipped."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import language_form
from quern.plans.lineage import written
from quern.session import ship

RANKS, SAMPLE, LEAST = 300, 3000, 100
#: Languages that a profile may have: it is sent to all tasks, with RANKS trigrams each.
LANGUAGES = 1_000
#: Texts count as Chinese or Arabic from this share of such letters; Latin texts are neither from the second one on.
SCRIPT, LATIN, SURELY_LATIN = 0.2, 0.8, 0.95
ALLOWED, CONFIDENCE = ("en",), 0.9


def middle(text: Column, sample: int = SAMPLE) -> Column:
    """The middle sample characters of longer texts."""
    start = F.floor((F.length(text) - sample) / 2).cast("int") + 1
    return F.when(F.length(text) > sample, F.substr(text, start, F.lit(sample))).otherwise(text)


def trigrams(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, trigram, n and first_pos: runs of three characters without a space at either edge. They are counted by row in
    tasks; only those of keys that several rows share are shuffled."""
    ship(docs.sparkSession)
    form = docs.select(F.col(key).alias("k"), middle(language_form(F.col(text))).alias("t"))
    shared = docs.groupBy(F.col(key).alias("s")).agg(F.count("*").alias("c")).filter("c > 1").select("s")
    types = f"k {docs.schema[key].dataType.simpleString()}, trigram string, n long, first_pos int"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                at, found = [], []
                for j, t in enumerate(part.column(1).to_pylist()):
                    if t is not None and len(t) >= 3:
                        at.append(j)
                        found.append((t, *_codes(t), np.flatnonzero(_within(t))))
                names = [t[p : p + 3] for t, _, _, first, places in found for p in places[first].tolist()]
                rows = np.repeat(at, [len(c) for _, c, *_ in found]) if at else np.empty(0, np.int64)
                n = np.concatenate([x[2] for x in found]) if at else np.empty(0, np.int64)
                first = np.concatenate([x[4][x[3]] for x in found]) if at else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), pa.array(names, pa.string()), pa.array(n, pa.int64()), pa.array(first, pa.int32())], ["k", "trigram", "n", "first_pos"])

    own = form.join(shared, F.col("k").eqNullSafe(F.col("s")), "left_anti").mapInArrow(each, types)
    several = form.join(shared, F.col("k").eqNullSafe(F.col("s")), "left_semi").mapInArrow(each, types)
    several = several.groupBy("k", "trigram").agg(F.sum("n").alias("n"), F.min("first_pos").alias("first_pos"))
    return own.unionByName(several).withColumnRenamed("k", key)


def _within(text: str) -> np.ndarray:
    """Whether the three characters from each place on have no space at either edge."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return (points[:-2] != 32) & (points[2:] != 32)


def _codes(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigrams as numbers, how often each occurs and where first, of a prepared text."""
    return _codes_of(np.frombuffer(text.encode("utf-32-le"), np.uint32))


def _codes_of(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    points = points.astype(np.int64)
    ok = (points[:-2] != 32) & (points[2:] != 32)
    grams = (points[:-2] << 42 | points[1:-1] << 21 | points[2:])[ok]
    codes, first, n = np.unique(grams, return_index=True, return_counts=True)
    return codes, n, first


def _letters() -> np.ndarray:
    """What ``language_form`` makes of each character of 16 bits: a lower-case letter, or a space."""
    out = np.full(1 << 16, 32, np.uint32)
    for first, last in (("a", "z"), ("A", "Z"), ("À", "ÿ"), ("一", "鿿"), ("\u0600", "\u06ff")):
        for c in range(ord(first), ord(last) + 1):
            out[c] = ord(chr(c).lower())
    return out


LETTERS = _letters()


def formed(text: str) -> np.ndarray:
    """``language_form`` of a text, as numbers of its characters."""
    points = LETTERS[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0xFFFF)]
    letter = points != 32
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first space after a letter
    points = points[kept]
    return points[:-1] if len(points) and points[-1] == 32 else points


def _middle(points: np.ndarray) -> np.ndarray:
    start = max(0, (len(points) - SAMPLE) // 2)
    return points[start : start + SAMPLE]


def code_of(trigram: str) -> int:
    a, b, c = map(ord, trigram)
    return a << 42 | b << 21 | c


def profiles(docs: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, trigram, rank from docs(doc_id, text, lang); ties by trigram. At most ranks rows a language. Trigrams are
    counted by language within each batch, so only sums are shuffled."""
    ship(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text is not None and len(points := _middle(formed(text))) >= 3:
                    sums.setdefault(lang, []).append(_codes_of(points)[:2])
            for lang, found in sums.items():
                codes, at = np.unique(np.concatenate([c for c, _ in found]), return_inverse=True)
                n = np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)
                trigrams = [chr(c >> 42) + chr(c >> 21 & 0x1FFFFF) + chr(c & 0x1FFFFF) for c in codes.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array(trigrams, pa.string()), pa.array(n)], ["lang", "trigram", "n"])

    grams = docs.filter("lang is not null").select("lang", "text").mapInArrow(each, "lang string, trigram string, n long").groupBy("lang", "trigram").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("n"), "trigram")
    return grams.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= ranks).select("lang", "trigram", "rank")


def detector(profile: DataFrame, absent: int = RANKS):
    """A function of a text column: a struct of lang and confidence, from profile(lang, trigram, rank).

    A text's trigrams are ranked by frequency, then by first place. A language's distance is the sum, over its profile, of
    differences of ranks, where a trigram that the text lacks has rank absent; it is divided by the profile's size. The
    confidence is 1 - best / second distance (4 places), of English in Latin letters at least their share. Texts of less
    than LEAST characters, null ones and those without a trigram are unknown.
    """
    ship(profile.sparkSession)
    profile = written(profile.select("lang", "trigram", "rank"), "profile")  # learned once, however often it is read
    if (n := profile.select("lang").distinct().count()) > LANGUAGES:
        raise ValueError(f"a profile of {n} languages; at most {LANGUAGES} are handled")
    lists: dict[str, list[tuple[int, int]]] = {}
    for r in profile.select("lang", "trigram", "rank").collect():  # at most LANGUAGES * RANKS rows
        lists.setdefault(r["lang"], []).append((code_of(r["trigram"]), r["rank"]))
    known = {lang: (np.array([c for c, _ in x], np.int64), np.array([k for _, k in x], np.int64)) for lang, x in sorted(lists.items())}
    arabic = np.array([chr(c).isalpha() for c in range(0x600, 0x700)])

    def one(text: str) -> tuple[str, float]:
        points = formed(text)
        part = _middle(points)
        codes, n, first = _codes_of(part) if len(part) >= 3 else (np.empty(0, np.int64),) * 3
        if not len(codes):
            return "unknown", 0.0
        cjk = int(((points >= 0x4E00) & (points <= 0x9FFF)).sum())
        arab = int(arabic[points[(points >= 0x600) & (points < 0x700)] - 0x600].sum())
        latin = int(((points < 0x600) & (points != 32) & (points != 0xD7) & (points != 0xF7)).sum())
        letters = cjk + arab + latin
        if cjk > SCRIPT * letters:
            return "zh", round(cjk / letters, 4)
        if arab > SCRIPT * letters:
            return "ar", round(arab / letters, 4)
        rank = np.empty(len(codes), np.int64)
        rank[np.lexsort((first, -n))] = np.arange(1, len(codes) + 1)
        found = []
        for lang, (c, k) in known.items():
            if lang in ("zh", "ar") and latin > LATIN * letters:
                continue
            at = np.minimum(np.searchsorted(codes, c), len(codes) - 1)
            own = np.where(codes[at] == c, rank[at], absent)
            found.append((int(np.abs(k - own).sum()) / len(k), lang))
        if not found:
            return "unknown", 0.0
        found.sort()
        (best, lang), second = found[0], found[1][0] if len(found) > 1 else found[0][0] * 2
        confidence = 1.0 if second == 0 else 1 - best / second
        if lang == "en" and latin > SURELY_LATIN * letters:
            confidence = max(confidence, latin / letters)
        return lang, round(confidence, 4)

    @F.pandas_udf("lang string, confidence double")
    def detected(s: pd.Series) -> pd.DataFrame:
        out = [("unknown", 0.0) if t is None else one(t) for t in s]
        return pd.DataFrame(out, columns=["lang", "confidence"])

    return lambda text: detected(F.when(F.length(text) >= LEAST, text))


def detect(docs: DataFrame, profile: DataFrame) -> DataFrame:
    """doc_id, lang_pred and confidence of each row of docs(doc_id, text)."""
    found = docs.select("doc_id", detector(profile)(F.col("text")).alias("x"))
    return found.select("doc_id", F.col("x.lang").alias("lang_pred"), "x.confidence")


def allowed(detected: Column, languages: tuple[str, ...] = ALLOWED, confidence: float = CONFIDENCE) -> Column:
    """Whether a detector's result names one of the languages, surely enough."""
    return (detected["lang"] != "unknown") & (detected["confidence"] >= confidence) & detected["lang"].isin(*languages)


def script_ratios(text: Column) -> Column:
    """Shares of Latin, CJK and Arabic letters among all letters."""
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    share = lambda p: F.when(letters > 0, F.length(F.regexp_replace(text, p, "")) / letters).otherwise(0.0)
    return F.struct(share(r"[^\p{IsLatin}]").alias("latin"), share(r"[^一-鿿]").alias("cjk"), share(r"[^؀-ۿ]").alias("arabic"))
