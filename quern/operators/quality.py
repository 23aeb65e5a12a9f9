"""Rules that reject documents, cheap ones first, with one code for the first that fails."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import LINE_END, alpha_ratio, bound, strip, word_count, words
from quern.operators.language import allowed


@dataclass(frozen=True)
class Rule:
    """A code and the condition under which it rejects; user rules may wrap any Column, pandas UDFs too."""

    code: str
    rejects: Column


def ngram_repetition(text: Column, n: int = 10) -> Column:
    """Share of the words that the most frequent n-gram covers; 0 for less than 2 n words.

    Counted in batches, by sorting the texts' own n-gram hashes, so nothing is exploded.
    """
    factors = np.random.RandomState(7).randint(1, 1 << 62, n, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    @F.arrow_udf("double")
    def ratio(lists: pa.Array) -> pa.Array:
        ends = lists.offsets.to_numpy().astype(np.int64)
        starts, ends = ends[:-1] - ends[0], ends[1:] - ends[0]
        sizes = np.where(ends - starts >= 2 * n, ends - starts, 0)
        found = lists.flatten().dictionary_encode()
        at = np.repeat(starts - np.cumsum(np.maximum(sizes - n + 1, 0)) + np.maximum(sizes - n + 1, 0), np.maximum(sizes - n + 1, 0))
        best = np.zeros(len(sizes), np.int64)
        if len(at):
            at += np.arange(len(at))
            rows = np.repeat(np.arange(len(sizes)), np.maximum(sizes - n + 1, 0))
            draw = np.random.RandomState(11)
            codes = draw.randint(0, 1 << 62, len(found.dictionary), np.int64).astype(np.uint64)[found.indices.to_numpy()]
            grams = draw.randint(0, 1 << 62, len(sizes), np.int64).astype(np.uint64)[rows]
            for i in range(n):
                grams += codes[at + i] * factors[i]
            order = np.argsort(grams)
            first = np.flatnonzero(np.concatenate([[True], np.diff(grams[order]) != 0]))
            np.maximum.at(best, rows[order[first]], np.diff(np.append(first, len(order))))
        return pa.array(np.where(sizes > 0, best * n / np.maximum(sizes, 1), 0.0))

    return ratio(F.coalesce(words(text), F.array().cast("array<string>")))


def sentence_repeats(text: Column, longer_than: int = 20) -> Column:
    """How often the most frequent long sentence occurs; 0 without any."""
    parts = F.transform(F.split(text, r"[.!?\n]+", -1), lambda s: F.lower(strip(s)))
    return _longest_run(F.array_sort(F.transform(F.filter(parts, lambda s: F.length(s) > longer_than), lambda s: F.xxhash64(s))))


def _longest_run(sorted_values: Column) -> Column:
    start = F.struct(F.lit(0).alias("best"), F.lit(0).alias("run"), F.lit(None).cast("long").alias("last"))

    def step(s: Column, v: Column) -> Column:
        run = F.when(s["last"] == v, s["run"] + 1).otherwise(1)
        return F.struct(F.greatest(s["best"], run).alias("best"), run.alias("run"), v.alias("last"))

    return F.aggregate(sorted_values, start, step)["best"]


def bullet_ratio(text: Column, least_lines: int = 5, short: int = 8) -> Column:
    lines = F.filter(F.split(text, LINE_END, -1), lambda x: strip(x) != "")
    ratio = lambda x: F.when(F.size(x) >= least_lines, F.size(F.filter(x, lambda y: word_count(y) < short)) / F.size(x)).otherwise(0.0)
    return bound(lines, ratio)


def standard_rules(text: Column, min_words: int = 50, max_words: int = 100_000, min_alpha: float = 0.6, max_repetition: float = 0.3, max_sentences: int = 3, max_bullets: float = 0.9) -> list[Rule]:
    n = word_count(text)
    return [
        Rule("too_short", n < min_words),
        Rule("too_long", n > max_words),
        Rule("low_alpha_ratio", alpha_ratio(text) < min_alpha),
        Rule("high_ngram_repetition", ngram_repetition(text) > max_repetition),
        Rule("repeated_sentences", (n >= 20) & (sentence_repeats(text) > max_sentences)),
        Rule("high_bullet_ratio", bullet_ratio(text) > max_bullets),
    ]


def judged(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", languages=None) -> DataFrame:
    """docs with reason_code: the first rule that rejects, or null. Later rules run only on what earlier ones pass.

    languages, a language.detector, adds the last rule: what the others pass has to be in an allowed language.
    """
    code = F.lit(None).cast("string")
    for rule in reversed(rules if rules is not None else standard_rules(F.col(text))):
        code = F.when(rule.rejects, F.lit(rule.code)).otherwise(code)
    out = docs.withColumn("reason_code", code)
    if languages is None:
        return out
    # Texts that are rejected already reach the detector as null.
    found = out.withColumn("__q_lang", languages(F.when(F.col("reason_code").isNull(), F.col(text))))
    last = F.when(~allowed(F.col("__q_lang")), F.lit("language_rejected"))
    return found.withColumn("reason_code", F.coalesce("reason_code", last)).drop("__q_lang")


def scores(docs: DataFrame, text: str = "text", languages=None) -> DataFrame:
    """docs with the figures that the standard rules compare, of every row whether an earlier rule rejects it or not."""
    c = F.col(text)
    out = docs.withColumns({"token_count": word_count(c), "alpha_ratio": alpha_ratio(c), "ngram_repetition": ngram_repetition(c), "sentence_repeats": sentence_repeats(c), "bullet_ratio": bullet_ratio(c)})
    if languages is None:
        return out
    return out.withColumn("__q_lang", languages(c)).withColumns({"language": F.col("__q_lang.lang"), "lang_confidence": F.col("__q_lang.confidence")}).drop("__q_lang")


def passing(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", languages=None) -> DataFrame:
    good = judged(docs, rules, text).filter("reason_code is null").drop("reason_code")
    if languages is None:
        return good
    # The detector sees what the other rules pass, as a column of its own: in a condition it would not reach its workers.
    return good.withColumn("__q_lang", languages(F.col(text)).alias("x")).filter(allowed(F.col("__q_lang"))).drop("__q_lang")


def counts_by_reason(docs: DataFrame, rules: list[Rule] | None = None, text: str = "text", languages=None) -> DataFrame:
    return judged(docs, rules, text, languages).groupBy(F.coalesce("reason_code", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))
