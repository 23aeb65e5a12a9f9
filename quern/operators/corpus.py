"""Corpus tooling: one-pass scan, gates, profile, frequencies, seeded splits, cards, stage statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.numbers import ratio, rounded
from quern.functions.text import non_ascii, strip, word_count


def _count(c: Column) -> Column:
    return F.count_if(c)


def tokens_of(words: Column) -> Column:
    return F.floor(words * 1.3).cast("long")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """All counters of the gates in one aggregate: one row."""
    c = F.col(text)
    t = strip(c)
    out = docs.agg(
        F.count(c).alias("total_docs"),
        F.coalesce(F.sum(word_count(c)), F.lit(0)).cast("long").alias("total_words"),
        _count(F.length(t) == 0).alias("empty_docs"),
        _count(F.length(t) < 20).alias("near_empty_docs"),
        _count(F.contains(c, F.lit("\x00"))).alias("null_byte_docs"),
        _count(non_ascii(t)).alias("non_ascii_docs"),
        (F.count("*") - F.count(c)).alias("missing_text"),
    )
    return out.withColumn("total_tokens_approx", tokens_of(F.col("total_words")))


def gates(stats: DataFrame, min_docs: int = 1000, min_tokens: int = 500_000, max_empty: float = 0.05, max_non_ascii: float = 0.1) -> DataFrame:
    """id, name and passed of each gate; all must pass. Gates on raw lines (1: parses, 3: no BOM) belong to the reader."""
    n = F.greatest("total_docs", F.lit(1))
    checks = [
        ("2", "text_field", F.col("missing_text") == 0),
        ("4", "no_null_bytes", F.col("null_byte_docs") == 0),
        ("5", "min_docs", F.col("total_docs") >= min_docs),
        ("6", "min_tokens", F.col("total_tokens_approx") >= min_tokens),
        ("7", "near_empty_rate", F.col("near_empty_docs") / n <= max_empty),
        ("8", "non_ascii_rate", F.col("non_ascii_docs") / n <= max_non_ascii),
    ]
    return stats.select(F.inline(F.array(*[F.struct(F.lit(i).alias("id"), F.lit(name).alias("name"), ok.alias("passed")) for i, name, ok in checks])))


def profile(docs: DataFrame, text: str = "text") -> DataFrame:
    """Counts, rates and exact percentiles (linear, cut to whole numbers) of characters and words: one row."""
    d = docs.filter(F.col(text).isNotNull()).select(F.length(text).alias("n"), word_count(F.col(text)).alias("w"))
    rate = lambda c: F.round(_count(c) / F.greatest(F.count("*"), F.lit(1)), 4)
    at = lambda c, p: F.floor(F.percentile(c, F.lit(p))).cast("long")
    mean = lambda c: F.floor(F.sum(c) / F.count("*")).cast("long")
    chars = [F.min("n").alias("chars_min"), *[at("n", p).alias(f"chars_{name}") for name, p in (("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p90", 0.9), ("p99", 0.99))], F.max("n").alias("chars_max"), mean("n").alias("chars_mean")]
    words = [F.min("w").alias("words_min"), at("w", 0.5).alias("words_median"), at("w", 0.9).alias("words_p90"), F.max("w").alias("words_max"), mean("w").alias("words_mean")]
    return d.agg(F.count("*").alias("total_docs"), F.sum("n").alias("total_chars"), F.sum("w").alias("total_words"), tokens_of(F.sum("w")).alias("total_tokens_approx"), rate(F.col("n") == 0).alias("empty_rate"), rate(F.col("n") < 20).alias("near_empty_rate"), *chars, *words)


def top_values(df: DataFrame, column: str, n: int) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def _ordered(docs: DataFrame, key: str, seed: int) -> DataFrame:
    """docs with __q_r, the rank in a seeded order: ranks come from sorted partitions and their offsets, not one task."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return ranks(docs.withColumn("__q_o", F.md5(name)), ["__q_o", key], "__q_r").drop("__q_o")


def in_order(df: DataFrame, order: list[str]) -> DataFrame:
    """df stored in a total order (rows of equal order by a hash of all they have), with __q_p and __q_i: its sorted
    partition and its place there. Whole rows go through the sort, so none is lost or doubled whatever its order columns hold."""
    from quern.plans.lineage import written

    plain = [F.col(f"`{f.name}`") for f in df.schema.fields if f.dataType.typeName() != "map"]
    placed = df.sort(*order, F.xxhash64(*plain)).withColumn("__q_p", F.spark_partition_id())
    return written(placed.withColumn("__q_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "sorted")


def before(sizes: list[tuple[int, int]]) -> Column:
    """The sum of the sizes of the partitions before __q_p, from a size for each; one entry a partition."""
    total, entries = 0, []
    for p, n in sorted(sizes):
        entries += [F.lit(p), F.lit(total)]
        total += n
    return F.create_map(*entries)[F.col("__q_p")].cast("long") if entries else F.lit(0).cast("long")


def ranks(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with its global rank by the order columns, from 1."""
    placed = in_order(df, order)
    sizes = [(r["__q_p"], r["count"]) for r in placed.groupBy("__q_p").count().collect()]  # one row a partition
    return placed.withColumn(name, before(sizes) + F.col("__q_i") + 1).drop("__q_p", "__q_i")


def split(docs: DataFrame, val: float, test: float, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """docs with split: the first ceil(n * test) of a seeded order test, then ceil(n * val) val, the rest train."""
    n = docs.count()
    t, v = -(-n * round(test * 10**6) // 10**6), -(-n * round(val * 10**6) // 10**6)
    r = F.col("__q_r")
    return _ordered(docs, key, seed).withColumn("split", F.when(r <= t, "test").when(r <= t + v, "val").otherwise("train")).drop("__q_r")


def split_floor(docs: DataFrame, train: float, val: float, key: str = "doc_id", seed: int = 42) -> DataFrame:
    """docs with split: floors, train first, test takes the rest."""
    n = docs.count()
    t, v = n * round(train * 10**6) // 10**6, n * round(val * 10**6) // 10**6
    r = F.col("__q_r")
    return _ordered(docs, key, seed).withColumn("split", F.when(r <= t, "train").when(r <= t + v, "val").otherwise("test")).drop("__q_r")


def card(split_docs: DataFrame) -> DataFrame:
    return split_docs.agg(F.count("*").alias("doc_count"), *[F.count_if(F.col("split") == s).alias(f"{s}_docs") for s in ("train", "val", "test")])


def stage_stats(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Counts after each stage and the rate each one drops, 4 places (not a number of none): one row."""
    out = None
    for i, (name, df) in enumerate(stages):
        one = df.agg(F.count("*").alias(name if i == 0 else f"after_{name}"))
        out = one if out is None else out.crossJoin(F.broadcast(one))  # one row each
    names = [stages[0][0], *[f"after_{n}" for n, _ in stages[1:]]]
    rates = [rounded(1 - ratio(F.col(b), F.col(a)), 4).alias(f"{b.removeprefix('after_')}_rate") for a, b in zip(names, names[1:], strict=False)]
    return out.select(*names, *rates)
