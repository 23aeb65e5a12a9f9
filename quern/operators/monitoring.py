"""Monitoring queries over samples: rates, ratios, histogram quantiles, increases, absence, and conditions that hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = (0.5, 1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)


def bucket_start(ts: Column, seconds: int) -> Column:
    return F.timestamp_seconds(F.floor(F.unix_timestamp(ts) / seconds) * seconds)


def rate_by(events: DataFrame, label: str, seconds: int = 300) -> DataFrame:
    """Events a second in each window, by label."""
    return events.groupBy(bucket_start(F.col("ts"), seconds).alias("at"), label).agg((F.count("*") / seconds).alias("rate"))


def ratio(events: DataFrame, bad: Column, seconds: int = 3600) -> DataFrame:
    """Share of bad events in each window."""
    return events.groupBy(bucket_start(F.col("ts"), seconds).alias("at")).agg((F.count_if(bad) / F.count("*")).alias("ratio"))


def histogram_quantile(events: DataFrame, value: str, q: float, buckets=BUCKETS, by: list[str] | None = None) -> DataFrame:
    """The quantile that cumulative buckets allow, linear within its bucket; above the last bound: that bound."""
    keys = by or []
    counts = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(buckets)]
    sums = events.groupBy(*keys).agg(*counts, F.count("*").alias("n"))
    rank = F.col("n") * q
    out = F.lit(float(buckets[-1]))
    for i in reversed(range(len(buckets))):
        low, below = (0.0, F.lit(0)) if i == 0 else (buckets[i - 1], F.col(f"b{i - 1}"))
        inside = F.col(f"b{i}") - below
        out = F.when(F.col(f"b{i}") >= rank, low + (buckets[i] - low) * (rank - below) / F.when(inside > 0, inside)).otherwise(out)
    return sums.select(*keys, F.when(F.col("n") > 0, out).alias("value"))


def increase(samples: DataFrame, keys: list[str], seconds: int = 1800) -> DataFrame:
    """Growth of a counter in each window; a fall is a reset, after which the counter counts from 0."""
    w = Window.partitionBy(*keys).orderBy("ts")
    last = F.lag("value").over(w)
    step = F.when(last.isNull(), 0.0).when(F.col("value") < last, F.col("value")).otherwise(F.col("value") - last)
    return samples.withColumn("step", step).groupBy(*keys, bucket_start(F.col("ts"), seconds).alias("at")).agg(F.sum("step").alias("increase"))


def absent(expected: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(series.select(*keys).distinct(), keys, "left_anti")


def held_for(points: DataFrame, keys: list[str], at: str, holds: str, least: int) -> DataFrame:
    """Runs of at least that many points in a row at which the condition holds: keys, start, end and points."""
    w = Window.partitionBy(*keys).orderBy(at)
    both = Window.partitionBy(*keys, holds).orderBy(at)
    island = (F.row_number().over(w) - F.row_number().over(both)).alias("island")
    runs = points.select(*keys, at, holds, island).filter(F.col(holds)).groupBy(*keys, "island")
    return runs.agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("points")).filter(F.col("points") >= least).drop("island")
