"""From raw pages to a corpus: crawl store, extraction, exact and near dedup, quality; resumable stage tables and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.html import html_metadata, html_text
from quern.functions.text import clean, normalise
from quern.functions.web import domain
from quern.operators import dedup, quality
from quern.operators.corpus import stage_stats
from quern.session import ship

STAGES = ("extracted", "exact", "near", "corpus")


def extracted(pages: DataFrame) -> DataFrame:
    """text, url, domain, title and language of pages(url, html); pages without text are left out. html stays behind."""
    ship(pages.sparkSession)  # pages go to workers in small batches
    both = pages.select("url", html_text("html").alias("t"), html_metadata("html").alias("m")).filter("t <> ''")
    out = both.select(normalise(clean(F.col("t"))).alias("text"), "url", domain(F.col("url")).alias("domain"), F.col("m.title").alias("title"), F.coalesce("m.language", F.lit("")).alias("language"))
    return out.filter("text <> ''")


def build(pages: DataFrame, folder: str, rules=None, start_from: str | None = None, force: bool = False, languages=None) -> dict[str, DataFrame]:
    """All stages of pages(url, html), each a Parquet table below folder. A stage whose table is complete (it has a _SUCCESS
    marker) is read, not computed, unless force is set or it comes at or after start_from. languages: a language.detector,
    whose rule comes last."""
    spark = pages.sparkSession
    steps = {
        "extracted": lambda d: extracted(d),
        "exact": lambda d: dedup.exact(d, order="url").drop("content_hash"),
        "near": lambda d: dedup.near(d, key="url"),
        "corpus": lambda d: quality.passing(d, rules, languages=languages),
    }
    first = STAGES.index(start_from) if start_from else len(STAGES)
    out, data = {}, pages
    for i, name in enumerate(STAGES):
        path = f"{folder}/{name}"
        if force or i >= first or not complete(spark, path):
            steps[name](data).write.mode("overwrite").parquet(path)
        data = out[name] = spark.read.parquet(path)
    return out


def complete(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    return stage_stats(list(tables.items()))
