"""The training-corpus pipeline: raw documents in, packed sequences out.

Each stage takes the session, the documents that its predecessor left, and the folder of the standard tables. All but the
last return the columns of documents, whatever others besides these there are; each result is written as Parquet and read
again as the next stage's documents, so a stage first deletes the tables that the one before it worked with.

Defined cases, beside those of the operators: any column may be null, an empty table passes through every stage as such,
and repeated rows are documents of their own up to near-dedup, which keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import line_dedup, mixing, near_dedup, packing, quality
from quern.llm.queries import tokenizer_path
from quern.plans.lineage import release, tables, written
from quern.session import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_used: dict[str, list[str]] = {}


def stage(f: Stage) -> Stage:
    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        release(spark, _used.pop(app, []))
        known = set(tables(spark))
        out = f(spark, docs, sf_dir)
        _used[app] = [x for x in tables(spark) if x not in known]
        return out

    return run


@stage
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go. A null or empty text is scored as such; without enough labels
    of either kind nothing goes."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


@stage
def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Recurring lines go; so do documents of which nothing but white space is left by that. Null and empty texts stay as
    they are; n_chars follows the text where lines went."""
    out = line_dedup.drop_lines(docs)
    out = out.filter((F.col("__q_dropped") == 0) | F.col("text").rlike(r"\S"))
    n = F.when(F.col("__q_dropped") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return out.select(*[n.cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


@stage
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the least id. Null and empty texts are like nothing but
    their own repetitions."""
    return near_dedup.one_of_each(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat by their source's target rate, in a global random order. A null source is a source."""
    return mixing.mix(docs, copy_column=None)


@stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in training sequences. A null or empty text is its final id alone."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("quality", keep_good), ("line_dedup", drop_lines), ("near_dedup", one_of_each), ("mixing", mix_sources), ("packing", pack)]

#: Sketches, classifiers and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, f in STAGES:
        docs = written(f(spark, docs, sf_dir), name)
        if last is not None:
            release(spark, [last])
        last = tables(spark)[-1]
    return docs
