"""Passages that are stored once and found by their words.

Storing appends passages and, by word, the lists of those that hold it, in buckets of words. A search reads the buckets of
its queries' words alone and, as lists are sorted, little of them; it never scans passages. A batch counts once its mark is
written, which comes last, so one that broke off is neither found nor counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.sources.files import write_small

BUCKETS = 64
#: Hits that a task of a search counts, on average at most.
HITS = 1 << 20
#: What stands between passages that are given together.
BETWEEN = "\n---\n"


def words(text: Column) -> Column:
    return F.filter(F.array_distinct(F.split(F.lower(text), r"\s+")), lambda w: w != "")


def episodes(rows: DataFrame) -> DataFrame:
    """Passages of rows(id, task, result)."""
    return rows.select("id", F.concat(F.lit("Task: "), "task", F.lit("\nResult: "), "result").alias("text"), F.lit("episodic").alias("kind"), F.lit(None).cast("string").alias("source"))


def facts(rows: DataFrame) -> DataFrame:
    """Passages of rows(id, fact, source)."""
    return rows.select("id", F.col("fact").alias("text"), F.lit("semantic").alias("kind"), F.coalesce("source", F.lit("unknown")).alias("source"))


class Memory:
    """The passages at a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, path: str) -> list[str]:
        p, fs = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def batches(self) -> list[str]:
        return [x for x in self._names(f"{self.folder}/done") if x.startswith("batch")]

    def store(self, passages: DataFrame) -> None:
        """Append passages(id, text, kind, source); those without text are left out."""
        batch = f"batch={len(self.batches()):08d}"
        use = passages.filter(F.length(F.trim("text")) > 0).select("id", "text", "kind", "source")
        use.write.mode("overwrite").parquet(f"{self.folder}/passages/{batch}")
        lists = self.spark.read.parquet(f"{self.folder}/passages/{batch}").select(F.explode(words(F.col("text"))).alias("word"), "id")
        placed = lists.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int"))
        # Ranges, so that the list of a frequent word may span files.
        placed.repartitionByRange("bucket", "word", "id").sortWithinPartitions("bucket", "word", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/lists/{batch}")
        write_small(self.spark, f"{self.folder}/done/{batch}", "")

    def passages(self) -> DataFrame:
        paths = [f"{self.folder}/passages/{b}" for b in self.batches()]
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], "id long, text string, kind string, source string")

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id, rank, id and score (words in common) of the k best passages for each of queries(query_id, text); of
        equal scores the lower id, none without a word in common."""
        asked = queries.select("query_id", F.explode(words(F.col("text"))).alias("word")).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(self.buckets)).cast("int"))
        wanted = {r["bucket"] for r in asked.select("bucket").distinct().collect()}  # at most as many as buckets
        paths = [f"{self.folder}/lists/{b}/bucket={n}" for b in self.batches() for n in sorted(wanted) if f"bucket={n}" in self._names(f"{self.folder}/lists/{b}")]
        if not paths:
            return self.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, rank int, id long, score long")
        # Hits are dealt before they are counted, to as many tasks as they need: one that reads lists, which are small files of
        # many rows, would hold the counts of all their passages for all queries.
        hits = asked.join(self.spark.read.parquet(*paths), "word").select("query_id", "id")
        parts = max(self.spark.sparkContext.defaultParallelism, -(-hits.count() // HITS))
        hits = hits.repartition(parts, "query_id", "id")
        met = hits.groupBy("query_id", "id").agg(F.count("*").alias("score"))
        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        return met.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")

    def recall(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """query_id and text: the best passages of each query, one after the other; empty where there are none."""
        found = self.search(queries, k).join(self.passages().select("id", F.col("text").alias("passage")), "id")
        texts = found.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage"))), lambda x: x["passage"]), BETWEEN).alias("found"))
        return queries.select("query_id").join(texts, "query_id", "left").select("query_id", F.coalesce("found", F.lit("")).alias("text"))

    def clear(self) -> None:
        for part in ("done", "lists", "passages"):  # the marks first
            p, fs = self._fs(f"{self.folder}/{part}")
            fs.delete(p, True)
