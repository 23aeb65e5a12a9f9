"""Readers and writers of the file formats that corpora come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import strip, wiki_plain


def read_jsonl(spark: SparkSession, path: str, schema: str = "text string") -> DataFrame:
    """One record a line, .gz by suffix; malformed and blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_jsonl_checked(spark: SparkSession, path: str, text: str = "text") -> DataFrame:
    """value (the line), parses, has_text and text of every line that isn't blank; only strings count as text."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value"), F.col("value").startswith("﻿").alias("bom")).filter(F.length(strip(F.col("value"))) > 0)
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{text}", "variant"))
    return lines.select("value", "bom", (v.isNotNull() & F.schema_of_variant(v).startswith("OBJECT")).alias("parses"), F.coalesce(kind == "STRING", F.lit(False)).alias("has_text"), F.when(kind == "STRING", F.try_variant_get(v, f"$.{text}", "string")).alias("text"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(strip(F.col("value")).alias("line")).filter("line <> ''")


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).filter(~F.col("line").startswith("#")).withColumnRenamed("line", "url")


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines of a text file, .gz by suffix."""
    return spark.read.text(path).count()


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A whole file as one JSON value (an object, or an array of them)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark names the files below it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """One document a .txt file below folder: text without NUL, trimmed, and its path from there."""
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt")
    below = F.replace(F.replace(F.col("_metadata.file_path"), F.lit("file:///"), F.lit("file:/")), F.lit(qualified(spark, folder).replace("file:///", "file:/") + "/"), F.lit(""))
    return files.select(strip(F.replace("value", F.lit("\x00"), F.lit(""))).alias("text"), below.alias("source"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, n (from 1) and line: lines are numbered within their split and shifted by the splits before it, so files may be
    of any size."""
    m = F.col("_metadata")
    lines = spark.read.text(path, lineSep="\n").select(m["file_path"].alias("path"), m["file_name"].alias("file"), m["file_block_start"].alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"))
    splits = lines.groupBy("path", "start").agg(F.min("id").alias("first"), F.count("*").alias("lines"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    splits = splits.withColumn("before", F.coalesce(F.sum("lines").over(before), F.lit(0)))
    return lines.join(splits, ["path", "start"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("n"), "line")


def read_numbered(spark: SparkSession, path: str, schema: str = "text string") -> DataFrame:
    """Records with source file:L<n>."""
    lines = numbered_lines(spark, path).filter(F.length(strip(F.col("line"))) > 0)
    return lines.select(F.from_json("line", schema).alias("r"), F.concat("file", F.lit(":L"), "n").alias("source")).filter("r is not null").select("r.*", "source")


def read_wiki_dump(spark: SparkSession, path: str, shortest: int = 200) -> DataFrame:
    """title and text of the pages of a MediaWiki dump (.xml, .bz2): no redirects, markup removed, short ones left out."""
    schema = "title string, redirect string, revision struct<text: string>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    raw = F.col("revision.text")
    kept = pages.filter(raw.isNotNull() & F.col("redirect").isNull() & ~F.upper(F.ltrim(raw)).startswith("#REDIRECT"))
    return kept.select("title", wiki_plain(raw).alias("text")).filter(F.length("text") >= shortest)


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def read_table(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """A relational table by JDBC; filters and columns are pushed down. The driver's jar has to be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def write_jsonl(df: DataFrame, path: str, mode: str = "errorifexists", chunk: int | None = None) -> None:
    """mode: overwrite, append or errorifexists; chunk: records a file at most."""
    w = df.write.mode(mode)
    (w.option("maxRecordsPerFile", chunk) if chunk else w).json(path)


def write_splits(df: DataFrame, path: str, column: str = "split", source: str | None = None) -> DataFrame:
    """A folder for each split, and a card of them: split, docs, and the md5 of the source file if one is named."""
    df.write.partitionBy(column).mode("overwrite").parquet(path)
    card = df.sparkSession.read.parquet(path).groupBy(column).agg(F.count("*").alias("docs"))
    if source is None:
        return card
    one = file_hashes(df.sparkSession, source).select(F.col("md5").alias("source_md5"))
    return card.crossJoin(F.broadcast(one.limit(1)))  # one row


def write_small(spark: SparkSession, path: str, text: str) -> None:
    """A small text file (a vocabulary, a card) on any file system that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_small(spark: SparkSession, path: str) -> str:
    return spark.read.format("binaryFile").load(path).first()["content"].decode()


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path, size, sha256 and md5 of files."""
    return read_binary(spark, path).select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), F.md5("content").alias("md5"))


def stale_files(spark: SparkSession, path: str, days: int, now: str) -> DataFrame:
    """Files last changed more than days before now; a report, nothing is deleted."""
    return read_binary(spark, path).select("path", "modificationTime").filter(F.col("modificationTime") < F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))


def registry(spark: SparkSession, root: str) -> DataFrame:
    """name, version, promoted_at, complete, size_mb and latest of <root>/<name>/<folder>, newest first within a name.

    metadata.json names version and time of promotion (else the folder is the version). A version is complete with
    model.pt, config.json and a tokenizer folder, and latest if the metadata in <name>/latest names it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    place = F.split(F.replace(F.replace("path", F.lit("file:///"), F.lit("file:/")), F.lit(qualified(spark, root).replace("file:///", "file:/") + "/"), F.lit("")), "/")
    below = F.array_join(F.slice(place, 3, 9), "/").alias("file")
    files = reader.load(root).select(place[0].alias("name"), place[1].alias("folder"), below, "length")
    meta = reader.option("pathGlobFilter", "metadata.json").load(root).select(place[0].alias("name"), place[1].alias("folder"), below, F.from_json(F.decode("content", "UTF-8"), "version string, promoted_at string").alias("m"))
    meta = meta.filter("file = 'metadata.json'").select("name", "folder", "m.*")
    held = F.collect_set(F.when(F.col("file").startswith("tokenizer/"), "tokenizer").otherwise(F.col("file")))
    size = F.sum(F.when(F.col("file") == "model.pt", F.col("length")).otherwise(0))
    versions = files.groupBy("name", "folder").agg(held.alias("files"), F.round(size / 1e6, 1).alias("size_mb"))
    versions = versions.filter(~F.col("folder").isin("latest", "previous", "latest.new")).join(meta, ["name", "folder"], "left")
    pointer = meta.filter("folder = 'latest'").select("name", F.col("version").alias("pointed"))
    complete = F.array_contains("files", "model.pt") & F.array_contains("files", "config.json") & F.array_contains("files", "tokenizer")
    latest = F.coalesce(F.col("version") == F.col("pointed"), F.lit(False))
    out = versions.join(pointer, "name", "left").select("name", F.coalesce("version", "folder").alias("version"), "promoted_at", complete.alias("complete"), "size_mb", latest.alias("latest"))
    return out.orderBy("name", F.desc_nulls_last("promoted_at"), F.desc("version"))
