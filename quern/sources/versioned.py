"""A keyed table in Parquet that changes by create, update and delete, keeps its versions, and is read as of any of them.

Rows lie in buckets by a hash of their key. A change rewrites the buckets that it touches into a folder of its own and then
writes the new version's manifest: which folder holds each bucket. The manifest's file is made under its final name only if
no other has that name, so of two writers of one version the later fails, and a write that breaks off leaves the version
before. Manifests name buckets, never rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.files import read_small


class Conflict(RuntimeError):
    """Another writer was first."""


def folded(changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The changes (keys, seq, op, columns) of each key as one: what it sets, by partial aggregates alone.

    create makes the row what it says and delete removes it, whatever was before; update sets its columns that aren't null.
    reset is the last create or delete, null if there is none; set holds, for each column, the last value after it.
    """
    reset = F.max(F.when(F.col("op").isin("create", "delete"), F.struct("seq", "op"))).alias("reset")
    last = [F.max(F.when(F.col(c).isNotNull() & (F.col("op") != "delete"), F.struct(F.col("seq").alias("seq"), F.col(c).alias("value")))).alias(f"__q_{i}") for i, c in enumerate(columns)]
    one = changes.groupBy(*keys).agg(reset, *last)
    current = lambda i: (F.col("reset").isNull()) | (F.col(f"__q_{i}.seq") >= F.col("reset.seq"))
    return one.select(*keys, F.col("reset.op").alias("reset"), F.struct(*[F.when(current(i), F.col(f"__q_{i}.value")).alias(c) for i, c in enumerate(columns)]).alias("set"))


@dataclass
class VersionedTable:
    """The table at a folder of any file system that Spark knows. Keys may be several columns, an owner's among them: a change
    with another owner then meets no row and does nothing."""

    spark: SparkSession
    folder: str
    keys: list[str]
    buckets: int = 64

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._fs(f"{self.folder}/log")
        return sorted(int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []

    def manifest(self, version: int | None = None) -> dict:
        if version is None:
            version = max(self.versions(), default=0)
        return json.loads(read_small(self.spark, f"{self.folder}/log/{version:08d}.json")) if version else {"version": 0, "buckets": {}}

    def read(self, version: int | None = None, schema: str | None = None) -> DataFrame:
        """The rows of a version, the last if none is given."""
        paths = sorted({f"{self.folder}/{d}/bucket={b}" for b, d in self.manifest(version)["buckets"].items()})
        if not paths:
            return self.spark.createDataFrame([], schema or ", ".join(f"{k} string" for k in self.keys))
        return self.spark.read.parquet(*paths)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def apply(self, changes: DataFrame) -> int:
        """Make a version of changes: the keys, seq (their order), op (create, update or delete) and the columns that create
        and update set, which the first changes name once for all. Returns the version's number."""
        before = self.manifest()
        columns = [c for c in changes.columns if c not in (*self.keys, "seq", "op")]
        one = folded(changes, self.keys, columns).withColumn("bucket", self._bucket())
        data = f"data/{before['version'] + 1:08d}-{uuid4().hex}"
        touched = sorted(r["bucket"] for r in one.select("bucket").distinct().collect())  # at most as many as buckets
        old = [f"{self.folder}/{before['buckets'][str(b)]}/bucket={b}" for b in touched if str(b) in before["buckets"]]
        if old:
            rows = self.spark.read.parquet(*old)
            rows = rows.select(*self.keys, F.struct(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in columns]).alias("held"), self._bucket().alias("bucket"))
            same = [one[k].eqNullSafe(rows[k]) for k in ("bucket", *self.keys)]
            met = rows.join(one, _all(same), "full")
            key = [F.coalesce(one[k], rows[k]).alias(k) for k in (*self.keys, "bucket")]
            held, exists = lambda c: F.when(F.col("reset").isNull(), F.col(f"held.{c}")), F.col("held").isNotNull()
        else:
            met, key, held, exists = one, [F.col(k) for k in (*self.keys, "bucket")], lambda c: F.lit(None), F.lit(False)
        alive = F.when(F.col("reset").isNull(), exists).otherwise(F.col("reset") == "create")
        new = met.filter(alive).select(*key, *[F.coalesce(F.col(f"set.{c}"), held(c)).alias(c) for c in columns])
        # Each bucket is one task's work and one file.
        new.repartition(min(len(touched), self.buckets) or 1, "bucket").write.partitionBy("bucket").parquet(f"{self.folder}/{data}")
        p, fs = self._fs(f"{self.folder}/{data}")
        filled = {s.getPath().getName().removeprefix("bucket=") for s in fs.listStatus(p) if s.getPath().getName().startswith("bucket=")}
        gone = {str(b) for b in touched}
        buckets = {b: d for b, d in before["buckets"].items() if b not in gone} | {b: data for b in filled}
        return self._commit({"version": before["version"] + 1, "buckets": buckets})

    def _commit(self, manifest: dict) -> int:
        p, fs = self._fs(f"{self.folder}/log/{manifest['version']:08d}.json")
        draft = p.suffix(f".{uuid4().hex}.draft")
        out = fs.create(draft)
        out.write(json.dumps(manifest).encode())
        out.close()
        if fs.exists(p) or not fs.rename(draft, p):
            fs.delete(draft, False)
            raise Conflict(f"version {manifest['version']} is there already")
        return manifest["version"]

    def vacuum(self, keep: int) -> int:
        """Delete the versions before the last keep ones, and the folders that none of those left names. Returns how many
        folders went."""
        versions = self.versions()
        for v in versions[: max(0, len(versions) - keep)]:
            p, fs = self._fs(f"{self.folder}/log/{v:08d}.json")
            fs.delete(p, False)
        used = {d for v in self.versions() for d in self.manifest(v)["buckets"].values()}
        p, fs = self._fs(f"{self.folder}/data")
        gone = [s.getPath() for s in fs.listStatus(p) if f"data/{s.getPath().getName()}" not in used]
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def revoked(keys: DataFrame, seq: Column, at: Column) -> DataFrame:
    """Changes that make the rows of these keys inactive from a time on."""
    return keys.select("*", seq.alias("seq"), F.lit("update").alias("op"), F.lit(False).alias("is_active"), at.alias("revoked_at"))


def rotated(rows: DataFrame, key: str, new_key: Column, seq: Column, at: Column) -> DataFrame:
    """Changes that make rows (with name, is_active and revoked_at) inactive and create active ones under new keys, which
    have all else of theirs; both in one version."""
    old = revoked(rows.drop("is_active", "revoked_at", "name", *[c for c in rows.columns if c not in (key, "org_id")]), seq, at)
    fresh = rows.withColumn(key, new_key).withColumn("name", F.concat("name", F.lit(" (rotated)"))).withColumn("is_active", F.lit(True)).withColumn("revoked_at", F.lit(None).cast(rows.schema["revoked_at"].dataType))
    return fresh.select("*", seq.alias("seq"), F.lit("create").alias("op")).unionByName(old, allowMissingColumns=True)
