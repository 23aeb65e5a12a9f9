"""Exact and MinHash deduplication of records, with state that outlives a run."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.numbers import rounded
from quern.functions.text import blank, content_hash
from quern.session import ship, spread


def one_of_equal(rows: DataFrame, name: str) -> DataFrame:
    """One row of each name, the one of least hash over all columns."""
    first = Window.partitionBy(name).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]))
    return rows.withColumn("__q_rn", F.row_number().over(first)).filter("__q_rn = 1").drop("__q_rn")


def exact(docs: DataFrame, text: str = "text", order: str = "doc_id", empty: bool = False) -> DataFrame:
    """The first record of each content, by order (nulls last; of equal orders the text of least hash); empty and null texts
    are left out, or with empty each a content of its own. Of rows that are equal in order and text one stays.

    Contents are hashed once; only hashes and order are grouped and meet the records again.
    """
    from quern.plans.lineage import written

    use = spread(docs) if empty else spread(docs).filter(~blank(F.col(text)))
    keyed = use.select(F.col(order).alias("__q_order"), content_hash(F.col(text)).alias("content_hash"), F.xxhash64(text).alias("__q_same"))
    equal = keyed.groupBy("content_hash", "__q_order", "__q_same").agg(F.count("*").alias("__q_n"))
    place = F.struct(F.isnull("__q_order"), F.col("__q_order"), F.col("__q_same"), F.col("__q_n"))
    first = written(equal.groupBy("content_hash").agg(F.min(place).alias("x")).select("content_hash", "x.__q_order", "x.__q_same", "x.__q_n"), "hashes")
    met = use.join(first, use[order].eqNullSafe(F.col("__q_order")) & (F.xxhash64(use[text]) == F.col("__q_same")))
    several = F.col("__q_n") > 1
    kept = [F.col(f"`{c}`") for c in docs.columns] + [F.col("content_hash")]
    if first.filter(several).isEmpty():
        return met.select(kept)
    return met.filter(~several).select(kept).unionByName(one_of_equal(met.filter(several).select(kept), "content_hash"))


def exact_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """total, unique_docs, duplicates and dup_rate (of all records, 4 places)."""
    use = ~blank(F.col(text))
    groups = docs.groupBy(F.when(use, content_hash(F.col(text))).alias("h")).agg(F.count("*").alias("n"))
    agg = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("h").alias("unique_docs"), F.coalesce(F.sum(F.when(F.col("h").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicates"))
    return agg.withColumn("dup_rate", rounded(F.coalesce(F.col("duplicates") / F.when(F.col("total") > 0, F.col("total")), F.lit(0.0)), 4))


def unseen(docs: DataFrame, seen: DataFrame, text: str = "text", order: str = "doc_id") -> DataFrame:
    """Records whose content is in no earlier run's seen(content_hash); append their hashes to it after the run."""
    return exact(docs, text, order).join(seen.select("content_hash"), "content_hash", "left_anti")


#: The hash family of signatures: a Mersenne prime, the range of values, and the seed of the coefficients.
PRIME, RANGE, SEED = (1 << 61) - 1, 1 << 32, 42


def coefficients(n: int = 128, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.RandomState(seed)
    return tuple(rng.randint(low, PRIME, size=n, dtype=np.int64) for low in (1, 0))


#: Hashes of the shingles that a worker met first, which are the frequent ones, and how many it keeps.
_met: dict[str, int] = {}
MET = 1 << 17


def shingle_hashes(text: str, n: int = 5) -> np.ndarray:
    """The first four bytes, little-endian, of the MD5 of each distinct run of n characters."""
    from hashlib import md5

    runs = {text[i : i + n] for i in range(len(text) - n + 1)}
    fresh = [r for r in runs if r not in _met]
    known = [_met[r] for r in runs.difference(fresh)]
    found = np.frombuffer(b"".join([md5(r.encode()).digest() for r in fresh]), "<u4")[::4].tolist()
    if len(_met) < MET:
        _met.update(zip(fresh, found, strict=True))
    return np.array(known + found, np.int64)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of (a * x + b) mod PRIME mod RANGE, with 64-bit wraparound; all 0 for an empty set."""
    if not len(hashes):
        return np.zeros(len(a), np.int64)
    out = np.full(len(a), RANGE - 1, np.uint32)
    for at in range(0, len(hashes), 2048):
        some = hashes[None, at : at + 2048]
        for i in range(0, len(a), 16):  # small blocks stay in the cache
            with np.errstate(over="ignore"):
                x = a[i : i + 16, None] * some
                x += b[i : i + 16, None]
            # The remainder by a Mersenne prime is the low bits plus the high ones, once corrected either way; of a sum that
            # needs no correction, which few low bits leave open, 32 bits are enough.
            low = x.astype(np.uint32)
            if (low + np.uint32(4)).min() < 8:
                y = (x & PRIME) + (x >> 61)
                y += PRIME * (y < 0)
                y -= PRIME * (y >= PRIME)
                low = (y & (RANGE - 1)).astype(np.uint32)
            else:
                x >>= 61
                low += x.astype(np.uint32)
            np.minimum(out[i : i + 16], low.min(1), out=out[i : i + 16])
    return out.astype(np.int64)


def signatures(docs: DataFrame, text: str = "text", key: str | list[str] = "doc_id", permutations: int = 128, n: int = 5) -> DataFrame:
    """The key's columns and signature array<long>."""
    ship(docs.sparkSession)
    keys = [key] if isinstance(key, str) else key

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(permutations)
        for batch in batches:
            found = [signature(shingle_hashes(t or "", n), a, b) for t in batch.column(len(keys)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(found, pa.list_(pa.int64()))], [*keys, "signature"])

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keys)
    return spread(docs.select(*keys, text)).mapInArrow(each, f"{kinds}, signature array<long>")


def bands_for(permutations: int = 128, threshold: float = 0.85) -> tuple[int, int]:
    """Bands and rows whose S-curve turns nearest to the threshold; the first of equals."""
    options = [(abs(threshold - (1 / b) ** (1 / (permutations // b))), b) for b in range(1, permutations + 1)]
    b = min(options)[1]
    return b, permutations // b


def classes_of(sigs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, members and signature: equal signatures are one class, named by its first key."""
    return sigs.groupBy(F.xxhash64("signature").alias("h")).agg(F.min(key).alias(key), F.count("*").alias("members"), F.first("signature").alias("signature")).drop("h")


def candidate_pairs(classes: DataFrame, key: str = "doc_id", permutations: int = 128, threshold: float = 0.85) -> DataFrame:
    """i < j: keys of classes_of that share a band, so large groups of copies make no pairs here."""
    b, r = bands_for(permutations, threshold)
    parts = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda k: F.xxhash64(k, F.slice("signature", k * r + 1, r)))
    banded = classes.select(F.col(key).alias("k"), F.explode(parts).alias("band"))
    return banded.alias("x").join(banded.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.k") < F.col("y.k"))).select(F.col("x.k").alias("i"), F.col("y.k").alias("j")).distinct()


#: Classes of a band that are compared as pairs of rows, and those of a block where there are more; rows of a block at once.
FEW, BLOCK, AT_ONCE = 200, 1_000, 64


def resembling(classes: DataFrame, permutations: int = 128, threshold: float = 0.85) -> DataFrame:
    """id of the classes(id, signature) that one of lower id resembles, by the bands they share. A band of many classes is
    compared block by block, each pair of blocks in a task of its own that yields ids alone, so it makes no pairs of rows."""
    from quern.operators.joins import by_parts
    from quern.plans.lineage import written

    b, r = bands_for(permutations, threshold)
    parts = F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda k: F.xxhash64(k, F.slice("signature", k * r + 1, r)))
    banded = classes.select("id", F.explode(parts).alias("band"))
    sizes = written(banded.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1"), "bands")
    few = banded.join(sizes.filter(F.col("n") <= FEW).select("band"), "band")
    pairs = few.alias("x").join(few.alias("y"), (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("i"), F.col("y.id").alias("j")).distinct()
    left, right = (classes.select(F.col("id").alias(x), F.col("signature").alias(f"s{x}")) for x in "ij")
    close = pairs.join(left, "i").join(right, "j").filter(jaccard_estimate(F.col("si"), F.col("sj")) >= threshold).select(F.col("j").alias("id"))
    large = sizes.filter(F.col("n") > FEW)
    if large.isEmpty():
        return close.distinct()
    many = by_parts(banded, large, ["band"], "n").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    dealt = many.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("id", "band", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).join(classes.select("id", "signature"), "id")

    def each(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("id")
        ids, side, sigs = f["id"].to_numpy(), f["own"].to_numpy(), np.stack(f["signature"]).astype(np.uint32)
        crossed = f["low"].iloc[0] != f["high"].iloc[0]
        bad = np.zeros(len(f), bool)
        for at in range(0, len(f), AT_ONCE):
            some = slice(at, at + AT_ONCE)
            alike = (sigs[some, None, :] == sigs[None, : at + AT_ONCE, :]).sum(2) >= threshold * sigs.shape[1]
            alike &= ids[None, : at + AT_ONCE] < ids[some, None]
            if crossed:
                alike &= side[None, : at + AT_ONCE] != side[some, None]
            bad[some] = alike.any(1)
        return pd.DataFrame({"id": ids[bad]})

    return close.unionByName(dealt.groupBy("band", "low", "high").applyInPandas(each, "id long")).distinct()


def lsh(sigs: DataFrame, key: str = "doc_id", permutations: int = 128, threshold: float = 0.85) -> DataFrame:
    """key, class (its first key) and links (other classes that share a band with it) of each row of sigs(key, signature)."""
    from quern.plans.lineage import cut

    sigs = cut(sigs)
    classes = cut(classes_of(sigs, key))
    pairs = candidate_pairs(classes, key, permutations, threshold)
    links = pairs.select(F.explode(F.array("i", "j")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    named = classes.select(F.xxhash64("signature").alias("__q_h"), F.col(key).alias("class")).join(links, "class", "left")
    return sigs.select(key, F.xxhash64("signature").alias("__q_h")).join(named, "__q_h").select(key, "class", F.coalesce("links", F.lit(0).cast("long")).alias("links"))


def jaccard_estimate(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda e: e)) / F.size(a)


def near(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.85, permutations: int = 128) -> DataFrame:
    """docs without those that an earlier one (by key, nulls last, then by a hash of the text) resembles in at least threshold
    of the signature, and without null and empty texts. Of rows that are equal in key and text one stays.

    Classes of equal signatures are compared once: a class's first row stands for it; all its others are duplicates.
    """
    from quern.operators.corpus import in_order
    from quern.plans.lineage import written

    docs = docs.filter(F.length(text) > 0)
    name = F.struct(F.isnull(key).alias("no_key"), F.col(key).alias("key"), F.xxhash64(text).alias("same"))
    keyed = docs.select(F.col(key).alias("__q_key"), F.xxhash64(text).alias("__q_same"), text)
    sigs = signatures(keyed, text, ["__q_key", "__q_same"], permutations)
    sigs = written(sigs.select(F.struct(F.isnull("__q_key").alias("no_key"), F.col("__q_key").alias("key"), F.col("__q_same").alias("same")).alias("name"), "signature"), "signatures")
    classes = in_order(classes_of(sigs, "name"), ["name"])
    classes = classes.withColumn("id", F.shiftleft(F.col("__q_p").cast("long"), 33) + F.col("__q_i"))
    # A later class member that resembles an earlier class resembles its first row.
    kept = classes.select("id", "name").join(resembling(classes, permutations, threshold), "id", "left_anti").select("name")
    several = written(sigs.groupBy("name").count().filter("count > 1").select("name", F.lit(True).alias("__q_several")), "several")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if several.isEmpty():
        return _semi(docs, name, kept).select(columns)
    named = _semi(docs, name, kept).join(several.withColumnRenamed("name", "__q_name"), "__q_name", "left")
    once = one_of_equal(named.filter("__q_several").drop("__q_several"), "__q_name")
    return named.filter("__q_several IS NULL").select(columns).unionByName(once.select(columns))


def _semi(docs: DataFrame, name: Column, kept: DataFrame) -> DataFrame:
    """The rows of docs whose name is in kept(name), with it as __q_name."""
    return docs.withColumn("__q_name", name).join(kept.withColumnRenamed("name", "__q_name"), "__q_name", "left_semi")


def remember(docs: DataFrame, path: str, text: str = "text") -> None:
    """Append the content hashes of docs to the table at path, which ``unseen`` of a later run reads."""
    docs.filter(~blank(F.col(text))).select(content_hash(F.col(text)).alias("content_hash")).distinct().write.mode("append").parquet(path)


def remember_signatures(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> None:
    """Append the signatures of docs to the table at path, which ``near_unseen`` of a later run reads."""
    signatures(docs.filter(F.length(text) > 0), text, key).write.mode("append").parquet(path)


def near_unseen(docs: DataFrame, seen: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.85, permutations: int = 128) -> DataFrame:
    """docs without those that an earlier one of them or of seen(signature) resembles."""
    from quern.plans.lineage import cut

    fresh = near(docs, text, key, threshold, permutations)
    name = F.struct(F.isnull(key).alias("no_key"), F.col(key).alias("key"), F.xxhash64(text).alias("same"))
    keyed = fresh.select(F.col(key).alias("__q_key"), F.xxhash64(text).alias("__q_same"), text)
    own = signatures(keyed, text, ["__q_key", "__q_same"], permutations)
    own = cut(own.select(F.struct(F.isnull("__q_key").alias("no_key"), F.col("__q_key").alias("key"), F.col("__q_same").alias("same")).alias("name"), "signature"))
    b, r = bands_for(permutations, threshold)
    bands = F.explode(F.transform(F.sequence(F.lit(0), F.lit(b - 1)), lambda k: F.xxhash64(k, F.slice("signature", k * r + 1, r)))).alias("band")
    old = seen.select("signature").distinct()
    old = cut(old.withColumn("old", F.xxhash64("signature")))
    met = own.select("name", bands).join(old.select("old", bands), "band").select("name", "old").distinct()
    close = met.join(own, "name").join(old.select("old", F.col("signature").alias("s")), "old").filter(jaccard_estimate(F.col("signature"), F.col("s")) >= threshold)
    left = own.select("name").join(close.select("name").distinct(), "name", "left_anti")
    return _semi(fresh, name, left).drop("__q_name").select([F.col(f"`{c}`") for c in docs.columns])


def jaccard_exact(pairs: DataFrame, docs: DataFrame, text: str = "text", key: str = "doc_id", n: int = 5) -> DataFrame:
    """i, j and the Jaccard likeness of their character shingles, for given pairs(i, j). Texts meet, which are shorter than
    their shingles, and each pair's shingles are compared in a task as numbers."""
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def jaccard(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([likeness(a or "", b or "", n) for a, b in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    left, right = (docs.select(F.col(key).alias(x), F.col(text).alias(f"s{x}")) for x in "ij")
    return pairs.join(left, "i").join(right, "j").select("i", "j", jaccard("si", "sj").alias("jaccard"))


def likeness(a: str, b: str, n: int = 5) -> float:
    """The Jaccard likeness of the distinct runs of n characters of two texts; 0 if neither has one."""
    points = np.frombuffer((a + b).encode("utf-32-le"), np.uint32).astype(np.int64)
    bits = 63 // n
    if len(points) and points.max() >> bits:  # rarer characters by their place among those of both texts
        points = np.unique(points, return_inverse=True)[1]
    if len(points) and points.max() >> bits:
        x, y = ({t[i : i + n] for i in range(len(t) - n + 1)} for t in (a, b))
        return len(x & y) / len(x | y) if x or y else 0.0

    def runs(p: np.ndarray) -> np.ndarray:
        size = max(0, len(p) - n + 1)
        return np.unique(sum((p[i : i + size] << bits * i for i in range(n)), np.zeros(size, np.int64)))

    x, y = runs(points[: len(a)]), runs(points[len(a) :])
    both = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - both
    return both / union if union else 0.0


def first_rows(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """The first row of each key by order."""
    return df.withColumn("__q_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).filter("__q_rn = 1").drop("__q_rn")
