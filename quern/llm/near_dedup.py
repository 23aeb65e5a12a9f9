"""Near-duplicate detection with bottom-k sketches from one hash function.

A document's set holds its distinct shingles of five words. Documents with equal sets form a class; everything below
happens between classes. A class keeps the ``k`` least hashes of its set (its sketch). Two sets of Jaccard likeness 0.75
share at least ``COMMON`` = 10 of 32 retained values with all but a chance of about 3e-8 (a set of at most 24 shingles is
its own sketch, and no chance is left), so in any order of the values, they share one among the first k - 10 + 1. The
order puts values that many classes retain last, so common lines and passages make no candidates unless nothing else can.

Inverted lists of those first values generate the candidates. A list of at most ``LIST`` classes yields its pairs, which
an estimate filters: among the k least values of the union of both sketches at least ``COMMON`` must lie in both.

Classes that stand in longer lists (large families of near copies) get sketches of ``WIDE`` values, which are whole sets
but for very long texts, and the same lists over these. There a value's place tells how much a class can share with one
that it first meets there, so documents that hold a large common part, but not enough of it to be near, leave the lists
that remain long. In each of these, the class that retains the most common values is compared with all others. Lists with
one such centre form a group; classes that are linked to the centre need no further comparing, and the rest of the group
is compared with the whole group in cells of two blocks, by products of incidence matrices, which emit links alone.

Candidates are decided on full sets, for which the texts of the classes at hand are shuffled once. Pairs meet by
neighbourhood: pairs around the same least class form one, dealt into blocks of about ``BLOCK`` shingles, so that a set
travels once per block and not once per pair, and a cell of two blocks is bounded however large a family or a text is.

Nothing is collected, and nothing broadcast but the common values, if their table is small; else they are joined, with the
same result. Joins whose keys can be hot (a common value, a neighbourhood, a group) are salted, and the names of very large classes go to where
their rows are; the star joins between links are left to adaptive execution, which splits the partitions of a large star.

Defined cases: null text counts as empty, and empty sets link with nothing (each such row is its own component); repeated
rows are copies; an empty table gives an empty result; a null id is never the least id of a component, and a component of
which no row has an id has none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import buffer_of, list_array, mix, parted_join, salted_join, slices, span_hashes, strings, word_hashes
from quern.llm.components import components
from quern.llm.line_dedup import _LOWER, words_of
from quern.plans.lineage import written
from quern.session import ship

K, COMMON, LIST = 32, 10, 64
#: The same for classes of large families; it again leaves six standard deviations.
WIDE, WIDE_COMMON = 1 << 14, 11_955
#: Shingles of a block of classes, on average.
BLOCK = 1 << 16
#: Values of long lists that are sent to all tasks at most (16 MB of them and their numbers); more are joined.
SENT_VALUES = 1 << 20
WORDS, NEAR = 5, 75
_NO_ID = (1 << 63) - 1
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct 63-bit hashes of its shingles."""
    raw, offsets = buffer_of(strings(column))
    for i, j in slices(np.diff(offsets)):
        part = _LOWER[raw[offsets[i] : offsets[j]]]
        own = offsets[i : j + 1] - offsets[i]
        if not len(part):
            yield from (np.empty(0, np.int64) for _ in range(j - i))
            continue
        starts, ends = words_of(part, own[:-1][own[:-1] < len(part)])
        hashes = word_hashes(part, starts, ends)
        bounds = np.searchsorted(starts, own)
        m = max(0, len(hashes) - words + 1)
        rolled = np.zeros(m, np.uint64)
        for k in range(words):
            rolled += hashes[k : k + m] * (_STEP[k % len(_STEP)] + np.uint64(2 * (k // len(_STEP))))
        rolled = (mix(rolled) >> np.uint64(1)).astype(np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= words:
                yield np.unique(rolled[a : b - words + 1])
            elif b > a:
                whole = span_hashes(hashes[a:b], np.array([0]), np.array([b - a]))
                yield (whole >> np.uint64(1)).astype(np.int64)
            else:
                yield np.empty(0, np.int64)


def _class_of(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) >> 1


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def sketches(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text_key (a hash of the text), n (distinct shingles), class (null for an empty set) and sketch of each row
    of docs(doc_id, text)."""
    ship(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, classes, kept = [], [], []
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                classes.append(_class_of(s) if len(s) else None)
                kept.append(s[:k])
            flat = np.concatenate(kept) if kept else np.empty(0, np.int64)
            lists = list_array(flat, np.array([len(s) for s in kept], np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(classes, pa.int64()), lists], ["doc_id", "text_key", "n", "class", "sketch"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_key(F.col("text")).alias("text_key"))
    return rows.mapInArrow(each, "doc_id long, text_key long, n long, class long, sketch array<long>")


def _least_common(n: np.ndarray, k: int, common: int) -> np.ndarray:
    """Retained values that a set of n shingles shares with any set near enough to it. A set of at most k shingles is
    whole; a set near to it has at most n / 0.75, of which k are retained."""
    return np.where(n <= k, np.maximum(1, np.ceil(0.75 * n - np.maximum(0, n / 0.75 - k) - 1e-9)), common).astype(np.int64)


def entries(classes: DataFrame, k: int = K, common: int = COMMON, most: int = LIST, sent_values: int = SENT_VALUES) -> DataFrame:
    """value, class, n, hot, weight and reach: the inverted lists of the values of each class that must be looked at.
    reach: the largest set that can be near the class if this is the first value that both have."""
    own = classes.select("class", F.explode("sketch").alias("value"))
    often = written(own.groupBy("value").agg(F.count("*").alias("often")).filter(F.col("often") > most), "often")
    none = F.array().cast("array<struct<value: bigint, often: bigint>>")
    if often.count() <= sent_values:
        known = classes.select("class", "n", "sketch").withColumn("hot", none)
        sent = classes.sparkSession.sparkContext.broadcast(tuple(often.orderBy("value").toArrow().column(c).to_numpy() for c in ("value", "often")))
    else:
        hot = salted_join(own, often, "value").groupBy("class").agg(F.collect_list(F.struct("value", "often")).alias("hot"))
        known = classes.select("class", "n", "sketch").join(hot, "class", "left").withColumn("hot", F.coalesce("hot", none))
        sent = None

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, sizes = batch.column(2), batch.column(1).to_numpy()
            flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
            if not len(flat):
                continue
            if sent is not None:
                known, often = sent.value
            else:
                hot = batch.column(3).flatten()
                known, first = np.unique(hot.field(0).to_numpy(), return_index=True)
                often = hot.field(1).to_numpy()[first]
            s = np.diff(ends, prepend=0)
            owner = np.repeat(np.arange(len(s)), s)
            at = np.minimum(np.searchsorted(known, flat), max(0, len(known) - 1))
            n = np.where(known[at] == flat, often[at], 0) if len(known) else np.zeros(len(flat), np.int64)
            weight = np.bincount(owner, weights=n, minlength=len(s)).astype(np.int64)
            order = np.lexsort((flat, n, owner))
            rank = np.arange(len(flat)) - (ends - s)[owner[order]]
            used = rank < (s - np.minimum(_least_common(sizes, k, common), s) + 1)[owner[order]]
            use, rank = order[used], rank[used]
            o = owner[use]
            # Sets a, b that are near share 3/7 of their sizes' sum, so from here on at least that must be left of a. It
            # holds for those that are whole with all that can be near to them.
            reach = np.where(sizes[o] * 100 <= k * NEAR, (7 * (sizes[o] - rank)) // 3 - sizes[o], _NO_ID)
            ids = batch.column(0).to_numpy()
            columns = [pa.array(flat[use]), pa.array(ids[o]), pa.array(sizes[o]), pa.array(n[use] > 0), pa.array(weight[o]), pa.array(reach)]
            yield pa.RecordBatch.from_arrays(columns, ["value", "class", "n", "hot", "weight", "reach"])

    return known.mapInArrow(each, "value long, class long, n long, hot boolean, weight long, reach long")


def _sizes_fit(a: Column, b: Column) -> Column:
    return (a * 100 >= b * NEAR) & (b * 100 >= a * NEAR)


def short_list_pairs(lists: DataFrame) -> DataFrame:
    """a < b: pairs of classes of one list, whose sizes allow the likeness."""
    grouped = lists.groupBy("value").agg(F.collect_list(F.struct("class", "n", "reach")).alias("own")).filter(F.size("own") > 1)
    first = grouped.select("own", F.posexplode("own").alias("i", "x"))
    x = F.col("x")
    other = F.filter("own", lambda y: (y["class"] > x["class"]) & _sizes_fit(y["n"], x["n"]) & (y["n"] <= x["reach"]) & (x["n"] <= y["reach"]))
    return first.select(x["class"].alias("a"), F.explode(other).alias("y")).select("a", F.col("y")["class"].alias("b"))


def within_reach(long: DataFrame) -> DataFrame:
    """The entries of long lists that another entry of their list can be near to: of two, the smaller reaches the larger,
    so a list needs a class that reaches its own size, and the others those sizes."""
    able = F.col("reach") >= F.col("n")
    spans = long.filter(able).groupBy("value").agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    return salted_join(long, spans, "value").filter(able | ((F.col("n") <= F.col("most")) & (F.col("reach") >= F.col("least")))).drop("least", "most")


def likely(pairs: DataFrame, classes: DataFrame, k: int = K, common: int = COMMON) -> DataFrame:
    """The pairs (a, b) that the estimate from the union of both sketches leaves."""
    left = classes.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    right = classes.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    both = F.array_intersect("sa", "sb")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    exact = F.size(both) * 100 >= (F.col("na") + F.col("nb") - F.size(both)) * NEAR
    passed = F.when(whole, exact).otherwise(F.size(F.array_intersect(union, both)) >= common)
    return pairs.distinct().join(left, "a").join(right, "b").filter(passed).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect what the pairs (a, b) with near enough sets connect."""
    pairs = written(pairs.distinct(), "candidates")
    ends = pairs.select(F.col("a").alias("class"), F.col("b").alias("other")).union(pairs.select("b", "a"))
    least = ends.groupBy("class").agg(F.min("other").alias("m")).select("class", F.least("class", "m").alias("m")).join(sets.select("class", "n"), "class")
    of_a, of_b = (least.select(F.col("class").alias(x), F.col("m").alias(f"m{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    near = written(pairs.join(of_a, "a").join(of_b, "b").select("a", "b", "na", "nb", F.least("ma", "mb").alias("home")), "homes")
    ends = F.array(F.struct(F.col("a").alias("class"), F.col("na").alias("n")), F.struct(F.col("b").alias("class"), F.col("nb").alias("n")))
    members = near.select("home", F.explode(ends).alias("x")).select("home", "x.*").distinct()
    blocks = members.groupBy("home").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks")).filter("blocks > 1")
    part = lambda c: F.pmod(F.xxhash64(c), F.coalesce("blocks", F.lit(1))).cast("int")
    cells = salted_join(near.select("a", "b", "home"), blocks, "home", "left").select("a", "b", "home", part("a").alias("pa"), part("b").alias("pb"))
    cells = cells.select("a", "b", "home", F.least("pa", "pb").alias("p1"), F.greatest("pa", "pb").alias("p2"))
    cells = written(cells, "cells")
    places = cells.select(F.explode(F.array("a", "b")).alias("class"), F.col("home").alias("h"), F.col("p1").alias("q1"), F.col("p2").alias("q2")).distinct()
    given = sets.join(places, "class")

    def decide(left: pa.Table, right: pa.Table) -> pa.Table:
        lists = right.column("shingles").combine_chunks()
        flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy())
        own = {c: flat[e - n : e] for c, e, n in zip(right.column("class").to_pylist(), ends.tolist(), lists.value_lengths().to_pylist(), strict=True)}
        root = {c: c for c in own}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out = []
        for a, b in sorted(zip(left.column("a").to_pylist(), left.column("b").to_pylist(), strict=True)):
            if a not in own or b not in own or (x := find(a)) == (y := find(b)):
                continue
            s, t = own[a], own[b]
            if min(len(s), len(t)) * 100 < max(len(s), len(t)) * NEAR:
                continue
            both = len(np.intersect1d(s, t, assume_unique=True))
            if both * 100 >= (len(s) + len(t) - both) * NEAR:
                root[max(x, y)] = min(x, y)
                out.append((a, b))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    # A cell holds two blocks of classes at most, however large a family is.
    return cells.groupBy("home", "p1", "p2").cogroup(given.groupBy("h", "q1", "q2")).applyInArrow(decide, "a long, b long")


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """class, n and shingles of the classes of wanted(class, rid, rkey: id and key of one text), from docs(doc_id, text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                sets = list(shingle_sets(batch.column(0).slice(i, 500)))
                flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
                n = np.array([len(s) for s in sets], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([_class_of(s) for s in sets], pa.int64()), pa.array(n), list_array(flat, n, pa.int64())], ["class", "n", "shingles"])

    texts = docs.select(_id_key().alias("rid"), text_key(F.col("text")).alias("rkey"), "text").join(wanted, ["rid", "rkey"], "left_semi")
    # Rows that repeat an id and a text repeat their set.
    return texts.select("text").mapInArrow(each, "class long, n long, shingles array<long>").dropDuplicates(["class"])


def _id_key() -> Column:
    return F.coalesce("doc_id", F.lit(_NO_ID))


def near_links(docs: DataFrame, classes: DataFrame, k: int = K, common: int = COMMON, most: int = LIST, wide: int = WIDE, wide_common: int = WIDE_COMMON, block: int = BLOCK) -> DataFrame:
    """node and root of every class that is linked to another; classes(class, n, rid, rkey, sketch) of docs(doc_id, text)."""
    lists = written(entries(classes, k, common, most), "lists")
    pairs = written(likely(short_list_pairs(lists.filter("not hot")), classes, k, common), "pairs")
    crowded = lists.filter("hot").select("class").distinct()
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).union(crowded).distinct()
    sets = written(full_sets(docs, wanted.join(classes.select("class", "rid", "rkey"), "class")), "sets")
    sketched = sets.join(crowded, "class", "left_semi").select("class", "n", F.slice("shingles", 1, wide).alias("sketch"))
    again = written(entries(sketched, wide, wide_common, most), "wide-lists")
    pairs = pairs.union(short_list_pairs(again.filter("not hot")))
    long = written(within_reach(again.filter("hot")), "long")
    any_long = not long.isEmpty()
    if any_long:
        tops = long.groupBy("value").agg(F.max_by(F.struct("class", "n"), F.struct("weight", "class")).alias("top")).select("value", F.col("top.class").alias("top"), F.col("top.n").alias("tn"))
        long = written(salted_join(long, tops, "value").select("top", "tn", "class", "n").distinct(), "groups")
        star = long.filter((F.col("class") != F.col("top")) & _sizes_fit(F.col("n"), F.col("tn")))
        pairs = pairs.union(star.select(F.least("class", "top").alias("a"), F.greatest("class", "top").alias("b")))
    links = written(components(written(confirmed(pairs, sets, block), "links")), "components")
    if any_long:
        more = written(_rest_links(long, links, sets, block), "rest-links")
        if not more.isEmpty():
            links = written(components(more.union(links.select(F.col("node").alias("a"), F.col("root").alias("b")))), "components")
    return links


def _rest_links(groups: DataFrame, links: DataFrame, sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between the classes of groups(top, class, n) that are not in their top's component and all of the group."""
    root = links.select("node", "root")
    rooted = groups.join(root.withColumnRenamed("node", "class"), "class", "left").select("top", "class", "n", F.coalesce("root", "class").alias("root"))
    of_top = groups.select("top").distinct().join(root.withColumnRenamed("node", "top"), "top", "left").select("top", F.coalesce("root", "top").alias("top_root"))
    rooted = written(salted_join(rooted, of_top, "top").select("top", "class", "n", (F.col("root") != F.col("top_root")).alias("rest")), "rooted")
    blocks = lambda c: F.greatest(F.ceil(F.sum(c) / block), F.lit(1)).cast("int")
    sizes = rooted.groupBy("top").agg(blocks("n").alias("all"), blocks(F.when(F.col("rest"), F.col("n")).otherwise(0)).alias("some"), F.max("rest").alias("any")).filter("any").drop("any")
    part = lambda n: F.pmod(F.xxhash64("class"), F.col(n)).cast("int")
    placed = written(salted_join(rooted, sizes, "top").select("top", "class", "rest", "all", "some", part("all").alias("pa"), part("some").alias("ps")), "placed")
    sets = sets.select("class", "shingles")
    left = placed.filter("rest").select("class", F.col("top").alias("lt"), F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("li"), F.col("ps").alias("lj"))
    right = placed.select("class", F.col("top").alias("rt"), F.col("pa").alias("ri"), F.explode(F.sequence(F.lit(0), F.col("some") - 1)).alias("rj"))

    def decide(x: pa.Table, y: pa.Table) -> pa.Table:
        out = linked_sets(*_sets_of(x, "class", "shingles"), *_sets_of(y, "rc", "rs"))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    others = sets.select(F.col("class").alias("rc"), F.col("shingles").alias("rs")).join(right.withColumnRenamed("class", "rc"), "rc")
    return sets.join(left, "class").groupBy("lt", "li", "lj").cogroup(others.groupBy("rt", "ri", "rj")).applyInArrow(decide, "a long, b long")


def _sets_of(t: pa.Table, key: str, values: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lists = t.column(values).combine_chunks()
    return t.column(key).to_numpy(), lists.flatten().to_numpy(), lists.value_lengths().to_numpy().astype(np.int64)


def linked_sets(a: np.ndarray, a_flat: np.ndarray, a_sizes: np.ndarray, b: np.ndarray, b_flat: np.ndarray, b_sizes: np.ndarray, columns: int = 2_048) -> list[tuple[int, int]]:
    """Near enough pairs of the sets of a with those of b, without those that others of them imply. Only shared values
    enter the matrices, some columns at a time."""
    if not len(a_flat) or not len(b_flat):
        return []
    shared = np.intersect1d(a_flat, b_flat)
    both = np.zeros((len(a), len(b)), np.float32)
    sides = []
    for flat, sizes in ((a_flat, a_sizes), (b_flat, b_sizes)):
        at = np.minimum(np.searchsorted(shared, flat), max(0, len(shared) - 1))
        hit = shared[at] == flat if len(shared) else np.zeros(len(flat), bool)
        sides.append((np.repeat(np.arange(len(sizes)), sizes)[hit], at[hit]))
    for i in range(0, len(shared), columns):
        m = []
        for (row, at), n in zip(sides, (len(a), len(b)), strict=True):
            use = (at >= i) & (at < i + columns)
            x = np.zeros((n, min(columns, len(shared) - i)), np.float32)
            x[row[use], at[use] - i] = 1
            m.append(x)
        both += m[0] @ m[1].T
    near = both * 100 >= (a_sizes[:, None] + b_sizes[None] - both) * NEAR
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(near), strict=True):
        p, q = int(a[i]), int(b[j])
        x, y = find(p), find(q)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((min(p, q), max(p, q)))
    return out


def components_of(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, text_key, n_shingles, component_id (its component's least id) and root (the component itself; null for an
    empty set) of each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = written(sketches(docs, k), "sketches")
    one = F.min(F.struct(_id_key().alias("rid"), F.col("text_key").alias("rkey"))).alias("one")
    classes = rows.filter("class is not null").groupBy("class").agg(F.max("n").alias("n"), F.min("doc_id").alias("doc_id"), one, F.count("*").alias("rows"), F.first("sketch").alias("sketch"))
    classes = written(classes.select("class", "n", "doc_id", "one.*", "rows", "sketch"), "classes")
    links = near_links(docs, classes, k)
    of_class = classes.select("class", "doc_id", "rows").join(links.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))
    least = of_class.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = of_class.join(least, "root").select("class", "component_id", "root", "rows")
    full = parted_join(rows.filter("class is not null"), written(named, "named"), "class", "rows").select("doc_id", "text_key", F.col("n").alias("n_shingles"), "component_id", "root")
    return full.union(rows.filter("class is null").select("doc_id", "text_key", "n", F.col("doc_id"), F.lit(None).cast("long")))


def near_duplicates(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the id is the component's least) of each row of docs(doc_id, text)."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    return components_of(docs, k).select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def one_of_each(docs: DataFrame, k: int = K) -> DataFrame:
    """docs with one row of each component: that of the least id, of rows with this id the one of the least text key.
    Components go by their roots, as several can have the same least id or none; rows without shingles repeat each other
    if id and text are equal."""
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    alone = [F.when(F.col("root").isNull(), F.col(c)).alias(f"__q_{c}") for c in ("doc_id", "text_key")]
    groups = components_of(docs, k).filter(kept).groupBy("root", *alone)
    chosen = groups.agg(F.min("component_id").alias("__q_least"), F.min("text_key").alias("__q_least_key")).select("__q_least", "__q_least_key")
    keyed = docs.withColumn("__q_key", text_key(docs["text"]))
    left = keyed.join(chosen, docs["doc_id"].cast("long").eqNullSafe(F.col("__q_least")) & (F.col("__q_key") == F.col("__q_least_key")), "left_semi")
    return left.dropDuplicates(["doc_id", "__q_key"]).drop("__q_key")
