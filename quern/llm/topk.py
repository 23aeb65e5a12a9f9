"""Exact top-k by inner product with KD-trees per shard.

Vectors become integers, floor(256 * x). Shards are the cells of median splits: in each pass every cell of more than
``SHARD_ROWS`` rows is split by planes that are found on a bounded sample of its own rows, some levels at a time, until no
cell is larger or none can be split (equal vectors), which is dealt over several shards by hash. The samples only decide
how even and tight the shards are. In its shard a KD-tree splits at the median of the widest component down to
``LEAF_ROWS`` rows; each node keeps the bounding box of its rows and their least id. The largest inner product that a box
allows is sum(max(q_i * low_i, q_i * high_i)); the traversal opens nodes by falling bounds and ends below the k-th score
so far.

Queries run twice: first in the shard whose box allows most, which yields a k-th score for each query; then, with that
score handed on, in every other shard whose box may still reach it. Queries are routed in blocks of ``BLOCK`` against
``BOXES`` boxes at a time, and meet a shard in such blocks; the driver sees counts alone.

Defined cases: an empty table gives an empty result; other columns are ignored; vectors that are null, empty or hold null
or non-finite components take no part, neither do components whose integers pass 2**53; only vectors of equal length are
compared; repeated rows are candidates each, but ask once; ids that are null take no part; a query's candidates are all rows
with another id; scores are exact as long as they fit into 63 bits.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import salted_join
from quern.plans.lineage import written
from quern.session import ship

K, EVERY, SCALE = 5, 50, 256
SHARD_ROWS, LEAF_ROWS, BLOCK, BOXES = 20_000, 64, 5_000, 2_048
#: Rows of a cell that its planes are found on, about, and levels of splits that a pass adds at most.
SAMPLE, LEVELS = 2_048, 6


def integers(table: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and vector array<long> of the rows of table(vec_id, embedding) that take part."""
    ship(table.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, vectors = [], []
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                    continue
                x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
                if np.isfinite(x).all() and np.abs(x).max() < 2.0**53:
                    ids.append(i)
                    vectors.append(x.astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(vectors, pa.list_(pa.int64()))], ["vec_id", "vector"])

    return table.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(each, "vec_id long, vector array<long>")


def cells(sample: np.ndarray, depth: int) -> list[tuple[int, float] | None]:
    """Median splits of the widest components as an implicit binary tree: (component, bound) of each inner node."""
    planes: list[tuple[int, float] | None] = [None] * ((1 << depth) - 1)
    groups = {0: np.arange(len(sample))}
    for node in range(len(planes)):
        rows = groups.pop(node, None)
        if rows is None or len(rows) < 2:
            continue
        part = sample[rows]
        axis = int(np.argmax(part.max(0) - part.min(0)))
        bound = float(np.median(part[:, axis]))
        right = part[:, axis] > bound
        if right.any():
            planes[node] = (axis, bound)
            groups[2 * node + 1], groups[2 * node + 2] = rows[~right], rows[right]
    return planes


def cell_of(vectors: np.ndarray, planes: list[tuple[int, float] | None]) -> np.ndarray:
    out, rows = np.zeros(len(vectors), np.int64), [(0, np.arange(len(vectors)))]
    while rows:
        node, which = rows.pop()
        plane = planes[node] if node < len(planes) else None
        if plane is None or not len(which):
            out[which] = node
            continue
        right = vectors[which, plane[0]] > plane[1]
        rows += [(2 * node + 1, which[~right]), (2 * node + 2, which[right])]
    return out


class Tree:
    """A KD-tree over integer vectors; nodes stand in arrays, leaves are ranges of the reordered rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        by_id = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[by_id], vectors[by_id]
        self.low, self.high, self.first, self.children, self.spans = [], [], [], [], []
        order = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            part = self.vectors[order[a:b]]
            node = len(self.low)
            low, high = part.min(0), part.max(0)
            self.low.append(low)
            self.high.append(high)
            self.first.append(int(self.ids[order[a:b]].min()))
            self.children.append([-1, -1])
            self.spans.append((a, b))
            if parent >= 0:
                self.children[parent][side] = node
            if b - a > leaf:
                axis = int(np.argmax(high - low))
                # Stable, so that equal vectors stay in the order of their ids.
                order[a:b] = order[a:b][np.argsort(part[:, axis], kind="stable")]
                middle = (a + b) // 2
                todo += [(middle, b, node, 1), (a, middle, node, 0)]
        self.ids, self.vectors = self.ids[order], self.vectors[order]
        self.low, self.high = np.array(self.low), np.array(self.high)
        # Products of doubles are exact below 2**53.
        most = float(np.abs(self.vectors).max()) if len(ids) else 0.0
        self.most = most * self.vectors.shape[1]

    def top(self, q_ids: np.ndarray, queries: np.ndarray, k: int, kth: np.ndarray | None = None) -> Iterator[list[tuple[int, int]]]:
        """For each query its best (score, vec_id), best first, k at most; kth: a score that k rows elsewhere reach."""
        exact = self.most * float(np.abs(queries).max() if len(queries) else 0) < 2.0**53
        kind = np.float64 if exact else np.int64
        low, high, rows = (x.astype(kind) for x in (self.low, self.high, self.vectors))
        for at in range(0, len(queries), 256):
            q = queries[at : at + 256].astype(kind)
            bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
            for i in range(len(q)):
                yield self._search(int(q_ids[at + i]), q[i], bounds[i], rows, k, None if kth is None else int(kth[at + i]))

    def _search(self, own: int, q: np.ndarray, bound: np.ndarray, rows: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        best: list[tuple[int, int]] = []  # a heap of (score, -id), the worst on top
        todo = [(-bound[0], self.first[0], 0)]
        while todo:
            b, first, node = heapq.heappop(todo)
            if floor is not None and -b < floor:
                break
            if len(best) == k and ((-b) < best[0][0] or (-b == best[0][0] and first > -best[0][1])):
                if -b < best[0][0]:
                    break
                continue
            left, right = self.children[node]
            if left >= 0:
                for child in (left, right):
                    heapq.heappush(todo, (-bound[child], self.first[child], child))
                continue
            a, e = self.spans[node]
            scores = rows[a:e] @ q
            least = best[0][0] if len(best) == k else -np.inf
            for j in np.flatnonzero(scores >= (least if floor is None else max(least, floor))):
                vec = int(self.ids[a + j])
                if vec == own:
                    continue
                entry = (int(scores[j]), -vec)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(s, -v) for s, v in sorted(best, reverse=True)]


def _planes(rows: DataFrame, large: DataFrame, shard_rows: int) -> DataFrame:
    """cell and planes (as JSON) of the cells of large(cell, n) that can be split, from rows(vec_id, vector, cell)."""

    def each(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        depth = int(min(LEVELS, np.ceil(np.log2(f["n"].iloc[0] / shard_rows))))
        found = cells(np.stack(f["vector"]), max(1, depth))
        return pd.DataFrame({"cell": [key[0]], "planes": [json.dumps(found)]} if found[0] is not None else {"cell": [], "planes": []}, dtype=object)

    place = F.pmod(F.xxhash64("vec_id", "vector", F.lit(3)), F.lit(1 << 30))
    sample = salted_join(rows, large, "cell", by=["vec_id"]).filter(place < F.lit(float(SAMPLE << 30)) / F.col("n"))
    return sample.groupBy("cell").applyInPandas(each, "cell string, planes string")


def _split(rows: DataFrame, planes: DataFrame) -> DataFrame:
    """rows(vec_id, vector, cell) with the cells that planes divide named anew."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = np.array(batch.column(2).to_pylist(), object)
            by = {c: p for c, p in zip(names, batch.column(3).to_pylist(), strict=True) if p is not None}
            for cell, text in by.items():
                at = np.flatnonzero(names == cell)
                x = batch.column(1).take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
                names[at] = [f"{cell}.{node}" for node in cell_of(x, json.loads(text)).tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names.tolist(), pa.string())], ["vec_id", "vector", "cell"])

    joined = salted_join(rows, planes, "cell", "left", by=["vec_id"]).select("vec_id", "vector", "cell", "planes")
    return joined.mapInArrow(each, "vec_id long, vector array<long>, cell string")


def shards(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """vec_id, vector, size and shard of vectors(vec_id, vector)."""
    rows = written(vectors.withColumn("cell", F.size("vector").cast("string")), "cells")
    while True:
        large = written(rows.groupBy("cell").agg(F.count("*").alias("n")).filter(F.col("n") > shard_rows), "large")
        planes = written(_planes(rows, large, shard_rows), "planes")
        if planes.isEmpty():
            break
        rows = written(_split(rows, planes), "cells")
    parts = large.select("cell", F.ceil(F.col("n") / shard_rows).alias("parts"))
    dealt = salted_join(rows, parts, "cell", "left", by=["vec_id"])
    part = F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("string")
    return dealt.select("vec_id", "vector", F.size("vector").alias("size"), F.concat_ws("/", "cell", part).alias("shard"))


def _boxes(sharded: DataFrame) -> DataFrame:
    """shard, size, low and high: one row a shard."""

    def each(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(f["vector"])
        return pd.DataFrame({"shard": [key[0]], "size": [x.shape[1]], "low": [x.min(0)], "high": [x.max(0)]}, dtype=object)

    return sharded.groupBy("shard").applyInPandas(each, "shard string, size int, low array<long>, high array<long>")


def _routes(queries: DataFrame, boxes: DataFrame, blocks: int, chunks: int, first: bool) -> DataFrame:
    """query_id, block, shard and bound: the best box of each chunk for each query, or all but its home that reach kth."""

    def each(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(b):
            low, high = (np.stack(b[c]).astype(np.float64) for c in ("low", "high"))
            names = b["shard"].to_numpy()
            for i in range(0, len(q), 512):
                part = q.iloc[i : i + 512]
                x = np.stack(part["query"]).astype(np.float64)
                bounds = np.maximum(x, 0) @ high.T + np.minimum(x, 0) @ low.T
                if first:
                    best = bounds.argmax(1)
                    out.append(pd.DataFrame({"query_id": part["query_id"], "block": part["block"], "shard": names[best], "bound": bounds[np.arange(len(best)), best]}))
                    continue
                # Rounding may lower a bound of very large integers.
                kth = part["kth"].astype(float).fillna(-np.inf).to_numpy()
                at, to = np.nonzero(bounds * (1 + 1e-12 * np.sign(bounds)) + 1 >= kth[:, None])
                found = pd.DataFrame({"query_id": part["query_id"].to_numpy()[at], "block": part["block"].to_numpy()[at], "shard": names[to], "bound": bounds[at, to]})
                out.append(found[found["shard"].to_numpy() != part["home"].to_numpy()[at]])
        found = pd.concat(out) if out else pd.DataFrame({"query_id": [], "block": [], "shard": [], "bound": []})
        return found.astype({"shard": object})  # one array, however many parts it came from

    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.withColumn("chunk", all_of(chunks))
    right = boxes.withColumn("chunk", F.pmod(F.xxhash64("shard"), F.lit(chunks)).cast("int")).withColumn("block", all_of(blocks))
    return left.groupBy("size", "block", "chunk").cogroup(right.groupBy("size", "block", "chunk")).applyInPandas(each, "query_id long, block int, shard string, bound double")


def top_k(table: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, shard_rows: int = SHARD_ROWS, block: int = BLOCK, at_once: int = BOXES) -> DataFrame:
    """query_id, rank, vec_id and score of the best k of all other rows for each row whose vec_id is divisible by every."""
    # Of equal rows no more than k can be among the best k.
    equal = integers(table, scale).groupBy("vec_id", "vector").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    sharded = written(shards(equal.select("vec_id", "vector", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy"), shard_rows), "shards")
    boxes = written(_boxes(sharded), "boxes")
    asked = sharded.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query"), "size").distinct()
    blocks, chunks = max(1, -(-asked.count() // block)), max(1, -(-boxes.count() // at_once))
    queries = written(asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")), "queries")

    def answer(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            tree = Tree(right["vec_id"].to_numpy(), np.stack(right["vector"]).astype(np.int64))
            kth = None if left["kth"].isna().any() else left["kth"].to_numpy().astype(np.int64)
            q_ids = left["query_id"].to_numpy()
            for i, found in zip(q_ids, tree.top(q_ids, np.stack(left["query"]).astype(np.int64), k, kth), strict=True):
                out += [(int(i), v, s, int(len(found) == k)) for s, v in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score", "whole"]).astype("int64")

    def search(routes: DataFrame, known: DataFrame) -> DataFrame:
        # A block of queries meets its own copy of a shard: blocks x shards groups of bounded size.
        visited = routes.select(F.col("shard").alias("to_shard"), F.col("block").alias("to_block")).distinct()
        left = routes.select("query_id", "block", "shard").join(known.select("query_id", "query", "kth"), "query_id")
        right = sharded.select("vec_id", "vector", F.col("shard").alias("to_shard")).join(visited, "to_shard")
        return left.groupBy("shard", "block").cogroup(right.groupBy("to_shard", "to_block")).applyInPandas(answer, "query_id long, vec_id long, score long, whole long")

    best = _routes(queries, boxes, blocks, chunks, first=True)
    home = best.groupBy("query_id").agg(F.max_by(F.struct("block", "shard"), F.struct("bound", "shard")).alias("x")).select("query_id", "x.*")
    home = written(home, "homes")
    near = written(search(home, queries.withColumn("kth", F.lit(None).cast("long"))), "near")
    kth = near.filter("whole = 1").groupBy("query_id").agg(F.min("score").alias("kth"))
    known = written(queries.join(kth, "query_id", "left").join(home.select("query_id", F.col("shard").alias("home")), "query_id"), "known")
    far = search(written(_routes(known, boxes, blocks, chunks, first=False), "routes"), known)
    both = near.union(far).groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    out = both.select("query_id", F.posexplode("best").alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x")["vec_id"].alias("vec_id"), (-F.col("x")["s"]).alias("score"))


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM (SELECT DISTINCT * FROM v) q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
