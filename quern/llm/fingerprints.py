"""Document fingerprints by winnowing.

Hashes of all k-grams of code points roll over the text; of every window of w hashes the least is chosen, the rightmost
of equal ones, and each choice is kept once with its position. Any common passage of at least w + k - 1 code points
therefore shares a chosen hash. A text shorter than k is one gram; an empty text has none.

Defined cases: null text counts as empty; likeness is the Jaccard likeness of the sets of hashes, 1 for two empty sets;
repeated rows each keep a row; rows with one doc_id are ordered by a hash of the text, null ids come last; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import list_array, mix, prefix_sums, shifted_back, span_hashes
from quern.session import ship

GRAM, WINDOW = 16, 16
#: Windows that are looked at together.
STEP = 1 << 17
_LOWEST = -(1 << 63)


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """The chosen 32-bit hashes of a text and their positions, in order."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    n = len(points)
    if not n:
        return np.empty(0, np.uint32), np.empty(0, np.int64)
    if n < gram:
        whole = span_hashes(points, np.array([0]), np.array([n]))
        return (whole >> np.uint64(32)).astype(np.uint32), np.zeros(1, np.int64)
    low = np.uint64(0xFFFFFFFF)
    most = min(window, n - gram + 1)
    out, last = [], None
    for a in range(0, n - gram - most + 2, STEP):  # windows that start here
        part = points[a : a + STEP + most + gram - 2]
        sums = prefix_sums(part)
        starts = np.arange(len(part) - gram + 1)
        hashes = mix(shifted_back(sums[gram:] - sums[:-gram], starts))
        # One key orders by hash, then from the right.
        keys = (hashes & ~low) | (low - (starts + a).astype(np.uint64))
        width, least = 1, keys
        while width * 2 <= most:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if most > width:
            least = np.minimum(least[: width - most], least[most - width :])
        fresh = np.concatenate(([last is None or least[0] != last], least[1:] != least[:-1]))
        out.append(least[fresh])
        last = least[-1]
    chosen = np.concatenate(out)
    return (chosen >> np.uint64(32)).astype(np.uint32), (low - (chosen & low)).astype(np.int64)


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """doc_id, hashes array<long> and positions array<long> of each row of docs(doc_id, text); no shuffle."""
    ship(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t or "", gram, window) for t in batch.column(1).to_pylist()]
            sizes = np.array([len(h) for h, _ in found], np.int64)
            flat = [np.concatenate([f[i] for f in found]).astype(np.int64) if len(found) else np.empty(0, np.int64) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(list_array(f, sizes, pa.int64()) for f in flat)], ["doc_id", "hashes", "positions"])

    return docs.select("doc_id", "text").mapInArrow(each, "doc_id long, hashes array<long>, positions array<long>")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard likeness of two sorted arrays of distinct hashes."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def in_order(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) dealt into blocks of descending doc_id, one a partition and sorted, each followed by the first
    row of the next block (after the last: of the first), marked as a guest.

    There are as many blocks as shuffle partitions. Their bounds come from a sample of some ids a block, so they only decide
    how even the blocks are; the driver sees these and the first row of each block, nothing that grows with the rows.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("key"), F.xxhash64(text).alias("tie"), text.alias("text"))
    total, blocks = docs.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    share = min(1.0, 40 * blocks / max(total, 1))
    places = sorted({(~k, t) for k, t in rows.select("key", "tie").sample(fraction=share, seed=7).collect()})
    bounds = places[:: max(1, -(-len(places) // blocks))][1:]
    keys_of_bounds = np.array([k for k, _ in bounds], np.int64)

    def block(keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        """0 for the highest ids; ~ turns their order. Only rows that share a bound's id need its tie."""
        out = np.searchsorted(keys_of_bounds, ~keys, side="right")
        for i in np.flatnonzero(out > np.searchsorted(keys_of_bounds, ~keys, side="left")).tolist():
            out[i] = bisect_right(bounds, (~int(keys[i]), int(ties[i])))
        return out

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            of = block(keys, ties)
            order = np.lexsort((ties, ~keys, of))
            first = order[np.concatenate(([True], np.diff(of[order]) > 0))] if len(order) else order
            yield pa.RecordBatch.from_arrays([pa.array(of[first], pa.int64()), pa.array(keys[first]), pa.array(ties[first])], ["block", "key", "tie"])

    top = F.min(F.struct(F.bitwise_not("key").alias("k"), "tie")).alias("top")
    found = rows.select("key", "tie").mapInArrow(tops, "block long, key long, tie long").groupBy("block").agg(top).collect()
    firsts = {r["block"]: (~r["top"]["k"], r["top"]["tie"]) for r in found}
    order = sorted(firsts)
    before = {b: order[i - 1] for i, b in enumerate(order)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            of = block(keys, ties)
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(np.zeros(len(keys), bool)), *batch.columns], names)
            if (guests := [i for i, (b, *place) in enumerate(zip(of.tolist(), keys.tolist(), ties.tolist(), strict=True)) if firsts[b] == tuple(place)]):
                at = pa.array(guests, pa.int64())
                to = [before[b] for b in of[guests].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(np.ones(len(to), bool)), *(c.take(at) for c in batch.columns)], names)

    names = ["block", "guest", "key", "tie", "text"]
    dealt = rows.mapInArrow(deal, "block long, guest boolean, key long, tie long, text string")
    n = len(bounds) + 1
    return dealt.repartitionById(n, F.col("block").cast("int")).sortWithinPartitions("block", "guest", F.desc("key"), "tie", "text").drop("tie")


def compared(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Each document's fingerprint beside that of its edited text, whose last half is replaced by as much of the start of
    the next document in descending doc_id (after the last: the first), and the likenesses to it and to that document."""
    ship(docs.sparkSession)

    def text_of(hashes: np.ndarray) -> str:
        return hashes.astype(">u4").tobytes().hex()

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []  # the row before, which waits for the one after it
        for batch in batches:
            for block, guest, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hashes, places = (None, None) if guest and (held is None or held[0] != block) else winnow(text, gram, window)
                own = None if hashes is None else np.unique(hashes)
                if held is not None and held[0] == block:
                    _, at, old, old_hashes, old_places, old_set = held
                    half = len(old) // 2
                    edited = old[: len(old) - half] + text[:half]
                    new_hashes, _ = winnow(edited, gram, window)
                    rows.append((None if at == _LOWEST else at, len(old), hashlib.sha256(edited.encode()).hexdigest(), text_of(old_hashes), text_of(new_hashes), likeness(old_set, np.unique(new_hashes)), likeness(old_set, own), old_places))
                held = None if guest else (block, key, text, hashes, places, own)
                if len(rows) >= 5_000:
                    yield out(rows)
                    rows = []
        if rows:
            yield out(rows)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
    return in_order(docs).mapInArrow(pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, positions array<int>")
