"""Packing whole documents into windows by a configuration linear program.

A configuration is a multiset of lengths that fits one window. The program asks how often to use each configuration so
that all pieces of the length histogram are covered with the fewest windows. It is solved by multiplicative weights: each
length has a price, a knapsack dynamic program over the window finds the configurations of highest price, these are used a
little more, and the prices of the lengths that they cover fall. Prices divided by the best configuration's are a feasible
dual, whose value no packing can go below. A share of the fractional uses is rounded down, the share that turns out best of
``SHARES``, and the program is solved again for the lengths that remain, while that helps. What remains then is completed
the largest length first, each window filled up as far as the remaining lengths can fill it.

The program's size depends on the window alone: the driver gets one count a length and sends back the plan, a row for each
length of each configuration in use (``PLAN_ROWS`` bounds it). Pieces are numbered within their length by task and place,
the plan turns that number into a sequence and a place in it, so no sequence is ever brought together.

Defined cases: null text is an empty document, which still has its final id; repeated rows are documents of their own;
null ids stay null; an empty table gives an empty result; other columns are ignored; a document longer than a window is cut
from its end into full windows, so only its first piece may be shorter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.packing import document_ids
from quern.llm.token_counts import special_of
from quern.plans.lineage import written
from quern.session import ship

WINDOW, END_ID = 1024, 2
#: Rounds at most, and pricing steps of a solution.
ROUNDS, STEPS = 6, 80
#: Learning rates that each round tries, with the share of the best price that a configuration must have to be used in a
#: step: slow ones suit many lengths, fast ones a few that are hard to combine.
RATES = ((0.1, 0.98), (0.3, 0.99))
#: Shares of the fractional solution that rounding tries.
SHARES = (1.0, 0.7, 0.4, 0.2, 0.1)
#: Rows of a plan at most: it has fewer than 60 000 at a window of 1024, 40 bytes each.
PLAN_ROWS = 1 << 20

Configuration = tuple[tuple[int, int], ...]


def priced(prices: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The best total price of lengths that fill at most c places, for each c, and the length to put there first (0: none).
    prices is indexed by length; lengths that do not occur have price 0."""
    best, first = np.zeros(window + 1), np.zeros(window + 1, np.int64)
    for c in range(1, window + 1):
        total = prices[1 : c + 1] + best[c - 1 :: -1]
        k = int(total.argmax())
        if total[k] > best[c - 1] and prices[k + 1] > 0:
            best[c], first[c] = total[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, first


def filled(first: np.ndarray, places: int) -> list[int]:
    """The lengths of the best filling of so many places."""
    out = []
    while places > 0:
        if first[places]:
            out.append(int(first[places]))
            places -= out[-1]
        else:
            places -= 1
    return out


def counted(lengths: list[int]) -> Configuration:
    held: dict[int, int] = {}
    for x in lengths:
        held[x] = held.get(x, 0) + 1
    return tuple(sorted(held.items(), reverse=True))


def fullest(left: np.ndarray, places: int) -> list[int]:
    """Lengths, none more often than left has it, whose sum comes as close to places as any; larger ones first."""
    reach, steps, mask = 1, [], (1 << (places + 1)) - 1
    for length in np.flatnonzero(left[: places + 1]).tolist():
        n, k = min(int(left[length]), places // length), 1
        while n > 0:  # powers of two and a rest stand for any number up to n
            k = min(k, n)
            steps.append((length, k, reach))
            reach |= (reach << (length * k)) & mask
            n, k = n - k, k * 2
    at, out = reach.bit_length() - 1, []
    for length, k, before in reversed(steps):
        if at >= length * k and before >> (at - length * k) & 1:
            out += [length] * k
            at -= length * k
    return out


def complete(left: np.ndarray, window: int) -> list[tuple[Configuration, int]]:
    """Windows for all lengths of left: each takes the largest that is left and is filled up, as often as lengths allow."""
    out = []
    while len(rest := np.flatnonzero(left)):
        top = int(rest[-1])
        left[top] -= 1
        lengths = [top, *fullest(left, window - top)]
        left[top] += 1
        use = counted(lengths)
        times = min(int(left[x]) // n for x, n in use)
        for x, n in use:
            left[x] -= n * times
        out.append((use, times))
    return out


def fractional(left: np.ndarray, window: int, rate: float, close: float, steps: int = STEPS) -> tuple[dict[Configuration, float], float]:
    """Uses of configurations that cover the lengths of left evenly with about as few windows as possible, found by
    multiplicative weights, and the best dual bound met on the way."""
    lengths = np.flatnonzero(left)
    need, size = left[lengths].astype(float), lengths / window
    bound, log = float(need @ size), np.zeros(len(lengths))
    uses: dict[Configuration, float] = {}
    for t in range(steps):
        if t == steps * 2 // 5:  # the first steps only find the prices
            uses = {}
        prices = np.zeros(window + 1)
        prices[lengths] = size * np.exp(np.clip(log - log.mean(), -30, 30))
        best, first = priced(prices, window)
        bound = max(bound, float(left @ prices) / best[window] * (1 - 1e-9))
        values = prices[lengths] + best[window - lengths]
        open_ = left.astype(float)
        for x in lengths[values >= close * values.max()][::-1].tolist():
            if open_[x] > 0:
                use = counted([x, *filled(first, window - x)])
                times = min(open_[a] / n for a, n in use)
                if times > 0:
                    uses[use] = uses.get(use, 0.0) + times
                    for a, n in use:
                        open_[a] -= n * times
        covered = 1 - open_[lengths] / need
        log -= rate / np.sqrt(1 + t / 20) * (covered - covered.mean())
    scale = bound / max(sum(uses.values()), 1e-9)
    return {use: x * scale for use, x in uses.items()}, bound


def rounded(uses: dict[Configuration, float], share: float, left: np.ndarray) -> list[tuple[Configuration, int]]:
    """Whole uses of a share of each configuration's, the fullest first, as far as the lengths of left allow, which go."""
    out = []
    for use, x in sorted(uses.items(), key=lambda p: (-sum(a * n for a, n in p[0]), -p[1], p[0])):
        times = min(int(x * share), *(int(left[a]) // n for a, n in use))
        if times > 0:
            out.append((use, times))
            for a, n in use:
                left[a] -= n * times
    return out


def windows(packing: list[tuple[Configuration, int]]) -> int:
    return sum(times for _, times in packing)


def solve(histogram: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[list[tuple[Configuration, int]], int]:
    """Configurations and how often each is used, for all pieces of the histogram (indexed by length), and a number of
    windows that no packing goes below."""
    left, taken, best, least = histogram.astype(np.int64), [], None, 0
    for _ in range(rounds):
        if not left.any():
            break
        tries = []
        for rate, close in RATES:
            uses, bound = fractional(left, window, rate, close)
            if best is None:
                least = max(least, int(np.ceil(bound - 1e-6)))
            for share in SHARES:
                rest = left.copy()
                part = rounded(uses, share, rest)
                tries.append((windows(part) + windows(complete(rest.copy(), window)), part, rest))
        n, part, rest = min(tries, key=lambda t: t[0])
        if best is not None and n + windows(taken) >= windows(best):
            break
        taken, left = taken + part, rest
        best = taken + complete(left.copy(), window)
        if windows(best) <= least:
            break
    return best or [], least


def plan_of(packing: list[tuple[Configuration, int]]) -> dict[str, np.ndarray]:
    """The packing as columns, sorted by length and number: pieces of this length from this number on go, each so many to a
    sequence, into sequences from this one on, from this place in each."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for use, times in packing:
        place = 0
        for length, each in use:
            rows.append((length, used.get(length, 0), each, sequence, place))
            used[length] = used.get(length, 0) + each * times
            place += length * each
        sequence += times
    if len(rows) > PLAN_ROWS:
        raise ValueError("the plan is larger than it can be")
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("length", "number", "each", "sequence", "place"), table.T, strict=True))


def pieces(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of docs(doc_id, text), and each one's number among those of its length in its task."""
    ship(docs.sparkSession)
    special = special_of(tokenizer_path)
    kinds = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "task": "long", "number": "long"}

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, numbers = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64)
        rows: list[tuple] = []

        def take() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == "int" else pa.int64()) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))
            rows.clear()
            return out

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), document_ids(batch.column(1), tokenizer_path, special, end_id), strict=True):
                start, i = 0, 0
                while start < len(ids):
                    n = (len(ids) - start) % window or window
                    rows.append((doc_id, i, start, n, zlib.crc32(ids[start : start + n].tobytes()), task, int(numbers[n])))
                    numbers[n] += 1
                    start, i = start + n, i + 1
                if len(rows) >= 50_000:
                    yield take()
        yield take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, ", ".join(f"{c} {k}" for c, k in kinds.items()))


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """One row per piece of the documents of docs(doc_id, text): where it is in its document and in its sequence."""
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer_path, window, end_id), "pieces")
    counts = cut.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = written(counts, "counts")
    histogram = np.zeros(window + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row a length
        histogram[row["length"]] = row["n"]
    plan = spark.sparkContext.broadcast(plan_of(solve(histogram, window)[0]))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    numbered = cut.join(counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before")), ["task", "length"])
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        keys = p["length"] << 48 | p["number"]
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, length << 48 | number, side="right") - 1
            turn, among = np.divmod(number - p["number"][at], p["each"][at])
            new = [pa.array(p["sequence"][at] + turn), pa.array(p["place"][at] + among * length)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(5)] + new, [*columns, "sequence_id", "offset"])

    rows = numbered.select(*columns, (F.col("before") + F.col("number")).alias("number"))
    return rows.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
