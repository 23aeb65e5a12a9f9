"""A unigram language model of subwords: trained by expectation and maximisation over all segmentations, pruned by loss,
and used by the best segmentation.

Words carry a mark for the space before them. Seeds are the substrings of words that cover most of the text; where they lie in
each distinct word is found once and stored. Each round weighs every segmentation of every distinct word by its probability
(forward and backward sums over many words of a length at once, in Arrow tasks) and sets a piece's probability to its share of
what all pieces are expected to occur. Then the pieces whose loss would cost the text
least go, until the vocabulary has its size; single characters stay. Counts of words and of pieces are tables; the driver and
the tasks hold the pieces, ``seeds`` of them at most.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators import tokenizers
from quern.plans.lineage import written
from quern.session import ship

#: Fixed value: the mark of a space.
SPACE = "▁"
LONGEST, SIZE, SEEDS, SHRINK, ROUNDS = 16, 8_000, 80_000, 0.75, 2
#: What a character that no piece covers costs, in logs, below the rarest piece.
UNKNOWN = 10.0
#: Edges of words of one length that are summed at once.
CELLS = 1 << 20


def words(text: Column) -> Column:
    """Runs without white space, each with the mark before it."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?U)(\S+)"), F.lit(1)), lambda w: F.concat(F.lit(SPACE), w))


def edges(word: str, logs: dict[str, float], longest: int, floor: float, but: str | None = None) -> list[list[tuple[int, float, str]]]:
    """For each end the (start, log, piece) of the pieces that end there; a character without a piece stands for itself."""
    out: list[list[tuple[int, float, str]]] = [[] for _ in range(len(word) + 1)]
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + longest) + 1):
            piece = word[i:j]
            log = logs.get(piece) if piece != but else None
            if log is None and j == i + 1:
                log = floor
            if log is not None:
                out[j].append((i, log, piece))
    return out


def best(word: str, logs: dict[str, float], longest: int, floor: float, but: str | None = None) -> tuple[float, list[str]]:
    """The log and the pieces of the most probable segmentation; of equal ones the one whose last piece is longest."""
    score, back = [0.0] + [-math.inf] * len(word), [None] * (len(word) + 1)
    for j in range(1, len(word) + 1):
        for i in range(max(0, j - longest), j):
            piece = word[i:j]
            log = logs.get(piece) if piece != but else None
            if log is None:
                if i < j - 1:
                    continue
                log = floor
            if score[i] + log > score[j]:
                score[j], back[j] = score[i] + log, (i, piece)
    out, at = [], len(word)
    while at:
        at, piece = back[at]
        out.append(piece)
    return score[-1], out[::-1]


def _sum(logs: list[float]) -> float:
    top = max(logs, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in logs))


def expected(word: str, logs: dict[str, float], longest: int, floor: float) -> tuple[float, dict[str, float]]:
    """The log of the word's probability over all segmentations, and how often each piece is expected in it."""
    lattice = edges(word, logs, longest, floor)
    forward = [0.0] * (len(word) + 1)
    for j in range(1, len(word) + 1):
        forward[j] = _sum([forward[i] + log for i, log, _ in lattice[j]])
    backward: list[list[float]] = [[] for _ in range(len(word) + 1)]
    after = [0.0] * (len(word) + 1)
    for j in range(len(word), 0, -1):
        if j < len(word):
            after[j] = _sum(backward[j])
        for i, log, _ in lattice[j]:
            backward[i].append(log + after[j])
    out: dict[str, float] = {}
    for j in range(1, len(word) + 1):
        for i, log, piece in lattice[j]:
            p = math.exp(forward[i] + log + after[j] - forward[-1])
            if piece in logs:
                out[piece] = out.get(piece, 0.0) + p
    return forward[-1], out


@dataclass(frozen=True)
class Unigram:
    """Pieces and the logs of their probabilities."""

    logs: dict[str, float]
    longest: int = LONGEST

    @cached_property
    def floor(self) -> float:
        return min(self.logs.values(), default=0.0) - UNKNOWN

    @property
    def vocabulary(self) -> list[str]:
        """The specials, then the pieces, most probable first."""
        return [*tokenizers.SPECIALS, *sorted(self.logs, key=lambda p: (-self.logs[p], p))]

    def pieces(self, word: str) -> list[str]:
        return best(word, self.logs, self.longest, self.floor)[1]

    def encode(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """key and ids of docs(key, text); pieces that the vocabulary lacks are unknown ones."""
        return tokenizers.encode(docs, words(F.col(text)), self.pieces, self.vocabulary, key)

    def decode(self, ids: Column) -> Column:
        """The text of ids, without specials."""
        names = F.array(*[F.lit("") for _ in tokenizers.SPECIALS], *[F.lit(p) for p in self.vocabulary[len(tokenizers.SPECIALS) :]])
        return F.ltrim(F.replace(F.array_join(F.transform(ids, lambda i: names[i]), ""), F.lit(SPACE), F.lit(" ")))


def seeds(counts: DataFrame, most: int, longest: int) -> dict[str, float]:
    """The characters of counts(word, n) and the substrings that cover most text, with their shares' logs."""
    starts = F.sequence(F.lit(1), F.length("word"))
    sub = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.length("word") - i + 1)), lambda k: F.substring(F.col("word"), i, k))))
    found = counts.select("n", F.explode(sub).alias("piece")).groupBy("piece").agg(F.sum("n").alias("n"))
    found = written(found.filter((F.length("piece") == 1) | (F.col("n") > 1)), "substrings")
    single = found.filter(F.length("piece") == 1)
    several = found.filter(F.length("piece") > 1).orderBy(F.desc(F.col("n") * F.length("piece")), "piece").limit(most)
    rows = single.orderBy(F.desc("n"), "piece").limit(most).union(several).collect()  # bounded by most
    total = math.log(sum(r["n"] for r in rows)) if rows else 0.0
    return {r["piece"]: math.log(r["n"]) - total for r in rows}


def lattices(counts: DataFrame, pieces: list[str], longest: int) -> DataFrame:
    """n and ids of counts(word, n): for each end in a word, and each of the longest starts before it in order, the place of what
    lies between among pieces; their number where it is none of them, and one more for a character that is none."""
    sent = counts.sparkSession.sparkContext.broadcast({p: i for i, p in enumerate(pieces)})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, none = sent.value.get, len(sent.value)
        for batch in batches:
            flat, ends = [], [0]
            for word in batch.column(0).to_pylist():
                for j in range(1, len(word) + 1):
                    flat += [none] * (longest - j) + [place(word[i:j], none) for i in range(max(0, j - longest), j)]
                    if flat[-1] == none:
                        flat[-1] = none + 1
                ends.append(len(flat))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))], ["n", "ids"])

    return counts.select("word", "n").mapInArrow(each, "n long, ids array<int>")


def _sums(ids: np.ndarray, n: np.ndarray, logs: np.ndarray) -> tuple[float, np.ndarray]:
    """The log-likelihood of words of one length, ids(word, end, start), that occur n times, and how often each id is expected."""
    rows, size, longest = ids.shape
    edge = logs[ids]
    forward, backward = np.full((2, rows, longest + size), -np.inf)  # of place p at p + longest - 1
    forward[:, longest - 1] = backward[:, -1] = 0.0
    for j in range(size):
        x = forward[:, j : j + longest] + edge[:, j]
        top = x.max(1)
        forward[:, j + longest] = top + np.log(np.exp(x - top[:, None]).sum(1))
    for j in reversed(range(size)):
        at = backward[:, j : j + longest]
        np.logaddexp(at, edge[:, j] + backward[:, j + longest, None], out=at)
    whole = forward[:, -1]
    for j in range(size):
        edge[:, j] += forward[:, j : j + longest] + (backward[:, j + longest] - whole)[:, None]
    np.exp(edge, out=edge)
    edge *= n[:, None, None]
    return float(n @ whole), np.bincount(ids.ravel(), edge.ravel(), len(logs))


def expectations(lattice: DataFrame, pieces: list[str], model: Unigram) -> tuple[float, dict[str, float]]:
    """The log-likelihood of the words of a lattice of pieces, and how often each piece is expected."""
    logs = np.array([*[model.logs.get(p, -math.inf) for p in pieces], -math.inf, model.floor])
    sent, longest = lattice.sparkSession.sparkContext.broadcast(logs), model.longest

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = sent.value
        total, sums = 0.0, np.zeros(len(logs))
        for batch in batches:
            n, lists = batch.column(0).to_numpy().astype(float), batch.column(1)
            at, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            sizes = np.diff(at)
            for size in np.unique(sizes[sizes > 0]):
                of, step = np.flatnonzero(sizes == size), max(1, CELLS // int(size))
                for k in range(0, len(of), step):
                    some = of[k : k + step]
                    ids = flat[at[some][:, None] + np.arange(size)].reshape(len(some), -1, longest)
                    log, found = _sums(ids, n[some], logs)
                    total, sums = total + log, sums + found
        used = np.flatnonzero(sums[:-2])
        yield pa.RecordBatch.from_arrays([pa.array([-1, *used.tolist()], pa.int32()), pa.array([total, *sums[used].tolist()], pa.float64())], ["piece", "x"])

    rows = lattice.mapInArrow(each, "piece int, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect()  # a row a piece
    found = {r["piece"]: r["x"] for r in rows}
    sent.destroy()
    log = found.pop(-1, 0.0)
    return log, {pieces[i]: x for i, x in found.items()}


def maximised(found: dict[str, float], logs: dict[str, float]) -> dict[str, float]:
    """Shares of the expected occurrences; what is all but never used goes, characters keep a little."""
    used = {p: max(x, 1e-6) if len(p) == 1 else x for p, x in ({p: found.get(p, 0.0) for p in logs}).items() if len(p) == 1 or x > 1e-9}
    total = math.log(sum(used.values()))
    return {p: math.log(x) - total for p, x in used.items()}


def losses(model: Unigram, found: dict[str, float]) -> dict[str, float]:
    """What the text's log-likelihood would lose by each piece of several characters, were its uses cut as is next best."""
    out = {}
    for piece, log in model.logs.items():
        if len(piece) > 1:
            out[piece] = found.get(piece, 0.0) * (log - best(piece, model.logs, model.longest, model.floor, but=piece)[0])
    return out


def train(counts: DataFrame, size: int = SIZE, most_seeds: int = SEEDS, longest: int = LONGEST, rounds: int = ROUNDS, shrink: float = SHRINK, trace: list[float] | None = None) -> Unigram:
    """The model of counts(word, n) with size pieces besides the specials, or as many as there are. trace gets the
    log-likelihood before each maximisation, and None where pieces went."""
    ship(counts.sparkSession)
    cores = counts.sparkSession.sparkContext.defaultParallelism
    counts = written(counts.repartition(4 * cores), "words")  # few bytes, but much work for each
    logs = seeds(counts, most_seeds, longest)
    if not logs:
        return Unigram({}, longest)
    pieces = list(logs)
    lattice = written(lattices(counts, pieces, longest), "lattices")
    while True:
        found: dict[str, float] = {}
        for _ in range(rounds):
            log, found = expectations(lattice, pieces, Unigram(logs, longest))
            if trace is not None:
                trace.append(log)
            logs = maximised(found, logs)
        if len(logs) <= size:
            return Unigram(logs, longest)
        cost = losses(Unigram(logs, longest), found)
        keep = max(size - (len(logs) - len(cost)), min(len(cost) - 1, int(len(cost) * shrink)), 0)
        kept = sorted(cost, key=lambda p: (-cost[p], p))[:keep]
        logs = {p: x for p, x in logs.items() if len(p) == 1} | {p: logs[p] for p in kept}
        if trace is not None:
            trace.append(None)
        if not cost:  # characters alone
            return Unigram(logs, longest)
