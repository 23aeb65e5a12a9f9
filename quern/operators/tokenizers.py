"""Subword tokenizers trained on word counts: BPE and WordPiece. Words are counted by Spark and encoded in tasks, once per
distinct word of a batch. Merges are found on the driver where it can hold the distinct words above a minimum frequency;
beyond that the words stay in Spark, which plays the merges, and the driver gets what the next few hundred depend on."""

from __future__ import annotations

import heapq
import json
from array import array
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quern.plans.lineage import written
from quern.session import ship, spread
from quern.sources.files import read_small, write_small

#: The first ids of every vocabulary.
SPECIALS = ["<pad>", "<unk>", "<bos>", "<eos>", "<mask>", "<sep>", "<cls>", "<pad_extra>", "<|system|>", "<|user|>", "<|assistant|>", "<|end_turn|>"]
PAD, UNK, BOS, EOS, MASK = 0, 1, 2, 3, 4
SYSTEM, USER, ASSISTANT, END_TURN = 8, 9, 10, 11
SPACE = "Ġ"
#: Fixed value: the standard pattern of pre-tokens.
PATTERN = r"(?i)'s|'t|'re|'ve|'m|'ll|'d| ?[a-zA-Z]+| ?[0-9]+| ?[^\s\w]+|\s+(?!\S)|\s+"
#: Distinct words that a trainer takes to the driver at most; with more, the same merges are found in Spark.
TRAIN_WORDS = 500_000
#: Live pairs of the first round, and distinct runs of live pairs that the driver takes at most.
LIVE_PAIRS, RUNS = 512, 200_000
#: Words whose pieces a task that encodes keeps.
KEPT_WORDS = 100_000


def pretokens(text: Column, pattern: str = PATTERN) -> Column:
    """Pieces of words, with a mark for a leading space; white space alone is left out. Letters beyond A-Z match no branch
    of the standard pattern, so they are dropped; pass another pattern to keep them."""
    found = F.filter(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0)), lambda t: t.rlike(r"(?U)\S"))
    return F.transform(found, lambda t: F.when(t.startswith(" "), F.concat(F.lit(SPACE), F.trim(t))).otherwise(F.regexp_replace(t, r"(?U)^\s+|\s+\z", "")))


def wordpiece_words(text: Column) -> Column:
    """Lower case, signs apart, split at white space."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"(?U)([^\w\s])", " $1 "), r"(?U)\s+", -1), lambda w: w != "")


@dataclass(frozen=True)
class Tokenizer:
    """A trained vocabulary (ids are places), with merges for BPE and without for WordPiece."""

    vocabulary: list[str]
    merges: list[tuple[str, str]] | None = None

    @property
    def kind(self) -> str:
        return "WordPiece" if self.merges is None else "BPE"

    def extended(self, tokens: list[str]) -> Tokenizer:
        """With tokens behind it that it lacks; those it has keep their ids."""
        return Tokenizer(list(dict.fromkeys([*self.vocabulary, *tokens])), self.merges)

    def words(self, text: Column) -> Column:
        return wordpiece_words(text) if self.merges is None else pretokens(text)

    def encode_word(self) -> Callable[[str], list[str]]:
        """The pieces of a word, as a function that holds what it needs; for BPE with ``many``, of many words at once."""
        if self.merges is None:
            known = set(self.vocabulary)
            return lambda w: encode_wordpiece_word(w, known)
        return BpeWords(self.merges)

    def encode(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """key and ids of docs(key, text)."""
        return encode(docs, self.words(F.col(text)), self.encode_word(), self.vocabulary, key)

    def save(self, spark: SparkSession, folder: str) -> None:
        """vocab.json, merges.txt and tokenizer_config.json in a folder of any file system that Spark knows."""
        write_small(spark, f"{folder}/vocab.json", json.dumps({t: i for i, t in enumerate(self.vocabulary)}, ensure_ascii=False, indent=2))
        if self.merges is not None:
            write_small(spark, f"{folder}/merges.txt", "".join(f"{a} {b}\n" for a, b in [("#version:", "1"), *self.merges]))
        write_small(spark, f"{folder}/tokenizer_config.json", json.dumps({"tokenizer_class": self.kind, "vocab_size": len(self.vocabulary)}))


def load(spark: SparkSession, folder: str) -> Tokenizer:
    """What ``save`` wrote, of the kind that its configuration names."""
    kind = json.loads(read_small(spark, f"{folder}/tokenizer_config.json")).get("tokenizer_class")
    if kind not in ("BPE", "WordPiece"):
        raise ValueError(f"unknown tokenizer class {kind!r} in {folder}")
    ids = json.loads(read_small(spark, f"{folder}/vocab.json"))
    vocabulary = sorted(ids, key=ids.get)
    if kind == "WordPiece":
        return Tokenizer(vocabulary)
    lines = read_small(spark, f"{folder}/merges.txt").split("\n")[1:]
    return Tokenizer(vocabulary, [tuple(x.split(" ")) for x in lines if x])


def word_counts(docs: DataFrame, words: Column) -> DataFrame:
    return docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _frequent(counts: DataFrame) -> dict[str, int]:
    return {r["word"]: r["n"] for r in counts.collect()}


def _in_turn(merges: list[tuple[str, str]], wordpiece: bool = False) -> Callable[[list[str]], Iterator[tuple[int, list[str]]]]:
    """For the parts of a word, the merges that change it, in order: each one's place and the parts after it."""
    places: dict[tuple[str, str], list[int]] = defaultdict(list)
    for i, pair in enumerate(merges):
        places[pair].append(i)

    def each(parts: list[str]) -> Iterator[tuple[int, list[str]]]:
        at = 0
        while len(parts) > 1:
            first = min((i for p in zip(parts, parts[1:], strict=False) for i in places.get(p, ()) if i >= at), default=None)
            if first is None:
                return
            a, b = merges[first]
            parts, at = merged(parts, (a, b), a + (b[2:] if wordpiece else b)), first + 1
            yield first, parts

    return each


def _applied(words: DataFrame, merges: list[tuple[str, str]], wordpiece: bool = False) -> DataFrame:
    """words(parts, n) after the merges; of BPE without those that are one part."""
    sent = words.sparkSession.sparkContext.broadcast(merges)  # a vocabulary at most

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns = _in_turn(sent.value, wordpiece)
        for batch in batches:
            out = []
            for parts in batch.column(0).to_pylist():
                for _, parts in turns(parts):  # noqa: B007, B020
                    pass
                out.append(parts)
            made = pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string())), batch.column(1)], ["parts", "n"])
            yield made if wordpiece else made.filter(pa.array([len(p) > 1 for p in out], pa.bool_()))

    return words.mapInArrow(each, "parts array<string>, n long")


def _segments(words: DataFrame, live: set[tuple[str, str]]) -> DataFrame:
    """Runs of parts whose neighbours are all live pairs, with the words' numbers: all that merges of live pairs depend on."""
    sent = words.sparkSession.sparkContext.broadcast(live)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums: Counter = Counter()
            for parts, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at = 0
                for i in range(1, len(parts) + 1):
                    if i == len(parts) or (parts[i - 1], parts[i]) not in sent.value:
                        if i - at > 1:
                            sums[tuple(parts[at:i])] += n
                        at = i
            yield pa.RecordBatch.from_arrays([pa.array([list(p) for p in sums], pa.list_(pa.string())), pa.array(list(sums.values()), pa.int64())], ["parts", "n"])

    return words.mapInArrow(each, "parts array<string>, n long").groupBy("parts").agg(F.sum("n").alias("n"))


def _hidden(words: DataFrame, live: set[tuple[str, str]], merges: list[tuple[str, str]], frequent: set[tuple[str, str]], least: float) -> DataFrame:
    """a, b, n, n0 and step of the pairs that the merges make, one after another, where no live pair was: n counts all of
    them, n0 those that were there before, and step is the first merge that makes one. Only pairs that occur there at least
    so often, or that are frequent elsewhere."""
    sent = words.sparkSession.sparkContext.broadcast((live, merges, frequent))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        live, merges, _ = sent.value
        turns = _in_turn(merges)
        for batch in batches:
            found: dict[tuple[str, str], list] = {}
            for parts, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, now = 0, {}
                for p, q in zip(parts, parts[1:], strict=False):
                    at += len(p)
                    if (p, q) not in live:
                        now[at] = (p, q)
                        x = found.setdefault((p, q), [0, 0, None])
                        x[0] += n
                        x[1] += n
                for step, parts in turns(parts) if now else ():  # noqa: B020
                    at = 0
                    for p, q in zip(parts, parts[1:], strict=False):
                        at += len(p)
                        if at in now and now[at] != (p, q):
                            now[at] = (p, q)
                            x = found.setdefault((p, q), [0, 0, None])
                            x[0] += n
                            x[2] = step if x[2] is None else min(x[2], step)
            columns = [pa.array([p for p, _ in found], pa.string()), pa.array([q for _, q in found], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x[i] for x in found.values()], pa.int64()) for i in range(3))], ["a", "b", "n", "n0", "step"])

    @F.pandas_udf("boolean")
    def known(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([p in sent.value[2] for p in zip(a, b, strict=True)], dtype=bool)

    sums = words.mapInArrow(each, "a string, b string, n long, n0 long, step long").groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("n0").alias("n0"), F.min("step").alias("step"))
    return sums.filter((F.col("n") >= least) | known("a", "b"))


def _pairs_of(words: DataFrame) -> DataFrame:
    """a, b and n: adjacent parts of words(parts, n), weighted by the words."""
    zipped = words.filter(F.size("parts") > 1).select("n", F.explode(F.arrays_zip(F.slice("parts", 1, F.size("parts") - 1).alias("a"), F.slice("parts", 2, F.size("parts")).alias("b"))).alias("p"))
    return zipped.groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b")).agg(F.sum("n").alias("n"))


def _bpe_apart(counts: DataFrame, size: int, least: int) -> tuple[list[tuple[str, str]], list[str]]:
    """Merges and vocabulary as ``train_bpe`` finds them, over words that stay in Spark.

    Each round takes the most frequent pairs as live ones and cuts the words where other pairs are. The driver merges in
    the distinct runs between the cuts, as long as the best pair is more frequent than any that was cut. Then the merges are
    played in all words, which counts the pairs that they make at the cuts: a merge can make a part that was there by
    another way. Merges stand up to the first that makes such a pair as frequent as the merges are; the rest are found anew.
    """
    spark = counts.sparkSession
    ship(spark)
    words = written(spread(counts.select(F.filter(F.split("word", "", -1), lambda c: c != "").alias("parts"), "n")), "words")
    vocabulary = [*SPECIALS, *sorted(r[0] for r in words.select(F.explode("parts").alias("p")).distinct().collect())]  # an alphabet
    known, merges, number = set(vocabulary), [], LIVE_PAIRS
    while len(vocabulary) < size:
        best = _pairs_of(words).filter(F.col("n") >= least).orderBy(F.desc("n"), "a", "b").limit(number).collect()
        if not best:
            break
        while True:
            live, whole = {(r["a"], r["b"]) for r in best}, len(best) < number
            runs = written(_segments(words, live), "runs")
            if (n := runs.count()) <= RUNS or len(best) < 2:
                break
            number = len(best) // 2
            best = best[:number]
        to = least if whole else max(best[len(best) // 2]["n"], best[-1]["n"] + 1)
        seen: dict[tuple[str, str], list[int]] = {}
        fresh = _merge(((r["parts"], r["n"]) for r in runs.toLocalIterator()), to, size, list(vocabulary), set(known), seen)
        frequent = {p for p, (peak, _) in seen.items() if 2 * peak >= to}
        for r in _hidden(words, live, fresh, frequent, to / 2).collect() if fresh else []:  # pairs that may matter: few
            peak, first = seen.get((r["a"], r["b"]), (0, None))
            if r["n"] + peak >= to:
                steps = [r["step"], first if r["n0"] else None]
                fresh = fresh[: min([len(fresh), *(x + 1 for x in steps if x is not None)])]
        for pair in fresh:
            merges.append(pair)
            if (new := "".join(pair)) not in known:
                known.add(new)
                vocabulary.append(new)
        if fresh:
            words = written(_applied(words, fresh), "words")
        elif whole:
            break
        number = number * 2 if n * 2 <= RUNS or not fresh else number
    return merges, vocabulary


def _with_any(words: DataFrame, live: set[tuple[str, str]]) -> DataFrame:
    """The words(parts, n) that have one of the pairs."""
    sent = words.sparkSession.sparkContext.broadcast(live)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([any(q in sent.value for q in zip(p, p[1:], strict=False)) for p in batch.column(0).to_pylist()], pa.bool_()))

    return words.mapInArrow(each, words.schema)


def _wordpiece_apart(counts: DataFrame, size: int) -> list[str]:
    """The vocabulary as ``train_wordpiece`` finds it, over words that stay in Spark.

    Each round the driver gets the counts of parts and pairs, at most a vocabulary and its square, and the words with one of
    the best pairs. It merges until a pair is best that also occurs in other words; then the merges are played in all words.
    """
    ship(counts.sparkSession)
    chars = F.filter(F.split("word", "", -1), lambda c: c != "")
    parts = F.transform(chars, lambda c, i: F.when(i > 0, F.concat(F.lit("##"), c)).otherwise(c))
    words = written(spread(counts.select(parts.alias("parts"), "n")), "words")
    vocabulary = None
    number = LIVE_PAIRS
    while vocabulary is None or len(vocabulary) < size:
        pairs = Counter({(r["a"], r["b"]): r["n"] for r in _pairs_of(words).collect()})
        single = Counter({r["p"]: r["n"] for r in words.select("n", F.explode("parts").alias("p")).groupBy("p").agg(F.sum("n").alias("n")).collect()})
        if vocabulary is None:
            vocabulary = [*SPECIALS, *sorted(single)]  # an alphabet
            known = set(vocabulary)
            continue
        best = sorted(pairs, key=lambda p: (-pairs[p] / (single[p[0]] * single[p[1]]), p))[:number]
        if not best:
            break
        while True:
            taken = written(_with_any(words, set(best)), "taken")
            if (n := taken.count()) <= RUNS or len(best) < 2:
                break
            number = len(best) // 2
            best = best[:number]
        if n > RUNS:  # one pair in very many words
            (a, b), fresh = best[0], best
            if (new := a + b[2:]) not in known:
                known.add(new)
                vocabulary.append(new)
        else:
            fresh = _merge_wordpiece(((r["parts"], r["n"]) for r in taken.toLocalIterator()), size, vocabulary, known, single, pairs)
        words = written(_applied(words, fresh, True), "words")
        number = number * 2 if n * 2 <= RUNS else number
    return vocabulary


def train_bpe(counts: DataFrame, size: int = 32_000, least: int = 2) -> tuple[list[tuple[str, str]], list[str]]:
    """Merges in order and the vocabulary. The most frequent pair merges; ties go to the lexicographically least.

    Pair counts and the words that hold each pair are kept up to date, so a merge costs only its own occurrences.
    """
    counts = written(counts.filter(F.col("n") >= least), "counts")
    if counts.count() > TRAIN_WORDS:
        return _bpe_apart(counts, size, least)
    freq = _frequent(counts)
    vocabulary = [*SPECIALS, *sorted({c for w in freq for c in w})]
    return _merge(((list(w), n) for w, n in freq.items()), least, size, vocabulary, set(vocabulary)), vocabulary


def _merge(words: Iterable[tuple[list[str], int]], least: int, size: int, vocabulary: list[str], known: set[str], seen: dict[tuple[str, str], list[int]] | None = None) -> list[tuple[str, str]]:
    """Merges of words (parts, n) in order, while the best pair occurs at least so often; the vocabulary grows to size. seen
    gets each pair's largest count, and the place of the merge that made it first (-1: it was there)."""
    state = _Parts(words)
    names, ids, pairs = state.names, state.ids, state.pairs
    if seen is not None:
        seen.update({(names[k >> 32], names[k & _LOW]): [n, -1] for k, n in pairs.items()})
    heap = [(-n, (names[k >> 32], names[k & _LOW]), k) for k, n in pairs.items()]
    heapq.heapify(heap)
    merges: list[tuple[str, str]] = []
    while heap and len(vocabulary) < size:
        n, pair, k = heapq.heappop(heap)
        if pairs.get(k, 0) != -n:
            if pairs.get(k, 0) > 0:
                heapq.heappush(heap, (-pairs[k], pair, k))
            continue
        if -n < least:
            break
        merges.append(pair)
        if (new := "".join(pair)) not in known:
            known.add(new)
            vocabulary.append(new)
        if new not in ids:
            ids[new] = len(names)
            names.append(new)
        for q in state.merge(k, ids[new]):
            if pairs[q] > 0:
                fresh = (names[q >> 32], names[q & _LOW])
                heapq.heappush(heap, (-pairs[q], fresh, q))
                if seen is not None:
                    x = seen.setdefault(fresh, [0, len(merges) - 1])
                    x[0] = max(x[0], pairs[q])
    return merges


_LOW = (1 << 32) - 1


class _Parts:
    """The parts of words (parts, n) as numbers in one array, linked to their neighbours in the word; the counts of pairs, as
    left << 32 | right, and the places where each pair begins or began. A merge looks at its own places alone, all at once."""

    def __init__(self, words: Iterable[tuple[list[str], int]]):
        self.ids: dict[str, int] = {}
        self.pairs: dict[int, int] = {}
        self.where: dict[int, list[np.ndarray]] = {}
        flat, sizes, freq = array("i"), array("i"), array("q")
        ids = self.ids
        for parts, n in words:
            flat.extend([ids.setdefault(p, len(ids)) for p in parts])
            sizes.append(len(parts))
            freq.append(n)
        self.names = list(ids)
        self.part = np.array(flat, np.int32)
        sizes = np.array(sizes, np.int64)
        self.weight = np.repeat(np.array(freq, np.int64), sizes)
        ends = np.cumsum(sizes)[sizes > 0]
        self.next = np.arange(1, len(self.part) + 1, dtype=np.int32)
        self.next[ends - 1] = -1
        self.last = np.arange(-1, len(self.part) - 1, dtype=np.int32)
        self.last[ends[:-1]] = -1
        self._count(np.flatnonzero(self.next >= 0), 1)

    def _count(self, at: np.ndarray, sign: int) -> list[int]:
        """Adds the pairs that begin at these distinct places, or takes them off; the pairs."""
        if not len(at):
            return []
        keys = self.part[at].astype(np.int64) << 32 | self.part[self.next[at]]
        order = np.argsort(keys, kind="stable")
        at, keys = at[order], keys[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        found, sums = keys[starts].tolist(), np.add.reduceat(self.weight[at], starts).tolist()
        for k, n in zip(found, sums, strict=True):
            self.pairs[k] = self.pairs.get(k, 0) + sign * n
        if sign > 0:
            ends = [*starts[1:].tolist(), len(at)]
            at = at.astype(np.int32)
            for k, i, j in zip(found, starts.tolist(), ends, strict=True):
                self.where.setdefault(k, []).append(at[i:j])
        return found

    def merge(self, key: int, new: int) -> list[int]:
        """Merges a pair wherever it stands, from the left; the pairs that arose."""
        a, b = key >> 32, key & _LOW
        places = self.where.pop(key)
        at = np.unique(np.concatenate(places)) if len(places) > 1 else places[0]
        after = self.next[at]
        ok = (self.part[at] == a) & (after >= 0)
        ok[ok] = self.part[after[ok]] == b
        at, after = at[ok], after[ok]
        if a == b and len(at) > 1:  # of a run every second one
            i = np.arange(len(at))
            first = np.concatenate([[True], at[1:] != after[:-1]])
            odd = (i - np.maximum.accumulate(np.where(first, i, 0))) % 2 == 1
            at, after = at[~odd], after[~odd]
        before = self.last[at]
        changed = np.concatenate([before[before >= 0], at, after[self.next[after] >= 0]])
        self._count(np.unique(changed), -1)
        beyond = self.next[after]
        self.part[at], self.part[after] = new, -1
        self.next[at] = beyond
        some = beyond >= 0
        self.last[beyond[some]] = at[some]
        before = self.last[at]
        return self._count(np.unique(np.concatenate([before[before >= 0], at[beyond >= 0]])), 1)


def merged(parts: list[str], pair: tuple[str, str], new: str | None = None) -> list[str]:
    out, i = [], 0
    while i < len(parts):
        if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
            out.append(parts[i] + parts[i + 1] if new is None else new)
            i += 2
        else:
            out.append(parts[i])
            i += 1
    return out


def encode_bpe_word(word: str, ranks: dict[tuple[str, str], int]) -> list[str]:
    parts = list(word)
    while len(parts) > 1:
        pair = min(zip(parts, parts[1:], strict=False), key=lambda p: ranks.get(p, 1 << 60))
        if pair not in ranks:
            break
        parts = merged(parts, pair)
    return parts


class BpeWords:
    """The pieces of words by merges; of the words in ``whole`` themselves."""

    def __init__(self, merges: list[tuple[str, str]], whole: frozenset[str] = frozenset()):
        self.ranks, self.whole = {m: i for i, m in enumerate(merges)}, whole

    def __call__(self, word: str) -> list[str]:
        return [word] if word in self.whole else encode_bpe_word(word, self.ranks)

    def many(self, ids: dict[str, int]) -> Callable[[list[str]], tuple[np.ndarray, np.ndarray]]:
        """A function of words: how many pieces each has, and the pieces' ids. Each round merges the best pair of every word."""
        names: dict[str, int] = {}
        for a, b in self.ranks:
            for p in (a, b, a + b):
                names.setdefault(p, len(names))
        pairs = np.array([names[a] << 32 | names[b] for a, b in self.ranks], np.int64)
        order = np.argsort(pairs)
        keys, places = np.append(pairs[order], -1), np.append(np.array(list(self.ranks.values()), np.int64)[order], _NONE)
        made = np.zeros(max(self.ranks.values(), default=0) + 1, np.int64)
        made[list(self.ranks.values())] = [names[a + b] for a, b in self.ranks]
        # Characters that no merge knows are numbered by their code, behind all parts.
        chars = np.arange(len(names), len(names) + 0x110000, dtype=np.int64)
        out_ids = np.full(len(names) + 0x110000, UNK, np.int32)
        for p, i in names.items():
            out_ids[i] = ids.get(p, UNK)
            if len(p) == 1:
                chars[ord(p)] = i
        for p, i in ids.items():
            if len(p) == 1 and p not in names:
                out_ids[len(names) + ord(p)] = i

        def ranks_of(left: np.ndarray, right: np.ndarray) -> np.ndarray:
            pair = left << 32 | right
            at = np.searchsorted(keys[:-1], pair)
            return np.where(keys[at] == pair, places[at], _NONE)

        def coded(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            one = np.array([w in self.whole for w in words], bool) if self.whole else None
            text = "".join(words if one is None else ["" if o else w for w, o in zip(words, one, strict=True)])
            sizes = np.array([len(w) for w in words], np.int64)
            if one is not None:
                sizes[one] = 0
            part = chars[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
            word = np.flatnonzero(sizes)  # of the words still at work: number and size
            size = sizes[word]
            ends = np.cumsum(size)
            rank = np.full(len(part), _NONE)
            inner = np.ones(len(part), bool)
            inner[ends - 1] = False
            at = np.flatnonzero(inner)
            rank[at] = ranks_of(part[at], part[at + 1])
            done = []
            while len(word):
                best = np.minimum.reduceat(rank, ends - size)
                open_ = best < _NONE
                if not open_.all():
                    of = np.repeat(open_, size)
                    done.append((word[~open_], size[~open_], part[~of]))
                    word, size, best, part, rank = word[open_], size[open_], best[open_], part[of], rank[of]
                    if not len(word):
                        break
                hit = np.flatnonzero(rank == np.repeat(best, size))
                place = np.arange(len(hit))
                first = np.concatenate([[True], hit[1:] != hit[:-1] + 1])  # of a run of one part every second one
                hit = hit[(place - np.maximum.accumulate(np.where(first, place, 0))) % 2 == 0]
                kept = np.ones(len(part), bool)
                kept[hit + 1] = False
                part[hit] = made[rank[hit]]
                size = np.add.reduceat(kept, np.cumsum(size) - size, dtype=np.int64)
                hit -= np.arange(len(hit))
                part, rank = part[kept], rank[kept]
                ends = np.cumsum(size)
                rank[hit] = _NONE
                fresh = np.zeros(len(part), bool)
                fresh[hit] = True
                fresh[hit[hit > 0] - 1] = True
                fresh[ends - 1] = False
                near = np.flatnonzero(fresh)
                rank[near] = ranks_of(part[near], part[near + 1])
            counts = np.zeros(len(words), np.int64)
            for w, n, _ in done:
                counts[w] = n
            if one is not None:
                counts[one] = 1
            starts = np.cumsum(counts) - counts
            flat = np.empty(int(counts.sum()), np.int32)
            for w, n, parts in done:
                flat[np.repeat(starts[w] - (np.cumsum(n) - n), n) + np.arange(len(parts))] = out_ids[parts]
            if one is not None:
                flat[starts[one]] = [ids.get(w, UNK) for w, o in zip(words, one, strict=True) if o]
            return counts, flat

        return coded


_NONE = 1 << 60


def train_wordpiece(counts: DataFrame, size: int = 1_000, least: int = 2) -> list[str]:
    """The vocabulary: at each step the pair with the highest count over the product of its parts' counts joins."""
    counts = written(counts.filter(F.col("n") >= least), "counts")
    if counts.count() > TRAIN_WORDS:
        return _wordpiece_apart(counts, size)
    freq = _frequent(counts)
    words = [([w[0], *("##" + c for c in w[1:])], n) for w, n in freq.items()]
    vocabulary = [*SPECIALS, *sorted({c for p, _ in words for c in p})]
    _merge_wordpiece(words, size, vocabulary, set(vocabulary))
    return vocabulary


def _merge_wordpiece(words: Iterable[tuple[list[str], int]], size: int, vocabulary: list[str], known: set[str], single: Counter | None = None, pairs: Counter | None = None) -> list[tuple[str, str]]:
    """Merges of words (parts, n) in order; the vocabulary grows to size. With counts of parts and pairs in all words, of which
    these are some, up to the first pair that occurs in others too."""
    parts, freq = [], []
    here: tuple[Counter, Counter] = Counter(), Counter()
    where: dict[tuple[str, str], set[int]] = defaultdict(set)
    for w, (p, n) in enumerate(words):
        parts.append(p)
        freq.append(n)
        _tally(p, n, w, *here, where)
    if pairs is None:
        single, pairs = here
        elsewhere = Counter()
    else:
        elsewhere = pairs - here[1]
    merges = []
    while len(vocabulary) < size:
        live = [(n / (single[a] * single[b]), (a, b)) for (a, b), n in pairs.items() if n > 0]
        if not live:
            break
        best = max(s for s, _ in live)
        pair = min(p for s, p in live if s == best)
        if elsewhere[pair]:
            break
        merges.append(pair)
        new = pair[0] + pair[1][2:]
        if new not in known:
            known.add(new)
            vocabulary.append(new)
        for w in where.pop(pair, set()):
            _tally(parts[w], -freq[w], w, single, pairs, None)
            parts[w] = merged(parts[w], pair, new)
            _tally(parts[w], freq[w], w, single, pairs, where)
        del pairs[pair]
    return merges


def _tally(parts, n, word, single, pairs, where) -> None:
    for p in parts:
        single[p] += n
    for pair in zip(parts, parts[1:], strict=False):
        pairs[pair] += n
        if where is not None:
            where[pair].add(word)


def encode_wordpiece_word(word: str, vocabulary: set[str], longest: int = 100) -> list[str]:
    """Greedy longest match; <unk> for the whole word if a gap remains or it is too long."""
    if len(word) > longest:
        return ["<unk>"]
    out, at = [], 0
    while at < len(word):
        for end in range(len(word), at, -1):
            piece = ("##" if at else "") + word[at:end]
            if piece in vocabulary:
                out.append(piece)
                at = end
                break
        else:
            return ["<unk>"]
    return out


def encode(docs: DataFrame, words: Column, encode_word, vocabulary: list[str], key: str = "doc_id") -> DataFrame:
    """key and ids array<int>, a row for each row of docs: nothing is shuffled. Each distinct word of a batch is encoded once,
    all of them together where encode_word can (``BpeWords``); else a task keeps the pieces of the first KEPT_WORDS words that
    it meets, the frequent ones among them."""
    ship(docs.sparkSession)
    ids = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})  # a vocabulary, of fixed size

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list[int]] = {}

        def pieces(word: str) -> list[int]:
            if (out := kept.get(word)) is None:
                out = [ids.value.get(t, UNK) for t in encode_word(word)]
                if len(kept) < KEPT_WORDS:
                    kept[word] = out
            return out

        def one_by_one(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
            coded = [pieces(w) for w in words]
            return np.array([len(c) for c in coded], np.int64), np.array([i for c in coded for i in c], np.int32)

        coder = encode_word.many(ids.value) if isinstance(encode_word, BpeWords) else one_by_one
        for batch in batches:
            lists = batch.column(1)
            at = lists.offsets.to_numpy().astype(np.int64)
            found = lists.flatten().dictionary_encode()
            index = found.indices.to_numpy()
            sizes, flat = coder(found.dictionary.to_pylist())
            ends = np.cumsum(sizes[index])
            places = np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(sizes) - sizes)[index] - (ends - sizes[index]), sizes[index])
            offsets = np.concatenate([[0], ends])[at - at[0]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[places], pa.int32()))], [key, "ids"])

    rows = docs.select(key, words.alias("words"))
    return rows.mapInArrow(each, StructType([rows.schema[key], StructField("ids", ArrayType(IntegerType()))]))


def with_specials(ids: Column, longest: int = 2048) -> Column:
    """BOS and EOS around, cut to longest with EOS last; empty stays empty."""
    return F.when(F.size(ids) == 0, ids).otherwise(F.concat(F.array(F.lit(BOS)), F.slice(ids, 1, longest - 2), F.array(F.lit(EOS))))


def bpe_text(tokens: Column) -> Column:
    return F.ltrim(F.replace(F.array_join(tokens, ""), F.lit(SPACE), F.lit(" ")))


def wordpiece_text(tokens: Column) -> Column:
    return F.replace(F.array_join(tokens, " "), F.lit(" ##"), F.lit(""))


def pair_counts(counts: DataFrame) -> DataFrame:
    """left, right and n: adjacent characters of the words of counts(word, n), weighted by the words."""
    chars = F.filter(F.split("word", "", -1), lambda c: c != "")
    zipped = counts.select("n", F.explode(F.arrays_zip(F.slice(chars, 1, F.size(chars) - 1).alias("left"), F.slice(chars, 2, F.size(chars)).alias("right"))).alias("p"))
    return zipped.groupBy(F.col("p.left").alias("left"), F.col("p.right").alias("right")).agg(F.sum("n").alias("n"))
