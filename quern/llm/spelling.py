"""Spelling variants: words that differ by one error, grouped under their most frequent neighbours.

The vocabulary is kept twice, in order of its words and of its words reversed, in shards of ranges. A shard becomes a
minimal acyclic automaton whose transitions count the words before them, so that a path's sum is the word's number in the
shard: what is known of a word (its id and count) is an array under that number. One error lies in one half of a word.
The forward automaton takes the first half as it is and completes the rest with one error, the backward automaton does so
for the second half, and what both find is counted once. Many words descend an automaton at once, as arrays of states.

A word is sent to the shards that its completions can lie in. As a rule its half lies in one shard; where it spans
several, the completions of each place of the error are looked up in the shards' least words, of which there are at most
``MOST_SHARDS`` of up to ``LONG`` characters each. No shard holds more words because a half is frequent.

Words of ``LONG`` characters or more pair by hashes of themselves without one character, place by place, where one of them
is longer than that, and the pairs are confirmed on the words; so every pair is found however long its words are.

Defined cases: null texts have no words; from documents without an id no character is deleted; repeated rows count as
documents of their own; of near words with equal counts the first in code-point order is the form; an empty table gives an
empty result; other columns are ignored; texts are cut between words into parts of ``PART`` characters for counting.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import mix, prefix_sums, ragged, shifted_back
from quern.plans.lineage import written
from quern.session import ship

#: The characters of words, the least length and count of a word, how much more frequent its form is, and the
#: rate of deleted characters.
LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH, MIN_COUNT, TIMES, RATE = 5, 3, 2, 97
#: Words of a shard, about; shards at most; the longest words of shards; characters of a text counted at once; entries that
#: a task counts before it hands them on; words that descend an automaton at once.
SHARD_WORDS, MOST_SHARDS, LONG, PART, HELD, AT_ONCE = 20_000, 65_536, 64, 1 << 20, 200_000, 20_000
_RUN, _GAP = re.compile(f"[{LETTERS}]+"), re.compile(f"[^{LETTERS}]")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The characters that an error may put in, as Latin-1 bytes.
ALPHABET = [bytes([c]) for c in [*range(97, 123), *range(0xC0, 0x100)]]


def lower(text: str) -> str:
    """A-Z in lower case, everything else as it is."""
    return text.encode().translate(_LOWER).decode()


def runs(text: str, part: int = PART) -> Counter[str]:
    """The lower-cased words of a text and how often each occurs."""
    out: Counter[str] = Counter()
    at = 0
    while at < len(text):
        gap = _GAP.search(text, min(at + part, len(text)))
        end = gap.start() if gap else len(text)
        out.update(_RUN.findall(lower(text[at:end])))
        at = end
    return out


def misspelt(words: list[str], doc_id: int | None, rate: int = RATE) -> list[str]:
    """The words as they stand in this document: every rate-th, by a hash, lacks a character."""
    if doc_id is None or not words:
        return words
    start = zlib.crc32(f"{doc_id}:".encode())
    hashes = np.fromiter(map(zlib.crc32, map(str.encode, words), repeat(start)), np.int64, len(words))
    for i in np.flatnonzero(hashes % rate == 0).tolist():
        k = int(hashes[i]) % len(words[i])
        words[i] = words[i][:k] + words[i][k + 1 :]
    return words


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word and n of the words of docs(doc_id, text)."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def take() -> Iterator[pa.RecordBatch]:
            words, n = list(held), list(held.values())
            held.clear()
            for i in range(0, len(words), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[i : i + 10_000], pa.string()), pa.array(n[i : i + 10_000], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if text.is_valid:
                    found = runs(text.as_py())
                    for word, n in zip(misspelt(list(found), doc_id), found.values(), strict=True):
                        if len(word) >= min_length:
                            held[word] = held.get(word, 0) + n
                    if len(held) >= HELD:
                        yield from take()
        yield from take()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(count, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def matrix(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Latin-1 words as rows of bytes, padded with zeros, and their lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    width = int(lengths.max(initial=0)) + 1
    return np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width), lengths


class Automaton:
    """The minimal acyclic automaton of sorted, distinct words. Transitions lie in order of (state, character): ``key`` holds
    both, ``to`` the state they lead to, ``skip`` the number of words of their state that come before theirs."""

    def __init__(self, words: list[bytes]):
        seed = 1
        while not self._build(*matrix(words), np.uint64(seed)):  # two states' hashes met by chance: take other hashes
            seed += 2

    def _build(self, chars: np.ndarray, lengths: np.ndarray, seed: np.uint64) -> bool:
        n, width = chars.shape
        common = np.zeros(n, np.int64)
        if n > 1:
            common[1:] = (chars[1:] != chars[:-1]).argmax(1)
        # A tree of prefixes: a word adds a node for each of its prefixes that the word before it lacks.
        own = lengths - common
        word = np.repeat(np.arange(n), own)
        depth = ragged(common + 1, own)
        node = np.arange(1, len(word) + 1)
        at = np.zeros((n, width), np.int64)
        at[word, depth] = node
        np.maximum.accumulate(at, axis=0, out=at)
        size = len(word) + 1
        parent, char, final = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size, bool)
        parent[1:], char[1:], final[1:] = at[word, depth - 1], chars[word, depth - 1], depth == lengths[word]
        height, below = np.zeros(size, np.int64), final.astype(np.int64)
        by_depth = np.argsort(depth, kind="stable")
        cuts = np.searchsorted(depth[by_depth], np.arange(1, width + 1))
        for d in range(width - 1, 0, -1):
            level = node[by_depth[cuts[d - 1] : cuts[d] if d < width else len(node)]]
            np.maximum.at(height, parent[level], height[level] + 1)
            np.add.at(below, parent[level], below[level])
        # Nodes with the same words below them become one state; the lowest nodes first.
        state, hashes, states = np.zeros(size, np.int64), final.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 0
        by_height = np.argsort(height, kind="stable")
        cuts = np.searchsorted(height[by_height], np.arange(int(height.max()) + 2))
        first_node = []
        for h in range(int(height.max()) + 1):
            level = by_height[cuts[h] : cuts[h + 1]]
            _, lead, which = np.unique(hashes[level], return_index=True, return_inverse=True)
            state[level] = states + which
            first_node.append(level[lead])
            states += len(lead)
            inner = level[level > 0]
            np.add.at(hashes, parent[inner], mix((state[inner] << 8 | char[inner]).astype(np.uint64) * seed))
        lead = np.concatenate(first_node)
        order = np.lexsort((char[1:], parent[1:])) + 1
        degree = np.bincount(parent[1:], minlength=size)
        begin = np.cumsum(degree) - degree
        # Each node must have the transitions of the node that stands for its state.
        same = (degree == degree[lead[state]]) & (final == final[lead[state]])
        if not same.all():
            return False
        mine, its = order[ragged(begin, degree)], order[ragged(begin[lead[state]], degree)]
        if (char[mine] != char[its]).any() or (state[mine] != state[its]).any():
            return False
        edges = order[ragged(begin[lead], degree[lead])]
        source = np.repeat(np.arange(states), degree[lead])
        self.root, self.final, self.words = int(state[0]), final[lead], int(below[0])
        self.key, self.to, self.degree = source << 8 | char[edges], state[edges], degree[lead]
        self.first = np.cumsum(self.degree) - self.degree
        total = np.cumsum(below[edges]) - below[edges]
        self.skip = total - np.repeat(np.append(total, 0)[self.first], self.degree) + self.final[source]
        return True

    def step(self, held: tuple[np.ndarray, ...], chars: np.ndarray) -> tuple[np.ndarray, ...]:
        """(query, state, number) after the query's next character, of those that have it."""
        query, state, number = held
        key = state << 8 | chars[query]
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        ok = self.key[at] == key
        at = at[ok]
        return query[ok], self.to[at], number[ok] + self.skip[at]

    def any_step(self, held: tuple[np.ndarray, ...], but: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
        """(query, state, number) after any character, or any but the query's."""
        query, state, number = held
        n = self.degree[state]
        at, query = ragged(self.first[state], n), np.repeat(query, n)
        number = np.repeat(number, n) + self.skip[at]
        if but is None:
            return query, self.to[at], number
        ok = (self.key[at] & 255) != but[query]
        return query[ok], self.to[at[ok]], number[ok]

    def near(self, chars: np.ndarray, length: int, exact: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, number of a word) of the words one error away, for queries of one length (rows of characters), the first
        exact characters without it."""
        held = (np.arange(len(chars)), np.full(len(chars), self.root), np.zeros(len(chars), np.int64))
        joined = lambda *parts: tuple(np.concatenate(x) for x in zip(*parts, strict=True))
        if not len(self.key):
            return held[0][:0], held[2][:0]
        for k in range(exact):
            held = self.step(held, chars[:, k])
        wrong = tuple(x[:0] for x in held)
        for k in range(exact, length):
            inserted = self.step(joined(wrong, self.any_step(held)), chars[:, k])
            wrong = joined(inserted, self.any_step(held, chars[:, k]), held)
            held = self.step(held, chars[:, k])
        wrong = joined(wrong, self.any_step(held))
        ok = self.final[wrong[1]]
        pairs = np.unique(wrong[0][ok] * np.int64(self.words + 1) + wrong[2][ok])
        return pairs // (self.words + 1), pairs % (self.words + 1)


def halves(length: int, backward: bool) -> int:
    """Characters that a direction takes as they are."""
    return length - length // 2 if backward else length // 2


def shards_of(word: bytes, exact: int, least: list[bytes]) -> set[int]:
    """The shards, by their least words, in which words with one error after so many characters can lie."""
    out: set[int] = set()

    def at(x: bytes) -> int:
        return max(0, bisect_right(least, x) - 1)

    for k in range(exact, len(word) + 1):
        head, low = word[:k], at(word[:k])
        if low == at(head + b"\xff" * (len(word) + 2 - k)):  # all that begins so, whatever the error is and wherever
            out.add(low)
            return out
        for x in ALPHABET:
            out.add(at(head + x + word[k:]))
            out.add(at(head + x + word[k + 1 :]))
        out.add(at(head + word[k + 1 :]))
    return out


def near_words(words: DataFrame, most: int = SHARD_WORDS, long: int = LONG) -> DataFrame:
    """id, near_id and near_n of each pair of words(id, word, n) one error apart, both ways; ids follow the words' order."""
    spark = words.sparkSession
    short = words.filter(F.length("word") <= long)
    k = max(1, min(MOST_SHARDS, -(-short.count() // most)))
    back = short.select("id", "n", F.reverse("word").alias("word"))
    tables = []
    for backward, table in enumerate((short.select("id", "n", "word"), back)):
        sharded = table.repartitionByRange(k, "word").sortWithinPartitions("word").withColumn("shard", F.spark_partition_id())
        sharded = written(sharded, "shards")
        firsts = sharded.groupBy("shard").agg(F.min("word").alias("word")).orderBy("word").collect()  # a row a shard
        sent = spark.sparkContext.broadcast(([r["word"].encode("latin-1") for r in firsts], [r["shard"] for r in firsts]))

        def route(batches: Iterator[pa.RecordBatch], sent=sent, backward=backward) -> Iterator[pa.RecordBatch]:
            least, shards = sent.value
            for batch in batches:
                found = [[shards[i] + backward * MOST_SHARDS for i in sorted(shards_of(w, halves(len(w), bool(backward)), least))] for w in (x.encode("latin-1") for x in batch.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["id", "word", "shards"])

        asked = sharded.select("id", "word").mapInArrow(route, "id long, word string, shards array<int>")
        tables.append(sharded.select((F.col("shard") + backward * MOST_SHARDS).alias("shard"), F.lit(0).alias("asks"), "word", "id", "n"))
        tables.append(asked.select(F.explode("shards").alias("shard"), F.lit(1).alias("asks"), "word", "id", F.lit(0).cast("long").alias("n")))
    rows = tables[0].unionByName(tables[1]).unionByName(tables[2]).unionByName(tables[3])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, automaton = None, [], None
        asked: list[tuple[bytes, int]] = []

        def answers() -> Iterator[pa.RecordBatch]:
            nonlocal automaton, held
            if automaton is None:
                automaton = Automaton([w for w, _, _ in held]), np.array([i for _, i, _ in held], np.int64), np.array([n for _, _, n in held], np.int64)
                held = []
            a, ids, counts = automaton
            by_length: dict[int, list[tuple[bytes, int]]] = {}
            for w, i in asked:
                by_length.setdefault(len(w), []).append((w, i))
            for length, group in by_length.items():
                query, number = a.near(matrix([w for w, _ in group])[0], length, halves(length, shard >= MOST_SHARDS))
                own = np.array([i for _, i in group], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own[query]), pa.array(ids[number]), pa.array(counts[number])], ["id", "near_id", "near_n"])
            asked.clear()

        for batch in batches:
            for s, asks, word, i, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != shard:
                    if asked:
                        yield from answers()
                    shard, held, automaton = s, [], None
                if asks:
                    asked.append((word.encode("latin-1"), i))
                    if len(asked) == AT_ONCE:
                        yield from answers()
                else:
                    held.append((word.encode("latin-1"), i, n))
        if asked:
            yield from answers()

    found = rows.repartition("shard").sortWithinPartitions("shard", "asks", "word").mapInArrow(match, "id long, near_id long, near_n long")
    if words.filter(F.length("word") > long).isEmpty():
        return found
    return found.unionByName(near_long_words(words.filter(F.length("word") >= long), long))


def one_error(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes a to b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def near_long_words(words: DataFrame, long: int) -> DataFrame:
    """The pairs of which one word is longer than long."""

    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                chars = np.frombuffer(text.encode("latin-1"), np.uint8)
                sums, n = prefix_sums(chars), len(chars)
                for a in range(0, n, 1 << 16):
                    k = np.arange(a, min(n, a + (1 << 16)))
                    # Without the k-th character, the rest stands one place further to the left.
                    rest = shifted_back(sums[n] - sums[k + 1], np.ones(len(k), np.int64))
                    h = mix(sums[k] + rest)
                    keys = np.concatenate((mix(h + k.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.unique(h)))
                    kinds = np.repeat([0, 1], [len(k), len(keys) - len(k)]).astype(np.int32)
                    lengths = np.where(kinds == 0, n, n - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i)), pa.array(kinds), pa.array(lengths), pa.array(keys.view(np.int64))], ["id", "kind", "length", "key"])
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([2], pa.int32()), pa.array([n]), pa.array(mix(sums[n:]).view(np.int64))], ["id", "kind", "length", "key"])

    keys = written(words.select("id", "word").mapInArrow(without, "id long, kind int, length long, key long"), "without")
    of = lambda kind, name: keys.filter(F.col("kind") == kind).select(F.col("id").alias(name), "length", "key").distinct()
    # Rows of one key differ in that character alone, or in one that lacks: no more than the alphabet times the length.
    replaced = of(0, "a").join(of(0, "b"), ["length", "key"]).filter("a < b").select("a", "b")
    deleted = of(1, "a").join(of(2, "b"), ["length", "key"]).select("a", "b")
    pairs = replaced.union(deleted).distinct()
    side = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"word_{x}"), F.col("n").alias(f"n_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter((F.length("word_a") > long) | (F.length("word_b") > long))

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [one_error(a, b) for a, b in zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select([0, 2, 3, 5])

    sure = both.select("a", "word_a", "n_a", "b", "word_b", "n_b").mapInArrow(confirmed, "a long, n_a long, b long, n_b long")
    return sure.select(F.inline(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("near_id"), F.col("n_b").alias("near_n")), F.struct(F.col("b").alias("id"), F.col("a").alias("near_id"), F.col("n_a").alias("near_n")))))


def roots(forms: DataFrame) -> DataFrame:
    """id and root of forms(id, form_id): the last of a chain of forms. Counts grow along a chain at least twofold, so it
    has less than 63 steps, and each round doubles the steps that are known."""
    known = written(forms.select("id", F.col("form_id").alias("root")), "roots")
    while True:
        up = known.select(F.col("id").alias("root"), F.col("root").alias("further"))
        further = written(known.join(up, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        known = further.select("id", "root")
        if further.filter("moved").isEmpty():
            return known


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, times: int = TIMES, most: int = SHARD_WORDS, long: int = LONG) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of docs(doc_id, text)."""
    return grouped(written(vocabulary(docs, min_length, min_count), "vocabulary"), times, most, long)


def grouped(words: DataFrame, times: int = TIMES, most: int = SHARD_WORDS, long: int = LONG) -> DataFrame:
    """The same of words(word, n), a row a word, which should be a stored table."""
    k = max(1, min(MOST_SHARDS, -(-words.count() // most)))
    # Ids follow the order of code points, so the least id is the first word.
    numbered = written(words.repartitionByRange(k, "word").sortWithinPartitions("word").select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")
    links = near_words(numbered, most, long).repartition("id").groupBy("id", "near_id").agg(F.max("near_n").alias("near_n"))
    first = F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near_id").alias("form_id")))
    best = links.groupBy("id").agg(F.count("*").alias("n_near"), first.alias("x")).select("id", "n_near", F.col("x.form_id"), (-F.col("x.n")).alias("form_n"))
    judged = numbered.select("id", "word", "n").join(best, "id", "left")
    has = F.col("form_n") >= times * F.col("n")
    judged = judged.select("id", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("form_id")).alias("form_id"), F.when(has, F.col("form_n")).alias("form_n"))
    judged = written(judged, "judged")
    linked = judged.filter("form_id IS NOT NULL")
    chain = roots(linked)
    name = lambda key, out: numbered.select(F.col("id").alias(key), F.col("word").alias(out))
    named = linked.join(name("form_id", "form"), "form_id").join(chain, "id").join(name("root", "root_word"), "root")
    named = named.select("word", "form", F.col("root_word").alias("root"), "n", "n_near", "form_n")
    alone = judged.filter("form_id IS NULL").select("word", F.lit(None).cast("string").alias("form"), F.col("word").alias("root"), "n", "n_near", "form_n")
    return named.unionByName(alone)


#: The contract in SQL: neighbours by joins of words without one character; CRC-32 is computed from its polynomial.
SQL = rf"""
WITH RECURSIVE codes AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i::BIGINT)) AS t),
runs AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[{LETTERS}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents) GROUP BY doc_id, w),
hashed AS (SELECT w, c, xor(4294967295, list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195, unicode(x)::BIGINT - 64] END)),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT)) AS h FROM runs, codes),
words AS (SELECT word, sum(c)::BIGINT AS n FROM (SELECT CASE WHEN h % {RATE} = 0 THEN left(w, (h % length(w))::BIGINT) || substr(w, (h % length(w))::BIGINT + 2) ELSE w END AS word, c FROM hashed) WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(c) >= {MIN_COUNT}),
less AS (SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS x FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, b.word AS other FROM less a JOIN less b ON a.x = b.x AND a.i = b.i AND a.word <> b.word UNION SELECT less.word, words.word FROM less JOIN words ON words.word = x UNION SELECT words.word, less.word FROM less JOIN words ON words.word = x),
best AS (SELECT near.word, count(*) AS n_near, arg_min(other, {{'a': -o.n, 'b': encode(other)}}) AS other, max(o.n) AS n FROM near JOIN words o ON o.word = other GROUP BY near.word),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN b.n >= {TIMES} * w.n THEN other END AS form, CASE WHEN b.n >= {TIMES} * w.n THEN b.n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (SELECT word, word AS root, 0 AS step FROM forms UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN forms f ON f.word = c.root AND f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word) USING (word)
"""
