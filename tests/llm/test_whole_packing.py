"""Packing of whole documents: the solver against exhaustive packings and bounds, the pieces against the tokenizer library."""

import functools
import os
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quern.llm import configuration_packing as cp
from quern.llm.queries import tokenizer_path
from test_llm import prose, table


def check(packing, histogram, window):
    held = np.zeros_like(histogram)
    for use, times in packing:
        assert sum(a * n for a, n in use) <= window and times > 0
        for a, n in use:
            held[a] += n * times
    assert (held == histogram).all()


def fewest(lengths, window):
    """The least number of windows, by trying all places for each piece."""

    @functools.cache
    def go(rest, rooms):
        if not rest:
            return 0
        x, rest = rest[0], rest[1:]
        tries = [1 + go(rest, tuple(sorted((*rooms, window - x))))]
        for i, r in enumerate(rooms):
            if r >= x and (i == 0 or rooms[i - 1] != r):
                tries.append(go(rest, tuple(sorted((*rooms[:i], r - x, *rooms[i + 1 :])))))
        return min(tries)

    return go(tuple(sorted(lengths, reverse=True)), ())


@pytest.mark.parametrize("seed", range(6))
def test_small_packings_against_all_packings(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 17, int(rng.integers(1, 10))).tolist()
    histogram = np.bincount(lengths, minlength=17)
    packing, least = cp.solve(histogram, 16)
    check(packing, histogram, 16)
    best = fewest(lengths, 16)
    assert least <= best <= cp.windows(packing) <= best + (best > 4)


def test_prices_against_all_fillings():
    rng = np.random.default_rng(7)
    prices = np.concatenate(([0.0], rng.random(12) * (rng.random(12) < 0.6)))

    @functools.cache
    def best(c):
        return max([0.0] + [prices[x] + best(c - x) for x in range(1, c + 1)])

    got, first = cp.priced(prices, 12)
    assert got == pytest.approx([best(c) for c in range(13)])
    for c in range(13):
        use = cp.filled(first, c)
        assert sum(use) <= c and sum(prices[x] for x in use) == pytest.approx(best(c))


def test_fullest_is_a_fullest_subset():
    rng = np.random.default_rng(8)
    for _ in range(40):
        left = rng.integers(0, 3, 15)
        left[0] = 0
        places = int(rng.integers(1, 15))
        sums = {0}
        for x, n in enumerate(left.tolist()):
            for _ in range(n):
                sums |= {s + x for s in sums if s + x <= places}
        got = cp.fullest(left, places)
        assert sum(got) == max(sums) and all(got.count(x) <= left[x] for x in got)


@pytest.mark.parametrize("low, high, n, slack", [(1, 1025, 20_000, 0.006), (300, 420, 5_000, 0.05), (1, 300, 3_000, 0.001), (1024, 1025, 50, 0), (513, 1025, 400, 0.5)])
def test_windows_against_the_bound(low, high, n, slack):
    lengths = np.random.default_rng(n).integers(low, high, n)
    histogram = np.bincount(lengths, minlength=1025)
    packing, least = cp.solve(histogram)
    check(packing, histogram, 1024)
    assert least >= int(np.ceil(lengths.sum() / 1024)) and cp.windows(packing) <= least * (1 + slack) + 1
    if low > 512:
        assert cp.windows(packing) == n


def test_the_program_is_needed_where_sizes_are_hard():
    """Five hundred pieces each of 511, 257 and 256: the largest first with whatever fills it best strands the rest."""
    histogram = np.zeros(1025, np.int64)
    histogram[[511, 257, 256]] = 500
    packing, least = cp.solve(histogram)
    check(packing, histogram, 1024)
    assert cp.windows(packing) == least == 500


def test_huge_counts():
    histogram = np.zeros(1025, np.int64)
    histogram[1:] = np.random.default_rng(9).integers(1, 10**12, 1024)
    packing, least = cp.solve(histogram)
    check(packing, histogram, 1024)
    assert cp.windows(packing) <= least * 1.01 and len(cp.plan_of(packing)["length"]) < 60_000


def held(rows, texts, encoder, window=1024):
    """Each id in one piece, pieces whole but for full ones at the end, sequences gapless and no longer than the window."""
    of, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= window
    for doc_id, text in texts:
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, r in enumerate(sorted(of.pop(doc_id), key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == window or k == 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    assert not of
    return len(sequences)


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    texts = [(i, prose(rng, int(n))) for i, n in enumerate(rng.integers(0, 900, 120))]
    texts += [(200, None), (201, ""), (202, prose(rng, 40_000)), (203, "ünï <|endoftext|> 😀"), (204, "x" * 300_000)]
    rows = cp.pack(table(spark, [(i, t, None, "s") for i, t in texts]).repartition(5), tokenizer_path()).collect()
    encoder = Tokenizer.from_file(tokenizer_path())
    n = held(rows, texts, encoder)
    assert n <= sum(r["length"] for r in rows) / 1024 * 1.02 + 1


def test_odd_rows_and_tables(spark):
    docs = spark.createDataFrame([(None, "a", 1), (None, "a", 2), (5, "b b", 3), (5, "c", 4)], "doc_id long, text string, sequence_id int")
    rows = cp.pack(docs, tokenizer_path()).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in rows) == [(0, 2), (0, 2), (5, 2), (5, 3)]
    assert {r["sequence_id"] for r in rows} == {0} and sorted(r["offset"] for r in rows)[0] == 0
    assert cp.pack(docs.limit(0), tokenizer_path()).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_whole_table(spark):
    from tokenizers import Tokenizer

    from quern.llm.queries import op13_whole_packing

    rows = op13_whole_packing(spark, "/root/testdata/sf0.001").collect()
    texts = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    held(rows, texts, Tokenizer.from_file(tokenizer_path()))
