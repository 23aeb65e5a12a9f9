"""Spelling variants: automata against sorted lists, neighbours against all pairs, the table against the contract's words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quern.llm import spelling as sp
from test_llm import table


def distance_one(a, b):
    """By the definition: one character inserted, deleted or replaced."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def plain(docs):
    """The result rows by the contract's words; docs: (doc_id, text)."""
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            if doc_id is not None and (h := zlib.crc32(f"{doc_id}:{word}".encode())) % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    form, near = {}, {}
    for w in n:
        near[w] = [v for v in n if abs(len(v) - len(w)) < 2 and distance_one(v, w)]
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def some_words(rng, n, letters="abé", low=5, high=9):
    out = {"".join(rng.choice(list(letters), int(rng.integers(low, high)))) for _ in range(n)}
    return sorted(out)


def rows(df):
    return {tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("seed", range(8))
def test_automaton_numbers_words_and_is_minimal(seed):
    rng = np.random.default_rng(seed)
    words = [w.encode("latin-1") for w in some_words(rng, int(rng.integers(1, 200)), low=1, high=8)]
    a = sp.Automaton(words)
    for i, w in enumerate(words):
        held = (np.array([0]), np.array([a.root]), np.array([0]))
        for c in w:
            held = a.step(held, np.array([c]))
        assert held[2].tolist() == [i] and a.final[held[1][0]]
    # As many states as there are different sets of endings.
    heads = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(a.final) == len({frozenset(w[len(h) :] for w in words if w.startswith(h)) for h in heads})


@pytest.mark.parametrize("backward", [False, True])
def test_near_against_all_words(backward):
    rng = np.random.default_rng(3)
    words = some_words(rng, 300, "ab", 5, 10)
    order = sorted((w[::-1] if backward else w).encode("latin-1") for w in words)
    a = sp.Automaton(order)
    for length in range(5, 11):
        asked = [w.encode("latin-1") for w in some_words(rng, 40, "abc", length, length + 1)]
        exact = sp.halves(length, backward)
        query, number = a.near(sp.matrix(asked)[0], length, exact)
        got = {(int(q), int(i)) for q, i in zip(query, number, strict=True)}
        want = {(q, i) for q, x in enumerate(asked) for i, v in enumerate(order) if distance_one(x.decode(), v.decode()) and v[:exact] == x[:exact]}
        # What shares the first characters is found; nothing is found that isn't one error away.
        late = {(q, i) for q, i in want if any(asked[q][:k] == order[i][:k] and asked[q][k + 1 :] in (order[i][k:], order[i][k + 1 :]) or asked[q][:k] == order[i][:k] and asked[q][k:] == order[i][k + 1 :] for k in range(exact, length + 1))}
        assert late <= got <= want


def test_shards_hold_every_completion():
    rng = np.random.default_rng(4)
    words = [w.encode("latin-1") for w in some_words(rng, 600, "abz", 5, 9)]
    for size in (1, 3, 40, 1000):
        least = words[::size]
        home = {w: i // size for i, w in enumerate(words)}
        for w in words[::7]:
            exact = len(w) // 2
            shards = sp.shards_of(w, exact, least)
            for v in words:
                if v[:exact] == w[:exact] and distance_one(v.decode("latin-1"), w.decode("latin-1")):
                    assert home[v] in shards
            assert len(shards) <= 190 * (len(w) + 1)


@pytest.mark.parametrize("most, long", [(10_000, 64), (7, 64), (1, 64), (20, 6), (10_000, 5)])
def test_table_against_all_pairs(spark, most, long):
    rng = np.random.default_rng(most + long)
    vocabulary = some_words(rng, 120, "abé", 4, 9)
    docs = [(int(i) if i % 9 else None, " ".join(w.upper() if rng.random() < 0.2 else w for w in rng.choice(vocabulary, 60, p=None) for _ in range(1 + int(rng.integers(3))))) for i in range(40)]
    docs += [(50, None), (51, ""), (52, "1 2 – ×÷ àÀ"), (3, docs[3][1]), (3, docs[4][1])]
    got = sp.variants(table(spark, [(i, t, None, "s") for i, t in docs]).repartition(3), most=most, long=long)
    assert rows(got) == plain(docs)
    assert got.count() == len(rows(got))


def test_chains_of_forms(spark):
    counts = {"aaaaa": 100, "aaaab": 50, "aaabb": 25, "aabbb": 12, "abbbb": 6, "bbbbb": 3, "zzzzz": 4}
    text = " ".join(w for w, n in counts.items() for _ in range(n))
    got = rows(sp.variants(table(spark, [(None, text, None, "s")])))
    assert {w: r for w, _, r, *_ in got} == {w: "zzzzz" if w == "zzzzz" else "aaaaa" for w in counts}
    assert got == plain([(None, text)])


def test_long_words_and_texts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    base = "".join(rng.choice(list("abcdé"), 3_000))
    words = [base, base[:5] + base[6:], base[:2000] + "z" + base[2001:], base + "q", base[:64], base[:65], base[:63], "x" * 200_000, "x" * 199_999]
    text = " ".join(w for i, w in enumerate(words) for _ in range(3 * (i + 1)))
    monkeypatch.setattr(sp, "PART", 1000)
    assert rows(sp.variants(table(spark, [(None, text, None, "s")]))) == plain([(None, text)])
    assert sp.runs("ab cd " * 1000, 7) == Counter(ab=1000, cd=1000)


def test_odd_tables(spark):
    docs = table(spark, [(1, "same words again " * 5, None, "s")]).selectExpr("*", "1 AS n", "'x' AS word", "2 AS id")
    assert {r[0] for r in rows(sp.variants(docs))} == {"words", "again"}
    assert sp.variants(docs.limit(0)).count() == 0
    assert sp.variants(table(spark, [(1, None, None, None), (None, "", None, None)])).count() == 0
