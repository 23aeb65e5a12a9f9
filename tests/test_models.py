"""Language models against plain versions of their definitions."""

import math
from collections import Counter

import numpy as np
import pytest

from quern.operators import perplexity


def plain_model(texts):
    """p(w | u, v) by the definition, over words; '?' is any unknown word."""
    grams = Counter()
    for t in texts:
        w = ["<s>", "<s>", *(t or "").lower().split(), "</s>"]
        grams.update(zip(w, w[1:], w[2:], strict=False))
    two = Counter((v, w) for _, v, w in grams)
    one = Counter(w for _, w in two)

    def discount(counts):
        n = [sum(c == k for c in counts.values()) for k in (1, 2, 3, 4)]
        if not all(n):
            return 0.5, 1.0, 1.5
        y = n[0] / (n[0] + 2 * n[1])
        return tuple(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))

    d3, d2, d1 = discount(grams), discount(two), discount(one)

    def mixed(counts, context, w, d, shorter):
        own = {g: c for g, c in counts.items() if g[:-1] == context} if not isinstance(w, tuple) else {}
        if not own:
            return shorter
        total = sum(own.values())
        c = own.get((*context, w), 0)
        return (c - d[min(c, 3) - 1] if c else 0) / total + sum(d[min(c, 3) - 1] for c in own.values()) / total * shorter

    def p(u, v, w):
        total = sum(one.values())
        c = one.get(w, 0)
        p1 = (c - d1[min(c, 3) - 1] if c else 0) / total + sum(d1[min(c, 3) - 1] for c in one.values()) / total / (len(one) + 1)
        return mixed(grams, (u, v), w, d3, mixed(two, (v,), w, d2, p1))

    return p, set(one)


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(30)]
    return [" ".join(rng.choice(words, int(rng.integers(0, 40)), p=np.arange(30, 0, -1) / 465)) for _ in range(60)] + ["", None, "W1 w2\n\tw3"]


def test_perplexity_against_the_definition(spark, texts):
    fresh = ["w1 w2 unheard of w3", "w1 w1 w1 w1", "", None, texts[0]]
    model = perplexity.fit(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    rows = spark.createDataFrame([(None if i % 2 else 5, t) for i, t in enumerate(fresh)] + [(5, fresh[0])], "id long, text string")
    p, _ = plain_model(texts)
    got = perplexity.score(rows, model).collect()
    assert len(got) == 6
    for r in got:
        w = ["<s>", "<s>", *(r["text"] or "").lower().split(), "</s>"]
        logs = [math.log(p(*g)) for g in zip(w, w[1:], w[2:], strict=False)]
        assert r["n_words"] == len(logs) and r["perplexity"] == pytest.approx(math.exp(-sum(logs) / len(logs)))


def test_probabilities_sum_to_one_after_any_words(spark, texts):
    p, known = plain_model(texts)
    model = perplexity.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    h = {r["w"]: r["h"] for r in spark.createDataFrame([(w,) for w in [*known, "?"]], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    h |= {"<s>": perplexity.BEGIN, "</s>": perplexity.END}
    contexts = [("<s>", "<s>"), ("w1", "w2"), ("?", "w1"), ("?", "?"), ("<s>", "w5")]
    asked = spark.createDataFrame([(h[u], h[v], h[w]) for u, v in contexts for w in [*known, "?"]], "u long, v long, w long")
    sums = Counter()
    for r in model.probabilities(asked).collect():
        sums[r["u"], r["v"]] += r["p"]
        assert r["p"] > 0
    assert len(sums) == len(contexts) and all(s == pytest.approx(1) for s in sums.values())


def test_gate_tells_prose_from_noise(spark, texts):
    rng = np.random.default_rng(2)
    noise = [(1000 + i, " ".join(f"z{rng.integers(10**6)}" for _ in range(20))) for i in range(5)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + noise, "doc_id long, text string")
    from pyspark.sql import functions as F

    out = {r["doc_id"]: r for r in perplexity.gate(docs, 60.0, F.col("doc_id") >= 50).collect()}
    assert len(out) == docs.count() and all(not out[i]["kept"] and out[i]["held_out"] for i, _ in noise)
    assert sum(out[i]["kept"] for i in range(60)) > 50
    assert all(r["kept"] for r in perplexity.gate(docs, None).collect())
    assert perplexity.gate(docs.limit(0), 1.0).count() == 0
    assert perplexity.gate(docs, 2.0, F.lit(True)).filter("perplexity = 1").count() == docs.count()


def segmentations(word):
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        for rest in segmentations(word[i:]):
            yield [word[:i], *rest]


def random_model(rng, longest=4):
    from quern.operators.unigram import Unigram

    pieces = {"".join(rng.choice(list("abc"), int(rng.integers(1, longest + 1)))) for _ in range(20)} | {"a", "b"}
    x = rng.random(len(pieces))
    return Unigram({p: float(v) for p, v in zip(sorted(pieces), np.log(x / x.sum()), strict=True)}, longest)


@pytest.mark.parametrize("seed", range(5))
def test_segmentations_against_all_of_them(seed):
    from quern.operators import unigram

    rng = np.random.default_rng(seed)
    m = random_model(rng)
    log = lambda s: sum(m.logs.get(p, m.floor if len(p) == 1 else -math.inf) if len(p) <= m.longest else -math.inf for p in s)
    for _ in range(25):
        word = "".join(rng.choice(list("abcd"), int(rng.integers(1, 9))))
        every = [(log(s), s) for s in segmentations(word)]
        every = [(x, s) for x, s in every if x > -math.inf]
        score, pieces = unigram.best(word, m.logs, m.longest, m.floor)
        assert score == pytest.approx(max(x for x, _ in every)) and "".join(pieces) == word and log(pieces) == pytest.approx(score)
        total, found = unigram.expected(word, m.logs, m.longest, m.floor)
        mass = sum(math.exp(x) for x, _ in every)
        assert total == pytest.approx(math.log(mass))
        want = Counter()
        for x, s in every:
            for p in s:
                if p in m.logs:
                    want[p] += math.exp(x) / mass
        assert found == pytest.approx(dict(want))


def test_likelihood_rises_and_the_vocabulary_has_its_size(spark):
    from quern.operators import unigram

    rng = np.random.default_rng(9)
    stems, ends = ["walk", "talk", "jump", "work"], ["", "s", "ed", "ing", "er", "ers"]
    counts = [(unigram.SPACE + rng.choice(stems) + rng.choice(ends), int(rng.integers(1, 50))) for _ in range(60)]
    frame = spark.createDataFrame(counts, "word string, n long").groupBy("word").sum("n").withColumnRenamed("sum(n)", "n")
    trace = []
    m = unigram.train(frame, 30, 500, 8, rounds=4, trace=trace)
    assert len(m.logs) <= 30 and {c for w, _ in counts for c in w} <= set(m.logs)
    for a, b in zip(trace, trace[1:], strict=False):
        assert a is None or b is None or b >= a - 1e-6
    assert sum(math.exp(x) for x in m.logs.values()) == pytest.approx(1)
    assert sum(x is None for x in trace) > 1 and {"ing", unigram.SPACE + "talk"} & set(m.logs)


def test_unigram_round_trip_with_odd_rows(spark):
    from quern.operators import tokenizers, unigram

    rows = [(1, "the cat sat on the mat"), (1, "the cat sat on the mat"), (None, "the dog"), (None, "a cat"), (1, "mat"), (2, ""), (3, None), (4, "zebra é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    m = unigram.train(tokenizers.word_counts(docs.filter("doc_id is null or doc_id < 4"), unigram.words(docs["text"])), 40, 200, 6)
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in m.encode(docs).collect())
    vocabulary = m.vocabulary
    ids = lambda t: tuple(vocabulary.index(p) if p in m.logs else tokenizers.UNK for w in (t or "").split() for p in m.pieces(unigram.SPACE + w))
    assert got == Counter((i, ids(t)) for i, t in rows)
    texts = sorted(r["t"] for r in m.encode(docs.filter("doc_id = 1")).select(m.decode("ids").alias("t")).collect())
    assert texts == sorted(t for i, t in rows if i == 1)
    assert unigram.train(tokenizers.word_counts(docs.limit(0), unigram.words(docs["text"]))).logs == {}


def test_unigram_sums_of_many_words_at_once_equal_each_words_own(spark):
    from quern.operators import unigram

    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdé𝒳"), rng.integers(1, 30))) for _ in range(200)] + ["zz", "z", "a" * 400]
    pieces = sorted({w[i : i + k] for w in words[:40] for i in range(len(w)) for k in (1, 2, 3, 5)} - {"z"})
    logs = dict(zip(pieces, np.log(rng.dirichlet(np.ones(len(pieces)))).tolist(), strict=True))
    dropped = [p for p in pieces if len(p) == 3][::2]
    model = unigram.Unigram({p: x for p, x in logs.items() if p not in dropped}, 5)
    frame = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long").repartition(3)
    log, found = unigram.expectations(unigram.lattices(frame, pieces, 5), pieces, model)
    total, want = 0.0, {}
    for i, w in enumerate(words):
        one, each = unigram.expected(w, model.logs, 5, model.floor)
        total += (i + 1) * one
        for p, x in each.items():
            want[p] = want.get(p, 0.0) + (i + 1) * x
    assert log == pytest.approx(total) and {p for p, x in found.items() if x > 1e-12} == {p for p, x in want.items() if x > 1e-12}
    assert all(found[p] == pytest.approx(x, rel=1e-8) for p, x in want.items() if x > 1e-12)
