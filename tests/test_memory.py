"""Passages by posting lists against a full scan, and contrastive losses against the definition."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import contrastive, vectors
from quern.sources import memory


def passages(spark, rows):
    return spark.createDataFrame(rows, "id long, text string, kind string, source string")


def test_search_equals_a_scan(spark, tmp_path):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(40)] + ["The", "the"]
    rows = [(i, " ".join(rng.choice(words, int(rng.integers(1, 9)))), "semantic", None) for i in range(80)]
    m = memory.Memory(spark, str(tmp_path / "m"), 8)
    m.store(passages(spark, rows[:50]).repartition(3))
    m.store(passages(spark, rows[50:] + [(900, "  ", "semantic", None), (901, None, "semantic", None)]))
    assert m.passages().count() == 80
    queries = [(1, "w1 W2 the"), (2, "w3"), (3, "nothing of these"), (4, ""), (5, None), (6, "w5 w5\tw6\n w7")]
    got = m.search(spark.createDataFrame(queries, "query_id long, text string"), 4).collect()
    for q, text in queries:
        mine = [(r["id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q]
        scan = [(r["id"], r["score"]) for r in vectors.keyword_overlap(passages(spark, rows), "text", text, 4).collect()] if text and text.strip() else []
        assert mine == scan
    texts = {r["query_id"]: r["text"] for r in m.recall(spark.createDataFrame(queries, "query_id long, text string"), 2).collect()}
    assert len(texts) == 6 and texts[3] == texts[4] == "" and texts[1].count(memory.BETWEEN) == 1


def test_only_lists_of_the_words_are_read(spark, tmp_path):
    m = memory.Memory(spark, str(tmp_path / "m"), 64)
    m.store(passages(spark, [(i, f"word{i} common", "semantic", None) for i in range(200)]))
    found = m.search(spark.createDataFrame([(1, "word7")], "query_id long, text string"))
    assert [r["id"] for r in found.collect()] == [7]
    assert len({f.split("bucket=")[1].split("/")[0] for f in found.inputFiles()}) == 1


def test_kinds_broken_batches_and_clearing(spark, tmp_path):
    m = memory.Memory(spark, str(tmp_path / "m"), 4)
    q = spark.createDataFrame([(1, "paris result:")], "query_id long, text string")
    assert m.search(q).count() == 0 and m.passages().count() == 0
    m.store(memory.episodes(spark.createDataFrame([(1, "find the city", "Paris")], "id long, task string, result string")))
    m.store(memory.facts(spark.createDataFrame([(2, "Paris is large", None), (3, "nothing", "book")], "id long, fact string, source string")))
    # A batch without its mark is not there.
    passages(spark, [(9, "paris paris", "semantic", None)]).write.parquet(str(tmp_path / "m/passages/batch=00000002"))
    assert {(r["id"], r["kind"], r["source"]) for r in m.passages().collect()} == {(1, "episodic", None), (2, "semantic", "unknown"), (3, "semantic", "book")}
    assert [r["text"] for r in m.recall(q).collect()] == ["Task: find the city\nResult: Paris\n---\nParis is large"]
    m.store(passages(spark, [(9, "paris", "semantic", None)]))
    assert m.passages().count() == 4
    m.clear()
    assert m.passages().count() == 0 and m.search(q).count() == 0


@pytest.mark.parametrize("block", [3, 7, 1000])
def test_contrastive_loss_by_the_definition(spark, block):
    rng = np.random.default_rng(2)
    pairs = [(b, p, rng.normal(size=5).tolist(), rng.normal(size=5).tolist()) for b, n in ((0, 9), (1, 4), (2, 1)) for p in range(n)]
    odd = [(0, 100, [0.0] * 5, [1.0] * 5), (0, 101, None, [1.0] * 5)]
    got = {(r["batch"], r["pair"], r["side"]): r["loss"] for r in contrastive.nt_xent(spark.createDataFrame(pairs + odd, "batch long, pair long, a array<double>, b array<double>").repartition(3), 0.3, block).collect()}
    assert len(got) == 2 * len(pairs)
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    for batch in (0, 1, 2):
        z = {(p, s): unit(v) for b, p, *both in pairs if b == batch for s, v in enumerate(both)}
        for (p, s), x in z.items():
            total = sum(math.exp(x @ y / 0.3) for k, y in z.items() if k != (p, s))
            assert got[batch, p, s] == pytest.approx(-math.log(math.exp(x @ z[p, 1 - s] / 0.3) / total))


def test_large_latency_table_is_ranked(spark):
    from quern.operators.corpus import ranks

    values = np.random.default_rng(3).random(1001)
    r = ranks(spark.createDataFrame([(float(v),) for v in values], "value double").repartition(5), ["value"], "r")
    assert r.filter(F.col("r") == 501).first()["value"] == pytest.approx(float(np.median(values)))
