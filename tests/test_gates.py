"""Release gates, shaped rewards and a relational source that runs inside the test."""

import json

import pytest
from pyspark.sql import functions as F

from quern.operators import evaluation, gates, tokenizers
from quern.sources import files


def weights(spark, path, bad=None, rows=14):
    data = [("embedding", i, [0.5, float(i)]) for i in range(rows)] + [("head", 0, [1.0, 2.0, 3.0])] + ([bad] if bad else [])
    spark.createDataFrame(data, "tensor string, row int, values array<double>").write.mode("overwrite").parquet(f"{path}/weights")


def test_release(spark, tmp_path):
    folder = str(tmp_path / "r")
    checks = lambda: {r["check"]: r["passed"] for r in gates.release(spark, folder).collect()}
    assert checks() == dict.fromkeys(("files", "state", "vocabulary", "weights", "match"), False)
    tokenizers.Tokenizer([*tokenizers.SPECIALS, "a", "b"]).save(spark, f"{folder}/tokenizer")
    files.write_small(spark, f"{folder}/train_state.json", '{"global_step": 7, "best_loss": Infinity}')
    weights(spark, folder)
    assert all(checks().values())
    for value in (float("nan"), float("inf"), None):
        weights(spark, folder, ("head", 1, [1.0, value, 2.0]))
        assert checks() == {"files": True, "state": True, "vocabulary": True, "weights": False, "match": True}
    weights(spark, folder, ("head", 1, [1.0]))
    assert not checks()["weights"]
    weights(spark, folder, rows=13)
    assert checks()["weights"] and not checks()["match"]
    files.write_small(spark, f"{folder}/tokenizer/vocab.json", json.dumps({"a": 0, "b": 2}))
    files.write_small(spark, f"{folder}/train_state.json", "{")
    assert not checks()["vocabulary"] and not checks()["state"]


def plain_reward(base, tokens, least, most, bonus, penalty):
    n = len(tokens)
    length = bonus if least <= n <= most else bonus * n / least - bonus if n < least else -bonus * (n - most) / most
    seen, repeats = set(), 0
    for pair in zip(tokens, tokens[1:], strict=False):
        repeats += pair in seen
        seen.add(pair)
    return base + length - (penalty * repeats / max(n - 1, 1) if n > 2 else 0)


@pytest.mark.parametrize("tokens", [[], [1], [1, 1], [1, 1, 1], [1, 2, 1, 2, 1], list(range(6)), [3] * 30])
def test_shaped_rewards(spark, tokens):
    df = spark.createDataFrame([(tokens,)], "t array<int>")
    [r] = df.select(evaluation.shaped_reward(F.lit(0.25), F.col("t"), 3, 6, 0.5, 0.3).alias("r")).collect()
    assert r["r"] == pytest.approx(plain_reward(0.25, tokens, 3, 6, 0.5, 0.3))


def test_a_relational_table_is_read_in_parts_with_its_filters(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([(i, f"n{i}", None if i % 5 == 0 else i * 1.5) for i in range(100)], "id int, name string, amount double")
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows.write.format("jdbc").options(url=url, dbtable="usage_records", **options).mode("overwrite").save()
    got = files.read_table(spark, url, "usage_records", partitionColumn="id", lowerBound="0", upperBound="100", numPartitions="4", **options)
    assert got.rdd.getNumPartitions() == 4
    assert sorted(tuple(r) for r in got.collect()) == sorted(tuple(r) for r in rows.collect())
    some = got.filter("id >= 90 AND amount IS NOT NULL").select("name")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ID,90)" in plan.replace("id", "ID") and {r["name"] for r in some.collect()} == {f"n{i}" for i in range(90, 100) if i % 5}


def test_passing_by_language_equals_the_judgement(spark):
    from quern.operators import language, quality

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language.detector(language.profiles(docs))
    want = {r["doc_id"] for r in quality.judged(docs, languages=found).filter("reason_code IS NULL").collect()}
    assert {r["doc_id"] for r in quality.passing(docs, languages=found).collect()} == want and want
