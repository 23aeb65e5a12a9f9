"""Versioned tables against changes applied one by one, broken writes, rivals and old versions."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.sources import versioned
from quern.sources.versioned import Conflict, VersionedTable

COLUMNS = "org_id long, id long, seq long, op string, name string, scope int"


def one_by_one(state, changes):
    for org, key, _, op, name, scope in sorted(changes, key=lambda c: c[2]):
        if op == "create":
            state[org, key] = (name, scope)
        elif op == "delete":
            state.pop((org, key), None)
        elif (org, key) in state:
            old = state[org, key]
            state[org, key] = (old[0] if name is None else name, old[1] if scope is None else scope)
    return state


def held(df):
    rows = [((r["org_id"], r["id"]), (r["name"], r["scope"])) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_changes_against_one_by_one(spark, tmp_path):
    rng = np.random.default_rng(1)
    t, state, kept = VersionedTable(spark, str(tmp_path / "t"), ["org_id", "id"], 8), {}, []
    seq = 0
    for _ in range(4):
        changes = []
        for _ in range(60):
            seq += 1
            key = int(rng.integers(12)) if rng.random() < 0.9 else None
            changes.append((int(rng.integers(2)), key, seq, str(rng.choice(["create", "update", "update", "delete"])), None if rng.random() < 0.4 else f"n{seq}", None if rng.random() < 0.4 else seq))
        changes += [(0, 3, seq + 1 + i, "update", f"hot{i}", None) for i in range(200)]
        seq += 300
        version = t.apply(spark.createDataFrame(changes, COLUMNS).repartition(3))
        state = one_by_one(dict(state), changes)
        kept.append((version, state))
        assert held(t.read()) == state
    for version, old in kept:
        assert held(t.read(version)) == old
    assert t.versions() == [1, 2, 3, 4]
    t.vacuum(2)
    assert t.versions() == [3, 4] and held(t.read(3)) == kept[2][1] and held(t.read()) == state


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["org_id", "id"], 16)
    t.apply(spark.createDataFrame([(1, i, i, "create", f"n{i}", 1) for i in range(200)], COLUMNS))
    before = t.manifest()["buckets"]
    t.apply(spark.createDataFrame([(1, 7, 1000, "update", "new", None), (2, 8, 1001, "update", "another's row", None)], COLUMNS))
    after = t.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in after) <= 2
    got = held(t.read())
    assert got[1, 7] == ("new", 1) and got[1, 8] == ("n8", 1) and len(got) == 200


def test_broken_and_rival_writes_leave_the_version(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["org_id", "id"], 4)
    t.apply(spark.createDataFrame([(1, i, i, "create", "a", 1) for i in range(10)], COLUMNS))
    bad = spark.createDataFrame([(1, 1, 50, "update", "x", 1)], COLUMNS).withColumn("name", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        t.apply(bad)
    assert t.versions() == [1] and {v for v, _ in held(t.read()).values()} == {"a"}
    rival = VersionedTable(spark, t.folder, ["org_id", "id"], 4)
    stale = rival.manifest()
    t.apply(spark.createDataFrame([(1, 1, 60, "delete", None, None)], COLUMNS))
    with pytest.raises(Conflict):
        rival._commit({"version": stale["version"] + 1, "buckets": {}})
    assert len(held(t.read())) == 9
    assert VersionedTable(spark, str(tmp_path / "none"), ["id"]).read().count() == 0


def test_keys_are_revoked_and_rotated(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), ["org_id", "id"], 4)
    at = datetime.datetime(2024, 5, 1)
    start = spark.createDataFrame([(1, i, 0, "create", f"key {i}", True, None, f"h{i}") for i in range(4)], "org_id long, id long, seq long, op string, name string, is_active boolean, revoked_at timestamp, key_hash string")
    t.apply(start)
    fill = lambda df: start.limit(0).unionByName(df, allowMissingColumns=True)
    t.apply(fill(versioned.revoked(spark.createDataFrame([(1, 0), (2, 1)], "org_id long, id long"), F.lit(1), F.lit(at))))
    rotating = t.read().filter("id = 2")
    t.apply(fill(versioned.rotated(rotating.withColumn("key_hash", F.lit("fresh")), "id", F.col("id") + 100, F.lit(2), F.lit(at))))
    got = {r["id"]: (r["name"], r["is_active"], r["revoked_at"] is not None, r["key_hash"]) for r in t.read().collect()}
    assert got == {0: ("key 0", False, True, "h0"), 1: ("key 1", True, False, "h1"), 2: ("key 2", False, True, "h2"), 3: ("key 3", True, False, "h3"), 102: ("key 2 (rotated)", True, False, "fresh")}
