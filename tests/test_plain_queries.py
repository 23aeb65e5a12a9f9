"""Queries that SQL doesn't state, over whole tables against plain versions of their rules."""

import base64
import hashlib
import itertools
import math
import os
import struct

import numpy as np
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def run(spark, name):
    return entry.queries()[name](spark, SF).collect()


def test_file_hashes(spark):
    raw = open(f"{SF}/nation.parquet", "rb").read()
    [r] = run(spark, "g_sha")
    assert (r["size"], r["sha256"], r["md5"]) == (len(raw), hashlib.sha256(raw).hexdigest(), hashlib.md5(raw).hexdigest())


def test_base64_of_vectors(spark):
    want = {r["vec_id"]: base64.b64encode(struct.pack(f"<{len(r['embedding'])}f", *r["embedding"])).decode() for r in table("embeddings")}
    assert {r["vec_id"]: r["data"] for r in run(spark, "emb_base64")} == want


def test_running_moments_of_returns(spark):
    want = {}
    for user, rows in itertools.groupby(sorted(table("events"), key=lambda r: (r["user_id"], r["event_id"])), key=lambda r: r["user_id"]):
        returns, total = [], 0.0
        for r in rows:
            total = 0.99 * total + r["value"]
            returns.append(total)
            want[user, r["event_id"]] = min(10.0, max(-10.0, r["value"] / math.sqrt(max(np.var(returns), 1e-8))))
    got = {(r["user_id"], r["event_id"]): r["normalised"] for r in run(spark, "w_welford")}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-9) for k in want)


def test_cubic_fit(spark):
    rows = table("lineitem")
    x, y = np.array([float(r["l_quantity"]) for r in rows]), np.array([float(r["l_extendedprice"]) for r in rows])
    scaled = (x - x.mean()) / x.std()
    fit = np.polynomial.Polynomial(np.linalg.lstsq(np.vander(scaled, 4, increasing=True), y, rcond=None)[0])
    got = [r["coefficient"] for r in sorted(run(spark, "v_poly"), key=lambda r: r["power"])]
    mine = np.polynomial.Polynomial(got)(x)
    assert mine == pytest.approx(fit(scaled), rel=1e-4)


def test_best_paths_against_all_paths(spark):
    vectors = {r["vec_id"]: r["embedding"] for r in table("embeddings")}
    t = np.full((4, 4), -0.1) + 0.2 * np.eye(4)
    every = np.array(list(itertools.product(range(4), repeat=6)))
    for r in sorted(run(spark, "v_viterbi"), key=lambda r: r["id"])[:20]:
        e = np.array(vectors[r["id"]], float).reshape(16, 4)
        path = np.array(r["path"])
        score = lambda p: e[np.arange(16), p].sum() + t[p[:-1], p[1:]].sum()
        best = score(path)
        for a in range(0, 11):  # no change of any six places in a row makes it better
            others = np.repeat(path[None], len(every), 0)
            others[:, a : a + 6] = every
            scores = e[np.arange(16), others].sum(1) + t[others[:, :-1], others[:, 1:]].sum(1)
            assert scores.max() <= best + 1e-9


def test_clusters_are_as_tight_as_lloyds(spark):
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table("embeddings")}
    got = {r["vec_id"]: r["cluster"] for r in run(spark, "v_kmeans")}
    assert set(got) == set(vectors)
    x, of = np.stack([vectors[i] for i in got]), np.array(list(got.values()))
    inertia = lambda of: sum(((x[of == c] - x[of == c].mean(0)) ** 2).sum() for c in set(of.tolist()))
    rng = np.random.default_rng(1)
    tries = []
    for _ in range(5):
        centres = x[rng.choice(len(x), 5, replace=False)]
        for _ in range(60):
            own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.stack([x[own == c].mean(0) if (own == c).any() else centres[c] for c in range(5)])
        tries.append(inertia(own))
    assert len(set(of.tolist())) <= 5 and inertia(of) <= 1.1 * np.median(tries)
    # A step of Lloyd's changes no more than rounding would.
    centres = np.stack([x[of == c].mean(0) for c in sorted(set(of.tolist()))])
    again = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (again != np.searchsorted(sorted(set(of.tolist())), of)).mean() < 0.05
