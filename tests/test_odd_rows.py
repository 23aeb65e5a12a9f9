"""Queries equal their SQL on rows that the given tables lack."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_oracle import canonical

import __spark_entry__ as entry


def both(spark, folder, name, **tables):
    """The rows of a query and of its SQL over some tables."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    mine = entry.queries()[name](spark, str(folder)).toPandas()
    theirs = con.execute(entry.oracle_sql()[name]).fetchdf()
    return canonical(mine), canonical(theirs)


def documents(texts):
    n = len(texts)
    return pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": [f"src{i % 3}" for i in range(n)], "n_chars": pa.array([len(t or "") for t in texts], pa.int64())})


BLANK = [None, "", " ", " ", "  ", "\n", "\t\n", " " * 300, None, ""]
WORDS = ["a b", "a b", "A  B", "x\x0by", "x y", "İstanbul", "istanbul", "ΑΣ", "ασ", " x", "x", "12 34", "!", "日本 a", "y" * 250, "Y" * 250]


@pytest.mark.parametrize("texts", [[], BLANK, WORDS, BLANK + WORDS], ids=["none", "blank", "words", "all"])
@pytest.mark.parametrize("name", ["a_stage_stats", "dd_exact_stats", "hash_norm", "dd_exact", "script_ratio"])
def test_odd_texts(spark, tmp_path, name, texts):
    mine, theirs = both(spark, tmp_path, name, documents=documents(texts))
    assert mine == theirs


def test_shares_just_below_a_half_round_down(spark, tmp_path):
    """57 of 800 is 0.07124999..., which Spark's own rounding makes 0.0713."""
    mine, theirs = both(spark, tmp_path, "script_ratio", documents=documents(["a" * k + "日" * (800 - k) for k in (57, 69, 113, 400)]))
    assert mine == theirs
    mine, theirs = both(spark, tmp_path, "dd_exact_stats", documents=documents([f"t{max(i, 57)}" for i in range(800)]))
    assert mine == theirs
    mine, theirs = both(spark, tmp_path, "a_stage_stats", documents=documents([f"t{max(i, 57)}" for i in range(800)]))
    assert mine == theirs


def events(rows):
    """A table of (user_id, event_id, value)."""
    u, i, v = zip(*rows, strict=True)
    return pa.table({"event_id": pa.array(i, pa.int64()), "user_id": pa.array(u, pa.int64()), "value": pa.array(v, pa.float64())})


def test_priorities_of_odd_rows(spark, tmp_path):
    """Without a sum, with a sum of zero, without ids (last), and with sums on borders, whose rounding tells the side."""
    rows = [(1, i, 0.0) for i in range(20)] + [(2, i, None) for i in range(3)] + [(3, i, float((-1) ** i)) for i in range(10)]
    rows += [(4, None if i == 7 else i, float(i % 17)) for i in range(40)] + [(None, i, float(i % 7)) for i in range(50)] + [(5, i, None if i % 5 == 0 else float(i)) for i in range(40)]
    rows += [(6 + u, i, (0.1, 0.2, 0.3, 0.7)[(u * u + i * i * (u + 3)) % 4]) for u in range(200) for i in range(80)]
    mine, theirs = both(spark, tmp_path, "w_priority", events=events(rows))
    assert mine == theirs


def test_sums_by_nodes():
    from quern.operators.usage import NodeSums

    sums = NodeSums()
    got = [sums.add(None if i % 7 == 3 else 1.0 + i * 2.0**-52) for i in range(4200)]
    values = [0.0 if i % 7 == 3 else 1.0 + i * 2.0**-52 for i in range(4200)]

    def added(xs, start=0.0):
        for x in xs:
            start += x
        return start

    nodes = [values]
    while len(nodes[-1]) >= 16:
        nodes.append([added(nodes[-1][i : i + 16]) for i in range(0, len(nodes[-1]) - 15, 16)])
    for n in (1, 15, 16, 17, 255, 256, 257, 300, 4095, 4096, 4097, 4200):
        want = 0.0
        for k in reversed(range(len(nodes))):
            want = added(nodes[k][n // 16 ** (k + 1) * 16 : n // 16**k], want)
        assert got[n - 1] == want
