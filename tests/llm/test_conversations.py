"""Conversation repair against all edit scripts, in blocks of any size, and on odd rows."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import conversations as cv

WHITE = "[\x20\x09-\x0d]"


def every_repair(rows):
    """The least (cost, audit, rows left) of all edit scripts with less than a bound of inserts, by trying them."""
    best = [(10**9, "", [])]

    def go(i, cost, audit, left, inserts):
        if cost > best[0][0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] if r else "?" for r, _ in left)):
            best[0] = min(best[0], (cost, audit, list(left)))
        if inserts <= len(rows) + 1:
            for role in ("user", "assistant"):
                go(i, cost + 2, audit + "I", [*left, (role, "")], inserts + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 3, audit + "D", left, inserts)
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                go(i + 1, cost + more, audit + "K", [*left, (role, text)], inserts)
                for new in ("user", "assistant"):
                    go(i + 1, cost + 2 + more, audit + "R", [*left, (new, text)], inserts)

    go(0, 0, "", [], 0)
    return best[0]


def plain(conversations, search=None):
    """conv_id to result row, by the contract's words; conversations: (conv_id, turn, role, text)."""
    after, ids = defaultdict(list), {c for c, *_ in conversations}
    for c, turn, role, text in conversations:
        role, text = " " if role is None else role, " " if text is None else text
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        after[c] += [(turn, role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    out = {}
    for c in ids:
        items = sorted(after[c], key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, rows = set(), []
        for _, role, text in items:
            last = re.findall(f"(?!{WHITE})[\\s\\S]", text)[-1:]
            fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[0] not in ".!?" else None
            seen.add((role, text))
            rows.append((role, text, fault))
        turns = [t for t, *_ in items if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(items, items[1:], strict=False)]
        cost, audit, left = (search or every_repair)(rows)
        out[c] = {
            "conv_id": c, "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{k: sum(r[2] == k for r in rows) for k in ("blank", "duplicate", "truncated")},
            "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in left).encode()).hexdigest(),
        }
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def some(rng, n, least=0, most=5):
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User"], ["a.", "b", "a.", "  \n", "", None, "c! ", "d?.", "é…"]
    out = []
    for c in range(n):
        for t in range(int(rng.integers(least, most))):
            turn = [t, t + 1, None, 2 * t][int(rng.choice(4, p=[0.7, 0.1, 0.1, 0.1]))]
            role = ["user", "assistant"][t % 2] if rng.random() < 0.6 else roles[int(rng.integers(len(roles)))]
            out.append((c, turn, role, f"t{t}." if rng.random() < 0.5 else texts[int(rng.integers(len(texts)))]))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_search_against_all_scripts(seed):
    rng = np.random.default_rng(seed)
    roles, kinds = ["user", "assistant", "system", "x", ""], [None, None, "blank", "duplicate", "truncated"]
    rows = [(roles[int(rng.integers(5))], f"{i}", kinds[int(rng.integers(5))]) for i in range(int(rng.integers(0, 5)))]
    seen = [(r[:1], k in ("blank", "duplicate"), k == "truncated") for r, _, k in rows]
    [(cost, audit)] = cv.cheapest(seen).values()
    assert (cost, audit) == every_repair(rows)[:2]
    assert cv.repaired([(None, r, t) for r, t, _ in rows], audit) == every_repair(rows)[2]


@pytest.mark.parametrize("partitions, block_rows, block_bytes", [(1, 100, 1000), (3, 100, 1000), (4, 1, 1000), (2, 2, 3), (7, 3, 1000)])
def test_table_against_all_scripts_in_any_blocks(spark, partitions, block_rows, block_bytes):
    rows = some(np.random.default_rng(partitions), 60) + [(None, 0, "user", "q."), (None, 1, "assistant", "r."), (-5, None, None, None)]
    rows += [(900, 3, "user", "same."), (900, 3, "user", "same."), (900, 3, "user", "same."), (901, 0, "user", "same.")]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = cv.repair(cv.damaged(frame(spark, rows).repartition(3)), block_rows, block_bytes).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    want = plain(rows)
    assert len(got) == len(want)
    for r in got:
        assert r.asDict() == want[r["conv_id"]]


def dynamic(rows):
    """(cost, audit, rows left) by a table over rows and states, for conversations too long to try all scripts."""
    best = {0: (0, "", [])}
    close = lambda b: [b.update({t: min(b.get(t, (10**9, "~")), (b[s][0] + 2, b[s][1] + "I", [*b[s][2], (w, "")]))}) for _ in range(3) for s, t, w in ((0, 2, "user"), (1, 2, "user"), (2, 3, "assistant"), (3, 2, "user")) if s in b]
    close(best)
    for role, text, fault in rows:
        after = {}

        def put(t, x, after=after):
            after[t] = min(after.get(t, (10**9, "~")), x)

        more = fault == "truncated"
        for s, (cost, audit, left) in best.items():
            put(s, (cost + 3, audit + "D", left))
            if fault not in ("blank", "duplicate"):
                t, w = (3, "assistant") if s == 2 else (2, "user")
                put(t, (cost + 2 + more, audit + "R", [*left, (w, text)]))
                kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get((s, role[:1]))
                if kept is not None:
                    put(kept, (cost + more, audit + "K", [*left, (role, text)]))
        close(after)
        best = after
    return min(best[s] for s in (0, 3) if s in best)


def test_one_conversation_with_most_rows_is_split(spark):
    rng = np.random.default_rng(5)
    rows = [(7, i, "user" if rng.random() < 0.5 else "assistant", "ok." if rng.random() < 0.3 else f"text {i}.") for i in range(3000)] + some(rng, 50)
    spark.conf.set("spark.sql.shuffle.partitions", "6")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        damaged = cv.damaged(frame(spark, [r for r in rows if r[0] == 7] + [(100 + (c or 0), *x) for c, *x in rows if c != 7]).repartition(3))
        most = max(r["count"] for r in cv.dealt(damaged).groupBy(F.spark_partition_id()).count().collect())
        got = {r["conv_id"]: r.asDict() for r in cv.repair(damaged, 64, 4000).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 1000
    assert got[7] == plain([r for r in rows if r[0] == 7], dynamic)[7]


def test_odd_tables(spark):
    assert cv.repair(cv.damaged(frame(spark, []))).count() == 0
    long = "word " * 400_000
    docs = frame(spark, [(1, 0, "user", long), (1, 5, "assistant", long + ".")]).withColumn("cost", F.lit("x")).withColumn("block", F.lit(1))
    [r] = cv.repair(cv.undamaged(docs)).collect()
    assert (r["gaps"], r["truncated"], r["cost"], r["audit"]) == (4, 1, 1, "KK")
    # Of the ids up to 400 some have all rows dropped.
    rows = [(i, 0, "user", "x.") for i in range(400)]
    got = {r["conv_id"]: r.asDict() for r in cv.repair(cv.damaged(frame(spark, rows))).collect()}
    assert got == plain(rows) and hashlib.sha256(b"").hexdigest() in {r["repaired_sha256"] for r in got.values()}
