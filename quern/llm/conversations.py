"""Repair of conversations by a cheapest edit script.

The lattice's nodes are (rows read, state of the grammar ``(s?(ua)+)?`` over role initials). Keep, rerole and delete read
a row, insert does not. Dijkstra's search makes nodes as it meets them; its key is (cost, audit), the edits' initials so
far, and it ends at the first accepting end node that it takes out, so of equally cheap repairs the audit of least ASCII
order wins. Two paths to one node with one cost are never a prefix of each other, so the order of what they lead to is theirs.

Rows are dealt by ranges of (conversation, turn) and sorted, so a conversation of any share of all rows spans as many tasks
as it needs. A task settles the conversations that lie in it as a whole with at most ``BLOCK_ROWS`` rows and ``BLOCK_BYTES``
of text. Of all others it leaves blocks of that size, in which the search runs from each state to each state; what blocks
yield is combined in order, block by block, by the same keys. Which rows repeat an earlier one of their conversation is
found by grouping digests. Only a conversation's repaired bytes, which one hash has to read in order, pass one task, a
block at a time.

Defined cases: null roles and texts are one space, so are null ids and turns in the damage's key; null turns stand first;
rows of one turn are ordered by role and text (the first ``HEAD`` characters, then a hash); null ids are one conversation;
an empty table gives an empty result; other columns are ignored; repeated rows are duplicates; texts may be of any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.lineage import written
from quern.session import ship

BLOCK_ROWS, BLOCK_BYTES, HEAD = 1_024, 1 << 20, 64
#: The costs of edits, the white space of blank texts, the signs that end a text, legal pairs of initials.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
WHITE, ENDS, LEGAL = " \t\n\x0b\x0c\r", ".!?", frozenset(("su", "ua", "au"))
#: States: nothing yet, after a system row, after a user row, after an assistant row. Where an initial leads, the role that
#: an insertion or a new role has, and the states in which a conversation may end.
STATES = range(4)
LEADS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
WANTED = ("user", "user", "assistant", "user")
ACCEPTING = (0, 3)

COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
RESULT = [pa.field("conv_id", pa.int64()), *[pa.field(c, pa.int64()) for c in COUNTS], pa.field("audit", pa.string()), pa.field("repaired_sha256", pa.string())]
RESULT_DDL = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
ITEM = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])
ITEM_DDL = "struct<turn: long, role: string, text: string>"

Row = tuple[str, bool, bool]  # initial, must go, truncated
Item = tuple[int | None, str, str]  # turn, role, text


def cheapest(rows: list[Row], start: int = 0, ends: tuple[int, ...] = ACCEPTING, all_ends: bool = False) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the cheapest edits from the state start to the first of the states ends that the search meets after
    the last row, or to each of them."""
    heap: list[tuple[int, str, int, int]] = [(0, "", 0, start)]
    done: set[tuple[int, int]] = set()
    out: dict[int, tuple[int, str]] = {}
    while heap:
        cost, audit, i, state = heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ends:
            out[state] = (cost, audit)
            if not all_ends or len(out) == len(ends):
                break
        following = LEADS[state, WANTED[state][0]]
        heappush(heap, (cost + INSERT, audit + "I", i, following))
        if i < len(rows):
            initial, gone, truncated = rows[i]
            heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if not gone:
                heappush(heap, (cost + REROLE + TRUNCATED * truncated, audit + "R", i + 1, following))
                if (kept := LEADS.get((state, initial))) is not None:
                    heappush(heap, (cost + TRUNCATED * truncated, audit + "K", i + 1, kept))
    return out


def faults(items: list[Item], fresh: set[int]) -> tuple[list[Row], list[int]]:
    """The rows as the search sees them, and how many are blank, duplicate and truncated; fresh: places of rows whose role
    and text the conversation did not have before."""
    rows, counts = [], [0, 0, 0]
    for i, (_, role, text) in enumerate(items):
        solid = text.rstrip(WHITE)
        kind = 0 if not solid else 1 if i not in fresh else 2 if solid[-1] not in ENDS else None
        if kind is not None:
            counts[kind] += 1
        rows.append((role[:1], kind in (0, 1), kind == 2))
    return rows, counts


def shape(items: list[Item]) -> dict[str, object]:
    """What gaps and illegal pairs are counted from, of adjacent rows in order."""
    turns = [t for t, _, _ in items if t is not None]
    initials = [r[:1] for _, r, _ in items]
    return {
        "rows": len(items), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
        "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)),
    }


def repaired(items: list[Item], audit: str, state: int = 0) -> list[tuple[str, str]]:
    """Role and text of the rows that the edits leave, from a state on."""
    out, rest = [], iter(items)
    for edit in audit:
        role, text = (WANTED[state], "") if edit == "I" else next(rest)[1:]
        if edit != "D":
            role = WANTED[state] if edit == "R" else role
            state = LEADS[state, role[:1]]
            out.append((role, text))
    return out


def joined(rows: list[tuple[str, str]]) -> bytes:
    return "\n".join(f"{role}:{text}" for role, text in rows).encode()


def settled(conv_id: int | None, items: list[Item]) -> tuple:
    """The result row of a whole conversation."""
    seen: dict[tuple[str, str], int] = {}
    for i, (_, role, text) in enumerate(items):
        seen.setdefault((role, text), i)
    rows, counts = faults(items, set(seen.values()))
    s = shape(items)
    gaps = s["last_turn"] - s["first_turn"] + 1 - s["turns"] if s["turns"] else 0
    [(cost, audit)] = cheapest(rows).values()
    return (conv_id, gaps, *counts, s["illegal"], cost, audit, hashlib.sha256(joined(repaired(items, audit))).hexdigest())


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: the row is dropped) of the rows after the stated damage."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat_ws(":", space("conv_id"), space("turn"))) % 20
    role = F.when(hit == 4, F.lit("user")).otherwise(space("role"))
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    copies = F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def undamaged(conversations: DataFrame) -> DataFrame:
    """The rows as they are, in the columns of ``damaged``."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role"), space("text"), F.lit(1).alias("copies"))


def batch_of(rows: list[tuple], fields: list[pa.Field]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], [f.name for f in fields])


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def batched(rows: Iterator[tuple], fields: list[pa.Field], size: int = 2_000, n_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of so many rows, or of so many bytes of the longest column."""
    held, weight = [], 0
    for row in rows:
        held.append(row)
        weight += max((len(x) for x in row if isinstance(x, (str, bytes))), default=0)
        if len(held) == size or weight > n_bytes:
            yield batch_of(held, fields)
            held, weight = [], 0
    yield batch_of(held, fields)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows in ranges of conversations and turns, in order; equal rows may lie in several."""
    order: list[Column] = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.substring("role", 1, HEAD), F.substring("text", 1, HEAD), F.xxhash64("role", "text"), F.col("place")]
    return rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("place")


def blocks(rows: Iterator[tuple], most_rows: int, most_bytes: int) -> Iterator[tuple[int | None, list[Item], bool]]:
    """(conv_id, rows, whole) of a task's rows in order; the first and the last conversation of a task count as parts."""
    items: list[Item] = []
    n_bytes, conv, begun, part = 0, None, False, True
    for conv_id, turn, role, text, copies in rows:
        if not begun or conv_id != conv:
            if begun:
                yield conv, items, not part
            items, n_bytes, part, conv = [], 0, not begun, conv_id
            begun = True
        for _ in range(copies):
            if items and (len(items) >= most_rows or n_bytes + len(text) > most_bytes):
                part = True
                yield conv, items, False
                items, n_bytes = [], 0
            items.append((turn, role, text))
            n_bytes += len(text)
    if begun:
        yield conv, items, False


def composed(parts: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (conv_id, block, state, edits of the block, counts, audit) of conversations whose blocks come in order; counts
    and audit stand on the first block of each."""

    def ended(conv_id, held: list[tuple], live: dict[int, tuple], counts: list[int]) -> Iterator[tuple]:
        cost, audit, state = min((live[s][0], live[s][1], s) for s in ACCEPTING if s in live)
        chosen = []
        for _, back in reversed(held):
            before, edits = back[state]
            chosen.append((before, edits))
            state = before
        for i, ((block, _), (before, edits)) in enumerate(zip(held, reversed(chosen), strict=True)):
            yield (conv_id, block, before, edits, [*counts, cost] if i == 0 else None, audit if i == 0 else None)

    conv, begun = None, False
    for conv_id, block, s, counts, ways in parts:
        if not begun or conv_id != conv:
            if begun:
                yield from ended(conv, held, live, [max(0, turns[1] - turns[0] + 1 - turns[2]) if turns else 0, *totals])
            conv, begun, held, live, totals, turns, last = conv_id, True, [], {0: (0, "")}, [0] * 4, None, None
        if s["turns"]:
            if turns is None:
                turns = [s["first_turn"], s["last_turn"], s["turns"]]
            else:
                turns = [turns[0], s["last_turn"], turns[2] + s["turns"] - (turns[1] == s["first_turn"])]
        if s["rows"]:
            edge = last is not None and last + s["first"] not in LEGAL
            totals, last = [a + b for a, b in zip(totals, [*counts, s["illegal"] + edge], strict=True)], s["last"]
        following: dict[int, tuple] = {}
        back: dict[int, tuple] = {}
        for w in ways:
            if w["start"] in live:
                cost, audit = live[w["start"]]
                way = (cost + w["cost"], audit + w["audit"])
                if w["end"] not in following or way < following[w["end"]]:
                    following[w["end"]], back[w["end"]] = way, (w["start"], w["audit"])
        held.append((block, back))
        live = following
    if begun:
        yield from ended(conv, held, live, [max(0, turns[1] - turns[0] + 1 - turns[2]) if turns else 0, *totals])


def hashed(parts: Iterator[tuple]) -> Iterator[tuple]:
    """Result rows of conversations whose blocks' repaired bytes come in order."""
    conv, digest = None, None
    for conv_id, _, counts, audit, data in parts:
        if counts is not None:  # a conversation's first block
            if digest is not None:
                yield (*head, digest.hexdigest())
            conv, digest, head, empty = conv_id, hashlib.sha256(), (conv_id, *counts, audit), True
        assert conv == conv_id
        if data is not None:
            digest.update(data if empty else b"\n" + data)
            empty = False
    if digest is not None:
        yield (*head, digest.hexdigest())


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per conversation of rows (as ``damaged`` has them): its faults, the cheapest repair and that one's digest."""
    spark = rows.sparkSession
    ship(spark)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId() << 33, 0

        def each() -> Iterator[tuple]:
            nonlocal n
            for conv_id, items, whole in blocks(rows_of(batches), block_rows, block_bytes):
                if whole:
                    yield (*settled(conv_id, items), None, None)
                else:
                    yield (conv_id, *[None] * (len(RESULT) - 1), task + n, [dict(zip(("turn", "role", "text"), x, strict=True)) for x in items])
                    n += 1

        yield from batched(each(), [*RESULT, pa.field("block", pa.int64()), pa.field("items", pa.list_(ITEM))], 500)

    out = written(dealt(rows).mapInArrow(first, f"{RESULT_DDL}, block long, items array<{ITEM_DDL}>"), "conversations")
    names = [f.name for f in RESULT]
    parts = out.filter("block IS NOT NULL").select("conv_id", "block", "items")
    return out.filter("block IS NULL").select(names).unionByName(repair_parts(parts))


def repair_parts(parts: DataFrame) -> DataFrame:
    """Result rows of the conversations that parts (conv_id, block, items) has the blocks of."""
    row = F.struct(F.col("block"), F.col("pos"))
    key = F.sha2(F.concat(F.length("item.role").cast("string"), F.lit(":"), F.col("item.role"), F.col("item.text")), 256)
    each = parts.select("conv_id", "block", F.posexplode("items").alias("pos", "item")).select("conv_id", "block", "pos", key.alias("key"))
    # A block's own first rows, then those of the conversation: a text that every turn repeats comes once for each block.
    inner = each.groupBy("conv_id", "block", "key").agg(F.min("pos").alias("pos"))
    first = inner.groupBy("conv_id", "key").agg(F.min(row).alias("x")).select("x.*")
    fresh = first.groupBy("block").agg(F.collect_list("pos").alias("fresh"))

    shape_type = pa.struct([("rows", pa.int64()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64())])
    way_type = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])

    def items_of(items: list[dict]) -> list[Item]:
        return [(x["turn"], x["role"], x["text"]) for x in items]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for conv_id, block, items, new in rows_of(batches):
                items = items_of(items)
                seen, counts = faults(items, set(new or ()))
                ways = [{"start": a, "end": b, "cost": c, "audit": t} for a in STATES for b, (c, t) in cheapest(seen, a, tuple(STATES), True).items()]
                yield (conv_id, block, shape(items), counts, ways)

        yield from batched(each(), [pa.field("conv_id", pa.int64()), pa.field("block", pa.int64()), pa.field("shape", shape_type), pa.field("counts", pa.list_(pa.int64())), pa.field("ways", pa.list_(way_type))], 50)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(composed(rows_of(batches)), [pa.field("conv_id", pa.int64()), pa.field("block", pa.int64()), pa.field("state", pa.int64()), pa.field("edits", pa.string()), pa.field("counts", pa.list_(pa.int64())), pa.field("audit", pa.string())])

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for conv_id, block, state, edits, counts, audit, items in rows_of(batches):
                left = repaired(items_of(items), edits, state)
                yield (conv_id, block, counts, audit, joined(left) if left else None)

        yield from batched(each(), [pa.field("conv_id", pa.int64()), pa.field("block", pa.int64()), pa.field("counts", pa.list_(pa.int64())), pa.field("audit", pa.string()), pa.field("data", pa.binary())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(hashed(rows_of(batches)), RESULT)

    ways = parts.join(fresh, "block", "left").select("conv_id", "block", "items", "fresh")
    ways = ways.mapInArrow(search, "conv_id long, block long, shape struct<rows: long, first_turn: long, last_turn: long, turns: long, first: string, last: string, illegal: long>, counts array<long>, ways array<struct<start: long, end: long, cost: long, audit: string>>")
    ordered = lambda df: df.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "block")
    chosen = ordered(ways).mapInArrow(combine, "conv_id long, block long, state long, edits string, counts array<long>, audit string")
    built = chosen.join(parts.select("block", "items"), "block").select("conv_id", "block", "state", "edits", "counts", "audit", "items")
    built = built.mapInArrow(rebuild, "conv_id long, block long, counts array<long>, audit string, data binary")
    return ordered(built).mapInArrow(digest, RESULT_DDL)


def _sql() -> str:
    """The contract in SQL: a fold over each conversation's rows whose state is the cheapest (cost, audit) of each grammar state,
    and a second fold that applies the audit. CRC-32 is computed from its polynomial."""
    far = "{'c': 1000000000::BIGINT, 'a': ''}"
    plus = lambda s, cost, edit: f"{{'c': {s}.c + {cost}, 'a': {s}.a || '{edit}'}}"
    least = lambda *xs: f"list_min([{', '.join(xs)}])"
    when = lambda cond, x: f"CASE WHEN {cond} THEN {x} ELSE {far} END"

    def insert(v: str) -> str:
        return f"{{'s0': {v}.s0, 's1': {v}.s1, 's2': {least(f'{v}.s2', *[plus(f'{v}.s{k}', 2, 'I') for k in (0, 1, 3)])}, 's3': {least(f'{v}.s3', plus(f'{v}.s2', 2, 'I'))}}}"

    def closed(out: str) -> str:
        for k in range(3):  # no more insertions in a row can help
            out = f"list_transform([{out}], lambda v{k}: {insert(f'v{k}')})[1]"
        return out

    def row(v: str, r: str) -> str:
        go = lambda s, edit, cost: plus(f"{v}.s{s}", cost, edit)
        keep = lambda s, initial: when(f"NOT {r}.gone AND {r}.initial = '{initial}'", go(s, "K", f"{r}.extra"))
        other = lambda s: when(f"NOT {r}.gone", go(s, "R", f"2 + {r}.extra"))
        return f"""{{'s0': {go(0, 'D', 3)}, 's1': {least(go(1, 'D', 3), keep(0, 's'))},
 's2': {least(go(2, 'D', 3), *[other(s) for s in (0, 1, 3)], *[keep(s, 'u') for s in (0, 1, 3)])}, 's3': {least(go(3, 'D', 3), other(2), keep(2, 'a'))}}}"""

    start = f"{{'s0': {{'c': 0::BIGINT, 'a': ''}}, 's1': {far}, 's2': {far}, 's3': {far}}}"
    return rf"""WITH codes AS (SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i::BIGINT)) AS t),
raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
hit AS (SELECT raw.*, xor(4294967295, list_reduce(list_transform(string_split(k, ''), lambda c: unicode(c)::BIGINT), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1]), 4294967295::BIGINT)) % 20 AS h FROM raw, codes),
after AS (SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hit),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid FROM after),
judged AS (SELECT *, CASE WHEN solid = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) AS pair FROM placed),
lists AS (SELECT conv_id, CASE WHEN count(turn) > 0 THEN max(turn) - min(turn) + 1 - count(DISTINCT turn) ELSE 0 END AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal, list({{'initial': left(role, 1), 'gone': coalesce(fault IN ('blank', 'duplicate'), false), 'extra': CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'role': role, 'text': text}} ORDER BY i) AS rows FROM judged GROUP BY conv_id),
every AS (SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(rows, []) AS rows FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN lists l ON c.conv_id IS NOT DISTINCT FROM l.conv_id),
solved AS (SELECT *, list_transform([list_reduce(rows, lambda v, r: {closed(row('v', 'r'))}, {closed(start)})], lambda e: {least('e.s0', 'e.s3')})[1] AS best FROM every),
repaired AS (SELECT *, list_reduce(string_split(best.a, ''), lambda z, e: CASE WHEN e = '' THEN z ELSE list_transform([{{'i': z.i + CASE e WHEN 'I' THEN 0 ELSE 1 END, 'role': CASE WHEN e = 'K' THEN rows[z.i].role WHEN z.s = 2 THEN 'assistant' ELSE 'user' END, 'text': CASE e WHEN 'I' THEN '' ELSE rows[z.i].text END}}],
  lambda n: {{'i': n.i, 's': CASE WHEN e = 'D' THEN z.s ELSE CASE left(n.role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END END, 'out': CASE WHEN e = 'D' THEN z.out ELSE list_append(z.out, n.role || ':' || n.text) END}})[1] END, {{'i': 1::BIGINT, 's': 0, 'out': []::VARCHAR[]}}).out AS lines FROM solved)
SELECT conv_id, gaps::BIGINT AS gaps, blank::BIGINT AS blank, duplicate::BIGINT AS duplicate, truncated::BIGINT AS truncated, illegal::BIGINT AS illegal, best.c::BIGINT AS cost, best.a AS audit, sha256(array_to_string(lines, chr(10))) AS repaired_sha256 FROM repaired"""


SQL = _sql()
