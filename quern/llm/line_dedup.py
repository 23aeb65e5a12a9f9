"""Line dedup with a log-template tree.

Every line descends a tree of fixed depth: its number of tokens, then its leading tokens; tokens with digits count as
variable. In its leaf a line takes part in templates that keep its tokens by position: the one with all of them, and for
lines of at least ``SEGMENTS`` * 2 tokens those that leave one of ``SEGMENTS`` contiguous parts variable. A template
that recurs in enough documents is boilerplate: its lines are dropped everywhere but in the document with the least id
(and of several rows with that id the one whose text has the least hash), so that no content leaves the corpus. Lines of ``long_tokens`` or more tokens count as recurring from two documents on if
they are equal as a whole, and so do runs of adjacent lines (blank ones between them aside) of as many tokens together: each line of a document that
recurs anywhere begins a window and ends one, the shortest of ``long_tokens`` tokens over lines that all recur, and
windows of equal templates are one passage.

All groups are counts and minima by template, combined before the shuffle. A template of a ``SHARE``-th of all lines or more
meets its lines where they are, so the lines of a footer are not brought together.

Defined cases: null and empty texts stay as they are; blank lines stay, and so do lines of less than ``min_tokens`` tokens
outside recurring runs; unlike rows that share an id are documents of their own; rows of equal id and text keep or lose their
lines alike; null ids are the lowest id; a line's end is ``\\n`` only; letters A-Z are compared in lower case; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import buffer_of, mix, parted_join, slices, span_hashes, strings, word_hashes
from quern.plans.lineage import written
from quern.session import ship

MIN_DOCS, MIN_TOKENS, LONG_TOKENS, LONG_DOCS = 8, 3, 50, 2
LEADING, SEGMENTS = 2, 4
_LOWEST = -(1 << 63)
_LOW_31, _LOW_62 = (1 << 31) - 1, (1 << 62) - 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_DIGIT = np.isin(np.arange(256), range(48, 58))


def words_of(part: np.ndarray, begins: np.ndarray, gap: np.ndarray = _GAP) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without the bytes of gap (white space); a run also ends where the next text begins."""
    solid = ~gap[part]
    edge = np.zeros(len(part) + 1, bool)
    edge[begins] = True
    edge[-1] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def templates(part: np.ndarray, offsets: np.ndarray, min_tokens: int = MIN_TOKENS) -> tuple[np.ndarray, ...]:
    """(row, line, tokens, template hash, place among lines that aren't blank, exact) of every template that every line of
    the texts at these offsets takes part in; exact marks those that leave no part variable."""
    n = len(offsets) - 1
    inside = offsets[:-1][offsets[:-1] < len(part)]
    breaks = np.flatnonzero(part == 10)
    row_of_break = np.searchsorted(offsets, breaks, side="right") - 1
    rows = np.concatenate((np.arange(n), row_of_break))
    places = np.concatenate((offsets[:-1], breaks + 1))
    order = np.lexsort((places, rows))
    rows, places = rows[order], places[order]
    line = np.arange(len(rows)) - np.searchsorted(rows, rows)
    starts, ends = words_of(part, inside)
    if not len(starts):
        return tuple(np.empty(0, np.int64) for _ in range(6))
    tokens = word_hashes(_LOWER[part], starts, ends)
    digits = np.flatnonzero(_DIGIT[part])
    tokens[np.searchsorted(digits, ends) > np.searchsorted(digits, starts)] = np.uint64(0x5851F42D4C957F2D)
    at = np.searchsorted(places, starts, side="right") - 1
    size = np.bincount(at, minlength=len(rows))
    begin = np.cumsum(size) - size
    before = np.cumsum(size > 0) - (size > 0)
    filled = before - before[np.searchsorted(rows, rows)]
    use = np.flatnonzero(size >= max(1, min_tokens))
    a, m = begin[use], size[use]
    leaf = mix(m.astype(np.uint64))
    for k in range(LEADING):
        leaf = mix(leaf ^ np.where(m > k, tokens[np.minimum(a + k, len(tokens) - 1)], np.uint64(k)))
    out = [(use, mix(leaf + span_hashes(tokens, a, a + m)))]
    wide = np.flatnonzero(m >= SEGMENTS * 2)
    if len(wide):
        aw, mw = a[wide], m[wide]
        bounds = [aw + mw * i // SEGMENTS for i in range(SEGMENTS + 1)]
        parts = [span_hashes(tokens, bounds[i], bounds[i + 1]) for i in range(SEGMENTS)]
        for free in range(SEGMENTS):
            h = leaf[wide] + np.uint64(free + 1)
            for i in range(SEGMENTS):
                if i != free:
                    h = mix(h ^ (parts[i] * np.uint64(2 * i + 3)))
            out.append((use[wide], h))
    which = np.concatenate([w for w, _ in out])
    return rows[which], line[which], size[which].astype(np.int64), np.concatenate([h for _, h in out]).view(np.int64), filled[which], np.arange(len(which)) < len(use)


def line_templates(docs: DataFrame, min_tokens: int = 1) -> DataFrame:
    """doc_id, text_key, place, tokens, template, lead: one row for each line and template of docs(doc_id, text); place
    holds the line's number (low 31 bits), its place among lines that aren't blank (next 31) and whether the template is
    exact (sign); lead marks the first line of a text with its template."""
    ship(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            raw, offsets = buffer_of(strings(batch.column(1)))
            for i, j in slices(np.diff(offsets)):
                part = raw[offsets[i] : offsets[j]]
                if not len(part):
                    continue
                row, line, size, template, filled, exact = templates(part, offsets[i : j + 1] - offsets[i], min_tokens)
                place = line.astype(np.int64) | filled.astype(np.int64) << 31 | np.where(exact, _LOWEST, 0)
                order = np.lexsort((template, line, row))
                row, place, size, template = row[order], place[order], size[order], template[order]
                by = np.lexsort((template, row))  # stable: of equal ones the first line leads
                lead = np.ones(len(by), bool)
                lead[by[1:]] = (template[by[1:]] != template[by[:-1]]) | (row[by[1:]] != row[by[:-1]])
                columns = [pa.array(ids[i:j][row]), pa.array(keys[i:j][row]), pa.array(place), pa.array(size.astype(np.int32)), pa.array(template), pa.array(lead)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "place", "tokens", "template", "lead"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)).alias("doc_id"), "text", F.xxhash64("text").alias("text_key"))
    return rows.mapInArrow(each, "doc_id long, text_key long, place long, tokens int, template long, lead boolean")


def windows(filled: np.ndarray, tokens: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Ranges of two or more adjacent lines, in order of filled, that reach least tokens and are the shortest with their
    first or their last line."""
    out = set()
    cuts = [0, *(np.flatnonzero(np.diff(filled) != 1) + 1).tolist(), len(filled)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        sums = np.concatenate(([0], np.cumsum(tokens[a:b])))
        ends = np.searchsorted(sums, sums[:-1] + least)
        begins = np.searchsorted(sums, sums[1:] - least, side="right") - 1
        out.update((a + i, a + int(j)) for i, j in enumerate(ends) if j <= b - a)
        out.update((a + int(i), a + j + 1) for j, i in enumerate(begins) if i >= 0)
    return sorted((i, j) for i, j in out if j - i > 1)


def recurring_runs(recurring: DataFrame, long_tokens: int, long_docs: int) -> DataFrame:
    """doc_id, text_key and line of lines in runs that recur, of the recurring lines with exact templates."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            for doc, key, lines, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = sorted({(x["place"] & _LOW_62) >> 31: x for x in lines}.items())
                filled, tokens = np.array([f for f, _ in own]), np.array([x["tokens"] for _, x in own], np.int64)
                template = np.array([x["template"] for _, x in own], np.int64)
                seen = set()
                for i, j in windows(filled, tokens, long_tokens):
                    h = xxhash.xxh3_64_intdigest(template[i:j].tobytes()) - (1 << 63)
                    out.append((doc, key, h, [x["place"] & _LOW_31 for _, x in own[i:j]], 0 if h in seen else copies))
                    seen.add(h)
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "text_key", "run", "lines", "copies"])

    # Rows of equal id and text bring each line as often as they are.
    lines = recurring.filter("place < 0").groupBy("doc_id", "text_key", "place", "template", "tokens").agg(F.count("*").alias("copies"))
    lists = lines.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("place", "template", "tokens")).alias("x"), F.max("copies").alias("copies"))
    runs = written(lists.mapInArrow(each, "doc_id long, text_key long, run long, lines array<int>, copies int"), "runs")
    found = runs.groupBy("run").agg(F.sum("copies").alias("n"), F.count("*").alias("all"), F.min("doc_id").alias("first"))
    found = written(found.filter(F.col("n") >= long_docs), "found")
    met = written(parted_join(runs, found.select("run", "all", "first"), "run", "all").drop("all"), "met")
    return later(met, "run").select("doc_id", "text_key", F.explode("lines").alias("line"))


def later(rows: DataFrame, key: str) -> DataFrame:
    """The rows (doc_id, text_key, first: the key's least doc_id) that do not stand in their key's first document."""
    # Rows with the first id are told apart by their texts' hashes; only where there are several need they meet again.
    tied = rows.filter(F.col("doc_id") == F.col("first"))
    several = tied.groupBy(key).agg(F.count("*").alias("all"), F.min("text_key").alias("first_key"), F.max("text_key").alias("last_key"))
    several = written(several.filter("first_key < last_key").select(key, "all", "first_key"), "several")
    among = parted_join(tied, several, key, "all").filter(F.col("text_key") != F.col("first_key")).select(rows.columns)
    return rows.filter(F.col("doc_id") != F.col("first")).unionByName(among)


def recurring_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, long_tokens: int = LONG_TOKENS, long_docs: int = LONG_DOCS) -> DataFrame:
    """doc_id, text_key and lines: the numbers of the lines to drop, for each document that has any."""
    lines = written(line_templates(docs), "lines")
    # A document counts once for a template however often it has it: its first line with it stands for it.
    found = lines.groupBy("template").agg(F.count_if("lead").alias("n"), F.count("*").alias("all"), F.min("doc_id").alias("first"), F.max("tokens").alias("tokens"))
    found = written(found.filter(F.col("n") >= min(min_docs, long_docs)), "found")
    recurring = written(parted_join(lines.select("doc_id", "text_key", "place", "template"), found, "template", "all").drop("all"), "recurring")
    enough = F.when((F.col("tokens") >= long_tokens) & (F.col("place") < 0), F.lit(long_docs)).otherwise(F.lit(min_docs))
    alone = later(recurring.filter((F.col("n") >= enough) & (F.col("tokens") >= min_tokens)), "template")
    alone = alone.select("doc_id", "text_key", F.col("place").bitwiseAND(F.lit(_LOW_31)).cast("int").alias("line"))
    return alone.union(recurring_runs(recurring, long_tokens, long_docs)).groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("lines"))


def without(text: Column, lines: Column) -> Column:
    """text without the lines of these numbers, in time that grows with its lines, however many go."""
    parts = F.split(text, "\n", -1)
    # Named once, so that the text is not split anew for each line.
    held = F.array(F.struct(parts.alias("parts"), F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), lines).alias("keep")))
    return F.transform(held, lambda h: F.array_join(F.transform(h["keep"], lambda i: F.get(h["parts"], i)), "\n"))[0]


def drop_lines(docs: DataFrame, **limits: int) -> DataFrame:
    """docs with the recurring lines gone from text, and __q_lines and __q_dropped: the numbers of lines before and dropped."""
    lines = recurring_lines(docs, **limits).select(F.col("doc_id").alias("__q_id"), F.col("text_key").alias("__q_key"), F.col("lines").alias("__q_drop"))
    key = F.coalesce(docs["doc_id"].cast("long"), F.lit(_LOWEST))
    joined = docs.join(lines, (key == F.col("__q_id")) & (F.xxhash64(docs["text"]) == F.col("__q_key")), "left")
    parts = F.split(docs["text"], "\n", -1)
    text = F.when(F.col("__q_drop").isNull(), docs["text"]).otherwise(without(docs["text"], F.col("__q_drop")))
    kept = [text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return joined.select(*kept, F.coalesce(F.size(parts), F.lit(0)).alias("__q_lines"), F.when(F.col("__q_drop").isNull(), 0).otherwise(F.size("__q_drop")).alias("__q_dropped"))
