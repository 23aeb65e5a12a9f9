"""Packing by bounded-space online best fit.

Each task keeps a fixed number of open windows. What remains of a document after its full windows goes whole into the
window that it fills best; if none has room, the fullest window is topped up with the document's first ids and emitted
full, and the rest tries again. At its end a task merges its open windows, and sends what is less than one window to
merging tasks, which do the same over all tasks' leftovers. What remains there is cut into powers of two, which need no
padding. Windows are placed by counts; ids are only held for the document at hand and the open windows.

Defined cases: null text is an empty document, which still has its final id; repeated rows are documents of their own;
an empty table gives an empty result; other columns are ignored; a document of any length passes through one window at
a time.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache
from struct import pack as pack_ids

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import ragged
from quern.llm.pretoken import pretokens
from quern.llm.token_counts import special_of, tokenizer
from quern.session import ship

NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


#: Bytes of pre-tokens and their ids that a worker keeps, with what objects of that size take besides, and the number of
#: pre-tokens that go to the library at once.
KEPT_BYTES, OVERHEAD, AT_ONCE = 48 << 20, 180, 10_000


class Known(dict):
    """Ids of the pre-tokens that this worker met first, which are the most frequent ones, while they take so many bytes."""

    room = KEPT_BYTES

    def keep(self, word: str, ids: bytes) -> None:
        size = OVERHEAD + 4 * len(word) + len(ids)  # a character takes four bytes at most
        if size <= self.room:
            self.room -= size
            self[word] = ids


@cache
def _known(path: str) -> Known:
    return Known()


def piece_ids(words: list[str], path: str) -> list[bytes]:
    """The ids of each pre-token, as the tokenizer file gives them, as little-endian unsigned 32-bit numbers."""
    known, encoder = _known(path), tokenizer(path)
    out = [known.get(w) for w in words]
    fresh = [i for i, x in enumerate(out) if x is None]
    for a in range(0, len(fresh), AT_ONCE):
        at = fresh[a : a + AT_ONCE]
        for i, found in zip(at, encoder.encode_batch_fast([words[i] for i in at], add_special_tokens=False), strict=True):
            ids = found.ids
            out[i] = pack_ids(f"<{len(ids)}I", *ids)
            known.keep(words[i], out[i])
    return out


def document_ids(texts: pa.Array, path: str, special: str, end_id: int) -> Iterator[np.ndarray]:
    """The ids of each text, with end_id after them; special is the text of the file's special token."""
    words, counts = pretokens(texts, special)
    ids = piece_ids(words.dictionary.to_pylist(), path)
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    flat = np.frombuffer(b"".join(ids), "<u4")
    begins = np.cumsum(sizes) - sizes
    at = words.indices.to_numpy()
    end = np.array([end_id], "<u4")
    for n, last in zip(counts, np.cumsum(counts), strict=True):
        used = at[last - n : last]
        yield np.append(flat[ragged(begins[used], sizes[used])], end)


class Packer:
    """Bounded-space best fit. A piece is (doc_id, start, ids, doc_tokens); rows go out as tuples of NAMES."""

    def __init__(self, window: int, n_open: int, first_id: int):
        self.window, self.n_open, self.next_id = window, n_open, first_id
        self.room: list[tuple[int, int]] = []  # sorted (free places, window)
        self.open: dict[int, list[tuple]] = {}
        self.rows: list[tuple] = []

    def emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next_id, at, None))
            at += len(ids)
        self.next_id += 1

    def add(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        w = self.window
        while len(ids) >= w:
            self.emit([(doc_id, start, ids[:w], total)])
            start, ids = start + w, ids[w:]
        while len(ids):
            i = bisect_left(self.room, (len(ids), -1))
            if i < len(self.room):  # the least room that suffices
                free, key = self.room.pop(i)
            elif len(self.room) < self.n_open:
                free, key = w, self.next_id
                self.next_id += 1
                self.open[key] = []
            else:  # none fits: the fullest goes out
                free, key = self.room.pop(0)
            part = ids[:free]
            self.open[key].append((doc_id, start, part.copy(), total))
            start, ids, free = start + len(part), ids[len(part) :], free - len(part)
            if free:
                insort(self.room, (free, key))
            else:
                self.emit(self.open.pop(key))

    def merge(self) -> list[tuple]:
        """Fill windows from the leftovers, fullest first; returns the pieces of the one that stays open."""
        left = [p for _, key in self.room for p in self.open[key]]
        self.room, self.open = [], {}
        held, n = [], 0
        for doc_id, start, ids, total in left:
            while len(ids):
                part = ids[: self.window - n]
                held.append((doc_id, start, part, total))
                start, ids, n = start + len(part), ids[len(part) :], n + len(part)
                if n == self.window:
                    self.emit(held)
                    held, n = [], 0
        return held

    def finish(self, held: list[tuple]) -> None:
        """Cut what remains into sequences whose lengths are powers of two."""
        n = sum(len(p[2]) for p in held)
        for bit in reversed(range(n.bit_length())):
            size, taken = n & (1 << bit), []
            while size:
                doc_id, start, ids, total = held.pop(0)
                part, rest = ids[:size], ids[size:]
                taken.append((doc_id, start, part, total))
                if len(rest):
                    held.insert(0, (doc_id, start + len(part), rest, total))
                size -= len(part)
            if taken:
                self.emit(taken)

    def take(self) -> pa.RecordBatch:
        rows, self.rows = self.rows, []
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(NAMES)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(NAMES, columns, strict=True)], NAMES)


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, n_open: int = 64, end_id: int = 0) -> DataFrame:
    """One row per piece of the documents of docs(doc_id, text): where it is in its document and in its sequence."""
    ship(docs.sparkSession)
    special = special_of(tokenizer_path)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, n_open, TaskContext.get().partitionId() << 33)
        for batch in batches:
            for doc_id, own in zip(batch.column(0).to_pylist(), document_ids(batch.column(1), tokenizer_path, special, end_id), strict=True):
                packer.add(doc_id, 0, own, len(own))
                if len(packer.rows) >= 50_000:
                    yield packer.take()
        for doc_id, start, ids, total in packer.merge():
            packer.rows.append((doc_id, start, len(ids), None, total, packer.next_id, None, ids.tobytes()))
        yield packer.take()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, n_open, 1 << 62 | TaskContext.get().partitionId() << 33)
        left = []
        for batch in batches:
            rest = batch.filter(batch.column(7).is_valid())
            left += rest.to_pylist()
            yield batch.filter(batch.column(7).is_null())
        for r in sorted(left, key=lambda r: (r["sequence_id"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["ids"])):
            packer.add(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"])
        packer.finish(packer.merge())
        yield packer.take()

    placed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(place, SCHEMA)
    # Finished pieces are spread evenly; a task's leftovers stay together.
    key = F.when(F.col("ids").isNull(), F.xxhash64("doc_id", "start", "sequence_id")).otherwise(F.xxhash64("sequence_id"))
    return placed.repartition(key).mapInArrow(merge, SCHEMA).drop("ids")
