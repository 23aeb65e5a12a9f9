"""Pre-tokens of byte-level BPE, found by array operations over whole batches.

The rule is the published one of byte-level BPE vocabularies: contractions, then runs of letters, of numbers or of
other signs, each with at most one leading space, then white space, of which the last character before a word stands
apart. Its classes come from Unicode's categories. A special token's text ends the segment before it.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from quern.llm.common import SLICE_BYTES, buffer_of, slices, strings

SPACE, WHITE, LETTER, NUMBER, OTHER = 0, 1, 2, 3, 4
#: Code points with Unicode's property White_Space, the space apart.
WHITE_SPACE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers of Unicode 16 that older category tables lack.
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4),
    (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3),
    (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]


@cache
def classes() -> np.ndarray:
    """The class of each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    for ranges, c in ((NEW_LETTERS, LETTER), (NEW_NUMBERS, NUMBER)):
        for a, b in ranges:
            out[a : b + 1] = c
    out[WHITE_SPACE] = WHITE
    out[32] = SPACE
    return out


def code_points(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """Code points of the joined texts, and each one's first byte (None: one byte each)."""
    if not len(raw) or raw.max() < 0x80:
        return raw, None
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return points, np.flatnonzero((raw & 0xC0) != 0x80)


def starts_of(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sorted positions at which pre-tokens start. firsts: where texts (or segments) start, sorted, below len(points)."""
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    c = classes()[points]
    fresh = np.zeros(n, bool)
    fresh[firsts] = True
    white = c <= WHITE
    # A white character directly before a character that isn't white, within one segment.
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~fresh[1:]
    before = np.empty(n, np.uint8)
    before[0] = 255
    before[1:] = c[:-1]
    start = fresh | last
    start |= np.where(white, ~np.concatenate(([False], white[:-1])), before != c)
    # The run after a space belongs to that space.
    joined = np.zeros(n, bool)
    joined[1:] = (before[1:] == SPACE) & last[:-1]
    start &= ~joined | fresh
    apostrophes = np.flatnonzero((points == 39) & start)
    if len(apostrophes):
        _contractions(points, fresh, start, apostrophes)
    return np.flatnonzero(start)


def _contractions(points: np.ndarray, fresh: np.ndarray, start: np.ndarray, at: np.ndarray) -> None:
    """Set the starts that an apostrophe with s, t, m, d, re, ve or ll at the start of a match makes."""
    n = len(points)
    get = lambda i: np.where(i < n, points[np.minimum(i, n - 1)], 0)
    cut = lambda i: (i >= n) | fresh[np.minimum(i, n - 1)]
    one, two = get(at + 1), get(at + 2)
    short = np.isin(one, [ord(x) for x in "stmd"]) & ~cut(at + 1)
    pair = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    pair &= ~cut(at + 1) & ~cut(at + 2) & ~short
    for hit, size in ((at[short], 2), (at[pair], 3)):
        for k in range(1, size):
            start[hit + k] = False
        after = hit + size
        after = after[after < n]
        # What follows starts anew, unless it is an apostrophe's run or a space that starts anyway.
        start[after] = True


def segments(raw: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of texts and of parts of long ones, and the number of parts of each text. A part begins at a single space
    between two letters A-Z, where a pre-token begins however the text goes on."""
    letter = lambda x: ((x | 32) >= 97) & ((x | 32) <= 122)
    cuts, parts = [], np.ones(len(offsets) - 1, np.int64)
    for i in np.flatnonzero(np.diff(offsets) > limit).tolist():
        text, own, at = raw[offsets[i] : offsets[i + 1]], [], limit
        while at < len(text) - 1:
            near = text[at - 1 : at + 65_537]
            hits = np.flatnonzero((near[1:-1] == 32) & letter(near[:-2]) & letter(near[2:]))
            if len(hits):
                own.append(offsets[i] + at + int(hits[0]))
                at += int(hits[0]) + limit
            else:
                at += 65_536
        cuts += own
        parts[i] += len(own)
    return np.sort(np.concatenate((offsets, np.array(cuts, np.int64)))), parts


def pretokens(column: pa.Array | pa.ChunkedArray, special: str = "") -> tuple[pa.DictionaryArray, np.ndarray]:
    """All pre-tokens of a text column as one dictionary array, and the number of them in each row.

    The text of a special token is one pre-token of its own.
    """
    text = strings(column)
    marked = bool(special) and bool(pc.any(pc.match_substring(text, special)).as_py())
    raw, offsets = buffer_of(text)
    offsets, parts = segments(raw, offsets)
    pieces, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, j in slices(np.diff(offsets)):
        a, b = offsets[i], offsets[j]
        if a == b:
            continue
        part = raw[a:b]
        points, places = code_points(part)
        begins = offsets[i:j] - a
        begins = np.unique(begins[begins < b - a])
        extra = np.empty(0, np.int64)
        if marked:
            extra, inner = _marks(part, special.encode(), begins)
            begins = np.unique(np.concatenate((begins, extra)))
        firsts = begins if places is None else np.searchsorted(places, begins)
        at = starts_of(points, firsts)
        at = at if places is None else places[at]
        if marked and len(extra):
            at = at[~np.isin(at, inner)]
        bounds = np.append(at, b - a).astype(np.int32)
        pieces.append(pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(bounds), pa.py_buffer(part)]))
        counts[i:j] = np.diff(np.searchsorted(at, offsets[i : j + 1] - a))
    flat = pa.chunked_array(pieces, pa.string()).dictionary_encode().combine_chunks() if pieces else pa.array([], pa.string()).dictionary_encode()
    of_text = np.diff(np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(parts)))])
    return (flat if isinstance(flat, pa.DictionaryArray) else flat.chunk(0)), of_text


def _marks(part: np.ndarray, special: bytes, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of a special token's occurrences, and the positions inside them, which start nothing."""
    data, at, hits = part.tobytes(), 0, []
    limits = set(begins.tolist())
    while (at := data.find(special, at)) >= 0:
        if any(x in limits for x in range(at + 1, at + len(special))):  # two texts meet here
            at += 1
            continue
        hits.append(at)
        at += len(special)
    hit = np.array(hits, np.int64)
    ends = hit + len(special)
    inner = (hit[:, None] + np.arange(1, len(special))).ravel() if len(hit) else np.empty(0, np.int64)
    return np.concatenate((hit, ends[ends < len(part)])), inner
