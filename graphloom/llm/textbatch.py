"""Arrow text batches as flat byte arrays: balanced slices, and chunks with a dictionary.

Every function works on whole texts. A batch is cut by bytes, never by characters of a text, so
memory follows the slice budget (or the longest single text), not the table.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
#: Where the work is on distinct pieces, of which larger slices have fewer a byte.
DISTINCT_BYTES = 8 << 20
#: ASCII white space: the space and tab, line feed, vertical tab, form feed, carriage return.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
CAPITAL, LETTER, STOP = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
CAPITAL[ord("A") : ord("Z") + 1] = True
LETTER[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
STOP[[ord(","), ord(".")]] = True


def flat(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array and its n + 1 offsets, counted from 0."""
    kind = np.int64 if pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type) else np.int32
    if arr.null_count:
        arr = pc.fill_null(arr, "")
    _, off, data = arr.buffers()
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(off, kind)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in order, in batches of about ``budget`` bytes of ``column`` (one text at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = flat(batch.column(column))[1]
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(ends, ends[at] + budget, side="right")) - 1
            to = max(at + 1, min(to, batch.num_rows))
            yield batch.slice(at, to - at)
            at = to


def binary(data: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Zero-copy binary array over ``data``, cut at ``starts`` (n + 1 offsets)."""
    return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cut every text before each ASCII white space that follows another character.

    Returns the bytes, chunk offsets (n + 1) over them and the number of chunks of each text. A chunk
    is a run of white space and the run of other characters after it; an empty text has none. There
    is no cut inside a run of white space that holds other spaces than ASCII's, and one more before
    each comma or full stop after an ASCII letter.
    """
    n = len(data)
    if n == 0:
        return data, np.zeros(1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    space = SPACE[data]
    cut = np.empty(n, bool)
    cut[0] = True
    np.logical_and(space[1:], ~space[:-1], out=cut[1:])
    at = np.flatnonzero(cut[1:] & (data[:-1] >= 0x80)) + 1
    if len(at):
        cut[at[_wide_space_before(data, at)]] = False
    cut[1:] |= LETTER[data[:-1]] & STOP[data[1:]]
    cut[offsets[:-1][offsets[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    return data, np.append(starts, n), np.diff(np.searchsorted(starts, offsets))


def _wide_space_before(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each position is white space outside ASCII."""
    a, b, c = (data[np.maximum(at - k, 0)].astype(np.int32) for k in (3, 2, 1))
    two = (b << 8) | c
    three = (a << 16) | two
    general = (three >= 0xE28080) & (three <= 0xE2808A)
    return np.isin(two, [0xC285, 0xC2A0]) | general | np.isin(three, [0xE19A80, 0xE280A8, 0xE280A9, 0xE280AF, 0xE2819F, 0xE38080])


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Like ``chunks`` for tokenizers that drop white space and case: words without the space.

    A comma or full stop after an ASCII letter begins a piece of its own. ASCII capitals are lowered
    where an ASCII character follows (before another, a combining mark may belong to the capital),
    and not at all where the bytes hold ``<|``, the head of special strings, which heed case.
    """
    n = len(data)
    if n == 0:
        return data, np.zeros(1, np.int64), np.zeros(len(offsets) - 1, np.int64)
    solid = ~SPACE[data]
    cut = solid.copy()
    cut[1:] &= ~solid[:-1]
    cut[1:] |= LETTER[data[:-1]] & STOP[data[1:]]
    heads = offsets[:-1][offsets[:-1] < n]
    cut[heads] |= solid[heads]
    after = np.empty(n, bool)
    after[-1] = True
    np.less(data[1:], 0x80, out=after[:-1])
    after[heads[1:] - 1 if len(heads) and heads[0] == 0 else heads - 1] = True
    if b"<|" not in data.tobytes():
        data = data + np.where(CAPITAL[data] & after, np.uint8(32), np.uint8(0))
    kept = cut[solid]
    return data[solid], np.append(np.flatnonzero(kept), len(kept)), np.diff(np.searchsorted(np.flatnonzero(cut), offsets))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every run without ASCII white space, and their number in each text."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets) - 1, np.int64)
    solid = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, offsets))


def expand(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... (len of them) of every item, one after the other."""
    total = int(lens.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lens)
    return np.arange(total) + np.repeat(starts - (ends - lens), lens)


_LIVE: list[Dictionary] = []


def release() -> None:
    """Empty the worker's dictionaries: a stage that needs none leaves their memory to other things."""
    for d in _LIVE:
        d.clear()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc keeps what is freed unless asked
    if trim is not None:
        trim(0)


class Dictionary:
    """What a function gives for distinct chunks, kept for the worker's life up to ``limit`` chunks.

    ``encode`` takes a list of byte strings and returns all their ids, the number for each, and in
    which order they come (positions in the list). The limit bounds memory only: a full dictionary
    starts anew, results stay the same.
    """

    def __init__(self, encode, cut=chunks, limit: int = 600_000, dtype=np.uint32):
        self.encode, self.cut, self.limit, self.dtype = encode, cut, limit, dtype
        self.clear()
        _LIVE.append(self)

    def clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.at = np.zeros(1024, np.int64)
        self.len = np.zeros(1024, np.int32)
        self.ids = np.zeros(4096, self.dtype)
        self.used = 0

    def rows(self, distinct: list[bytes]) -> np.ndarray:
        if len(self.known) + len(distinct) > self.limit:
            self.clear()
        get = self.known.get
        out = np.fromiter((get(x, -1) for x in distinct), np.int64, len(distinct))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            new = [distinct[k] for k in missing.tolist()]
            ids, lens, order = self.encode(new)
            total, n = len(ids), len(self.known)
            while n + len(new) > len(self.at):
                self.at, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.len))
            while self.used + total > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
            self.len[n : n + len(new)] = lens
            self.at[n : n + len(new)] = self.used + np.cumsum(lens) - lens
            self.ids[self.used : self.used + total] = ids
            self.used += total
            place = np.empty(len(new), np.int64)
            place[order] = np.arange(n, n + len(new))
            self.known.update(zip(new, place.tolist(), strict=True))
            out[missing] = place
        return out

    def codes(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Row of each chunk."""
        if len(starts) < 2:
            return np.zeros(0, np.int64)
        coded = binary(data, starts).dictionary_encode()
        return self.rows(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ids in each text."""
        data, starts, per = self.cut(data, offsets)
        rows = self.codes(data, starts)
        return sums(self.len[rows], per)

    def encoded(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and their number in each text."""
        data, starts, per = self.cut(data, offsets)
        rows = self.codes(data, starts)
        lens = self.len[rows].astype(np.int64)
        return self.ids[expand(self.at[rows], lens)], sums(lens, per)


def sums(values: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Sums over consecutive groups of ``per`` values each; 0 for an empty group."""
    total = np.append(0, np.cumsum(values, dtype=np.int64))
    ends = np.cumsum(per)
    return total[ends] - total[ends - per]
