"""Vectorised work on many texts at once: one byte buffer plus offsets, no loop per text.

A batch of texts is a ``(data, offsets)`` pair: the UTF-8 bytes end to end and where each text
begins.  Substrings are ``(start, end)`` index arrays into ``data``.  A substring is hashed eight bytes
at a time, its length first, every step through a mixing function that is no linear map; one of up to
eight bytes has a hash of its own among those of its length.  Windows of numbers are hashed by joining
the hashes of their halves.  Equal hashes are no proof: ``distinct`` compares the bytes.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Text bytes handled at once; bounds a worker's memory whatever the rows of an Arrow batch are.
SLICE_BYTES = 2 << 20
#: Spans hashed at once.
SPANS = 1 << 15

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
_SEED = (U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93))
_JOIN = (U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB))
#: Bytes from which a span is hashed, or compared, by itself.
LONG = 2048


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every input bit over the word."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, off - off[0]


def release() -> None:
    """Give memory that is free in this process back to the system, where it can be asked to."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(ctypes.util.find_library("c")), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows, cut so that each piece has about ``most`` bytes of text (one row at least)."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, off = texts(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()  # workers are used again, by other operators too


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """``concatenate([arange(s, s + n) for s, n in zip(start, length)])``."""
    total = int(length.sum())
    if not total:
        return np.empty(0, np.int64)
    begin = np.cumsum(length) - length
    return np.repeat(start - begin, length) + np.arange(total, dtype=np.int64)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run without ASCII white space, and word offsets by text."""
    ink = ~_WHITE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    first = ink & edge[:-1]
    first[1:] |= ink[1:] & ~ink[:-1]
    last = ink & edge[1:]
    last[:-1] |= ink[:-1] & ~ink[1:]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


def _octets(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[:-8] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def _steps(start: np.ndarray, size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each run of eight bytes: which spans reach it, where it starts, and the mask of what is theirs."""
    which, at = np.flatnonzero(size), 0
    while len(which):
        left = size[which] - at
        yield which, start[which] + at, _KEEP[np.minimum(left, 8)]
        which, at = which[left > 8], at + 8


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each ``data[start:end]``; ``which`` selects one of two independent hashes."""
    size = end - start
    out = mix(size.astype(U64) + _SEED[which])
    eight = _octets(data)
    for k in range(0, len(size), SPANS):
        part, n = out[k : k + SPANS], size[k : k + SPANS]
        for own, at, keep in _steps(start[k : k + SPANS], np.where(n < LONG, n, 0)):
            part[own] = mix(part[own] ^ (eight[at] & keep))
    for i in np.flatnonzero(size >= LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes((which,))).digest(), "little")
    return out


def digests(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A cryptographic hash of 128 bits of each text, as two numbers."""
    raw, ends = data.tobytes(), off.tolist()
    both = np.frombuffer(b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(ends, ends[1:])), np.int64)
    return both[::2], both[1::2]


def _joined(a: np.ndarray, b: np.ndarray, which: int) -> np.ndarray:
    x = a * _JOIN[which]
    x += b
    x ^= x >> U64(32)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(29)
    return x


def window_hash(values: np.ndarray, at: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of ``values[i:i + length]`` for each ``i`` in ``at`` (ascending).

    Windows of powers of two are joined from their halves; a window of another length from the powers that
    its length is made of.  Places are worked on some at a time, so that all levels stay in the processor's cache.
    """
    out = np.empty(len(at), U64)
    for k in range(0, len(at), SPANS):
        s = at[k : k + SPANS]
        base = int(s[0])
        level, size, have, reach = values[base : int(s[-1]) + length], 1, None, length
        while reach:  # from the smallest power to the largest, the last words of a window first
            if length & size:
                reach -= size
                part = level[s - base + reach]
                have = part if have is None else _joined(part, have, which)
            if reach:
                level, size = _joined(level[:-size], level[size:], which), 2 * size
        out[k : k + SPANS] = mix(have + _SEED[which])
    return out


def same_bytes(data: np.ndarray, first: np.ndarray, second: np.ndarray, size: np.ndarray) -> bool:
    """Whether ``data[first:first + size]`` equals ``data[second:second + size]`` for all spans."""
    eight = _octets(data)
    short = np.where(size < LONG, size, 0)
    for own, at, keep in _steps(first, short):
        if ((eight[at] ^ eight[second[own] + at - first[own]]) & keep).any():
            return False
    return all(np.array_equal(data[first[i] : first[i] + size[i]], data[second[i] : second[i] + size[i]]) for i in np.flatnonzero(size >= LONG).tolist())


def distinct(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(which, inverse)``: the index of one span for each distinct string, and each span's entry.

    Spans are grouped by a hash, and each is compared with the first of its group, byte by byte; should
    one differ, the strings themselves make the groups.
    """
    if not len(start):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, first, inverse = np.unique(span_hash(data, start, end), return_index=True, return_inverse=True)
    size, like = end - start, first[inverse]
    if not (np.array_equal(size, size[like]) and same_bytes(data, start, start[like], size)):
        seen: dict[bytes, int] = {}
        raw = data.tobytes()
        inverse = np.array([seen.setdefault(raw[s:e], len(seen)) for s, e in zip(start.tolist(), end.tolist())])
        first = np.unique(inverse, return_index=True)[1]
    return first, inverse


def strings(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[s:e] for s, e in zip(start.tolist(), end.tolist())]
