"""Vector helpers over a batch's UTF-8 bytes: documents, words, 64-bit hashes. All are used inside Spark tasks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Number that glibc's mallopt has for the size from which a block of memory is returned as soon as it is freed.
_M_MMAP_THRESHOLD = -3

#: Characters between words: space and the five ASCII controls from tab to carriage return.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@functools.cache
def lean() -> None:
    """Lets this worker return the memory of large arrays once they are freed, where the C library can be told so."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").mallopt(_M_MMAP_THRESHOLD, 16 << 20)


def trim() -> None:
    """Gives memory that is free but held back to the system, as a worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end and the int64 offsets of each; null counts as empty."""
    lean()
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def blocks(offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most `limit` bytes together, or one document that is longer."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j
    trim()


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (bytes other than white space, or than those marked in `apart`), and the range of words of each document."""
    solid = ~apart[data]
    before, after = np.zeros_like(solid), np.zeros_like(solid)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = offsets[:-1][offsets[:-1] < len(data)]
    before[inner] = False
    last = offsets[1:][offsets[1:] > 0] - 1
    after[last] = False
    starts, ends = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words with one space after each, and where each begins."""
    sizes = ends - starts
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(sizes + 1, out=at[1:])
    out = np.full(int(at[-1]) + 8, 32, np.uint8)  # 8 more, for reads of whole lanes
    to = np.arange(int(sizes.sum())) + np.repeat(np.arange(len(starts)), sizes)
    solid = ~_SPACE[data]
    out[to] = data[solid]
    return out, at[:-1]


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turn(x: np.ndarray, k: int) -> np.ndarray:
    return (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def _mix(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, seed: int) -> np.ndarray:
    """XXH64 of many slices of a byte array (which has 8 spare bytes at its end), as uint64."""
    with np.errstate(over="ignore"):
        lanes = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        halves = np.ndarray((len(data) - 3,), "<u4", data, strides=(1,))
        seed_ = np.uint64(seed)
        out = np.full(len(starts), seed_ + _P5, np.uint64)
        at = starts.astype(np.int64)
        long = np.flatnonzero(sizes >= 32)
        if len(long):
            stripes = sizes[long] >> 5
            order = np.argsort(-stripes, kind="stable")
            long, stripes = long[order], stripes[order]
            v = [np.full(len(long), s, np.uint64) for s in (seed_ + _P1 + _P2, seed_ + _P2, seed_, seed_ - _P1)]
            base = at[long]
            for s in range(int(stripes[0])):
                k = int(np.searchsorted(-stripes, -s, "left"))
                for j in range(4):
                    v[j][:k] = _mix(v[j][:k], lanes[base[:k] + (32 * s + 8 * j)])
            h = _turn(v[0], 1) + _turn(v[1], 7) + _turn(v[2], 12) + _turn(v[3], 18)
            for x in v:
                h = (h ^ _mix(np.zeros_like(x), x)) * _P1 + _P4
            out[long] = h
            at[long] += stripes << 5
        out += sizes.astype(np.uint64)
        rest = sizes & 31
        for k in range(3):
            sel = np.flatnonzero(rest >= 8 * (k + 1))
            out[sel] = _turn(out[sel] ^ _mix(np.zeros(len(sel), np.uint64), lanes[at[sel] + 8 * k]), 27) * _P1 + _P4
        at += rest & 24
        sel = np.flatnonzero(rest & 4)
        out[sel] = _turn(out[sel] ^ (halves[at[sel]].astype(np.uint64) * _P1), 23) * _P2 + _P3
        at += rest & 4
        for k in range(3):
            sel = np.flatnonzero((rest & 3) > k)
            out[sel] = _turn(out[sel] ^ (data[at[sel] + k].astype(np.uint64) * _P5), 11) * _P1
        out = (out ^ (out >> np.uint64(33))) * _P2
        out = (out ^ (out >> np.uint64(29))) * _P3
        return out ^ (out >> np.uint64(32))
