"""Byte-level tokens of many texts at once, inside a task.

Texts are cut into the tokenizer's pieces (letters, digits, other marks, white space, English contractions) by vector
operations, equal pieces are put together by Arrow, and each distinct piece is encoded once: by the tokenizers library
here, by the merge queue of `bpe` there. A piece is encoded alone in either case, so the ids are those of whole texts.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from gleaner.llm.textscan import blocks, utf8

#: Bytes of text cut at a time. Bounds the memory of a task, whatever the number and length of its texts, but for the longest
#: piece: one run of letters, digits, marks or spaces is cut whole.
BLOCK_BYTES = 1 << 20
#: Bytes in which the end of a part is looked for at a time.
WINDOW_BYTES = 1 << 16
#: Bytes of text whose pieces are put together and encoded at a time.
GROUP_BYTES = 16 << 20
#: Bytes of distinct pieces that a Python worker remembers between batches, and of their ids and places.
REMEMBERED_BYTES = 48 << 20


@functools.cache
def _classes() -> np.ndarray:
    """0 other, 1 letter, 2 digit, 3 white space, for every code point."""
    import regex

    out = np.zeros(0x110000, np.uint8)
    patterns = [(1, regex.compile(r"\p{L}+")), (2, regex.compile(r"\p{N}+")), (3, regex.compile(r"\s+"))]
    for low in (x for x in range(0, 0x110000, 0x800) if x != 0xD800):  # the surrogates are one such range
        text = "".join(map(chr, range(low, low + 0x800)))
        for kind, pattern in patterns:
            for m in pattern.finditer(text):
                out[low + m.start() : low + m.end()] = kind
    return out


def cut(data: np.ndarray, offsets: np.ndarray, special: tuple[bytes, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of all pieces (and the end), and the range of pieces of each document. Special tokens' strings are pieces.

    Long texts are cut part by part, at places where a piece begins whatever stands before and after: at a space after another
    character than white space, and at a mark other than the apostrophe after a letter or digit.
    """
    raw = data.tobytes()
    holes = np.array(list(_found(raw, offsets, special)) if special else [], np.int64).reshape(-1, 2)
    bounds = np.unique(np.concatenate([offsets, holes.reshape(-1)]))
    starts, low = [], 0
    while low < len(raw):
        high = _part_end(raw, low, bounds)
        inner = bounds[(bounds > low) & (bounds < high)] - low
        starts.append(_piece_starts(raw[low:high], np.concatenate([[0], inner, [high - low]])) + low)
        low = high
    starts = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    if len(holes):
        inside = np.searchsorted(holes[:, 0], starts, "right") - 1
        at = np.maximum(inside, 0)
        starts = starts[(inside < 0) | (starts == holes[at, 0]) | (starts >= holes[at, 1])]
    return np.append(starts, len(raw)), np.searchsorted(starts, offsets)


@functools.cache
def _special(strings: tuple[bytes, ...]) -> re.Pattern:
    """Any of the strings; the longest of those that begin at a place."""
    return re.compile(b"|".join(re.escape(x) for x in sorted(strings, key=len, reverse=True)))


def _found(raw: bytes, offsets: np.ndarray, special: tuple[bytes, ...]) -> Iterator[tuple[int, int]]:
    """Where special strings stand, none reaching from one document into the next."""
    at, pattern = 0, _special(special)
    while m := pattern.search(raw, at):
        edge = int(offsets[np.searchsorted(offsets, m.start(), "right")])
        if m.end() <= edge:
            yield m.span()
        at = min(m.end(), edge)


def _part_end(raw: bytes, low: int, bounds: np.ndarray) -> int:
    """Where a part that begins at `low` may end: at a document's edge, else at the next place where a piece surely begins."""
    at = low + BLOCK_BYTES
    if at >= len(raw):
        return len(raw)
    k = int(np.searchsorted(bounds, at, "right")) - 1
    if bounds[k] > low + BLOCK_BYTES // 2:
        return int(bounds[k])
    following = int(bounds[k + 1]) if k + 1 < len(bounds) else len(raw)
    while at < following:
        while at < following and raw[at] & 0xC0 == 0x80:  # within a character
            at += 1
        text = raw[at : min(at + WINDOW_BYTES, following)].decode("utf-8", "ignore")  # without a character that is cut
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = _classes()[points]
        sure = (kind[:-1] != 3) & (points[1:] == 0x20)
        sure |= (kind[:-1] > 0) & (kind[:-1] < 3) & (kind[1:] == 0) & (points[1:] != 0x27)
        if sure.any():
            return at + len(text[: int(sure.argmax()) + 1].encode())
        at += max(1, len(text[:-1].encode()))  # the last character may be followed by such a place
    return following


def _piece_starts(raw: bytes, bounds: np.ndarray) -> np.ndarray:
    """Byte offsets of the pieces of some text; pieces don't cross `bounds`."""
    points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    wide = len(raw) != n
    if wide:
        to_byte = np.zeros(n + 1, np.int32)  # a block is far below 2 GB
        sizes = (points >= 0x80).view(np.uint8) + (points >= 0x800).view(np.uint8) + (points >= 0x10000).view(np.uint8) + np.uint8(1)
        np.cumsum(sizes, dtype=np.int32, out=to_byte[1:])
        bounds = np.searchsorted(to_byte, bounds)
    firsts = bounds[:-1][bounds[:-1] < n]
    kind = _classes()[points]
    first = np.zeros(n + 1, bool)
    first[firsts] = True
    first[n] = True
    change = np.empty(n, bool)
    change[:1] = True
    change[1:] = kind[1:] != kind[:-1]
    change |= first[:n]
    blank, is_space = kind == 3, points == 0x20
    after_space = np.zeros(n, bool)
    after_space[1:] = is_space[:-1]
    after_space &= ~first[:n]
    start = np.zeros(n + 1, bool)
    start[:n] = change & (blank | ~after_space)
    before_solid = np.zeros(n, bool)
    before_solid[:-1] = blank[:-1] & ~blank[1:] & ~first[1:n]
    start[:n] |= before_solid
    marks = np.flatnonzero((points == 0x27) & change & ~after_space)
    if len(marks):
        pad = np.concatenate([points, np.zeros(2, np.uint32)])
        a, b = pad[marks + 1], pad[marks + 2]
        inside, inside2 = ~first[marks + 1], ~first[np.minimum(marks + 2, n)] & (marks + 2 <= n)
        one = inside & np.isin(a, [ord(x) for x in "stmd"])
        two = inside & inside2 & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        for sel, size in ((one, 2), (two, 3)):
            m = marks[sel]
            start[m + 1] = False
            start[np.minimum(m + size, n)] = True
    starts = np.flatnonzero(start[:n])
    return to_byte[starts].astype(np.int64) if wide else starts


class Memory:
    """Distinct pieces that a worker has encoded, held in Arrow and numpy buffers."""

    def __init__(self) -> None:
        self.words = pa.array([], pa.string())
        self.ids = np.empty(0, np.uint32)
        self.at = np.zeros(1, np.int64)
        self.bytes = 0

    def coded(self, words: pa.StringArray, encode: Callable[[list[str]], Iterable[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All known ids and, for each word, where its own begin and end."""
        where = pc.index_in(words, value_set=self.words)
        new = words.filter(where.is_null())
        where = where.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        ids, at = self.ids, self.at
        if len(new):
            sizes, parts = [], [ids]
            for k in range(0, len(new), 32_768):
                blobs = list(encode(new[k : k + 32_768].to_pylist()))
                sizes.append(np.fromiter(map(len, blobs), np.int64, len(blobs)) >> 2)
                parts.append(np.frombuffer(b"".join(blobs), "<u4"))
            at = np.concatenate([at, at[-1] + np.cumsum(np.concatenate(sizes))])
            ids = np.concatenate(parts)
            where[where < 0] = len(self.words) + np.arange(len(new))
            # what each new piece would take: its bytes, its offset, its ids and their place
            taken = pc.binary_length(new).to_numpy(zero_copy_only=False).astype(np.int64) + 12 + 4 * np.diff(at[len(self.words) :])
            room = int(np.searchsorted(np.cumsum(taken), REMEMBERED_BYTES - self.bytes, "right"))
            if room > 0:
                self.words = pa.concat_arrays([self.words, new[:room]])
                self.at = at[: len(self.words) + 1].copy()
                self.ids = ids[: self.at[-1]].copy()
                self.bytes += int(taken[:room].sum())
        return ids, at[where], at[where + 1]


@dataclass
class Pieces:
    """Documents of a block as indices of distinct pieces; `ids` has tokens of pieces, `lo` and `hi` where each piece's are."""

    words: pa.StringArray
    codes: np.ndarray
    docs: np.ndarray
    ids: np.ndarray
    lo: np.ndarray
    hi: np.ndarray

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the block and the offsets of each document among them."""
        lo = self.lo[self.codes]
        size = self.hi[self.codes] - lo
        ends = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        return self.ids[np.repeat(lo - ends[:-1], size) + np.arange(int(ends[-1]))], ends[self.docs]


def pieces(column: pa.Array, encode: Callable[[list[str]], Iterable[bytes]], memory: Memory, special: tuple[bytes, ...] = ()) -> Iterator[tuple[int, int, Pieces]]:
    """Block by block: the range of rows and its pieces. `encode` gives uint32 little-endian ids of distinct pieces."""
    data, offsets = utf8(column)
    for first, last in blocks(offsets, GROUP_BYTES):
        parts, ranges = [], []
        for i, j in blocks(offsets[first : last + 1], BLOCK_BYTES):
            i, j = i + first, j + first
            own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            starts, docs = cut(own, at, special) if len(own) else (np.zeros(1, np.int64), np.zeros(j - i + 1, np.int64))
            texts = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int32).tobytes()), pa.py_buffer(own.tobytes()))
            parts.append(texts.dictionary_encode())
            ranges.append((i, j, docs))
        whole = pa.chunked_array(parts).unify_dictionaries()
        words = whole.chunk(0).dictionary
        ids, lo, hi = memory.coded(words, encode)
        for (i, j, docs), part in zip(ranges, whole.chunks, strict=True):
            yield i, j, Pieces(words, part.indices.to_numpy(), docs, ids, lo, hi)


@functools.cache
def tokenizer(path: str):
    """The library's tokenizer, without truncation and padding. One for each worker."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


#: What a tokenizer's file must say for the rule by which texts are cut here (fixed values of the format).
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
_PLAIN = {"dropout": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}


def unlike(spec: dict) -> list[str]:
    """In what a tokenizer's specification asks for another rule than that of this module: none if its ids come out right."""
    model, first = spec.get("model") or {}, spec.get("pre_tokenizer") or {}
    out = [] if spec.get("normalizer") is None else ["normalizer"]
    out += [f"pre_tokenizer.{k}" for k, v in _BYTE_LEVEL.items() if first.get(k, v if k == "use_regex" else None) != v]
    out += [] if model.get("type", "BPE") == "BPE" else ["model.type"]
    out += [f"model.{k}" for k, v in _PLAIN.items() if (model.get(k) or None) != (v or None)]
    flags = ("single_word", "lstrip", "rstrip", "normalized")
    return out + [f"added_tokens.{k}" for k in flags if any(t.get(k) for t in spec.get("added_tokens") or [])]


@functools.cache
def special_texts(path: str) -> tuple[bytes, ...]:
    """The added tokens' strings; the library gives their ids wherever the strings stand in a text.

    A file whose texts are to be cut by another rule is an error, as its ids would be wrong.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if found := unlike(spec):
        raise ValueError(f"{path} is not a byte-level BPE of the rule that texts are cut by here: {', '.join(found)}")
    return tuple(t["content"].encode() for t in spec.get("added_tokens") or [])


_memory: dict[str, Memory] = {}


def library_pieces(column: pa.Array, path: str) -> Iterator[tuple[int, int, Pieces]]:
    """`pieces`, with ids by the tokenizers library and add_special_tokens=False."""
    own = tokenizer(path)

    def encode(words: list[str]) -> Iterator[bytes]:
        for k in range(0, len(words), 8192):
            for e in own.encode_batch_fast(words[k : k + 8192], add_special_tokens=False):
                yield np.array(e.ids, "<u4").tobytes()

    return pieces(column, encode, _memory.setdefault(path, Memory()), special_texts(path))
