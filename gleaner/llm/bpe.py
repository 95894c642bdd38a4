"""BPE encoding and decoding with a priority queue of merge ranks over a doubly linked list of symbols."""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from gleaner.llm.tokens import Memory, pieces


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself if it prints, else 256 and up."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class MergeQueue:
    """A vocabulary and its merges, read from a tokenizer file in JSON."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.first = [vocab[c] for c in letters]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: (left id, right id) -> (rank, id of the merged symbol)
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in reversed([*enumerate(pairs)])}
        back = {c: b for b, c in enumerate(letters)}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.special = {text.encode(): i for text, i in added.items()}
        self.strings = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for text, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in text) if all(c in back for c in text) else text.encode()
        for text, i in added.items():
            self.strings[i] = text.encode()

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece. Every queue entry names a left symbol and the pair it had; an entry whose pair has changed is skipped."""
        if piece in self.special:
            return [self.special[piece]]
        ids = [self.first[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        merges = self.merges
        queue = []
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                queue.append((found[0], i, ids[i], ids[i + 1], found[1]))
        if not queue:
            return ids
        heapq.heapify(queue)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        while queue:
            _, i, a, b, merged = heapq.heappop(queue)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = merged, -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if found := merges.get((merged, ids[k])):
                    heapq.heappush(queue, (found[0], i, merged, ids[k], found[1]))
            h = before[i]
            if h >= 0 and (found := merges.get((ids[h], merged))):
                heapq.heappush(queue, (found[0], h, ids[h], merged, found[1]))
        return [x for x in ids if x >= 0]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The vocabulary strings of the ids on end."""
        strings = self.strings
        return b"".join([strings[i] for i in ids])


@functools.cache
def merge_queue(path: str) -> MergeQueue:
    return MergeQueue(path)


_memory: dict[str, Memory] = {}


def _encoder(queue: MergeQueue):
    def encode(words: list[str]) -> Iterator[bytes]:
        for w in words:
            yield np.array(queue.encode(w.encode()), "<u4").tobytes()

    return encode


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_tokens, ids (array<int>), decoded (string).

    Null text counts as empty: no ids, an empty string. Repeated rows and null ids each give a row of their own. Bytes that
    form no text after decoding (never so for ids of a text) become U+FFFD. Other columns of `docs` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = merge_queue(path)
        for batch in batches:
            for i, j, p in pieces(batch.column(1), _encoder(queue), _memory.setdefault(path, Memory()), tuple(queue.special)):
                ids, at = p.tokens()
                texts = [queue.decode(ids[at[k] : at[k + 1]].tolist()).decode("utf-8", "replace") for k in range(j - i)]
                yield pa.record_batch([batch.column(0)[i:j], pa.array(np.diff(at)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32))), pa.array(texts, pa.string())], ["id", "n_tokens", "ids", "decoded"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`encoded` as digests: id_col, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (decoded text, UTF-8).

    The strings to digest are put together from those of distinct pieces, so that a piece's ids are written out once for a
    batch however often it occurs. Cases as in `encoded`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queue = merge_queue(path)
        for batch in batches:
            known = None
            for i, j, p in pieces(batch.column(1), _encoder(queue), _memory.setdefault(path, Memory()), tuple(queue.special)):
                if known is not p.words:  # one vocabulary of pieces for all blocks of a batch
                    known, said, decoded = p.words, [], []
                    for a, b in zip(p.lo.tolist(), p.hi.tolist(), strict=True):
                        own = p.ids[a:b].tolist()
                        said.append(",".join(map(str, own)))
                        decoded.append(queue.decode(own))
                    said, decoded = pa.array(said, pa.string()), pa.array(decoded, pa.binary())
                at = pa.array(p.docs.astype(np.int32))
                codes = pa.array(p.codes)
                lines = pc.binary_join(pa.ListArray.from_arrays(at, said.take(codes)), ",")
                texts = pc.binary_join(pa.ListArray.from_arrays(at, decoded.take(codes)), b"")
                size = np.zeros(len(p.codes) + 1, np.int64)
                np.cumsum((p.hi - p.lo)[p.codes], out=size[1:])
                yield pa.record_batch(
                    [
                        batch.column(0)[i:j],
                        pa.array(np.diff(size[p.docs])),
                        pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in lines], pa.string()),
                        pa.array([hashlib.sha256(_text(x.as_buffer())).hexdigest() for x in texts], pa.string()),
                    ],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def _text(decoded: pa.Buffer) -> bytes:
    return decoded.to_pybytes().decode("utf-8", "replace").encode()
