"""Token ids in sorted-string-table shards.

A shard is one file: compressed blocks of entries in key order, a block index, a Bloom filter and a footer. Keys within a
block leave out what they share with the key before. A reader takes footer and index first, asks the filter, finds the
block by binary search and scans that one block.
"""

from __future__ import annotations

import bisect
import functools
import json
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import work_path, written
from gleaner.llm.tokens import library_pieces

MAGIC = b"GLSST002"
BLOCK_BYTES = 64 << 10
BLOOM_BITS, BLOOM_HASHES = 10, 7  # bits a key; about 1 % of absent keys pass
#: Stored bytes and rows after which a task goes on with a new shard.
SHARD_BYTES, SHARD_ROWS = 256 << 20, 1 << 20
_SUFFIX = struct.Struct(">QI")

Id = int | str | None


def id_bytes(doc_id: Id) -> bytes:
    """The part of a key that names an id, which the filter knows and look-ups go by. It sorts as the id does, null first."""
    if doc_id is None:
        return b"\x00"
    if isinstance(doc_id, int):
        return b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")
    return b"\x02" + doc_id.encode().replace(b"\x00", b"\x00\xff") + b"\x00\x01"


def key_of(doc_id: Id, text_hash: int = -(1 << 63), ordinal: int = 0) -> bytes:
    """A key that sorts as the id does; a hash of the text and `ordinal` tell rows of one id apart."""
    return id_bytes(doc_id) + _SUFFIX.pack(text_hash + (1 << 63), ordinal)


def id_part(key: bytes) -> bytes:
    return key[: -_SUFFIX.size]


def id_of(key: bytes) -> Id:
    part = id_part(key)
    if part[0] == 0:
        return None
    return int.from_bytes(part[1:], "big") - (1 << 63) if part[0] == 1 else part[1:-2].replace(b"\x00\xff", b"\x00").decode()


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unvarint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _halves(part: bytes) -> tuple[int, int]:
    h = xxhash.xxh3_128_intdigest(part)
    return h & (1 << 64) - 1, h >> 64 | 1


def _probes(part: bytes, bits: int) -> list[int]:
    a, b = _halves(part)
    return [(a + k * b) % bits for k in range(BLOOM_HASHES)]


class ShardWriter:
    """Takes keys in ascending order; `close` writes index, filter and footer."""

    def __init__(self, sink: BinaryIO) -> None:
        self.sink, self.at = sink, 0
        self.index: list[tuple[bytes, int, int]] = []
        self.rows, self.halves = 0, array("Q")  # sixteen bytes a key, for the filter
        self.pack = zstandard.ZstdCompressor(level=1)
        self._fresh()

    def _fresh(self) -> None:
        self.block, self.size, self.first, self.last = [], 0, None, b""

    def add(self, key: bytes, value: bytes) -> None:
        if self.first is None:
            self.first = key
        shared = 0
        while shared < len(self.last) and shared < len(key) and self.last[shared] == key[shared]:
            shared += 1
        entry = _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += [entry, value]
        self.size += len(entry) + len(value)
        self.last = key
        self.rows += 1
        self.halves.extend(_halves(id_part(key)))
        if self.size >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.first is not None:
            data = self.pack.compress(b"".join(self.block))
            self.index.append((self.first, self.at, len(data)))
            self.sink.write(data)
            self.at += len(data)
            self._fresh()

    def close(self) -> None:
        self._flush()
        bits = max(64, BLOOM_BITS * self.rows)
        bloom = np.zeros(bits, bool)
        a, b = (x % np.uint64(bits) for x in np.frombuffer(self.halves, np.uint64).reshape(-1, 2).T)
        for k in range(BLOOM_HASHES):
            bloom[(a + np.uint64(k) * b) % np.uint64(bits)] = True
        index = b"".join(_varint(len(k)) + k + struct.pack("<QI", at, size) for k, at, size in self.index)
        footer = json.dumps({"index": [self.at, len(index)], "bloom": [self.at + len(index), -(-bits // 8), bits], "rows": self.rows}).encode()
        self.sink.write(index + np.packbits(bloom, bitorder="little").tobytes() + footer + struct.pack("<I", len(footer)) + MAGIC)


class ShardReader:
    """Looks keys up in a shard, or goes through it block by block; holds index and filter, and one block at a time."""

    def __init__(self, source) -> None:
        self.source = source
        size = source.size()
        tail = source.read_at(12, size - 12)
        if tail[4:] != MAGIC:
            raise ValueError("not a shard")
        n = struct.unpack("<I", tail[:4])[0]
        self.footer = json.loads(source.read_at(n, size - 12 - n))
        at, length = self.footer["index"]
        raw = source.read_at(length, at)
        self.keys, self.places, pos = [], [], 0
        while pos < length:
            n, pos = _unvarint(raw, pos)
            self.keys.append(raw[pos : pos + n])
            self.places.append(struct.unpack_from("<QI", raw, pos + n))
            pos += n + 12
        at, length, self.bits = self.footer["bloom"]
        self.bloom = source.read_at(length, at)

    def _entries(self, block: int) -> Iterator[tuple[bytes, bytes]]:
        at, size = self.places[block]
        data = zstandard.ZstdDecompressor().decompress(self.source.read_at(size, at))
        pos, key = 0, b""
        while pos < len(data):
            shared, pos = _unvarint(data, pos)
            rest, pos = _unvarint(data, pos)
            length, pos = _unvarint(data, pos)
            key = key[:shared] + data[pos : pos + rest]
            pos += rest
            yield key, data[pos : pos + length]
            pos += length

    def may_have(self, part: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(part, self.bits))

    def get(self, part: bytes) -> bytes | None:
        """The first value of an id (`id_bytes`), by the filter, a binary search of the index and one block, or the next."""
        if not self.may_have(part):
            return None
        block = max(0, bisect.bisect_left(self.keys, part) - 1)
        while block < len(self.places) and id_part(self.keys[block]) <= part:
            for k, v in self._entries(block):
                if id_part(k) == part:
                    return v
            block += 1
        return None

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for block in range(len(self.places)):
            yield from self._entries(block)


@functools.cache
def filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    """The store and the path in it of a folder's address (file://, hdfs://, s3://, gs://)."""
    store, path = pafs.FileSystem.from_uri(root)
    store.create_dir(path, recursive=True)
    return store, path


def pack_ids(ids: np.ndarray, wide: bool) -> bytes:
    return ids.astype("<u4" if wide else "<u2").tobytes()


def _kind(docs: DataFrame, id_col: str) -> str:
    """Ids of integer types are longs; all others are read, sorted and returned as strings."""
    return "long" if dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") else "string"


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row, written: id, h (a hash of the text) and value (compressed: a byte that tells the width, then the ids with the end id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for i, j, p in library_pieces(batch.column(2), path):
                ids, at = p.tokens()
                values = []
                for k in range(j - i):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id))
                    wide = bool(own.max() > 0xFFFF)
                    values.append(squeeze.compress(bytes([wide]) + pack_ids(own, wide)))
                yield pa.record_batch([batch.column(0)[i:j], batch.column(1)[i:j], pa.array(values, pa.binary())], ["id", "h", "value"])

    kind = _kind(docs, id_col)
    own = docs.select(F.col(id_col).cast(kind).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    return written(own.mapInArrow(run, f"id {kind}, h long, value binary"), "encoded")


MANIFEST = "shard string, first_key binary, last_key binary, rows long, tokens long"


def write_shards(docs: DataFrame, root: str, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Writes ascending shards below `root`; returns the manifest, a written table with a row per shard.

    Texts are encoded where they lie and only ids are shuffled: by ranges of document id and text hash, so that shards follow
    each other and rows that repeat an id need not share one. A task goes on with a new shard after `shard_bytes` or `shard_rows`,
    so neither a shard nor what its writer holds grows with the range. A task writes under new names each time it is tried and
    only the names that its finished try returned enter the manifest, so retries and lost executors leave no half shard.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(root)
        unpack = zstandard.ZstdDecompressor()
        name, writer, sink, tokens, first, key, last, ordinal = "", None, None, 0, b"", b"", None, 0

        def ended() -> pa.RecordBatch:
            writer.close()
            sink.close()
            return pa.record_batch([[name], [first], [key], [writer.rows], [tokens]], [c.split()[0] for c in MANIFEST.split(", ")])

        for batch in batches:
            for doc, h, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                ordinal = ordinal + 1 if (doc, h) == last else 0
                last = (doc, h)
                if writer is not None and (writer.at >= shard_bytes or writer.rows >= shard_rows):
                    yield ended()
                    writer = None
                value = unpack.decompress(value.as_buffer())
                next_key = key_of(doc, h, ordinal)
                if writer is None:
                    name, tokens, first = f"{uuid.uuid4().hex}.sst", 0, next_key
                    sink = store.open_output_stream(f"{folder}/{name}")
                    writer = ShardWriter(sink)
                key = next_key
                writer.add(key, value)
                tokens += (len(value) - 1) // (4 if value[0] else 2)
        if writer is not None:
            yield ended()

    order = [F.col("id").asc_nulls_first(), F.col("h")]
    ordered = encoded(docs, path, end_id, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = f"{root}/manifest"
    ordered.mapInArrow(write, MANIFEST).write.parquet(manifest)
    return docs.sparkSession.read.schema(MANIFEST).parquet(manifest)


def read_shards(manifest: DataFrame, root: str, id_col: str = "doc_id", kind: str = "long") -> DataFrame:
    """Per document, in its shard's order: id_col, start (ids of all documents before it), n_tokens, ids_crc32, shard.

    `kind` is the type of the shards' ids, long or string.

    Each shard is gone through block by block; the first id of every block is also looked up by filter and binary search, and
    a look-up that does not give what the block holds fails the job.
    """
    before = Window.orderBy("first_key", "last_key").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    based = manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(root)
        for batch in batches:
            for shard, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{folder}/{shard}") as source:
                    reader = ShardReader(source)
                    rows: list[tuple] = []
                    last = None
                    for block in range(len(reader.places)):
                        for n, (key, value) in enumerate(reader._entries(block)):
                            if not n and id_part(key) != last and reader.get(id_part(key)) != value:
                                raise ValueError(f"{shard}: the look-up of {id_of(key)} does not give its ids")
                            last = id_part(key)
                            ids = np.frombuffer(value, "<u4" if value[0] else "<u2", offset=1).astype("<u4")
                            rows.append((id_of(key), base, len(ids), zlib.crc32(ids), shard))
                            base += len(ids)
                            if len(rows) == 8192:
                                yield _batch(rows, kind)
                                rows = []
                    yield _batch(rows, kind)

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return based.select("shard", "base").repartition(parts, "shard").mapInArrow(read, f"{id_col} {kind}, start long, n_tokens long, ids_crc32 long, shard string")


def _arrow(kind: str) -> pa.DataType:
    return pa.int64() if kind == "long" else pa.string()


def _batch(rows: list[tuple], kind: str) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (_arrow(kind), *[pa.int64()] * 3, pa.string()), strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32", "shard"])


def token_shards(docs: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes, writes and reads back: id_col, start, n_tokens (with the end id), ids_crc32, shard.

    Null or empty text is the end id alone. Ids of integer types are longs and sort as numbers; all others are strings, and
    sort by their UTF-8 bytes. A null id sorts first; repeated ids are each kept, in an order that a hash of their texts gives.
    An empty table gives no shards and no rows. Other columns of `docs` are not read.
    """
    root = work_path(docs.sparkSession, "shards")
    return read_shards(write_shards(docs, root, path, end_id, id_col, text_col), root, id_col, _kind(docs, id_col))


def lookup(root: str, manifest: DataFrame, doc_ids: DataFrame, id_col: str = "doc_id", group: int = 32) -> DataFrame:
    """Ids of single documents without reading whole shards: a row (id_col, ids) for each wanted id that a shard has.

    About one in `group` shards, picked by a hash, is a border; borders alone go to the tasks, which tell by them which run
    of shards an id or a shard belongs to. Both meet in a join, and an id goes on to the shards whose range holds it. Of rows
    that repeat an id the first is found.
    """
    kind = _kind(doc_ids, id_col)
    found = f"id {kind}, ids array<long>, first_key binary"
    wanted = doc_ids.select(F.col(id_col).cast(kind).alias("id")).distinct()
    borders = sorted(bytes(r["first_key"]) for r in manifest.where(F.pmod(F.xxhash64("shard"), F.lit(group)) == 0).select("first_key").toLocalIterator())
    sent = manifest.sparkSession.sparkContext.broadcast(borders)
    after = b"\xff" * _SUFFIX.size

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [id_bytes(x) for x in batch.column(0).to_pylist()]
            # rows of an id may begin in the run before the border that their keys follow
            runs = [sorted({bisect.bisect_left(sent.value, p), bisect.bisect_right(sent.value, p + after)}) for p in parts]
            every = [k for r in runs for k in range(r[0], r[-1] + 1)]
            of = pa.array([i for i, r in enumerate(runs) for _ in range(r[0], r[-1] + 1)], pa.int64())
            yield pa.record_batch([batch.column(0).take(of), pa.array(parts, pa.binary()).take(of), pa.array(every, pa.int64())], ["id", "part", "run"])

    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, last = (batch.column(c).to_pylist() for c in (1, 2))
            runs = [bisect.bisect_right(sent.value, k) for k in first]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([id_part(k) for k in first], pa.binary()), pa.array([id_part(k) for k in last], pa.binary()), pa.array(runs, pa.int64())], ["shard", "first_key", "low", "high", "run"])

    ids = wanted.mapInArrow(keyed, f"id {kind}, part binary, run long")
    shards = manifest.select("shard", "first_key", "last_key").mapInArrow(grouped, "shard string, first_key binary, low binary, high binary, run long")
    asked = ids.join(shards, "run").where((F.col("part") >= F.col("low")) & (F.col("part") <= F.col("high"))).select("shard", "first_key", "id", "part")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(root)
        name, reader = None, None
        for batch in batches:
            out: list[tuple] = []
            for shard, first, doc, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if shard != name:
                    name, reader = shard, ShardReader(store.open_input_file(f"{folder}/{shard}"))
                if (value := reader.get(part)) is not None:
                    out.append((doc, np.frombuffer(value, "<u4" if value[0] else "<u2", offset=1).tolist(), first))
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (_arrow(kind), pa.list_(pa.int64()), pa.binary()), strict=True)], ["id", "ids", "first_key"])

    rows = asked.repartition("shard").sortWithinPartitions("shard", "part").mapInArrow(read, found)
    return rows.groupBy("id").agg(F.min_by("ids", "first_key").alias("ids")).withColumnRenamed("id", id_col)
