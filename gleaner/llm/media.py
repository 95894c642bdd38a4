"""Payloads as chunks cut by their content.

A rolling gear hash cuts payloads where their bytes say so, so equal passages give equal chunks wherever they stand. Tasks
append chunks to pack files in the shared folder; Spark groups and joins digests, never contents, so that each digest has
one place in all recipes; payloads are put together again from their ordered chunk lists and verified.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.llm import textscan
from gleaner.llm.shared import work_path, written

UNIT = 192
BLOCK_BYTES = 4 << 20
#: Chunk sizes: no cut before the least, one at 2^-11 of places after, always one at the most.
LEAST, BITS, MOST = 512, 11, 16_384
PACK_BYTES = 32 << 20
MAGIC = b"GLMEDIA1"


@functools.cache
def _gear() -> np.ndarray:
    return np.random.default_rng(192).integers(0, 1 << 32, 256, np.uint32, endpoint=False)


def cut_places(data: np.ndarray) -> np.ndarray:
    """Where the gear hash of the last 32 bytes (shifted by one for each) has BITS zero bits on top: ends of chunks.

    The window is shorter than the least chunk, so that a cut depends only on bytes of its own chunk.
    """
    h = _gear()[data]
    for k in (1, 2, 4, 8, 16):
        wider = h.copy()
        wider[k:] += h[:-k] << np.uint32(k)
        h = wider
    return np.flatnonzero(h >> np.uint32(32 - BITS) == 0) + 1


def chunk_edges(places: np.ndarray, start: int, stop: int) -> list[int]:
    """Edges of the chunks of bytes start to stop, from sorted places of cuts."""
    edges = [start]
    while stop - edges[-1] > LEAST:
        low = edges[-1] + LEAST
        k = int(np.searchsorted(places, low, "left"))
        end = int(places[k]) if k < len(places) else stop
        edges.append(min(end, edges[-1] + MOST, stop))
    if edges[-1] < stop:
        edges.append(stop)
    return edges


def payload(text: bytes, unit: int = UNIT) -> bytes:
    """The bytes, with spaces up to a positive multiple of `unit`."""
    return text.ljust(max(unit, -(-len(text) // unit) * unit))


@functools.cache
def filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    store, path = pafs.FileSystem.from_uri(root)
    store.create_dir(path, recursive=True)
    return store, path


#: A row per chunk. `part` is the task that wrote the pack; a document's first chunk has its recipe; ids are of the table's type.
CHUNK_ROW = "part int, home string, doc_no long, id {kind}, ord int, digest binary, offset long, stored int, recipe binary"
_HEAD, _PART = struct.Struct("<QQI"), struct.Struct("<32sII")


def recipe_of(n_bytes: int, size: int, parts: list[tuple[bytes, int, int]]) -> bytes:
    """A document's recipe: header, and for each chunk in order its digest, its size and the size of its stored bytes."""
    return MAGIC + _HEAD.pack(n_bytes, size, len(parts)) + b"".join(_PART.pack(*p) for p in parts)


def read_recipe(recipe: bytes) -> tuple[int, int, list[tuple[bytes, int, int]]]:
    """What `recipe_of` was given."""
    if recipe[: len(MAGIC)] != MAGIC:
        raise ValueError("not a recipe")
    n_bytes, size, n = _HEAD.unpack_from(recipe, len(MAGIC))
    return n_bytes, size, [_PART.unpack_from(recipe, len(MAGIC) + _HEAD.size + k * _PART.size) for k in range(n)]


def write_packs(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Appends chunks to packs below `root`; returns a written table with a row per chunk of each document (CHUNK_ROW).

    Within a pack a digest is stored once. A task's tries write packs of new names, and only those of the finished try are
    in the table. Stored bytes depend on a chunk's bytes alone, so a recipe holds for whichever copy is read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, folder = filesystem(root)
        part_no = TaskContext.get().partitionId()
        squeeze = zstandard.ZstdCompressor(level=3)
        home, sink, at, known, doc_no = "", None, 0, {}, 0
        for batch in batches:
            ids = batch.column(0)
            data, offsets = textscan.utf8(batch.column(1))
            for i, j in textscan.blocks(offsets, BLOCK_BYTES):
                raw = data[offsets[i] : offsets[j]].tobytes()
                own = [payload(raw[offsets[k] - offsets[i] : offsets[k + 1] - offsets[i]]) for k in range(i, j)]
                whole = b"".join(own)
                places = cut_places(np.frombuffer(whole, np.uint8))
                rows: list[tuple] = []
                begin = 0
                for k, body in zip(range(i, j), own, strict=True):
                    if sink is None or at > PACK_BYTES:
                        if sink is not None:
                            sink.close()
                        home, at, known, doc_no = f"{uuid.uuid4().hex}.pack", 0, {}, 0
                        sink = store.open_output_stream(f"{folder}/{home}")
                    edges = chunk_edges(places, begin, begin + len(body))
                    parts: list[tuple[bytes, int, int]] = []
                    spots: list[int] = []
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        chunk = whole[a:b]
                        digest = hashlib.sha256(chunk).digest()
                        place = known.get(digest)
                        if place is None:
                            packed = squeeze.compress(chunk)
                            packed = packed if len(packed) < len(chunk) else chunk
                            sink.write(packed)
                            place = known[digest] = (at, len(packed))
                            at += len(packed)
                        parts.append((digest, b - a, place[1]))
                        spots.append(place[0])
                    recipe = recipe_of(int(offsets[k + 1] - offsets[k]), len(body), parts)
                    rows += [(part_no, home, doc_no, k, n, p[0], spot, p[2], None if n else recipe) for n, (p, spot) in enumerate(zip(parts, spots, strict=True))]
                    begin += len(body)
                    doc_no += 1
                columns = list(zip(*rows, strict=True))
                types = [pa.int32(), pa.string(), pa.int64(), None, pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.binary()]
                arrays = [ids.take(pa.array(c, pa.int64())) if t is None else pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                yield pa.record_batch(arrays, [c.split()[0] for c in CHUNK_ROW.split(", ")])
        if sink is not None:
            sink.close()

    chunks, row = f"{root}/chunks", CHUNK_ROW.format(kind=dict(docs.dtypes)[id_col])
    docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, row).write.parquet(chunks)
    return docs.sparkSession.read.schema(row).parquet(chunks)


def placed(chunks: DataFrame) -> DataFrame:
    """Rows of `chunks` with `pack` and `at`, the one place of their digest: of all its places the least by a hash of digest and pack.

    So shared chunks are read from all packs alike. A digest that a third of all documents share is summed up before it is
    shuffled, and its rows meet one row in a join that Spark can split.
    """
    spread = F.xxhash64("digest", "home")
    # written, so that the join below has nothing but its own exchanges and a hot digest's rows can be split
    places = written(chunks.groupBy("digest").agg(F.min(F.struct(spread.alias("h"), "home", "offset")).alias("place")), "places")
    places = places.select("digest", F.col("place.home").alias("pack"), F.col("place.offset").alias("at"))
    return chunks.select("part", "home", "doc_no", "id", "ord", "digest", "stored", "recipe").join(places, "digest")


class PackReader:
    """Stored chunks by pack and place: the home pack is held whole (PACK_BYTES and a document at most), others are read in parts."""

    def __init__(self, root: str, remember: int = 512) -> None:
        self.store, self.folder = filesystem(root)
        self.home, self.held = "", b""
        self.recent: OrderedDict[tuple[str, int], bytes] = OrderedDict()
        self.files: OrderedDict[str, object] = OrderedDict()
        self.remember = remember

    def at_home(self, home: str) -> None:
        if home != self.home:
            with self.store.open_input_file(f"{self.folder}/{home}") as f:
                self.home, self.held = home, f.read()

    def read(self, pack: str, offset: int, stored: int) -> bytes:
        if pack == self.home:
            return self.held[offset : offset + stored]
        key = (pack, offset)
        if key not in self.recent:
            if pack not in self.files:
                self.files[pack] = self.store.open_input_file(f"{self.folder}/{pack}")
                if len(self.files) > 32:
                    self.files.popitem(last=False)[1].close()
            self.recent[key] = self.files[pack].read_at(stored, offset)
            if len(self.recent) > self.remember:
                self.recent.popitem(last=False)
        self.recent.move_to_end(key)
        return self.recent[key]


def sample_features(body: bytes, unit: int = UNIT) -> str:
    """Units, mean, variance and entropy of 8-bit samples (in thousandths), distinct values."""
    count = np.bincount(np.frombuffer(body, np.uint8), minlength=256)
    share = count[count > 0] / len(body)
    values = np.arange(256)
    mean = float(count @ values) / len(body)
    var = float(count @ (values - mean) ** 2) / len(body)
    return f"{len(body) // unit}:{mean * 1000:.0f}:{var * 1000:.0f}:{-(share * np.log2(share)).sum() * 1000:.0f}:{len(share)}"


def rebuilt(chunks: DataFrame, root: str, id_col: str = "doc_id") -> DataFrame:
    """Reads payloads back by their recipes and places; a chunk whose digest or size differs fails the job.

    Per document: id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, n_chunks.
    The stored form of a document is its recipe, as written, and the stored bytes of its chunks in order. A task reads the
    packs that one task wrote, so tasks are as even as those that wrote.
    """
    top = chunks.agg(F.max("part").alias("n")).first()["n"]
    rows = placed(chunks).repartitionById(1 + (top or 0), F.col("part")).sortWithinPartitions("home", "doc_no", "ord")

    def document(packs: PackReader, unpack: zstandard.ZstdDecompressor, doc: int | None, stored_recipe: bytes, places: list[tuple[str, int]]) -> tuple:
        import zlib

        n_bytes, size, parts = read_recipe(stored_recipe)
        form, length, body = hashlib.sha256(stored_recipe), len(stored_recipe), []
        for (digest, n, stored), (pack, at) in zip(parts, places, strict=True):
            raw = packs.read(pack, at, stored)
            chunk = unpack.decompress(raw) if stored < n else raw
            if len(chunk) != n or hashlib.sha256(chunk).digest() != digest:
                raise ValueError(f"chunk at {at} of {pack} is not what was stored")
            body.append(chunk)
            form.update(raw)
            length += len(raw)
        whole = b"".join(body)
        if len(whole) != size:
            raise ValueError("a payload's chunks do not add up")
        return (doc, n_bytes, size, hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-16:]), length, form.hexdigest(), sample_features(whole), len(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs, unpack = PackReader(root), zstandard.ZstdDecompressor()
        doc, recipe, places, out = None, None, [], []
        kind = pa.null()
        for batch in batches:
            kind = batch.column(1).type
            for home, ident, ord_, own, pack, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not ord_:  # a document's first chunk
                    if recipe is not None:
                        out.append(document(packs, unpack, doc, recipe, places))
                    packs.at_home(home)
                    doc, recipe, places = ident, own, []
                places.append((pack, at))
            yield _results(out, id_col, kind)
            out = []
        if recipe is not None:
            yield _results([document(packs, unpack, doc, recipe, places)], id_col, kind)

    columns = rows.select("home", "id", "ord", "recipe", "pack", "at")
    return columns.mapInArrow(run, f"{id_col} {dict(chunks.dtypes)['id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_chunks int")


def _results(rows: list[tuple], id_col: str, kind: pa.DataType) -> pa.RecordBatch:
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_chunks"]
    types = [kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32()]
    columns = list(zip(*rows, strict=True)) or [()] * len(types)
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def stored_and_read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`rebuilt` of all rows of `docs`, through packs and recipes in the shared folder.

    Ids may be of any type. Null and empty texts are one unit of spaces, with n_bytes 0. Null ids and repeated rows are each stored and read; equal
    texts have equal values. An empty table gives an empty result. Other columns are not read.
    """
    root = work_path(docs.sparkSession, "media")
    return rebuilt(write_packs(docs, root, id_col, text_col), root, id_col)


def unreferenced(chunks: DataFrame) -> DataFrame:
    """One row: stored bytes of all packs, and those of copies that no recipe reads (a digest that several packs hold)."""
    own = chunks.select("home", "digest", "stored").distinct().groupBy("digest").agg(F.max("stored").alias("stored"), F.count("*").alias("n"))
    return own.agg(F.sum(F.col("stored") * F.col("n")).alias("stored"), F.sum(F.col("stored") * (F.col("n") - 1)).alias("unreferenced"))
