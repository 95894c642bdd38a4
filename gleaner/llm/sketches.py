"""Document fingerprints as threshold-scaled sketches, which can be merged and tell how much of one text another holds.

A text's sketch keeps every hash of its word shingles below a fixed fraction of all hashes. Whether a hash is kept depends
on the hash alone, so sketches of texts of very unequal length can be compared, and the sketch of several texts together is
that of their sketches. A text with few such hashes keeps its least ones instead, up to a number, and its sketch is known to
be whole, or complete up to its last hash: two sketches are compared below the bound to which both are complete.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import textscan
from gleaner.llm.shared import written

SEED = 42
#: Words of a shingle; the fraction of hashes that are kept is one in SCALED; how many a text keeps at least, if it has them.
SHINGLE, SCALED, LEAST = 5, 16, 32
#: Bytes of text whose shingles are hashed at a time.
BLOCK_BYTES = 2 << 20
#: Characters of text, about, that are edited and compared at a time.
EDIT_CHARS = 4 << 20
_TOP = (1 << 64) - 1

#: Hashes in ascending order, and whether they are all that the text has.
Sketch = tuple[np.ndarray, bool]


def limit(scaled: int = SCALED) -> int:
    """The greatest hash that is kept whatever else a text has."""
    return _TOP // scaled


def reduced(hashes: np.ndarray, owner: np.ndarray, n: int, scaled: int = SCALED, least: int = LEAST) -> list[Sketch]:
    """The sketches of `n` texts from the hashes of their shingles, in any order and with repeats."""
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    once = np.ones(len(hashes), bool)
    once[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    hashes, owner = hashes[once], owner[once]
    edge = np.searchsorted(owner, np.arange(n + 1))
    keep = (hashes <= np.uint64(limit(scaled))) | (np.arange(len(hashes)) - edge[owner] < least)
    kept_edge = np.concatenate([[0], np.cumsum(keep)])[edge]
    hashes = hashes[keep]
    return [(hashes[a:b], bool(b - a == d - c)) for a, b, c, d in zip(kept_edge[:-1].tolist(), kept_edge[1:].tolist(), edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def sketches(column: pa.Array, shingle: int = SHINGLE, scaled: int = SCALED, least: int = LEAST) -> Iterator[Sketch]:
    """The sketch of each text in order. Words are told by white space, in lower case (A-Z); a text of fewer words is one shingle."""
    data, offsets = textscan.utf8(column)
    for i, j in textscan.blocks(offsets, BLOCK_BYTES):
        own, at = textscan.lower(data[offsets[i] : offsets[j]]), offsets[i : j + 1] - offsets[i]
        starts, ends, docs = textscan.words(own, at)
        if not len(starts):
            yield from [(np.empty(0, np.uint64), True)] * (j - i)
            continue
        text, begin = textscan.joined(own, starts, ends)
        stop = begin + (ends - starts)
        n = np.diff(docs)
        count = np.where(n >= shingle, n - shingle + 1, np.minimum(n, 1))
        edge = np.concatenate([[0], np.cumsum(count)])
        first = np.arange(edge[-1]) + np.repeat(docs[:-1] - edge[:-1], count)
        last = np.minimum(first + shingle, np.repeat(docs[1:], count)) - 1
        hashes = textscan.xxh64(text, begin[first], stop[last] - begin[first], SEED)
        yield from reduced(hashes, np.repeat(np.arange(j - i), count), j - i, scaled, least)


def bound(sketch: Sketch, scaled: int = SCALED) -> int:
    """Up to which hash a sketch has all that its text has."""
    hashes, whole = sketch
    return _TOP if whole else max(limit(scaled), int(hashes[-1]))


def merged(sketches_: list[Sketch], scaled: int = SCALED, least: int = LEAST) -> Sketch:
    """The sketch of several texts' shingles together, from their sketches alone."""
    to = min([bound(s, scaled) for s in sketches_], default=_TOP)
    hashes = np.unique(np.concatenate([np.empty(0, np.uint64), *(s[0] for s in sketches_)]))
    hashes = hashes[hashes <= np.uint64(to)]
    keep = max(least, int(np.searchsorted(hashes, np.uint64(limit(scaled)), "right")))
    return hashes[:keep], all(s[1] for s in sketches_) and keep >= len(hashes)


def containment(a: Sketch, b: Sketch, scaled: int = SCALED) -> float:
    """The share of a's shingles that b has, by the hashes up to which both are complete.

    Without any there (an empty text, or a short one beside a long one) it is 1 if both sketches are equal, else 0.
    """
    to = np.uint64(min(bound(a, scaled), bound(b, scaled)))
    own = a[0][: np.searchsorted(a[0], to, "right")]
    if not len(own):
        return float(a[1] == b[1] and np.array_equal(a[0], b[0]))
    return len(np.intersect1d(own, b[0], assume_unique=True)) / len(own)


def _bytes(sketch: Sketch) -> bytes:
    return sketch[0].astype(">u8").tobytes()


def written_form(sketch: Sketch) -> str:
    """`all:` or `part:` and the hashes in ascending order, sixteen lower-case hex digits each."""
    return ("all:" if sketch[1] else "part:") + _bytes(sketch).hex()


def _form(whole: str, hashes: str) -> Column:
    """`written_form` of stored columns."""
    return F.concat(F.when(F.col(whole), "all:").otherwise("part:"), F.lower(F.hex(hashes)))


def read_form(text: str) -> Sketch:
    """What `written_form` was given."""
    kind, _, digits = text.partition(":")
    return np.frombuffer(bytes.fromhex(digits), ">u8").astype(np.uint64), kind == "all"


def group_hashes(docs: DataFrame, key: str, text_col: str = "text", shingle: int = SHINGLE, scaled: int = SCALED) -> DataFrame:
    """(key, hash) without repeats: the merged sketches of each key's texts (hashes below the fraction alone).

    A key's sketch grows with its texts, so it is rows and not one value; a hot key's rows are summed up in their tasks first.
    Null keys are a key of their own; null and empty texts add nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s[0] for s in sketches(batch.column(1), shingle, scaled, 0)]
            rows = np.repeat(np.arange(len(found)), [len(h) for h in found])
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["key", "hash"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text_col).alias("text")).mapInArrow(run, f"key {kind}, hash long").distinct()


def group_containment(left: DataFrame, right: DataFrame) -> DataFrame:
    """(a, b, shared, size, containment) of merged sketches (key, hash): the share of a's shingles that b has, where it has any.

    Hashes meet in a join and are counted; the pairs of one hash are those of the keys that have it.
    """
    sizes = left.groupBy(F.col("key").alias("a")).agg(F.count("*").alias("size"))
    met = left.select(F.col("key").alias("a"), "hash").join(right.select(F.col("key").alias("b"), "hash"), "hash").groupBy("a", "b").agg(F.count("*").alias("shared"))
    sized = met.join(sizes.withColumnRenamed("a", "_a"), F.col("a").eqNullSafe(F.col("_a")))
    return sized.select("a", "b", "shared", "size", (F.col("shared") / F.col("size")).alias("containment"))


def edited(text: str, following: str) -> str:
    """The text with its last half (in code points, rounded down) replaced by the first as many, or all, of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: A row of `compared` is a document's result, the text that a task met first, or the last one, whose next another task has.
RESULT, HEAD, OPEN = 0, 1, 2
_FIELDS = "role int, part int, doc_id {kind}, n_chars long, edited_sha256 string, whole boolean, own binary, edited_whole boolean, edited binary, near_edited double, near_next double, packed binary"
_NAMES = [x.split()[0] for x in _FIELDS.split(", ")]
_TYPES = [pa.int32(), pa.int32(), None, pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.bool_(), pa.binary(), pa.float64(), pa.float64(), pa.binary()]


def _batch(ids: pa.Array, columns: list[list]) -> pa.RecordBatch:
    arrays = [ids if t is None else pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)]
    return pa.record_batch(arrays, _NAMES)


def _results(part: int, ids: pa.Array, texts: list[str], nexts: list[str], own: list[Sketch], following: list[Sketch], how: dict) -> pa.RecordBatch:
    new = [edited(a, b) for a, b in zip(texts, nexts, strict=True)]
    other = list(sketches(pa.array(new, pa.large_string()), **how))
    scaled = how["scaled"]
    n = len(texts)
    return _batch(
        ids,
        [
            [RESULT] * n,
            [part] * n,
            [],
            [len(t) for t in texts],
            [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
            [s[1] for s in own],
            [_bytes(s) for s in own],
            [s[1] for s in other],
            [_bytes(s) for s in other],
            [containment(a, b, scaled) for a, b in zip(own, other, strict=True)],
            [containment(a, b, scaled) for a, b in zip(own, following, strict=True)],
            [None] * n,
        ],
    )


def _edge(role: int, part: int, ids: pa.Array, text: bytes) -> pa.RecordBatch:
    return _batch(ids, [[role], [part], [], *[[None]] * (len(_TYPES) - 4), [text]])


def _squeezed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, h, packed): texts compressed before they are shuffled, and a hash of each that orders rows of equal ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([squeeze.compress(t.as_buffer()) for t in batch.column(2)], pa.binary())], ["id", "h", "packed"])

    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(docs.dtypes)[id_col]
    return given.select("id", F.xxhash64("text").alias("h"), F.col("text").cast("binary")).mapInArrow(run, f"id {kind}, h long, packed binary")


def compared(docs: DataFrame, shingle: int = SHINGLE, scaled: int = SCALED, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The next document is that with the next smaller id, after the last the first; a single document is its own next. The
    edited text is the document with its last half replaced by the beginning of the next one. Likeness is `containment` of a
    document's sketch in that of its edited text, and in that of the next document.

    Null text is an empty one; empty texts are like each other (1) and like no other (0). Rows without an id come last; rows
    that repeat an id follow each other by a hash of their texts, so equal texts among them are like their next. An empty
    table gives no rows. Columns other than the two are not read, whatever their names.

    Texts are compressed, dealt by sampled ranges of ids and met in order, one at a time, so that no task holds a range. The
    last text of a task and the first of the one after it are returned and meet in a second step, as many rows as tasks.
    """
    how = {"shingle": shingle, "scaled": scaled, "least": least}
    kind = dict(docs.dtypes)[id_col]
    schema = _FIELDS.format(kind=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, unpack, last = TaskContext.get().partitionId(), zstandard.ZstdDecompressor(), None
        for batch in batches:
            ids, packed = batch.column(0), batch.column(1)
            low = 0
            while low < len(ids):
                texts, high, held = [], low, 0
                while high < len(ids) and (high == low or held < EDIT_CHARS):
                    texts.append(unpack.decompress(packed[high].as_buffer()).decode("utf-8", "surrogatepass"))
                    held += len(texts[-1])
                    high += 1
                own = list(sketches(pa.array(texts, pa.large_string()), **how))
                if last is None:
                    yield _edge(HEAD, part, ids[low : low + 1], packed[low].as_py())
                else:
                    yield _results(part, last[0], [last[1]], texts[:1], [last[2]], own[:1], how)
                yield _results(part, ids[low : high - 1], texts[:-1], texts[1:], own[:-1], own[1:], how)
                last = (ids[high - 1 : high], texts[-1], own[-1], packed[high - 1].as_py())
                low = high
        if last is not None:
            yield _edge(OPEN, part, last[0], last[3])

    order: list[Column] = [F.col("id").desc_nulls_last(), F.col("h")]
    dealt = _squeezed(docs, id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = written(dealt.select("id", "packed").mapInArrow(run, schema), "compared")

    heads = rows.where(F.col("role") == HEAD).select("part")  # a row for each task
    turn = heads.withColumn("before", F.lag("part").over(Window.orderBy("part")))
    turn = turn.withColumn("before", F.coalesce("before", F.max("part").over(Window.partitionBy())))
    first = rows.where(F.col("role") == HEAD).select("part", F.col("packed").alias("following")).join(turn, "part").select(F.col("before").alias("part"), "following")
    ends = rows.where(F.col("role") == OPEN).select("doc_id", "part", "packed").join(first, "part")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                pair = [unpack.decompress(batch.column(c)[k].as_buffer()).decode("utf-8", "surrogatepass") for c in (2, 3)]
                two = list(sketches(pa.array(pair, pa.large_string()), **how))
                yield _results(batch.column(0)[k].as_py(), batch.column(1)[k : k + 1], pair[:1], pair[1:], two[:1], two[1:], how)

    closed = ends.select("part", "doc_id", "packed", "following").mapInArrow(close, schema)
    out = rows.where(F.col("role") == RESULT).unionByName(closed)
    forms = _form("whole", "own").alias("fingerprint"), _form("edited_whole", "edited").alias("edited_fingerprint")
    return out.select(F.col("doc_id").alias(id_col), "n_chars", "edited_sha256", *forms, "near_edited", "near_next")
