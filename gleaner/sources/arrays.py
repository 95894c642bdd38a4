"""Files of one JSON array each, read by byte ranges.

Spark cuts a file at any closing brace. Whether a range begins within a string or a record is known only from all before it, so
a first pass returns, for each range, how it changes that: the parity of its quotes, and the depth it adds if it begins outside
or inside a string. Sums of these tell every range its beginning; a second pass cuts records out, and those that go over a
border are put together from their parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CUT = b"}"
#: Bytes of a range that a task holds at a time, about: at least a record.
PIECE = 1 << 20


def marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of quotes that no backslash escapes, and per byte +1 for an opening bracket or brace and -1 for a closing one."""
    escaped = np.zeros(len(data), bool)
    slash = np.flatnonzero(data == 0x5C)
    if len(slash):
        first = np.flatnonzero(np.diff(slash, prepend=-2) > 1)  # of each run of backslashes
        place = np.arange(len(slash)) - np.repeat(first, np.diff(np.append(first, len(slash))))
        after = slash[place % 2 == 0] + 1
        escaped[after[after < len(data)]] = True
    step = ((data == 0x7B) | (data == 0x5B)).astype(np.int8) - ((data == 0x7D) | (data == 0x5D)).astype(np.int8)
    return np.flatnonzero((data == 0x22) & ~escaped), step


def inside(size: int, quotes: np.ndarray, begins_inside: bool) -> np.ndarray:
    """Which bytes are within a string, its opening quote included."""
    turn = np.zeros(size, bool)
    turn[quotes] = True
    return np.logical_xor.accumulate(turn) ^ begins_inside if size else turn


def records(data: np.ndarray, begins_inside: bool, depth: int) -> tuple[list[tuple[int, int]], tuple[int, int] | None, tuple[int, int] | None]:
    """Whole elements (start, end) of a piece, the part of one that began before it, and that of one that goes on after it.

    Elements are objects or lists; what is neither is left out.
    """
    quotes, step = marks(data)
    step[inside(len(data), quotes, begins_inside)] = 0
    return _cut(step, depth)


def _cut(step: np.ndarray, depth: int) -> tuple[list[tuple[int, int]], tuple[int, int] | None, tuple[int, int] | None]:
    at = np.flatnonzero(step)
    turn = step[at]
    level = depth + np.cumsum(turn, dtype=np.int64)
    starts, ends = at[(turn > 0) & (level == 2)], at[(turn < 0) & (level == 1)] + 1
    head = None
    if depth >= 2:
        head = (0, int(ends[0]) if len(ends) else len(step))
        ends = ends[1:]
    tail = (int(starts[-1]), len(step)) if len(starts) > len(ends) else None
    return list(zip(starts[: len(ends)].tolist(), ends.tolist(), strict=True)), head, tail


Range = tuple[str, int]


def _pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Range, bytes | None]]:
    """The ranges that a task reads, in pieces of about PIECE bytes that end after a closing brace, and None at the end of each.

    Rows (value, file, start) come range by range.
    """
    at, held, size = None, [], 0
    for batch in batches:
        for value, file, start in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if (file, start) != at or size >= PIECE:
                if held:
                    yield at, b"".join(held)
                    held, size = [], 0
                if (file, start) != at:
                    if at is not None:
                        yield at, None
                    at = (file, start)
            held += [value.as_buffer().to_pybytes(), CUT]
            size += len(held[-2]) + 1
    if at is not None:
        yield at, b"".join(held)
        yield at, None


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    odd, depths = 0, [0, 0]
    for (file, start), raw in _pieces_of(batches):
        if raw is None:
            yield pa.record_batch([pa.array([file]), pa.array([start]), pa.array([odd]), *(pa.array([d]) for d in depths)], ["file", "start", "odd", "outside", "inside"])
            odd, depths = 0, [0, 0]
            continue
        data = np.frombuffer(raw, np.uint8)
        quotes, step = marks(data)
        in_ = inside(len(data), quotes, bool(odd))  # of a range that begins outside a string; the other way round in one that begins inside
        depths = [d + int(step[x].sum(dtype=np.int64)) for d, x in zip(depths, (~in_, in_), strict=True)]
        odd = (odd + len(quotes)) % 2


def _elements(begins: dict[Range, tuple[bool, int]]):
    """Objects (part null) and parts of elements that go over the borders of a range: 0 of one that began before, 1 of one that begins in it."""
    names = ["file", "start", "part", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_, part, within, depth = None, [], 0, False, 0
        for at, raw in _pieces_of(batches):
            if at != now:
                now, open_, part = at, [], 0
                within, depth = begins.get(at, (False, 0))
            out: list[tuple[int | None, bytes]] = []
            if raw is None:
                out += [(part, b"".join(open_))] if open_ else []
                now = None
            else:
                data = np.frombuffer(raw, np.uint8)
                quotes, step = marks(data)
                step[inside(len(data), quotes, within)] = 0
                found, head, tail = _cut(step, depth)
                if head:
                    open_.append(raw[: head[1]])
                within, depth = within ^ bool(len(quotes) % 2), depth + int(step.sum(dtype=np.int64))
                if head and (found or tail or depth < 2):  # it ends here
                    whole = b"".join(open_)
                    if part == 0 or whole[:1] == b"{":
                        out.append((None if part else 0, whole))
                    open_, part = [], 1
                out += [(None, raw[a:b]) for a, b in found if raw[a] == 0x7B]
                if tail:
                    open_, part = [raw[tail[0] :]], 1
            if out:
                yield pa.record_batch([pa.array([at[0]] * len(out)), pa.array([at[1]] * len(out)), pa.array([p for p, _ in out], pa.int32()), pa.array([v for _, v in out], pa.binary())], names)

    return run


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(value): the text of every object in the arrays of the files, each read by as many tasks as Spark makes ranges of it.

    Elements that are no objects are left out. The driver and the tasks hold a few numbers for each range.
    """
    cut = spark.read.option("lineSep", CUT.decode()).text(path)
    rows = cut.select(F.col("value").cast("binary").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    changes = rows.mapInArrow(_changes, "file string, start long, odd long, outside long, inside long")
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a file
    begins = changes.withColumn("within", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1)
    begins = begins.withColumn("adds", F.when(F.col("within"), F.col("inside")).otherwise(F.col("outside")))
    begins = begins.withColumn("depth", F.coalesce(F.sum("adds").over(before), F.lit(0)))
    known = {(r["file"], r["start"]): (r["within"], r["depth"]) for r in begins.select("file", "start", "within", "depth").collect()}

    pieces = rows.mapInArrow(_elements(known), "file string, start long, part int, value binary")
    # parts follow the tail that begins their record
    turn = Window.partitionBy("file").orderBy("start", "part")
    parts = pieces.where("part IS NOT NULL").withColumn("record", F.sum("part").over(turn))
    whole = F.array_sort(F.collect_list(F.struct("start", F.col("value").cast("string").alias("value"))))
    joined = parts.groupBy("file", "record").agg(F.array_join(F.transform(whole, lambda p: p["value"]), "").alias("value"))
    joined = joined.where(F.col("value").startswith("{"))  # lists go
    return pieces.where("part IS NULL").select(F.col("value").cast("string").alias("value")).unionByName(joined.select("value"))


def read_arrays(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of files that hold one JSON array each, of any size."""
    kind = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    return texts(spark, path).select(F.from_json("value", kind).alias("r")).select("r.*")
