"""Vectors as tables: profiles, scores and neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import vectors as V
from gleaner.operators import cells
from gleaner.sources.tables import staged

#: Vectors of a block of queries and of a tile of rows, about: what one task holds of either side.
QUERIES, ROWS = 4096, 8192
#: Vectors of either side that are multiplied at a time.
LEFT, RIGHT = 256, 4096
#: Rows of either tile whose gains are taken at a time, partitions at most that tiles meet in, and the threshold up to which no
#: tile is ruled out.
BLOCK, MEETINGS, NONE = 512, 4096, 1e-9


def centroid(df: DataFrame, vector: str, normalize: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Element-wise mean per group, as `centroid`; divided by its norm where that is positive."""
    keys = keys or []
    means = df.select(*keys, F.posexplode(vector).alias("pos", "x")).groupBy(*keys, "pos").agg(F.avg("x").alias("m"))
    mean = F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"])
    out = means.groupBy(*keys).agg(mean.alias("centroid"))
    if not normalize:
        return out
    size = V.norm(F.col("centroid"))
    return out.withColumn("centroid", F.when(size > 0, V.scaled(F.col("centroid"), 1 / size)).otherwise(F.col("centroid")))


def score_to_reference(df: DataFrame, reference: DataFrame, vector: str) -> DataFrame:
    """Adds `similarity`: cosine to the one reference vector, from [-1, 1] to [0, 1]; a zero vector has 0.5."""
    one = F.broadcast(reference.select(F.col("centroid").alias("_c")))  # one row
    return df.join(one).withColumn("similarity", (V.cosine(F.col(vector), F.col("_c")) + 1) / 2).drop("_c")


def diversity(df: DataFrame, vector: str) -> DataFrame:
    """One row: n, the mean cosine over pairs of unit vectors, and diversity, 1 less that (1 for less than two rows).

    The mean over pairs is (|sum|^2 - n) / (n (n - 1)), so no pair is formed.
    """
    unit = df.select(F.posexplode(V.l2_normalized(F.col(vector))).alias("pos", "x"))
    sums = unit.groupBy("pos").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count("*").alias("n"))
    whole = sums.agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum("q").alias("qq"))
    n = F.col("n")
    mean = F.when(n > 1, (F.col("ss") - F.col("qq")) / (n * (n - 1))).otherwise(F.lit(0.0))
    return whole.select(F.coalesce(n, F.lit(0)).alias("n"), mean.alias("mean_similarity"), F.when(n > 1, 1 - mean).otherwise(F.lit(1.0)).alias("diversity"))


def _best(s: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The `k` greatest of each row of `s` and their ids, near ties (nine places) by id; only what reaches the k-th is put in order."""
    if s.shape[1] <= 2 * k:
        return s, np.broadcast_to(ids, s.shape)
    edge = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None] - 2e-9
    many = int((s >= edge).sum(axis=1).max())
    if many > s.shape[1] // 2:
        return s, np.broadcast_to(ids, s.shape)
    at = np.argpartition(s, s.shape[1] - many, axis=1)[:, s.shape[1] - many :]
    return np.take_along_axis(s, at, 1), ids[at]


def _met(queries: DataFrame, rows: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """(query_id, neighbour_id, similarity): for each query of a tile (`meet`) the `k` best of its rows, ties by id.

    A tile's queries are dealt into blocks of about QUERIES, and its rows are copied once for each of those.
    """
    many = queries.groupBy("meet").agg(F.ceil(F.count("*") / QUERIES).cast("long").alias("blocks"))
    q = queries.join(many, "meet").select("id", "v", "meet", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"))
    b = rows.withColumnRenamed("tile", "meet").join(many, "meet").select("id", "v", "meet", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, own = left["id"].to_numpy(), right["id"].to_numpy()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(ids) and len(own):
            q, m = (cells.matrix(x["v"].combine_chunks()) for x in (left, right))
            for low in range(0, len(ids), LEFT):
                some = ids[low : low + LEFT]
                kept_s, kept_i = np.empty((len(some), 0)), np.empty((len(some), 0), np.int64)
                for at in range(0, len(own), RIGHT):
                    s = q[low : low + LEFT] @ m[at : at + RIGHT].T
                    near = own[at : at + RIGHT]
                    if exclude_self:
                        s[some[:, None] == near[None, :]] = -np.inf
                    new_s, new_i = _best(s, near, k)
                    kept_s, kept_i = np.concatenate([kept_s, new_s], axis=1), np.concatenate([kept_i, new_i], axis=1)
                    order = np.lexsort((kept_i, -kept_s.round(9)), axis=1)[:, :k]
                    kept_s, kept_i = np.take_along_axis(kept_s, order, 1), np.take_along_axis(kept_i, order, 1)
                ok = np.isfinite(kept_s)
                out.append((np.repeat(some, ok.sum(axis=1)), kept_i[ok], kept_s[ok]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] or [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "neighbour_id", "similarity"])

    return q.groupBy("meet", "block").cogroup(b.groupBy("meet", "block")).applyInArrow(best, "query_id long, neighbour_id long, similarity double")


def knn(queries: DataFrame, base: DataFrame, k: int, key: str, vector: str, exclude_self: bool = False) -> DataFrame:
    """Per query (query_id): its k nearest rows of `base` by cosine, with rank; ties by key. Exact.

    Queries are a stated set. The rows of `base` are filed in tiles around centres. A query first meets the tile whose centre
    is nearest and has k rows; the worst of the k it finds bounds how far off its neighbours can be, and it goes on only to
    those tiles that may hold a nearer row. Rows with a null vector take no part.
    """
    rows, tiles = cells.tiled(base, key, vector, ROWS)
    order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "neighbour_id")
    if len(tiles.rows) < 2:
        found = _met(cells.units(queries, key, vector).withColumn("meet", F.lit(0).cast("long")), rows, k, exclude_self)
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    rows = staged(rows, "tiles")
    sent = rows.sparkSession.sparkContext.broadcast(tiles)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        enough = own.rows >= min(k + exclude_self, own.rows.max())
        for batch in batches:
            for low in range(0, batch.num_rows, cells.STEP):
                some = batch.slice(low, cells.STEP)
                near = np.where(enough, own.angles(cells.matrix(some.column(1))), np.inf)
                # of the tiles of one cell, which are as near, a query takes one by its id
                ties = near == near.min(axis=1, keepdims=True)
                turn = some.column(0).to_numpy() % ties.sum(axis=1)
                meet = (np.cumsum(ties, axis=1) == turn[:, None] + 1).argmax(axis=1)
                yield pa.record_batch([*some.columns, pa.array(meet)], ["id", "v", "meet"])

    asked = staged(cells.units(queries, key, vector).mapInArrow(first, "id long, v array<double>, meet long"), "asked")
    found = staged(_met(asked, rows, k, exclude_self), "found")
    worst = found.groupBy(F.col("query_id").alias("id")).agg(F.when(F.count("*") >= k, F.min("similarity")).alias("worst"))
    open_ = asked.withColumnRenamed("meet", "tile").join(worst, "id", "left").select("tile", "id", "v", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    more = staged(cells.reaching(open_, tiles, _nearer, pairs=False), "reach")
    found = found.unionByName(_met(more.select("id", "v", "meet"), rows, k, exclude_self))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearer(tiles: cells.Tiles, m: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
    """Tiles, but the query's own, that may hold a row at least as near as the worst it has; nine places count as equal."""
    worst = batch.column(3).to_numpy()
    far = np.where(worst < -1, np.inf, cells.angle(worst - 2e-9))
    out = tiles.ends(m)[0] <= far[:, None]
    out[np.arange(len(m)), batch.column(0).to_numpy()] = False
    return out


def _block_pairs(met: DataFrame, count: int, found, schema: str) -> DataFrame:
    """`found(ids, products, other ids, same tile)` of each two tiles that meet (tile, id, v, meet); each two meet in one task."""
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"long": pa.int64(), "double": pa.float64()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def pairs(key_, table):
        ids, tile = table["id"].to_numpy(), table["tile"].to_numpy()
        m = cells.matrix(table["v"].combine_chunks())
        low, high = divmod(key_[0].as_py(), count)
        left, right = np.flatnonzero(tile == low), np.flatnonzero(tile == high)
        mr, ir = (m, ids) if low == high else (m[right], ids[right])
        parts = [found(ids[left[at : at + LEFT]], m[left[at : at + LEFT]] @ mr.T, ir, low == high) for at in range(0, len(left), LEFT)] if len(right) else []
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] or [np.empty(0)] * len(names)
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return met.groupBy("meet").applyInArrow(pairs, schema)


def meetings(df: DataFrame, key: str, vector: str, threshold: float, size: int) -> tuple[DataFrame, int]:
    """(tile, id, v, meet): rows in tiles, once for each tile that may hold a row with a cosine of `threshold` or more; and the number of tiles."""
    rows, tiles = cells.tiled(df, key, vector, size)
    far = float(cells.angle(np.array(threshold - 1e-12))) if threshold <= 1 else -1.0
    return cells.reaching(rows, tiles, lambda own, m, _: own.ends(m)[0] <= far, pairs=True), len(tiles.rows)


def similar_pairs(df: DataFrame, key: str, vector: str, threshold: float, size: int = ROWS) -> DataFrame:
    """Pairs (id_a < id_b) with a cosine of `threshold` or more. Exact.

    Rows are filed in tiles of about `size` around centres, and a row is sent only to tiles that may hold one near enough. Two
    tiles meet in one task, and only pairs over the threshold leave it. Where vectors have no clusters all tiles meet. Rows
    with a null vector take no part.
    """

    def over(ids: np.ndarray, s: np.ndarray, others: np.ndarray, same: bool) -> tuple[np.ndarray, ...]:
        i, j = np.nonzero(s >= threshold)
        x, y = ids[i], others[j]
        ok = (x < y) if same else np.ones(len(x), bool)
        return np.minimum(x, y)[ok], np.maximum(x, y)[ok], s[i, j][ok]

    return _block_pairs(*meetings(df, key, vector, threshold, size), over, "id_a long, id_b long, similarity double")


def coverage_gains(rows: DataFrame, tiles: cells.Tiles, threshold: float, after: tuple[np.ndarray, np.ndarray] | None = None, exact: bool = False) -> DataFrame:
    """(id, g0, ...): what each row's similarities to all rows (tile, id, v, c), as far as they reach `threshold`, exceed the coverage c of these by.

    g1 and on are the same beside the first, the first two and so on of some rows (ids, vectors) that come to the coverage
    with `after`: similarities are taken once for all of them. The similarity to itself is 1; c is 0 or more, and `threshold`
    above 0. Tiles that may hold such rows meet once for both, each two in a partition of their own, and return sums. These
    are in single precision, and raised by all that it may be off by, so none is below what is meant; or `exact`, in double.
    """
    count = len(tiles.rows)
    kind = np.float64 if exact else np.float32
    sent = rows.sparkSession.sparkContext.broadcast(after)  # a few rows

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, c, ids = cells.matrix(batch.column(2)), batch.column(3).to_numpy(), batch.column(1).to_numpy()
            own = [*v.T, c]
            for x, u in zip(*sent.value, strict=True) if sent.value and len(ids) else ():
                s = v @ u
                s[ids == x] = 1.0
                own.append(np.maximum(own[-1], np.where(s >= threshold, s, 0.0)))
            body = np.stack(own, axis=1).astype(kind)
            yield pa.record_batch([*batch.columns[:2], pa.array([x.tobytes() for x in body], pa.binary()), *batch.columns[4:]], ["tile", "id", "body", *batch.schema.names[4:]])

    if threshold <= NONE:  # half of all rows are as near, so all tiles meet
        every = F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))
        meet = F.explode(F.transform(every, lambda o: F.least("tile", o) * count + F.greatest("tile", o)))
        met = rows.select("tile", "id", "v", "c").mapInArrow(packed, "tile long, id long, body binary").withColumn("meet", meet)
    else:
        far = float(cells.angle(np.array(threshold - 1e-12))) if threshold <= 1 else -1.0
        met = cells.reaching(rows.select("tile", "id", "v", "c"), tiles, lambda own, m, _: own.ends(m)[0] <= far, pairs=True)
        met = met.mapInArrow(packed, "tile long, id long, body binary, meet long")
    covers = 1 + len(after[0]) if after else 1
    names = [f"g{k}" for k in range(covers)]

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for meet, table in _whole(batches, "meet"):
            ids, sums = _exceeding(table, *divmod(meet, count), covers, kind, threshold)
            yield pa.record_batch([pa.array(ids), *(pa.array(s) for s in sums)], ["id", *names])

    # each two tiles have a number without gaps, and so a partition that no others share, up to MEETINGS of them
    low, high = F.floor(F.col("meet") / count), F.col("meet") % count
    parts = max(1, min(count * (count + 1) // 2, MEETINGS))
    dealt = met.repartitionById(parts, ((F.floor(high * (high + 1) / 2) + low) % parts).cast("int")).sortWithinPartitions("meet")
    found = dealt.mapInArrow(gains, "id long, " + ", ".join(f"{g} double" for g in names))
    return found.groupBy("id").agg(*[F.sum(g).alias(g) for g in names])


def _whole(batches: Iterator[pa.RecordBatch], group: str) -> Iterator[tuple[int, pa.Table]]:
    """The groups of sorted batches, one after the other."""
    held, now = [], None
    for batch in batches:
        g = batch.column(group).to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]])) if len(g) else []
        for low, high in zip(starts, [*starts[1:], len(g)], strict=True):
            if held and g[low] != now:
                yield now, pa.Table.from_batches(held)
                held = []
            now = int(g[low])
            held.append(batch.slice(low, high - low))
    if held:
        yield now, pa.Table.from_batches(held)


def _exceeding(table: pa.Table, low: int, high: int, covers: int, kind: type, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the rows of two tiles, and under each coverage what the similarities to the rows of the other tile exceed it by."""
    first = np.argsort(table["tile"].to_numpy() != low, kind="stable")
    ids, body = table["id"].to_numpy()[first], np.frombuffer(b"".join(table["body"].to_pylist()), kind).reshape(len(first), -1)[first]
    n, width, same = len(ids), body.shape[1] - covers, low == high
    m, cover = np.ascontiguousarray(body[:, :width]), np.ascontiguousarray(body[:, width:].T)
    left = n if same else int((table["tile"].to_numpy() == low).sum())
    # products of unit rows in single precision, and coverages, are off by so much at most
    unit = float(np.finfo(np.float32).eps) / 2
    off = (width + 8) * unit if kind == np.float32 else 0.0
    least = threshold - off
    sums, held, ones = np.zeros((covers, n)), np.empty(BLOCK * BLOCK, kind), np.ones(BLOCK, kind)
    for i in range(0, left, BLOCK):
        a = slice(i, min(i + BLOCK, left))
        for j in range(i if same else left, n, BLOCK):
            b = slice(j, min(j + BLOCK, n))
            s = m[a] @ m[b].T
            if same:
                s[ids[a][:, None] == ids[b][None, :]] = 1.0
            if least > 0:
                s[s < least] = 0.0
            over, (across, down) = held[: s.size].reshape(s.shape), (ones[: s.shape[1]], ones[: s.shape[0]])
            # the greater of both less the coverage is what exceeds it; each coverage is that before or more
            for k in range(covers):
                sums[k, a] += np.maximum(over if k else s, cover[k, b], out=over) @ across
            for k in range(covers if not same or i != j else 0):
                sums[k, b] += down @ np.maximum(over if k else s, cover[k, a, None], out=over)
    total, whole = np.empty((covers, n)), cover.astype(np.float64)
    total[:, :left], total[:, left:] = whole[:, 0 if same else left :].sum(axis=1)[:, None], whole[:, :left].sum(axis=1)[:, None]
    if kind == np.float32:  # and sums of BLOCK numbers, none below 0, by a share
        sums *= 1 + (BLOCK + 2) * unit
        sums[:, :left] += off * (n if same else n - left)
        sums[:, left:] += off * left
    return ids, sums - total


def similarity_extremes(df: DataFrame, key: str, vector: str, size: int = ROWS) -> DataFrame:
    """One row: the least and greatest cosine of two different rows (`min`, `max`), by branch and bound. Exact.

    Each tile first meets itself and the tile whose centre is farthest. What these give bounds both ends, and rows go on only
    to tiles that may hold a row that is nearer or farther than that.
    """

    def ends(ids: np.ndarray, s: np.ndarray, others: np.ndarray, same: bool) -> tuple[np.ndarray, ...]:
        own = s[ids[:, None] < others[None, :]] if same else s.reshape(-1)
        return (own.min(keepdims=True), own.max(keepdims=True)) if len(own) else (np.empty(0), np.empty(0))

    rows, tiles = cells.tiled(df, key, vector, size)
    count = len(tiles.rows)
    rows = staged(rows, "tiles") if count > 1 else rows
    partner = np.concatenate([(tiles.centre[k : k + cells.STEP] @ tiles.centre.T).argmin(axis=1) for k in range(0, count, cells.STEP)] or [np.empty(0, np.int64)])

    def at_first(own: cells.Tiles, m: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        tile = batch.column(0).to_numpy()[:, None]
        every = np.arange(len(own.rows))[None, :]
        return (every == tile) | (partner[tile] == every) | (partner[every] == tile)

    schema = "min double, max double"
    found = staged(_block_pairs(cells.reaching(rows, tiles, at_first, pairs=True), count, ends, schema), "ends")
    low, high = found.agg(F.min("min"), F.max("max")).first()
    if count > 1:
        near, far = (float(cells.angle(np.array(x))) if x is not None else y for x, y in ((high, np.pi), (low, 0.0)))

        def beyond(own: cells.Tiles, m: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
            least, most = own.ends(m)
            return ((least < near) | (most > far)) & ~at_first(own, m, batch)

        found = found.unionByName(_block_pairs(cells.reaching(rows, tiles, beyond, pairs=True), count, ends, schema))
    return found.agg(F.min("min").alias("min"), F.max("max").alias("max"))


def choose_index(n: int, flat_below: int = 10_000, lists_below: int = 1_000_000) -> str:
    """Which search fits n vectors: flat, ivf, or graph, for which an index with more lists (`index.VectorIndex`) stands in here."""
    return "flat" if n < flat_below else "ivf" if n < lists_below else "graph"
