"""Vectors filed in cells around centres, with bounds that tell which cells a row can reach.

Centres come from a bounded sample. Each row goes to the cell of the nearest centre it finds, and each cell keeps its radius:
the greatest angle of a row to the centre. The angle between a row and any row of a cell is at least the row's angle to the
centre less the radius, and at most both together. So exact joins meet only cells that these bounds leave, and a row is sent
only to such cells. Cells of many rows are cut into tiles of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.sources.tables import staged

#: Centres at most, and rows at most that they are drawn from: what the driver holds, and what tasks get.
CENTRES, SAMPLE = 4096, 65_536
#: Rows that are set against all centres at a time.
STEP = 1024
#: Rows that a task gives out at a time when it sends rows to tiles.
SPREAD = 4096
#: Radians by which angles may be wrong through rounding.
SLACK = 1e-6


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))


def k_means(m: np.ndarray, count: int, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Unit centres of `count` clusters of unit rows at most, by spherical k-means."""
    count = min(count, len(m))
    centres = m[np.random.default_rng(seed).choice(len(m), count, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([(m[k : k + STEP] @ centres.T).argmax(axis=1) for k in range(0, len(m), STEP)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, m)
        centres = unit(np.where(np.abs(sums).sum(axis=1, keepdims=True) > 0, sums, centres))
    return centres


@dataclass(frozen=True)
class Centres:
    """Centres in two levels: `tops`, and for each centre in `own` the top it belongs to."""

    tops: np.ndarray
    own: np.ndarray
    top_of: np.ndarray

    def nearest(self, m: np.ndarray, n: int = 1, tops: int = 3) -> tuple[np.ndarray, np.ndarray]:
        """The `n` centres found nearest to each unit row (-1 for none) and the products with them: those of its `tops` nearest tops are tried."""
        best, products = np.full((len(m), n), -1), np.full((len(m), n), -np.inf)
        for low in range(0, len(m), STEP):
            some = m[low : low + STEP]
            s = some @ self.own.T
            if tops < len(self.tops):
                t = some @ self.tops.T
                open_ = np.zeros(t.shape, bool)
                np.put_along_axis(open_, np.argpartition(-t, tops - 1, axis=1)[:, :tops], True, axis=1)
                s[~open_[:, self.top_of]] = -np.inf
            k = min(n, s.shape[1])
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            products[low : low + STEP, :k] = np.take_along_axis(s, order, 1)
            best[low : low + STEP, :k] = np.where(np.isfinite(products[low : low + STEP, :k]), order, -1)
        return best, products


def fitted(df: DataFrame, key: str, vector: str, count: int, sample: int = SAMPLE) -> Centres:
    """`count` centres (CENTRES at most) from at most `sample` rows that a hash of the key picks."""
    n, count = df.count(), min(count, CENTRES)
    want = min(sample, max(64 * count, 4096))
    u = F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(1)), 11) / float(1 << 53)
    picked = vectors(df.where(u <= min(1.0, 1.1 * want / max(n, 1))), key, vector).where("v IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(want)
    m = matrix(picked.select("v").toArrow()["v"].combine_chunks())
    m = unit(m[np.linalg.norm(m, axis=1) > 0]) if len(m) else m
    if not len(m):
        return Centres(m, m, np.empty(0, np.int64))
    tops = k_means(m, max(1, round(count**0.5)))
    near = (m @ tops.T).argmax(axis=1)
    parts = [k_means(m[near == t], max(1, round(count * float((near == t).mean())))) for t in range(len(tops)) if (near == t).any()]
    used = [t for t in range(len(tops)) if (near == t).any()]
    return Centres(tops[used], np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(p) for p in parts]))


def angle(products: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(products, -1.0, 1.0))


@dataclass(frozen=True)
class Tiles:
    """Where tiles lie: their cell's centre, its radius (more than a half turn for rows that have no direction) and their rows."""

    centre: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    def angles(self, m: np.ndarray) -> np.ndarray:
        """The angle of each unit row of m to each tile's centre."""
        return angle(m @ self.centre.T) if m.shape[1] == self.centre.shape[1] else np.zeros((len(m), len(self.rows)))

    def ends(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest angle that each unit row of m can have to a row of each tile."""
        to = self.angles(m)
        return np.maximum(to - self.radius - SLACK, 0.0), np.minimum(to + self.radius + SLACK, np.pi)


def units(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) of unit vectors; zero vectors stay, null ones go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), lists(unit(matrix(batch.column(1))))], ["id", "v"])

    return vectors(df, key, vector).where("v IS NOT NULL").mapInArrow(run, "id long, v array<double>")


def dealt(df: DataFrame, key: str, vector: str, size: int) -> tuple[DataFrame, Tiles]:
    """(tile, id, v) of unit vectors, and the tiles: `size` rows or fewer each, about, dealt by a hash, so that all reach all."""
    given = units(df, key, vector)
    n = df.where(F.col(vector).isNotNull()).count()
    count = -(-n // size)
    tile = F.pmod(F.xxhash64("id"), F.lit(max(1, count))).alias("tile")
    return given.select(tile, "id", "v"), Tiles(np.zeros((count, 1)), np.full(count, 4.0), np.full(count, size))


def tiled(df: DataFrame, key: str, vector: str, size: int) -> tuple[DataFrame, Tiles]:
    """(tile, id, v) of unit vectors, and the tiles: `size` rows or fewer each, about.

    There is a cell for every `size` rows (CENTRES at most). Rows without a direction have a cell of their own that all reach.
    Rows that one tile holds are not filed at all.
    """
    given = vectors(df, key, vector).where("v IS NOT NULL")
    n = given.count()
    if n <= size:
        one = min(n, 1)
        return units(given, "id", "v").select(F.lit(0).cast("long").alias("tile"), "id", "v"), Tiles(np.zeros((one, 1)), np.full(one, 4.0), np.full(one, n))
    centres = fitted(given, "id", "v", -(-n // size))
    sent = given.sparkSession.sparkContext.broadcast(centres)  # CENTRES vectors at most

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            raw = matrix(batch.column(1))
            m, flat = unit(raw), np.linalg.norm(raw, axis=1) == 0
            cell, wide = np.zeros(len(m), np.int64), np.full(len(m), 4.0)
            if len(own.own) and len(m):
                near, product = own.nearest(m)
                cell, wide = near[:, 0], angle(product[:, 0])
            cell[flat], wide[flat] = -1, 4.0
            yield pa.record_batch([pa.array(cell), pa.array(wide), batch.column(0), lists(m)], ["cell", "angle", "id", "v"])

    filed = staged(given.mapInArrow(file, "cell long, angle double, id long, v array<double>"), "filed")
    cells = filed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).orderBy("cell").collect()  # CENTRES rows and one
    width = centres.own.shape[1] if len(centres.own) else 1
    first, parts, centre, radius, rows = {}, {}, [], [], []
    for c in cells:
        first[c["cell"]], parts[c["cell"]] = len(rows), max(1, -(-c["n"] // size))
        for _ in range(parts[c["cell"]]):
            centre.append(centres.own[c["cell"]] if c["cell"] >= 0 and len(centres.own) else np.zeros(width))
            radius.append(c["r"])
            rows.append(-(-c["n"] // parts[c["cell"]]))
    places = [(c, first[c], parts[c]) for c in first]
    at = filed.sparkSession.createDataFrame(places or [(-2, 0, 1)], "cell long, first long, parts long")
    tile = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("tile")
    out = filed.join(F.broadcast(at), "cell").select(tile, "id", "v")  # CENTRES rows and one
    return out, Tiles(np.array(centre).reshape(len(rows), width), np.array(radius, float), np.array(rows, np.int64))


def reaching(rows: DataFrame, tiles: Tiles, reaches, pairs: bool) -> DataFrame:
    """`rows` (tile, id, v, ...) with `meet`: one for each tile that `reaches(tiles, m, batch)` (a mask, rows by tiles) gives.

    With `pairs` a meeting is that of the row's own tile and the other, in either order: the lower times the number of tiles
    plus the higher. Otherwise it is the tile.
    """
    sent = rows.sparkSession.sparkContext.broadcast(tiles)
    names = rows.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", meet long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        count = len(own.rows)
        for batch in batches:
            for low in range(0, batch.num_rows, STEP):
                some = batch.slice(low, STEP)
                m = matrix(some.column(names.index("v")))
                met = np.nonzero(reaches(own, m, some))
                for at in range(0, len(met[0]), SPREAD):
                    i, j = (x[at : at + SPREAD] for x in met)
                    if pairs:
                        tile = some.column(names.index("tile")).to_numpy()[i]
                        j = np.minimum(tile, j) * count + np.maximum(tile, j)
                    yield pa.record_batch([*(c.take(pa.array(i)) for c in some.columns), pa.array(j.astype(np.int64))], [*names, "meet"])

    return rows.mapInArrow(run, schema)
