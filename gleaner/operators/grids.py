"""Masks and maps as cell tables (grid_id, y, x, ...): counts, neighbourhoods, overlaps and edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import boxes as B
from gleaner.sources.tables import staged

CELL = ["grid_id", "y", "x"]


def mask_counts(cells: DataFrame) -> DataFrame:
    """Cells of each grid, and those in masks in_a and in_b."""
    return cells.groupBy("grid_id").agg(F.count("*").alias("cells"), F.count_if("in_a").alias("a"), F.count_if("in_b").alias("b"))


def coverage_gate(cells: DataFrame, least: float = 0.10) -> DataFrame:
    """Shares of both masks, and `low_coverage` where either is below `least`."""
    counts = mask_counts(cells)
    a, b = F.col("a") / F.col("cells"), F.col("b") / F.col("cells")
    return counts.select("grid_id", F.round(a, 6).alias("cover_a"), F.round(b, 6).alias("cover_b"), F.when((a < least) | (b < least), "low_coverage").alias("fail_reason"))


def prefilter_reason(share: Column, regions: Column, parts: Column, least: float = 0.003, most_regions: int = 30, most_parts: int = 25) -> Column:
    """The first rule that a boundary mask breaks, or null."""
    return F.when(share < least, "no_boundary_pixels").when(regions > most_regions, "too_fragmented").when(parts > most_parts, "too_many_boundary_components")


def pair_counts(cells: DataFrame, other_id: Column, mask: str = "in_a") -> DataFrame:
    """Mask sizes of each grid (a) and of the grid that `other_id` names (b), their overlap, and cells. Grids without a partner are left out."""
    own = cells.select(other_id.alias("_other"), *CELL, F.col(mask).alias("_a"))
    other = cells.select(F.col("grid_id").alias("_other"), "y", "x", F.col(mask).alias("_b"))
    both = own.join(other, ["_other", "y", "x"])
    return both.groupBy("grid_id").agg(F.count("*").alias("cells"), F.count_if("_a").alias("a"), F.count_if("_b").alias("b"), F.count_if(F.col("_a") & F.col("_b")).alias("both"))


def pair_reason(a: Column, b: Column, both: Column, cells: Column, shared: Column | None = None, least_cells: int = 100, least_share: float = 0.01, most_ratio: float = 20.0, most_overlap: float = 0.15, least_shared: float = 0.10) -> Column:
    """Why a pair of masks is no good, or an empty text; the first failure counts."""
    small, large = F.least(a, b), F.greatest(a, b)
    reason = F.when(a < least_cells, "mask_a too small").when(b < least_cells, "mask_b too small")
    reason = reason.when((a / cells < least_share) | (b / cells < least_share), "mask covers too little")
    reason = reason.when(large / F.greatest(small, F.lit(1)) > most_ratio, "area ratio too extreme")
    reason = reason.when((small > 0) & (both / F.nullif(small, F.lit(0)) > most_overlap), "masks overlap too much")
    if shared is not None:
        reason = reason.when(shared < least_shared, "no significant shared boundary")
    return reason.otherwise("")


def complement_decision(a: Column, b: Column, both: Column, cells: Column, least: float = 0.05, overlap: float = 0.70) -> Column:
    """Which mask to derive as the complement of the other: one that collapsed, or the larger of two that overlap much."""
    floor = F.floor(cells * least)
    swallowed = (F.least(a, b) > 0) & (both / F.nullif(F.least(a, b), F.lit(0)) > overlap)
    return F.when((a < floor) & (b >= floor), "derive_a").when((b < floor) & (a >= floor), "derive_b").when(swallowed, F.when(a <= b, "derive_b").otherwise("derive_a")).otherwise("as_is")


def scale_factor(height: Column, width: Column, most: int, factor: int = 2) -> Column:
    """`factor` where the enlarged side still fits `most`, else 1."""
    return F.when(F.greatest(height, width) * factor <= most, factor).otherwise(1)


def placed(cells: DataFrame, boxes: DataFrame, mask_w: int, mask_h: int, width: int, height: int) -> DataFrame:
    """Cells of each grid laid into its box on a canvas: the box is clamped, and each cell of it takes the nearest source cell.

    Boxes without an area give no cells.
    """
    box = B.clamp(B.Box.of(), F.lit(width), F.lit(height))
    own = boxes.select("grid_id", *box.named()).where(B.is_valid(B.Box.of()))

    def taking(at: Column, size: int, low: Column, high: Column) -> Column:
        """The places from `low` on that take the source cell `at`: a run, or none."""
        first, end = (low + F.ceil(n * (high - low) / size) for n in (at, at + 1))
        return F.explode(F.when((at >= 0) & (at < size) & (first < end), F.sequence(first, end - 1)))

    # cells meet their grid's box alone, and are copied after that
    met = cells.join(own, "grid_id").withColumn("ty", taking(F.col("y"), mask_h, F.col("y1"), F.col("y2"))).withColumn("tx", taking(F.col("x"), mask_w, F.col("x1"), F.col("x2")))
    return met.select("grid_id", F.col("ty").alias("y"), F.col("tx").alias("x"), *[c for c in cells.columns if c not in CELL])


def neighbourhood(cells: DataFrame, value: Column, radius: int, op: str) -> DataFrame:
    """Adds `near`: the least (op="min", erosion) or greatest (op="max", dilation) value in a square around each cell.

    Squares are separable: one window along rows, then one along columns. Missing cells have no say.
    """
    f = {"min": F.min, "max": F.max}[op]
    along = Window.partitionBy("grid_id", "y").orderBy("x").rangeBetween(-radius, radius)
    across = Window.partitionBy("grid_id", "x").orderBy("y").rangeBetween(-radius, radius)
    return cells.withColumn("near", f(value).over(along)).withColumn("near", f("near").over(across))


def boundary(cells: DataFrame, mask: str, radius: int = 1) -> DataFrame:
    """Cells of a mask that erosion takes away."""
    eroded = neighbourhood(cells.withColumn("_m", F.col(mask).cast("int")), F.col("_m"), radius, "min")
    return eroded.where((F.col("_m") == 1) & (F.col("near") == 0)).select(CELL)


def band(cells: DataFrame, mask: str, radius: int = 1) -> DataFrame:
    """`cells` with `in_band`: within `radius` of the mask's boundary."""
    eroded = neighbourhood(cells.withColumn("_m", F.col(mask).cast("int")), F.col("_m"), 1, "min")
    edge = eroded.withColumn("_e", F.when((F.col("_m") == 1) & (F.col("near") == 0), 1).otherwise(0))
    return neighbourhood(edge, F.col("_e"), radius, "max").withColumn("in_band", F.col("near") == 1).drop("_m", "_e", "near")


def _near(points: DataFrame, others: DataFrame, distance: float, value: str | None = None) -> tuple[DataFrame, DataFrame, Column]:
    """Both tables filed for a join, and its condition: points of a grid within a Euclidean distance.

    Points are filed in squares as wide as the distance; each looks into its own and the eight around, by an equi-join.
    """
    side = max(1.0, float(distance))
    own = points.withColumn("_by", F.floor(F.col("y") / side)).withColumn("_bx", F.floor(F.col("x") / side))
    around = F.explode(F.array(*[F.struct((F.col("_y0") + i).alias("_by"), (F.col("_x0") + j).alias("_bx")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    kept = [F.col(value).alias("_v")] if value else []
    base = others.select(F.col("grid_id").alias("_g"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.floor(F.col("y") / side).alias("_y0"), F.floor(F.col("x") / side).alias("_x0"), *kept)
    spread = base.withColumn("_s", around).select("_g", "_y", "_x", F.col("_s._by").alias("_oy"), F.col("_s._bx").alias("_ox"), *(["_v"] if value else []))
    near = (F.col("y") - F.col("_y")) ** 2 + (F.col("x") - F.col("_x")) ** 2 <= float(distance) ** 2
    return own, spread, (F.col("grid_id") == F.col("_g")) & (F.col("_by") == F.col("_oy")) & (F.col("_bx") == F.col("_ox")) & near


def within(points: DataFrame, others: DataFrame, distance: float) -> DataFrame:
    """Rows of `points` that have one of `others` of their grid within a Euclidean distance."""
    own, spread, on = _near(points, others, distance)
    return own.join(spread, on, "left_semi").select(points.columns)


def best_within(points: DataFrame, others: DataFrame, distance: float, value: str) -> DataFrame:
    """Cells of `points` that `within` would keep, each with the greatest value of `others` near it."""
    own, spread, on = _near(points.select(CELL), others, distance, value)
    return own.join(spread, on).groupBy(*CELL).agg(F.max("_v").alias(value))


def match_counts(pred: DataFrame, truth: DataFrame, distance: float, keys: list[str] | None = None) -> DataFrame:
    """tp, fp and fn of each grid: predicted cells near a true one, others, and true cells with no prediction near.

    `keys` (default grid_id) may hold more columns of `pred`; `truth` then needs them as well.
    """
    keys = keys or ["grid_id"]
    group = F.xxhash64(*keys) if keys != ["grid_id"] else F.col("grid_id")
    p, t = (d.withColumn("_k", F.struct(*keys)).withColumn("grid_id", group) for d in (pred, truth))
    sides = [
        p.select("_k", F.lit(0).alias("hit"), F.lit(1).alias("pred"), F.lit(0).alias("seen"), F.lit(0).alias("true")),
        within(p, t, distance).select("_k", F.lit(1), F.lit(0), F.lit(0), F.lit(0)),
        t.select("_k", F.lit(0), F.lit(0), F.lit(0), F.lit(1)),
        within(t, p, distance).select("_k", F.lit(0), F.lit(0), F.lit(1), F.lit(0)),
    ]
    every = sides[0].union(sides[1]).union(sides[2]).union(sides[3])
    sums = every.groupBy("_k").agg(F.sum("hit").alias("tp"), (F.sum("pred") - F.sum("hit")).alias("fp"), (F.sum("true") - F.sum("seen")).alias("fn"))
    return sums.select(*[F.col(f"_k.{k}").alias(k) for k in keys], "tp", "fp", "fn")


def nearest_centre(points: DataFrame, centres: list[float], value: Column, cutoff: float) -> DataFrame:
    """Adds `label`: the index of the nearest centre (the first of equals), or -1 beyond the cutoff. Centres are a short list of the plan."""
    if not centres:
        return points.withColumn("label", F.lit(-1))
    best = F.array_min(F.array(*[F.struct(F.abs(value - c).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(centres)]))
    return points.withColumn("label", F.when(best["d"] > cutoff, -1).otherwise(best["i"]))


def assign_unlabelled(cells: DataFrame, value: str = "gray", cutoff: float = 40.0) -> DataFrame:
    """Adds `side`: a or b for labelled cells; others go to the mask whose mean value is closer within the cutoff, ties to a; else null."""
    means = cells.groupBy("grid_id").agg(F.avg(F.when(F.col("in_a"), F.col(value))).alias("_ma"), F.avg(F.when(F.col("in_b"), F.col(value))).alias("_mb"))
    far = F.lit(float("inf"))
    da, db = (F.coalesce(F.abs(F.col(value) - F.col(m)), far) for m in ("_ma", "_mb"))
    side = F.when(F.col("in_a"), "a").when(F.col("in_b"), "b").when((da <= db) & (da <= cutoff), "a").when((db < da) & (db <= cutoff), "b")
    return cells.join(means, "grid_id").withColumn("side", side).drop("_ma", "_mb")


def cells_in_boxes(cells: DataFrame, boxes: DataFrame, edge: str, least_balance: float = 0.20, side: int = 64) -> DataFrame:
    """Per box (grid_id, box_id): shares of both masks by its area, and the density of edge cells, or -1 where the smaller share is below the least.

    Boxes are filed under the squares of `side` cells that they reach, so a box meets cells of those squares alone.
    """
    inside = (F.col("x") >= F.col("x1")) & (F.col("x") < F.col("x2")) & (F.col("y") >= F.col("y1")) & (F.col("y") < F.col("y2"))
    own = cells.withColumnRenamed("grid_id", "_g").withColumn("_cy", F.floor(F.col("y") / side)).withColumn("_cx", F.floor(F.col("x") / side))
    reach = lambda low, high: F.explode(F.sequence(F.floor(F.col(low) / side), F.greatest(F.floor((F.col(high) - 1) / side), F.floor(F.col(low) / side))))
    filed = boxes.withColumn("_by", reach("y1", "y2")).withColumn("_bx", reach("x1", "x2"))
    joined = filed.join(own, (F.col("grid_id") == F.col("_g")) & (F.col("_by") == F.col("_cy")) & (F.col("_bx") == F.col("_cx")) & inside, "left")
    sums = joined.groupBy("grid_id", "box_id", *B.Box._fields).agg(*[F.sum(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(f"_{c}") for c in ("in_a", "in_b", edge)])
    area = B.Box.of().area.cast("double")
    shares = sums.select("grid_id", "box_id", F.when(area > 0, F.col("_in_a") / area).otherwise(F.lit(0.0)).alias("frac_a"), F.when(area > 0, F.col("_in_b") / area).otherwise(F.lit(0.0)).alias("frac_b"), F.when(area > 0, F.col(f"_{edge}") / area).otherwise(F.lit(0.0)).alias("_d"))
    return shares.select("grid_id", "box_id", "frac_a", "frac_b", F.when(F.least("frac_a", "frac_b") < least_balance, F.lit(-1.0)).otherwise(F.col("_d")).alias("score"))


def cooccurrence(cells: DataFrame, level: Column, offsets: list[tuple[int, int]]) -> DataFrame:
    """Per grid: contrast, homogeneity, energy and correlation of the symmetric, normalised co-occurrence of levels, as means over offsets (dy, dx)."""
    own = cells.select(*CELL, level.cast("double").alias("i"))
    shifts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(offsets)]))
    moved = own.withColumn("o", shifts).select("grid_id", F.col("o.k").alias("k"), (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("i"))
    pairs = moved.join(own.withColumnRenamed("i", "j"), CELL).select("grid_id", "k", "i", "j")
    counts = pairs.groupBy("grid_id", "k", "i", "j").agg(F.count("*").alias("n"))
    both = counts.unionByName(counts.select("grid_id", "k", F.col("j").alias("i"), F.col("i").alias("j"), "n")).groupBy("grid_id", "k", "i", "j").agg(F.sum("n").alias("n"))
    p = both.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("grid_id", "k")))
    i, j, w = F.col("i"), F.col("j"), F.col("p")
    # both margins are alike, as the matrix is symmetric
    stats = p.groupBy("grid_id", "k").agg(F.sum(w * (i - j) ** 2).alias("contrast"), F.sum(w / (1 + (i - j) ** 2)).alias("homogeneity"), F.sqrt(F.sum(w * w)).alias("energy"), F.sum(w * i).alias("m"), F.sum(w * i * i).alias("s"), F.sum(w * i * j).alias("c"))
    var = F.col("s") - F.col("m") ** 2
    stats = stats.withColumn("correlation", F.when(var > 1e-12, (F.col("c") - F.col("m") ** 2) / var).otherwise(F.lit(1.0)))
    return stats.groupBy("grid_id").agg(*[F.avg(c).alias(c) for c in ("contrast", "homogeneity", "energy", "correlation")])


def band_statistics(cells: DataFrame, ids: DataFrame, band_flag: str, signal: str, edge: str) -> DataFrame:
    """Per id: variance, mean, deviation and maximum of a signal in the band, and the share of band cells on an edge; `empty` where the band has no cell."""
    stats = cells.where(F.col(band_flag)).groupBy("grid_id").agg(F.var_pop(signal).alias("variance"), F.avg(signal).alias("mean"), F.stddev_pop(signal).alias("std"), F.max(signal).alias("top"), (F.count_if(edge) / F.count("*")).alias("edge_share"))
    return ids.join(stats, "grid_id", "left").withColumn("empty", F.col("mean").isNull())


def dominant_values(cells: DataFrame, value: str = "gray", step: int = 8, tolerance: float = 20.0, least: float = 0.05) -> DataFrame:
    """Per grid: centres of its most common values with their share of all cells.

    Values become a small histogram; in each group the most common one left takes in those within the tolerance, centres
    closer than 1.5 tolerances merge, and shares are recounted over all cells of the histogram's exact values.
    """
    # a grid has at most as many rows here as a channel has values
    histogram = cells.groupBy(F.col("grid_id").cast("long").alias("grid_id"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))

    def found(v: np.ndarray, n: np.ndarray) -> list[tuple[float, float]]:
        coarse = (v // step) * step + step / 2
        free = n > 0
        centres: list[float] = []
        while free.any():  # each round takes one value at least
            at, of = np.unique(coarse[free], return_inverse=True)
            sums = np.zeros(len(at), np.int64)
            np.add.at(sums, of, n[free])
            seed = float(at[sums.argmax()])  # the least of the most common
            near = free & (abs(v - seed) <= tolerance)
            if not near.any():
                near = free & (coarse == seed)
            centre = float((v[near] * n[near]).sum() / n[near].sum())
            if all(abs(centre - c) > 1.5 * tolerance for c in centres):
                centres.append(centre)
            free = free & ~near
        shares = [(c, float(n[abs(v - c) <= tolerance].sum()) / n.sum()) for c in centres]
        return sorted(((c, s) for c, s in shares if s >= least), key=lambda x: (-x[1], x[0]))

    def grids(table: pa.Table) -> pa.RecordBatch:
        g, v, n = (table[c].to_numpy() for c in ("grid_id", "v", "n"))
        edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if len(g) else np.zeros(1, np.int64)
        out = [(int(g[a]), k, c, s) for a, b in zip(edges[:-1], edges[1:], strict=True) for k, (c, s) in enumerate(found(v[a:b], n[a:b]), 1)]
        columns = list(zip(*out, strict=True)) or [()] * 4
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["grid_id", "rank", "centre", "share"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            g = table["grid_id"].to_numpy()
            whole = int(np.searchsorted(g, g[-1], "left")) if len(g) else 0  # the last grid may go on
            yield grids(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None:
            yield grids(rest)

    dealt = histogram.where("grid_id IS NOT NULL AND v IS NOT NULL").repartition("grid_id").sortWithinPartitions("grid_id", "v")
    return dealt.mapInArrow(run, "grid_id long, rank int, centre double, share double")


def spaced_peaks(cells: DataFrame, value: str, n: int, separation: float, metric: str = "euclidean", fill: bool = False, seed: int = 0) -> DataFrame:
    """Per grid: up to n highest cells (rank, value), none within the separation of a higher one taken, of all its cells.

    Equal values go by y, then x. Grids in which fewer than n are found give none or, with `fill`, all found and others at
    random (by a seeded hash of their place) for the rest. Cells stream by in order; only those taken are held.
    """
    rows = cells.select(F.col("grid_id").cast("long"), F.col("y").cast("long"), F.col("x").cast("long"), F.col(value).cast("double").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid, taken, done = None, [], []
        for batch in batches:
            g, y, x, v = (c.to_numpy() for c in batch.columns)
            edges = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]])) if len(g) else np.zeros(1, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if g[a] != grid:
                    done += taken if fill or len(taken) == n else []
                    grid, taken = g[a], []
                open_ = np.ones(b - a, bool)
                for t in taken:
                    open_ &= apart(y[a:b] - t[1], x[a:b] - t[2])
                while len(taken) < n and open_.any():
                    k = a + int(open_.argmax())
                    taken.append((int(grid), int(y[k]), int(x[k]), len(taken) + 1, float(v[k])))
                    open_ &= apart(y[a:b] - y[k], x[a:b] - x[k])
                    open_[: k - a + 1] = False
            if len(done) > 10_000:
                yield _peaks(done)
                done = []
        yield _peaks(done + (taken if fill or len(taken) == n else []))

    def apart(dy: np.ndarray, dx: np.ndarray) -> np.ndarray:
        return (np.abs(dy) + np.abs(dx) if metric == "manhattan" else np.sqrt(dy * dy + dx * dx)) > separation

    schema = "grid_id long, y long, x long, rank int, value double"
    found = rows.repartition("grid_id").sortWithinPartitions("grid_id", F.col("v").desc(), "y", "x").mapInArrow(run, schema)
    if not fill:
        return found
    found = staged(found, "peaks")
    have = found.groupBy("grid_id").agg(F.count("*").alias("_have")).where(F.col("_have") < n)
    spare = rows.join(have, "grid_id").join(found.select(CELL), CELL, "left_anti")
    order = Window.partitionBy("grid_id").orderBy(F.xxhash64(F.lit(seed), "y", "x"), "y", "x")
    drawn = spare.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n - F.col("_have"))
    return found.unionByName(drawn.select(*CELL, (F.col("_have") + F.col("_r")).cast("int").alias("rank"), F.col("v").alias("value")))


def _peaks(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True)], ["grid_id", "y", "x", "rank", "value"])


def shared_boundary(cells: DataFrame, a: str, b: str, distance: float) -> DataFrame:
    """Per grid: perimeter cells of one mask near the other (the larger of both ways), the smaller perimeter, and their ratio; zeros where a perimeter is empty."""
    pa, pb = boundary(cells, a), boundary(cells, b)
    sides = [
        pa.select("grid_id", *[F.lit(x).alias(n) for n, x in zip(("na", "nb", "sa", "sb"), (1, 0, 0, 0), strict=True)]),
        pb.select("grid_id", F.lit(0), F.lit(1), F.lit(0), F.lit(0)),
        within(pa, cells.where(F.col(b)), distance).select("grid_id", F.lit(0), F.lit(0), F.lit(1), F.lit(0)),
        within(pb, cells.where(F.col(a)), distance).select("grid_id", F.lit(0), F.lit(0), F.lit(0), F.lit(1)),
        cells.select("grid_id", F.lit(0), F.lit(0), F.lit(0), F.lit(0)),
    ]
    every = sides[0]
    for s in sides[1:]:
        every = every.union(s)
    sums = every.groupBy("grid_id").agg(*[F.sum(c).alias(c) for c in ("na", "nb", "sa", "sb")])
    ok = (F.col("na") > 0) & (F.col("nb") > 0)
    top, small = F.greatest("sa", "sb"), F.least("na", "nb")
    return sums.select("grid_id", F.when(ok, top).otherwise(0).alias("shared"), F.when(ok, small).otherwise(0).alias("perimeter"), F.when(ok, top / F.nullif(small, F.lit(0))).otherwise(F.lit(0.0)).alias("ratio"))
