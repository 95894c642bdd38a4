"""Hard negatives of anchor vectors, by summaries of vector segments.

Each vector is cut into segments, and each segment's mean and deviation are stored. A product of two segments lies within
the product of their means, times the length, plus or minus that of their deviations. Sums of these bound the score of two
vectors; wide segments are tried first, their narrow parts for pairs that are left, and only what these leave is scored.
Anchors are a stated part of the rows: blocks of them meet blocks of rows, as many as there are rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm.shared import written

#: Components of a narrow segment, and narrow segments of a wide one.
NARROW, WIDE = 4, 4
#: Anchors of a block, rows of a block of a small and of a large table, about: what one task holds of either; and how many of
#: both are tried at a time.
ANCHORS, FEW_ROWS, ROWS, TILE = 32_768, 2048, 32_768, 1024
#: Pairs below which scores are taken pair by pair, as a share of a tile.
SPARSE = 1 / 16
#: Sums of products below which arithmetic on doubles is exact.
_EXACT = 2.0**53
_LONG = (1 << 63) - 1


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors as rows, filled up with zeros to a whole number of wide segments."""
    step = NARROW * WIDE
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    width = max(step, -(-int(sizes.max(initial=0)) // step) * step)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def summaries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of the narrow segments, (rows, segments) each."""
    cut = rows.reshape(len(rows), -1, NARROW)
    return cut.mean(axis=2), cut.std(axis=2)


def widened(means: np.ndarray, deviations: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the wide segments, from those of the narrow ones."""
    m, d = (x.reshape(len(x), -1, WIDE) for x in (means, deviations))
    wide = m.mean(axis=2)
    return wide, np.sqrt((d * d).mean(axis=2) + ((m - wide[:, :, None]) ** 2).mean(axis=2))


class Side:
    """A block's rows with their summaries at both levels, scaled so that a product of two rows needs no factor."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, tie: np.ndarray, rows: np.ndarray, means: np.ndarray, deviations: np.ndarray) -> None:
        self.ids, self.labels, self.tie, self.rows = ids, labels, tie, rows
        narrow, wide = (means, deviations), widened(means, deviations)
        self.levels = [(m * np.sqrt(size), d * np.sqrt(size)) for (m, d), size in ((wide, NARROW * WIDE), (narrow, NARROW))]
        self.size = np.linalg.norm(rows, axis=1)

    def __len__(self) -> int:
        return len(self.ids)

    def part(self, at: np.ndarray | slice) -> Side:
        out = object.__new__(Side)
        out.ids, out.labels, out.tie, out.rows, out.size = (x[at] for x in (self.ids, self.labels, self.tie, self.rows, self.size))
        out.levels = [(m[at], d[at]) for m, d in self.levels]
        return out


def bounds(a: Side, b: Side, level: int, pairs: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores of all rows of a with all of b, or of the given pairs; a little wide, for rounding."""
    (am, ad), (bm, bd) = a.levels[level], b.levels[level]
    if pairs is None:
        middle, reach, slack = am @ bm.T, ad @ bd.T, np.outer(a.size, b.size)
    else:
        i, j = pairs
        middle, reach, slack = np.einsum("ij,ij->i", am[i], bm[j]), np.einsum("ij,ij->i", ad[i], bd[j]), a.size[i] * b.size[j]
    reach = reach + slack * 1e-9 + 1e-6
    return middle - reach, middle + reach


def scores(a: Side, b: Side, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Integer products of the given pairs: int64, or Python integers where these are too small."""
    if not len(i):
        return np.empty(0, np.int64)
    most = np.abs(a.rows).max(initial=0) * np.abs(b.rows).max(initial=0) * a.rows.shape[1]
    if most < _EXACT:
        if len(i) > SPARSE * len(a) * len(b):
            return (a.rows @ b.rows.T)[i, j].astype(np.int64)
        out = np.empty(len(i), np.int64)
        for low in range(0, len(i), 1 << 16):
            part = slice(low, low + (1 << 16))
            out[part] = np.einsum("ij,ij->i", a.rows[i[part]], b.rows[j[part]])
        return out
    return np.array([sum(int(x) * int(y) for x, y in zip(a.rows[p], b.rows[q], strict=True)) for p, q in zip(i.tolist(), j.tolist(), strict=True)], object)


def _first(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, tie: np.ndarray, n: int) -> np.ndarray:
    """Places of the first `n` rows of each owner, in order: by score, the higher first, then by id."""
    order = np.lexsort((tie, ids, -score, owner)) if score.dtype != object else np.array(sorted(range(len(owner)), key=lambda k: (owner[k], -score[k], ids[k], tie[k])), np.int64)
    own = owner[order]
    start = np.searchsorted(own, own, "left")
    return order[np.arange(len(own)) - start < n]


Found = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _none(kind: np.dtype | type = np.int64) -> Found:
    return np.empty(0, np.int64), np.empty(0, kind), np.empty(0, np.int64), np.empty(0, np.int64)


def _kept(held: Found, more: Found, n: int) -> Found:
    whole = tuple(np.concatenate(x) for x in zip(held, more, strict=True))
    at = _first(*whole, n)
    return tuple(x[at] for x in whole)


def _floor_of(held: Found, rows: int, n: int) -> np.ndarray:
    """The n-th best score that each owner has so far, or minus infinity."""
    out = np.full(rows, -np.inf)
    owner, score = held[:2]
    if len(owner):
        start = np.searchsorted(owner, np.arange(rows))
        full = np.searchsorted(owner, np.arange(rows), "right") - start >= n
        out[full] = score[start[full] + n - 1].astype(float)
    return out


def _left(a: Side, b: Side, may: np.ndarray, low: np.ndarray, high: np.ndarray, sure: tuple[np.ndarray, np.ndarray], n: int, seen: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs among `may` that the bounds leave: those that may reach low, and stay at high or below, of their row of a.

    Each row of a is after its `n` best, so `low` rises to the n-th best lower bound of what surely counts: within `sure`.
    """
    lower, upper = bounds(a, b, 0)
    seen["all"] = seen.get("all", 0) + int(may.sum())
    may &= (upper >= low[:, None]) & (lower <= high[:, None])
    if len(b) >= n:
        counts = np.where(may & (lower >= sure[0][:, None]) & (upper <= sure[1][:, None]), lower, -np.inf)
        low = np.maximum(low, np.partition(counts, len(b) - n, axis=1)[:, len(b) - n])
        may &= upper >= low[:, None]
    i, j = np.nonzero(may)
    seen["wide"] = seen.get("wide", 0) + len(i)
    if len(i) > SPARSE * may.size:
        lower, upper = (x[i, j] for x in bounds(a, b, 1))
    else:
        parts = [bounds(a, b, 1, (i[k : k + (1 << 16)], j[k : k + (1 << 16)])) for k in range(0, max(len(i), 1), 1 << 16)]
        lower, upper = (np.concatenate(x) for x in zip(*parts, strict=True))
    ok = (upper >= low[i]) & (lower <= high[i])
    seen["narrow"] = seen.get("narrow", 0) + int(ok.sum())
    return i[ok], j[ok]


def nearest_alike(a: Side, b: Side, n: int, seen: dict[str, int] | None = None) -> Found:
    """(row of a, score, id, tie): for each row of a the first `n` other rows of b with its label."""
    seen = {} if seen is None else seen
    out = []
    for first in range(0, len(a), TILE):
        some, held = a.part(slice(first, first + TILE)), _none()
        for at in range(0, len(b), TILE):
            tile = b.part(slice(at, at + TILE))
            floor = _floor_of(held, len(some), n)
            for label in np.intersect1d(some.labels, tile.labels).tolist():
                mine = np.flatnonzero(some.labels == label)
                own, other = some.part(mine), tile.part(np.flatnonzero(tile.labels == label))
                may = (own.ids[:, None] != other.ids[None, :]) | (own.tie[:, None] != other.tie[None, :])
                ends = np.full(len(own), -np.inf), np.full(len(own), np.inf)
                i, j = _left(own, other, may, floor[mine], ends[1], ends, n, seen)
                held = _kept(held, (mine[i], scores(own, other, i, j), other.ids[j], other.tie[j]), n)
        out.append((held[0] + first, *held[1:]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _none()


def best_within(a: Side, b: Side, owner: np.ndarray, low: np.ndarray, high: np.ndarray, n: int, seen: dict[str, int] | None = None) -> Found:
    """(window, score, id, tie): for each window (its row of a, ascending, and scores from low to high) the first `n` rows of b of another label in it."""
    seen = {} if seen is None else seen
    out = []
    for first in range(0, len(a), TILE):
        some, held = a.part(slice(first, first + TILE)), _none()
        begin, end = np.searchsorted(owner, [first, first + TILE])
        own, low_, high_ = owner[begin:end] - first, low[begin:end], high[begin:end]
        if not len(own):
            continue
        turn = np.arange(len(own)) - np.searchsorted(own, own, "left")
        ends = np.full(len(some), -np.inf), np.full(len(some), np.inf)
        most = ends[0].copy()
        np.maximum.at(most, own, high_.astype(float))
        np.maximum.at(ends[0], own, low_.astype(float))  # within the highest low and the lowest high a row is in all windows
        np.minimum.at(ends[1], own, high_.astype(float))
        for at in range(0, len(b), TILE):
            tile = b.part(slice(at, at + TILE))
            # a window that is full takes only what reaches its last score; an anchor asks for the lowest of its windows
            floor = np.maximum(low_.astype(float), _floor_of(held, len(own), n))
            least = np.full(len(some), np.inf)
            np.minimum.at(least, own, floor)
            i, j = _left(some, tile, some.labels[:, None] != tile.labels[None, :], least, most, ends, n, seen)
            found = scores(some, tile, i, j)
            for t in range(int(turn.max()) + 1):
                window = np.full(len(some), -1)
                window[own[turn == t]] = np.flatnonzero(turn == t)
                of = window[i]
                ok = np.flatnonzero(of >= 0)
                ok = ok[((found[ok] >= low_[of[ok]]) & (found[ok] <= high_[of[ok]])).astype(bool)]
                if len(ok):
                    held = _kept(held, (of[ok], found[ok], tile.ids[j[ok]], tile.tie[j[ok]]), n)
        out.append((held[0] + begin, *held[1:]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else _none()


_ROW = "id long, label long, tie long, v array<double>, means array<double>, deviations array<double>"


def summarized(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256, relabel: int = 7, labels: int = 10) -> DataFrame:
    """(id, label, tie, v, means, deviations), written: rows that take part, with the summaries of their narrow segments.

    A component x becomes floor(scale * x). Rows with a null id, label, vector or component, or one that is not finite, are
    left out. Rows whose id is divisible by `relabel` get the next label of `labels`. Rows equal in id, label and vector are
    one; `tie` tells others of the same id apart.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v")).where("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").where(good)
    if relabel:
        rows = rows.withColumn("label", F.when(F.col("id") % relabel == 0, F.pmod(F.col("label") + 1, F.lit(labels))).otherwise(F.col("label")))
    rows = rows.withColumn("tie", F.xxhash64("label", "v")).dropDuplicates(["id", "label", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = np.floor(matrix(batch.column(3)) * scale)
            yield pa.record_batch([*batch.columns[:3], *(_lists(x) for x in (m, *summaries(m)))], [c.split()[0] for c in _ROW.split(", ")])

    return written(rows.select("id", "label", "tie", "v").mapInArrow(run, _ROW), "summaries")


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1)))


def _side(table: pa.Table, width: int) -> Side:
    wide = lambda c, w: _filled(matrix(table[c].combine_chunks()), w)
    return Side(*(table[c].to_numpy() for c in ("id", "label", "tie")), wide("v", width), wide("means", width // NARROW)[:, : width // NARROW], wide("deviations", width // NARROW)[:, : width // NARROW])


def _filled(rows: np.ndarray, width: int) -> np.ndarray:
    return rows if rows.shape[1] >= width else np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _width(*tables: pa.Table) -> int:
    sizes = [int(np.diff(t["v"].combine_chunks().offsets.to_numpy()).max(initial=0)) for t in tables if t.num_rows]
    step = NARROW * WIDE
    return max([step, *(-(-s // step) * step for s in sizes)])


def _dealt(rows: DataFrame, anchors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with the block of anchors (`ab`) and the block of rows (`rb`) that meet; blocks are as many as the rows make."""
    n_anchors, n_rows = anchors.count(), rows.count()
    a, b = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n_rows // max(FEW_ROWS, min(ROWS, n_rows // 64))))
    every: Column = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(b - 1).cast("long"))).alias("rb")
    every_a = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(a - 1).cast("long"))).alias("ab")
    block = lambda n, salt: F.pmod(F.xxhash64("id", "tie", F.lit(salt)), F.lit(n))
    return anchors.withColumn("ab", block(a, 1)).select("*", every), rows.withColumn("rb", block(b, 2)).select("*", every_a)


def _clipped(x: np.ndarray) -> pa.Array:
    """Integers as longs; those beyond the type's range are its nearest value."""
    return pa.array(x if x.dtype != object else [max(-_LONG - 1, min(_LONG, int(v))) for v in x], pa.int64())


def mined(df: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10, low: str = "0.3", high: str = "0.9", id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", scale: int = 256, relabel: int = 7, labels: int = 10) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): hard negatives of anchors and their positives.

    Anchors are rows whose id is divisible by `every`. An anchor's positives are the first `positives` other rows of its
    label by integer inner product; for each, the first `negatives` rows of another label whose product is between `low` and
    `high` times the positive's are returned. Ties go to the smaller id. Exact: the bounds discard only what cannot count.

    Rows that take part are those of `summarized`. Vectors of different lengths are filled up with zeros. Anchors of fewer
    positives, and positives of fewer negatives, return what they have, or no row. Products beyond a long's range are
    compared as they are and returned as the nearest long. An empty table gives no rows. Other columns are not read.
    """
    rows = summarized(df, id_col, label_col, vector_col, scale, relabel, labels)
    anchors = rows.where(F.col("id") % every == 0)
    least, most = Fraction(low), Fraction(high)
    left, right = _dealt(rows, anchors)
    owner = "anchor_id long, anchor_tie long"

    def alike(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["anchor_id", "anchor_tie", "score", "id", "tie"]
        found, ids, ties = _none(), np.empty(0, np.int64), np.empty(0, np.int64)
        if a.num_rows and b.num_rows:
            width = _width(a, b)
            sides = _side(a, width), _side(b, width)
            found, ids, ties = nearest_alike(*sides, positives), sides[0].ids, sides[0].tie
        return pa.table([pa.array(ids[found[0]]), pa.array(ties[found[0]]), _clipped(found[1]), pa.array(found[2]), pa.array(found[3])], names)

    met = left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(alike, f"{owner}, score long, id long, tie long")
    order = Window.partitionBy("anchor_id", "anchor_tie").orderBy(F.col("score").desc(), "id", "tie")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    best = written(best.select("anchor_id", "anchor_tie", F.struct("rank", "id", "tie", "score").alias("p")), "positives")
    windows = best.groupBy("anchor_id", "anchor_tie").agg(F.sort_array(F.collect_list("p")).alias("p"))  # `positives` at most
    asked = anchors.join(windows.select(F.col("anchor_id").alias("id"), F.col("anchor_tie").alias("tie"), "p"), ["id", "tie"])
    left, right = _dealt(rows, written(asked, "anchors"))

    def different(a: pa.Table, b: pa.Table) -> pa.Table:
        names = ["anchor_id", "anchor_tie", "positive_id", "positive_tie", "positive_score", "score", "id", "tie"]
        if not (a.num_rows and b.num_rows):
            return pa.table([pa.array([], pa.int64())] * len(names), names)
        width = _width(a, b)
        sides = _side(a, width), _side(b, width)
        lists = a["p"].combine_chunks()
        own = np.repeat(np.arange(a.num_rows), np.diff(lists.offsets.to_numpy()))
        pos = lists.flatten()
        p_id, p_tie, p_score = (pos.field(c).to_numpy() for c in ("id", "tie", "score"))
        exact = p_score.astype(object)
        floor = np.array([-(-s * least.numerator // least.denominator) for s in exact], np.int64)
        ceil = np.array([s * most.numerator // most.denominator for s in exact], np.int64)
        found = best_within(*sides, own, floor, ceil, negatives)
        w = found[0]
        columns = (sides[0].ids[own[w]], sides[0].tie[own[w]], p_id[w], p_tie[w], p_score[w])
        return pa.table([*(pa.array(c) for c in columns), _clipped(found[1]), pa.array(found[2]), pa.array(found[3])], names)

    met = left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(different, f"{owner}, positive_id long, positive_tie long, positive_score long, score long, id long, tie long")
    order = Window.partitionBy("anchor_id", "anchor_tie", "positive_id", "positive_tie").orderBy(F.col("score").desc(), "id", "tie")
    ranked = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


#: The query's result in DuckDB, by all products of anchors and rows.
ORACLE = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS alike, list_dot_product(a.v, b.v)::BIGINT AS s FROM e AS a JOIN e AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT a, b, s FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b)::INT AS rank, s.b AS negative_id, p.s AS positive_score, s.s AS negative_score
FROM p JOIN s ON p.a = s.a AND NOT s.alike AND 30 * p.s <= 100 * s.s AND 100 * s.s <= 90 * p.s QUALIFY rank <= 10
"""
