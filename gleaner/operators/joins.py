"""Joins between records, annotations and files. None sends a side whole to all tasks unless its size is bounded; sizes are Spark's to judge."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.functions import boxes as B
from gleaner.sources.tables import staged


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest `order` of each key."""
    row = F.max_by(F.struct(*df.columns), F.col(order)).alias("_r")
    return df.groupBy(F.col(key).alias("_key")).agg(row).select("_r.*")


def pair_by_stem(images: DataFrame, masks: DataFrame, order: str, mark: str = "_mask") -> DataFrame:
    """Images (stem, ...) with the path of the mask of the same stem, else of stem + mark; images without one are left out.

    Of several masks of a stem the last by `order` counts.
    """
    known = last_per_key(masks, "stem", order).select(F.col("stem").alias("_s"), F.col("path").alias("_p"))
    marked = known.select(F.col("_s").alias("_t"), F.col("_p").alias("_q"))
    both = images.join(known, F.col("stem") == F.col("_s"), "left").join(marked, F.concat("stem", F.lit(mark)) == F.col("_t"), "left")
    return both.withColumn("mask_path", F.coalesce("_p", "_q")).where(F.col("mask_path").isNotNull()).drop("_s", "_p", "_t", "_q")


def attach(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of `left` with the columns of `right`, null where there is no match."""
    return left.join(right, keys, "left")


def assemble(boxes: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Boxes with a `skip_reason`: no_verdict, not_passed or no_points, else null."""
    joined = boxes.join(verdicts, key, "left")
    reason = F.when(F.col("passed").isNull(), "no_verdict").when(~F.col("passed"), "not_passed").when(F.col("points").isNull(), "no_points")
    return joined.withColumn("skip_reason", reason)


def attach_text(stems: DataFrame, lookup: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Stems with the last text of their key; those without a text are left out."""
    known = last_per_key(lookup, key, order).where(F.length(F.trim(text)) > 0).select(key, text)
    return stems.join(known, key)


def overlapping_pairs(df: DataFrame, group: str, key: str, threshold: float) -> DataFrame:
    """Pairs (i < j) of boxes of a group with an IoU of `threshold` or more.

    Groups of a few boxes are paired as they are. Boxes of larger ones are also filed in squares of a grid, so that such a
    group is not paired whole: a pair meets in the square that holds the upper left corner of its intersection.
    """
    a = df.select(F.col(group).alias("g"), F.col(key).alias("k"), *B.Box.of())
    b = a.select("g", F.col("k").alias("j"), *[F.col(c).alias(f"{c}_b") for c in B.Box._fields])
    met = _met(a, b, _crowded(a)).where(F.col("k") < F.col("j"))
    return met.select(F.col("g").alias(group), F.col("k").alias("i"), "j", _iou().alias("iou")).where(F.col("iou") >= threshold)


#: Boxes of a group, on one side at least, up to which it is paired without squares.
PAIRED_ROWS = 64


def _crowded(rows: DataFrame) -> DataFrame | None:
    """Groups (g) of more than PAIRED_ROWS rows, if there are any."""
    many = staged(rows.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > PAIRED_ROWS).select("g"), "crowded")
    return many if many.limit(1).count() else None


def _met(left: DataFrame, right: DataFrame, crowded: DataFrame | None) -> DataFrame:
    """Boxes with an area beside those of the same group on the right (suffix `_b`): all, in crowded groups those whose intersection begins in a square that both reach.

    Few rows of the left meet each row of a group that is not crowded, so these pairs grow as the rows.
    """
    left = left.where((F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2"))).withColumn("area", B.Box.of().area)
    right = right.where((F.col("x1_b") < F.col("x2_b")) & (F.col("y1_b") < F.col("y2_b"))).withColumn("area_b", B.Box.of(suffix="_b").area)
    if crowded is None:
        return left.join(right, "g")
    filed = [_in_squares(rows.join(crowded, "g", "left_semi"), suffix) for rows, suffix in ((left, ""), (right, "_b"))]
    in_squares = filed[0].join(filed[1], ["g", "gy", "gx"]).where(_meeting_square()).drop("gy", "gx")
    return left.join(crowded, "g", "left_anti").join(right, "g").unionByName(in_squares)


def _iou() -> Column:
    """As `boxes.iou` of boxes that `_met` brings together, in so few terms that a join's loop is still compiled."""
    side = lambda low, high: F.greatest(F.least(high, f"{high}_b") - F.greatest(low, f"{low}_b"), F.lit(0))
    inter = side("x1", "x2") * side("y1", "y2")
    return inter / (F.col("area") + F.col("area_b") - inter)


#: Side of the squares that boxes are filed in.
SQUARE = 256


def _in_squares(rows: DataFrame, suffix: str = "") -> DataFrame:
    """Boxes with an area, a row for each square (gy, gx) that they reach into."""
    reach = lambda low, high: F.explode(F.sequence(F.floor(F.col(low + suffix) / SQUARE), F.floor((F.col(high + suffix) - 1) / SQUARE)))
    return rows.withColumn("gy", reach("y1", "y2")).withColumn("gx", reach("x1", "x2"))


def _meeting_square() -> Column:
    """Whether a square holds the upper left corner of the intersection of a box and one with the suffix `_b`."""
    return (F.floor(F.greatest("y1", "y1_b") / SQUARE) == F.col("gy")) & (F.floor(F.greatest("x1", "x1_b") / SQUARE) == F.col("gx"))


def skip_processed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def require_existing(df: DataFrame, listing: DataFrame, columns: list[str]) -> DataFrame:
    """Rows all of whose named paths are in the listing (column `path`)."""
    for c in columns:
        df = df.join(listing.select(F.col("path").alias("_p")), F.col(c) == F.col("_p"), "left_semi")
    return df


def collect_by_parent(children: DataFrame, parents: DataFrame | None, key: str, label: str, accepted: list[str], rejected: list[str]) -> DataFrame:
    """Children with `outcome`: kept, diverted or dropped by their parent's label; without a parent table all are kept."""
    if parents is None:
        return children.withColumn("outcome", F.lit("kept"))
    joined = children.join(parents.select(key, F.col(label).alias("_l")), key, "left")
    return joined.withColumn("outcome", F.when(F.col("_l").isin(accepted), "kept").when(F.col("_l").isin(rejected), "diverted").otherwise("dropped")).drop("_l")


#: Pairs of a group up to which one task settles it.
PASS_PAIRS = 100_000


def match_greedy(pred: DataFrame, truth: DataFrame, group: str, threshold: float = 0.5, pass_pairs: int = PASS_PAIRS) -> DataFrame:
    """One-to-one matches (i predicted, j true, iou) per group: the best IoU first (ties: lower i, then j), none below the threshold.

    Boxes meet in their group, in large ones in squares, as in `overlapping_pairs`. A pair that is the best of both its boxes is a match whatever else is
    chosen, so all such pairs are taken at once, what shares a box with them goes, and the rest has new best pairs: the same
    matches as one pass over all pairs, in few rounds. Groups of up to `pass_pairs` pairs are settled within a task, side by
    side in numpy; larger ones in rounds of Spark, so that their pairs can be split.
    """
    p = pred.select(F.col(group).cast("long").alias("g"), F.col("box_id").cast("long").alias("i"), *B.Box.of())
    t = truth.select(F.col(group).cast("long").alias("g"), F.col("box_id").cast("long").alias("j"), *[F.col(c).alias(f"{c}_b") for c in B.Box._fields])
    pairs = _met(p, t, _crowded(p)).select("g", "i", "j", _iou().alias("iou")).where((F.col("iou") >= threshold) if threshold > 0 else (F.col("iou") > 0))
    pairs = staged(pairs, "pairs")
    large = staged(pairs.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > pass_pairs).select("g"), "large")
    some = large.limit(1).count() > 0
    small = pairs.join(large, "g", "left_anti") if some else pairs
    found = small.repartition("g").sortWithinPartitions("g").mapInArrow(_settled, pairs.schema)
    if some:
        found = found.unionByName(_settled_in_rounds(pairs.join(large, "g", "left_semi")))
    return found.withColumnRenamed("g", group)


def _codes(*columns: np.ndarray) -> np.ndarray:
    """A number for each different row."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), np.int64)
    for c in columns:
        new[1:] |= c[order][1:] != c[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches of complete groups, all groups at hand side by side; groups come one after the other."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        g = table["g"].to_numpy()
        whole = int(np.searchsorted(g, g[-1], "left")) if len(g) else 0  # the last group may go on
        yield from _matches(table.slice(0, whole))
        rest = table.slice(whole)
    if rest is not None:
        yield from _matches(rest)


def _matches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    g, i, j, iou = (table[c].to_numpy() for c in ("g", "i", "j", "iou"))
    own, other = _codes(g, i), _codes(g, j)
    open_ = np.lexsort((j, i, -iou))  # best first
    free = np.ones(len(g), bool), np.ones(len(g), bool)
    taken: list[np.ndarray] = []
    while len(open_):
        firsts = (np.unique(code[open_], return_index=True)[1] for code in (own, other))
        both = open_[np.intersect1d(*firsts, assume_unique=True)]
        taken.append(both)
        free[0][own[both]] = False
        free[1][other[both]] = False
        open_ = open_[free[0][own[open_]] & free[1][other[open_]]]
    if taken:
        yield from table.take(pa.array(np.sort(np.concatenate(taken)))).combine_chunks().to_batches()


def _settled_in_rounds(pairs: DataFrame) -> DataFrame:
    """As `_matches`, by aggregation and joins: a round for each step of the longest chain of pairs that wait for a better one."""
    left, taken = staged(pairs, "open"), None
    while left.limit(1).count():
        order = F.struct(F.col("iou").alias("v"), (-F.col("i")).alias("i"), (-F.col("j")).alias("j"))
        best = {c: left.groupBy("g", c).agg(F.max(order).alias("b")).select("g", (-F.col("b.i")).alias("i"), (-F.col("b.j")).alias("j")) for c in "ij"}
        now = staged(left.join(best["i"].intersect(best["j"]), ["g", "i", "j"], "left_semi").select("g", "i", "j", "iou"), "matches")
        taken = now if taken is None else taken.unionByName(now)
        left = staged(left.join(now.select("g", "i"), ["g", "i"], "left_anti").join(now.select("g", "j"), ["g", "j"], "left_anti"), "open")
    return pairs if taken is None else taken.select("g", "i", "j", "iou")


def apply_once(df: DataFrame, column: str, f) -> DataFrame:
    """`df` with `f(distinct texts)` joined back: each distinct text is worked on once. `f` takes and returns a DataFrame keyed by `text`."""
    done = f(df.select(F.col(column).alias("text")).where("text IS NOT NULL").distinct())
    named = done.select(*[F.col(c).alias(f"{column}_{c}" if c != "text" else "_t") for c in done.columns])
    return df.join(named, F.col(column) == F.col("_t"), "left").drop("_t")


def compare_runs(runs: DataFrame, key: str, run: str, metric: str, names: list[str]) -> DataFrame:
    """A row per sample with each run's metric; samples that a run lacks are left out."""
    wide = runs.groupBy(key).pivot(run, names).agg(F.first(metric))
    return wide.dropna(subset=names)


def lookup(df: DataFrame, ids: DataFrame, key: str, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Rows of `df` for a list of ids (key, position), in that order: with defaults, missing ids stay and take them; else they go."""
    out = ids.join(df, key, "inner" if defaults is None else "left")
    for c, value in (defaults or {}).items():
        out = out.withColumn(c, F.coalesce(F.col(c), value))
    return out.orderBy("position")


def first_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
