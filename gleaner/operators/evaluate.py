"""Evaluation of predictions: overlap, ranking, detection and edge metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.operators import grids, ordering


def quality_band(iou: Column, good: float = 0.7, bad: float = 0.4) -> Column:
    return F.when(iou >= good, "good").when(iou >= bad, "medium").otherwise("bad")


def binarized(df: DataFrame, group: str, score: str, threshold: float) -> DataFrame:
    """Adds `on`: score above the threshold, after a sigmoid in groups whose scores leave [-0.5, 1.5]."""
    logits = (F.min(score) < -0.5) | (F.max(score) > 1.5)
    return ordering.with_sums(df, [group], logits.alias("_l")).withColumn("on", F.when(F.col("_l"), 1 / (1 + F.exp(-F.col(score)))).otherwise(F.col(score)) > threshold).drop("_l")


def _share(a: Column, b: Column, empty: float) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(empty))


def overlap(cells: DataFrame, pred: str, truth: str, empty: float = 1.0) -> DataFrame:
    """IoU and Dice of two masks per grid; `empty` where neither has a cell."""
    p, t = F.col(pred), F.col(truth)
    sums = cells.groupBy("grid_id").agg(F.count_if(p & t).alias("i"), F.count_if(p | t).alias("u"), F.count_if(p).alias("np"), F.count_if(t).alias("nt"))
    return sums.select("grid_id", _share(F.col("i"), F.col("u"), empty).alias("iou"), _share(2 * F.col("i"), F.col("np") + F.col("nt"), empty).alias("dice"))


def _twos(n: Column) -> Column:
    return n * (n - 1) / 2


def adjusted_rand(rows: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings per group, from their contingency table; 1 where both put all rows in one class."""
    table = rows.groupBy(group, a, b).agg(F.count("*").alias("n"))
    wa = table.groupBy(group, a).agg(F.sum("n").alias("n")).groupBy(group).agg(F.sum(_twos(F.col("n"))).alias("sa"))
    wb = table.groupBy(group, b).agg(F.sum("n").alias("n")).groupBy(group).agg(F.sum(_twos(F.col("n"))).alias("sb"))
    whole = table.groupBy(group).agg(F.sum(_twos(F.col("n"))).alias("s"), F.sum("n").alias("total"))
    joined = whole.join(wa, group).join(wb, group)
    pairs = _twos(F.col("total"))
    expected = F.col("sa") * F.col("sb") / F.when(pairs > 0, pairs)
    top = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(pairs <= 0, F.lit(1.0)).when(top == expected, F.lit(1.0)).otherwise((F.col("s") - expected) / (top - expected))
    return joined.select(group, ari.alias("ari"))


def sample_metrics(cells: DataFrame, pred_a: str, pred_b: str, true_a: str, true_b: str) -> DataFrame:
    """Seven metrics per grid: iou and dice of both masks and their means, and ari of three classes (b over a over rest).

    Predicted masks are exchanged where that gives a strictly better mean IoU.
    """
    c = {n: F.col(x) for n, x in (("pa", pred_a), ("pb", pred_b), ("ta", true_a), ("tb", true_b))}
    sums = cells.groupBy("grid_id").agg(
        *[F.count_if(c[n]).alias(n) for n in c],
        *[F.count_if(c[p] & c[t]).alias(f"i_{p}{t}") for p in ("pa", "pb") for t in ("ta", "tb")],
        *[F.count_if(c[p] | c[t]).alias(f"u_{p}{t}") for p in ("pa", "pb") for t in ("ta", "tb")],
    )

    def iou(p: str, t: str) -> Column:
        return _share(F.col(f"i_{p}{t}"), F.col(f"u_{p}{t}"), 1.0)

    def dice(p: str, t: str) -> Column:
        return _share(2 * F.col(f"i_{p}{t}"), F.col(p) + F.col(t), 1.0)

    sums = sums.withColumn("swapped", iou("pb", "ta") + iou("pa", "tb") > iou("pa", "ta") + iou("pb", "tb"))
    pick = lambda f, t: F.when(F.col("swapped"), f("pb" if t == "ta" else "pa", t)).otherwise(f("pa" if t == "ta" else "pb", t))
    out = sums.select("grid_id", "swapped", pick(iou, "ta").alias("iou_a"), pick(iou, "tb").alias("iou_b"), pick(dice, "ta").alias("dice_a"), pick(dice, "tb").alias("dice_b"))
    out = out.withColumn("mean_iou", (F.col("iou_a") + F.col("iou_b")) / 2).withColumn("mean_dice", (F.col("dice_a") + F.col("dice_b")) / 2)
    classes = cells.join(out.select("grid_id", "swapped"), "grid_id")
    a, b = F.when(F.col("swapped"), c["pb"]).otherwise(c["pa"]), F.when(F.col("swapped"), c["pa"]).otherwise(c["pb"])
    classes = classes.select("grid_id", F.when(b, 2).when(a, 1).otherwise(0).alias("p"), F.when(c["tb"], 2).when(c["ta"], 1).otherwise(0).alias("t"))
    return out.join(adjusted_rand(classes, "grid_id", "p", "t"), "grid_id").drop("swapped")


def improvement(base: Column, new: Column, least: float = 1e-8) -> tuple[Column, Column]:
    """Difference, and per cent of the base rounded to 2 places; 0 per cent for a base near 0."""
    delta = new - base
    return delta, F.when(F.abs(base) > least, F.round(100 * delta / base, 2)).otherwise(F.lit(0.0))


def detection_metrics(images: DataFrame) -> DataFrame:
    """Means over images of recall, precision, matched IoU and confidence, from a row of counts per image."""
    per = images.select(
        (F.col("matched") / F.greatest(F.col("n_gt"), F.lit(1))).alias("recall"),
        (F.col("matched") / F.greatest(F.col("n_pred"), F.lit(1))).alias("precision"),
        F.when(F.col("matched") > 0, F.col("iou_sum") / F.col("matched")).otherwise(F.lit(0.0)).alias("mean_iou"),
        "max_confidence",
        "mean_confidence",
    )
    return per.agg(F.count("*").alias("images"), *[F.avg(c).alias(c) for c in per.columns])


def ranked_counts(df: DataFrame, score: str, matched: str, key: str) -> DataFrame:
    """Adds rank, tp and fp, counted down the ranking by score (ties by key).

    Rows are dealt by sampled ranges of the ranking: totals of the ranges before are joined to running counts within, so
    that no task holds the whole ranking.
    """
    rows = ordering.in_ranges(df, [-F.col(score), F.col(key)])
    hit = F.col(matched).cast("long")
    sums = ordering.before(rows.groupBy("_range").agg(F.count("*").alias("n"), F.sum(hit).alias("h")), ["n", "h"])
    upto = Window.partitionBy("_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.join(sums, F.col("_range") == F.col("_of_range"))
    out = out.withColumn("rank", F.col("_n") + F.col("_place") + 1).withColumn("tp", F.col("_h") + F.sum(hit).over(upto))
    return out.withColumn("fp", F.col("rank") - F.col("tp")).drop("_range", "_place", "_of_range", "_n", "_h")


def average_precision(ranked: DataFrame, n_truth: int, points: int = 101) -> DataFrame:
    """Mean over recall levels of the best precision at that recall or beyond, from `ranked_counts`; one row, `ap`.

    Rows are summed up by the highest level that they reach before levels look for their best, so the join is of `points` rows.
    """
    recall, precision = F.col("tp") / n_truth if n_truth else F.lit(0.0), F.col("tp") / F.col("rank")
    level = F.floor(recall * (points - 1) + 1e-9).cast("int")
    best = ranked.groupBy(level.alias("level")).agg(F.max(precision).alias("p"))
    levels = ranked.sparkSession.range(points).select(F.col("id").cast("int").alias("at"))
    beyond = levels.join(F.broadcast(best), F.col("level") >= F.col("at"), "left").groupBy("at").agg(F.coalesce(F.max("p"), F.lit(0.0)).alias("p"))
    return beyond.agg(F.avg("p").alias("ap"))


def pr_sweep(scores: DataFrame, truth: DataFrame, thresholds: list[float], distance: float) -> DataFrame:
    """Per grid and threshold (index t): tp, fp, fn, precision, recall, f of cells with score >= threshold, matched within the distance.

    `thresholds` ascend. Cells are matched once: whether one has a true cell near does not depend on the threshold, and a
    true cell is hit up to the highest score near it. Cells are then counted by the number of thresholds that they reach.
    """
    cuts = F.array(*[F.lit(float(x)) for x in thresholds])
    reached = scores.withColumn("k", F.size(F.filter(cuts, lambda c: c <= F.col("score")))).where("k > 0").select("grid_id", "y", "x", "k")
    zero = F.lit(0)
    sides = [
        reached.select("grid_id", "k", F.lit(1).alias("pred"), zero.alias("near"), zero.alias("hit")),
        grids.within(reached, truth, distance).select("grid_id", "k", zero, F.lit(1), zero),
        grids.best_within(truth, reached, distance, "k").select("grid_id", "k", zero, zero, F.lit(1)),
    ]
    every = sides[0].union(sides[1]).union(sides[2])
    sums = every.groupBy("grid_id", "k").agg(*[F.sum(c).alias(c) for c in ("pred", "near", "hit")])
    # a grid without a true cell, or without a prediction at some threshold, still has counts of zero there
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(float(x)).alias("cut")) for i, x in enumerate(thresholds)]))
    ids = scores.select("grid_id").distinct().withColumn("_s", steps).select("grid_id", F.col("_s.t").alias("t"), F.col("_s.cut").alias("threshold"))
    full = ids.join(sums.withColumn("t", F.col("k") - 1), ["grid_id", "t"], "left").join(truth.groupBy("grid_id").agg(F.count("*").alias("true")), "grid_id", "left")
    above = Window.partitionBy("grid_id").orderBy(F.col("t").desc()).rowsBetween(Window.unboundedPreceding, 0)  # a row per threshold
    at = {c: F.coalesce(F.sum(c).over(above), zero) for c in ("pred", "near", "hit")}
    tp = at["near"].alias("tp")
    return with_prf(full.select("grid_id", "t", "threshold", tp, (at["pred"] - at["near"]).alias("fp"), (F.coalesce("true", zero) - at["hit"]).alias("fn")))


def with_prf(df: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = df.withColumn("precision", _share(tp, tp + fp, 0.0)).withColumn("recall", _share(tp, tp + fn, 0.0))
    both = F.col("precision") + F.col("recall")
    return out.withColumn("f", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(F.lit(0.0)))


def ods_ois_ap(sweep: DataFrame) -> DataFrame:
    """One row: best f over thresholds of summed counts (ods), mean of images' best f (ois), area under precision by recall (ap)."""
    total = with_prf(sweep.groupBy("t", "threshold").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")]))
    top = F.max_by(F.struct(F.col("f").alias("ods_f"), F.col("precision").alias("ods_p"), F.col("recall").alias("ods_r"), F.col("threshold").alias("ods_threshold")), F.struct("f", (-F.col("t")).alias("_")))
    ods = total.agg(top.alias("o")).select("o.*")
    best = sweep.groupBy("grid_id").agg(F.max_by(F.struct("f", "precision", "recall"), F.struct("f", (-F.col("t")).alias("_"))).alias("b"))
    ois = best.agg(F.avg("b.f").alias("ois_f"), F.avg("b.precision").alias("ois_p"), F.avg("b.recall").alias("ois_r"))
    order = Window.orderBy("recall", "t")  # one row per threshold
    edge = total.select("t", "recall", "precision", F.lag("recall").over(order).alias("r0"), F.lag("precision").over(order).alias("p0"))
    area = (F.col("recall") - F.coalesce("r0", F.lit(0.0))) * (F.col("precision") + F.coalesce("p0", "precision")) / 2
    ap = edge.agg(F.least(F.greatest(F.sum(area), F.lit(0.0)), F.lit(1.0)).alias("ap"))
    return ods.join(ois).join(ap)  # one row each
