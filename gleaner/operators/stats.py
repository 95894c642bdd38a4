"""Counts, profiles and health figures over record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.sources.tables import staged

#: Rows of a range up to which its values are put in order, and ranges that a larger one is cut into.
RANGE_ROWS, RANGES = 65_536, 1024


def pass_summary(df: DataFrame, passed: str) -> DataFrame:
    """One row: total, processed (a verdict is there), passed, failed and pass_rate in per cent of the processed, 0 for none."""
    n = F.count(passed)
    ok = F.count_if(passed)
    return df.agg(F.count("*").alias("total"), n.alias("processed"), ok.alias("passed"), (n - ok).alias("failed"), F.when(n > 0, F.round(100.0 * ok / n, 1)).otherwise(F.lit(0.0)).alias("pass_rate"))


def reason_histogram(df: DataFrame, reason: str) -> DataFrame:
    """Rows per reason, most first, with their share of all rows."""
    counts = df.groupBy(reason).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6)).orderBy(F.col("n").desc(), reason)


def _logarithm(v: Column) -> Column:
    """A number that rises with v, by its sign and the logarithm of its size."""
    size = F.log2(F.abs(v)) + 1075  # 1 at least for the least number above 0
    return F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0.0))


def quantiles(df: DataFrame, value: str | Column, shares: list[float], keys: list[str] | None = None) -> DataFrame:
    """(keys, q): per group the interpolated quantiles of a value, in the order of `shares`; exact. Nulls and NaN are left out.

    Rows are counted by ranges of the value, and only the range that holds a rank is gone into: counted by finer ranges while
    it has many rows, then put in order. So no task holds a group's values, and a hot group is summed up before any shuffle.
    Ranges are of equal width in the value and, in every other round, in its logarithm, so values of any spread take few rounds.
    """
    keys = keys or []
    names = [f"_k{i}" for i in range(len(keys))]
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], v.alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    whole = rows.groupBy(*names).agg(F.count("*").alias("rows"), F.min("v").alias("low"), F.max("v").alias("high")).where("rows > 0")
    at = F.col("s") * (F.col("rows") - 1)
    wanted = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)])).alias("w")
    asked = whole.select(*names, "rows", "low", "high", wanted).select(*names, "rows", "low", "high", "w.i", "w.s")
    ends = F.explode(F.array(F.struct(F.lit(0).alias("end"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("end"), F.ceil(at).alias("rank")))).alias("e")
    targets = asked.select(*names, "i", "rows", "low", "high", (at - F.floor(at)).alias("part"), ends).select(*names, "i", "rows", "low", "high", "part", "e.end", "e.rank")
    targets = staged(targets, "targets")

    def same(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
        other = b.select(*[F.col(c).alias(f"_{c}") if c in columns else F.col(c) for c in b.columns])
        on = F.lit(True)
        for c in columns:
            on = on & F.col(c).eqNullSafe(F.col(f"_{c}"))
        return a.join(other, on).drop(*[f"_{c}" for c in columns])

    turn = 0
    while True:
        many = (F.col("rows") > RANGE_ROWS) & (F.col("low") < F.col("high"))
        wide = targets.where(many)
        if not wide.limit(1).count():
            break
        inside = same(rows, wide.select(*names, "low", "high").distinct(), names).where("v >= low AND v <= high")
        to = _logarithm if turn % 2 else lambda c: c / 2  # halves, so that no difference is infinite
        place = (to(F.col("v")) - to(F.col("low"))) / (to(F.col("high")) - to(F.col("low"))) * RANGES
        # the ends are told by value, also where they are infinite or too near to be divided
        inner = F.when(F.isnan(place) | place.isNull(), F.lit(1)).otherwise(F.greatest(F.least(F.floor(place), F.lit(RANGES - 2)), F.lit(1)))
        cut = F.when(F.col("v") == F.col("low"), F.lit(0)).when(F.col("v") == F.col("high"), F.lit(RANGES - 1)).otherwise(inner)
        turn += 1
        counts = inside.groupBy(*names, "low", "high", cut.alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = Window.partitionBy(*names, "low", "high").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)  # RANGES rows
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
        found = same(wide, counts, [*names, "low", "high"]).where("before <= rank AND rank < before + n")
        finer = found.select(*names, "i", F.col("n").alias("rows"), F.col("least").alias("low"), F.col("most").alias("high"), "part", "end", (F.col("rank") - F.col("before")).alias("rank"))
        targets = staged(targets.where(~many).unionByName(finer), "targets")

    few = targets.where("low < high")
    values = same(rows, few.select(*names, "low", "high").distinct(), names).where("v >= low AND v <= high").groupBy(*names, "low", "high", "v").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*names, "low", "high").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # RANGE_ROWS rows
    values = values.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = same(few, values, [*names, "low", "high"]).where("before <= rank AND rank < before + n").select(*names, "i", "end", "part", "v")
    found = found.unionByName(targets.where("low = high").select(*names, "i", "end", "part", F.col("low").alias("v")))
    low, high = F.max(F.when(F.col("end") == 0, F.col("v"))), F.max(F.when(F.col("end") == 1, F.col("v")))
    each = found.groupBy(*names, "i").agg((low * (1 - F.max("part")) + high * F.max("part")).alias("q"))
    out = each.groupBy(*names).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))
    return out.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "q")


def distribution(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Mean, population deviation, extremes and interpolated quartiles of a value."""
    keys, v = keys or [], F.col(value)
    sums = df.groupBy(*keys).agg(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"))
    q = quantiles(df, value, [0.25, 0.75], keys)
    q = q.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)], F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(1)).alias("p75"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_{i}"))
    return sums.join(q, on, "left").select(*keys, "mean", "std", "min", "max", "p25", "p75")


def group_entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shannon entropy in bits of the values of each group."""
    counts = df.groupBy(*keys, value).agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n")
    return counts.groupBy(*keys).agg((F.log2(total) - F.sum(F.col("n") * F.log2("n")) / total).alias("entropy"))


def size_histogram(df: DataFrame, size: Column, edges: list[int]) -> DataFrame:
    """Rows and share per half-open bucket [edge, next edge); below the first and from the last on as well."""
    label = F.lit(f">={edges[-1]}")
    for low, high in zip(reversed(edges[:-1]), reversed(edges[1:]), strict=True):
        label = F.when(size < high, f"{low}-{high}").otherwise(label)
    label = F.when(size < edges[0], f"<{edges[0]}").otherwise(label)
    counts = df.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def upper_median(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """The element at n // 2 of the sorted values (the upper one of an even number), with mean and extremes.

    Values are counted first; the element is the least value with more than n // 2 rows at or below it.
    """
    keys = keys or []
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("n").over(upto)).withColumn("total", F.sum("n").over(Window.partitionBy(*keys)))
    middle = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col(value)))
    return ranked.groupBy(*keys).agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), middle.alias("median"), F.min(value).alias("least"), F.max(value).alias("most"))


def target_size(df: DataFrame, side: Column, percent: float = 95, step: int = 64, otherwise: int = 1024) -> DataFrame:
    """One row: a percentile of the longer side, up to a multiple of `step`."""
    p = quantiles(df, side, [percent / 100]).agg(F.max(F.get("q", F.lit(0))).alias("p"))  # one row, also for no rows
    return p.select(F.coalesce((F.ceil(F.col("p") / step) * step).cast("long"), F.lit(otherwise).cast("long")).alias("target"))


def learning_health(df: DataFrame) -> DataFrame:
    """Per run: ratio of the mean losses of val and train, their gap, and train over val; null where a loss is not positive."""
    by = df.groupBy("run").pivot("phase", ["train", "val"]).agg(F.avg("total"))
    t, v = F.col("train"), F.col("val")
    return by.select("run", F.when(t > 0, v / t).alias("loss_ratio"), (t - v).alias("gap"), F.when(v > 0, t / v).alias("generalisation"))


def loss_ratios(df: DataFrame, components: list[str], total: str = "total") -> DataFrame:
    """Long form: each component that is not 0, as a share of a positive total."""
    stacked = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("value")) for c in components]))
    rows = df.where(F.col(total) > 0).withColumn("_c", stacked)
    return rows.where(F.col("_c.value") != 0).select("run", "step", F.col("_c.component").alias("component"), (F.col("_c.value") / F.col(total)).alias("ratio"))


def score_diagnostics(cells: DataFrame, group: str, position: list[str], score: str, floor: float = 0.1) -> DataFrame:
    """One row: mean of groups' maxima and means, deviation, share of positions ever above the floor, and percentiles."""
    per = cells.groupBy(group).agg(F.max(score).alias("mx"), F.avg(score).alias("mn"))
    rows = per.agg(F.avg("mx").alias("mean_max"), F.avg("mn").alias("mean_mean"))
    places = cells.groupBy(*position).agg(F.bool_or(F.col(score) > floor).alias("ever")).agg((F.count_if("ever") / F.count("*")).alias("active_share"))
    p = quantiles(cells, score, [0.5, 0.9, 0.99]).agg(F.first("q").alias("p"))  # one row, also for no cells
    whole = cells.agg(F.stddev_pop(score).alias("std"))
    return rows.join(places).join(whole).join(p).select("mean_max", "mean_mean", "std", "active_share", F.get("p", F.lit(0)).alias("p50"), F.get("p", F.lit(1)).alias("p90"), F.get("p", F.lit(2)).alias("p99"))  # one row each
