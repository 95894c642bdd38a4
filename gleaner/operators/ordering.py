"""Ordered operators: windows, ranks, splits and samples.

A window without a partition would put all rows into one task. Where a global order is meant, rows are dealt by sampled
ranges of the order instead, numbered within each range, and moved up by the counts of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.sources.tables import staged


def in_ranges(df: DataFrame, order: list[Column]) -> DataFrame:
    """`df`, written in an order, with the number of a row's range (`_range`) and its place there from 0 (`_place`).

    Ranges are of about equal size whatever the values are: their edges come from a sample. Give columns that tell rows apart, so that
    rows of one value need not share a range. The table is written, as ranges must not be drawn anew.
    """
    columns = {f"_o{k}": c for k, c in enumerate(order)}
    dealt = df.withColumns(columns).repartitionByRange(*[F.col(c).asc_nulls_first() for c in columns])
    place = F.monotonically_increasing_id()  # the range's number in the upper bits, the place in the lower 33
    rows = dealt.sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in columns]).withColumn("_m", place)
    rows = rows.select(*df.columns, F.shiftright("_m", 33).alias("_range"), F.col("_m").bitwiseAND((1 << 33) - 1).alias("_place"))
    return staged(rows, "ranges")


def before(sizes: DataFrame, totals: list[str]) -> DataFrame:
    """Sums of each total over the ranges before, as `_<name>`; a row per range."""
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select(F.col("_range").alias("_of_range"), *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"_{c}") for c in totals])


def numbered(df: DataFrame, order: Column | list[Column], ties: list[str], name: str = "n") -> DataFrame:
    """`df` with a row number from 1 in the order of one or more columns (nulls first), ties by the columns named."""
    rows = in_ranges(df, [*(order if isinstance(order, list) else [order]), *[F.col(t) for t in ties]])
    sizes = before(rows.groupBy("_range").agg(F.count("*").alias("c")), ["c"])
    return rows.join(sizes, F.col("_range") == F.col("_of_range")).withColumn(name, F.col("_c") + F.col("_place") + 1).drop("_range", "_place", "_of_range", "_c")


def seeded(key: str, seed: int) -> Column:
    """A hash that orders rows at random, but the same way each time."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


#: Rows of a group that a window task takes.
CHUNK = 1_000_000


def chunked(df: DataFrame, keys: list[str], order: list[str], chunk: int = CHUNK) -> DataFrame:
    """`df` with each row's place in its group (`_at`, from 0, in the order) and the chunk of the group that it is in (`_c`)."""
    rows = numbered(df, [F.col(c) for c in (*keys, *order)], [], "_at")
    first = rows.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min("_at").alias("_first"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = rows.join(first, on).withColumn("_at", F.col("_at") - F.col("_first"))
    return rows.withColumn("_c", F.floor(F.col("_at") / chunk)).drop("_first", *[f"_k{i}" for i in range(len(keys))])


def rolling_mean(df: DataFrame, value: str, keys: list[str], order: list[str], n: int = 100, chunk: int = CHUNK) -> DataFrame:
    """Adds `rolling`: the mean of a row and the n - 1 before it. Chunks of a group take the last n - 1 rows of the one before with them."""
    rows = chunked(df, keys, order, max(chunk, n))
    ahead = rows.where(F.col("_at") % max(chunk, n) > max(chunk, n) - n).withColumn("_c", F.col("_c") + 1)
    both = rows.withColumn("_own", F.lit(True)).unionByName(ahead.withColumn("_own", F.lit(False)))
    w = Window.partitionBy(*keys, "_c").orderBy("_at").rowsBetween(-(n - 1), 0)
    return both.withColumn("rolling", F.avg(value).over(w)).where("_own").drop("_at", "_c", "_own")


def _carried(df: DataFrame, keys: list[str], order: list[str], totals: dict[str, Column], chunk: int) -> tuple[DataFrame, Window]:
    """Rows of `chunked` with each total over the chunks of their group before, as `_<name>`; and the window within a chunk."""
    rows = chunked(df, keys, order, chunk)
    sums = rows.groupBy(*keys, "_c").agg(*[f.alias(n) for n, f in totals.items()])
    earlier = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)  # a row per chunk
    carried = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_c").alias("_d"), *[(F.max(n) if n == "top" else F.sum(n)).over(earlier).alias(f"_{n}") for n in totals])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    joined = rows.join(carried, [*on, F.col("_c") == F.col("_d")]).drop("_d", *[f"_k{i}" for i in range(len(keys))])
    return joined, Window.partitionBy(*keys, "_c").orderBy("_at")


def running_mean(df: DataFrame, value: str, keys: list[str], order: list[str], chunk: int = CHUNK) -> DataFrame:
    """Adds `running`: the mean of a row and all before it in its group; chunks of a group carry sums and counts on."""
    rows, own = _carried(df, keys, order, {"total": F.sum(value), "many": F.count(value)}, chunk)
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    total = F.coalesce("_total", F.lit(0.0)) + F.sum(value).over(upto)
    return rows.withColumn("running", total / (F.coalesce("_many", F.lit(0)) + F.count(value).over(upto))).drop("_at", "_c", "_total", "_many")


def running_best(df: DataFrame, value: str, keys: list[str], order: list[str], chunk: int = CHUNK) -> DataFrame:
    """Adds `is_best`: strictly better than all before, and than 0; chunks of a group carry the best on."""
    rows, own = _carried(df, keys, order, {"top": F.max(value)}, chunk)
    earlier = F.max(value).over(own.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("is_best", F.col(value) > F.greatest(F.coalesce(earlier, F.lit(0.0)), F.coalesce("_top", F.lit(0.0)), F.lit(0.0))).drop("_at", "_c", "_top")


def every_nth(df: DataFrame, keys: list[str], order: list[str], spacing: int, most: int) -> DataFrame:
    """Every `spacing`-th row of each group, at most `most` of them (then at even steps); groups shorter than the spacing give none."""
    w = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_place", F.row_number().over(w) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    taken = F.ceil(F.col("_n") / spacing)
    at = F.col("_place") / spacing
    rows = rows.where((F.col("_n") >= spacing) & (F.col("_place") % spacing == 0)).withColumn("_j", at.cast("long")).withColumn("_t", taken)
    # position p of `most` even ones is the entry floor(p * taken / most)
    p = F.ceil(F.col("_j") * most / F.col("_t"))
    even = (p < most) & (F.floor(p * F.col("_t") / most) == F.col("_j"))
    return rows.where((F.col("_t") <= most) | even).drop("_place", "_n", "_j", "_t")


def with_sums(df: DataFrame, keys: list[str], *sums: Column) -> DataFrame:
    """`df` with aggregates of each row's group (null keys are a group): summed up before they are shuffled, and joined, so a hot group can be split."""
    names = [f"_g{i}" for i in range(len(keys))]
    found = df.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(*sums)
    on = F.lit(True)
    for k, n in zip(keys, names, strict=True):
        on = on & F.col(k).eqNullSafe(F.col(n))
    return df.join(found, on).drop(*names)


def minmax(df: DataFrame, value: str, keys: list[str] | None = None) -> DataFrame:
    """Adds `scaled`: (x - min) / (max - min) of the group, 1 where all are equal. Without keys, the ends are a one-row table joined to all rows."""
    lo, hi = F.min(value).alias("_lo"), F.max(value).alias("_hi")
    out = df.join(df.groupBy(*keys).agg(lo, hi), keys) if keys else df.join(F.broadcast(df.agg(lo, hi)))
    return out.withColumn("scaled", F.when(F.col("_hi") > F.col("_lo"), (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(1.0))).drop("_lo", "_hi")


def confident_top(df: DataFrame, keys: list[str], score: str, ties: list[str], floor: float = 0.3, most: int = 100) -> DataFrame:
    """Per group, rows above the floor by score, or all rows where none is; at most `most`."""
    rows = with_sums(df, keys, F.count_if(F.col(score) > floor).alias("_c")).where((F.col(score) > floor) | (F.col("_c") == 0))
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *ties)  # Spark cuts to `most` before the shuffle as well
    return rows.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_c", "_k")


def best_per_group(df: DataFrame, keys: list[str], score: str, key: str) -> DataFrame:
    """The row (key, score) of the greatest score of each group, of equal ones that of the smallest key; null scores take no part."""
    row = F.struct((-F.col(score)).alias("s"), F.col(key).alias("k"))
    best = df.groupBy(*keys).agg(F.min(F.when(F.col(score).isNotNull(), row)).alias("_r"), F.max(score).alias(score))
    return best.select(*keys, F.col("_r.k").alias(key), score)


def recent_messages(df: DataFrame, n: int, role: str, conversation: str = "conv_id", turn: str = "turn", text: str = "text", most: int = 200) -> DataFrame:
    """Of the last 2n messages of each conversation, those of a role, their text cut at `most` characters."""
    w = Window.partitionBy(conversation).orderBy(F.col(turn).desc())
    last = df.withColumn("_k", F.row_number().over(w)).where((F.col("_k") <= 2 * n) & (F.col("role") == role))
    return last.withColumn(text, F.substring(text, 1, most)).drop("_k")


def split_by_rank(df: DataFrame, rank: Column, bounds: list[tuple[str, Column]], rest: str) -> DataFrame:
    """Adds `split`: the first part whose upper bound a row's rank does not pass."""
    name = F.lit(rest)
    for part, top in reversed(bounds):
        name = F.when(rank <= top, part).otherwise(name)
    return df.withColumn("split", name)


def train_test(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """Adds `split`: test for the first max(1, int(n * fraction)) rows by a seeded hash of the key, else train."""
    n = df.count()
    return split_by_rank(numbered(df, seeded(key, seed), [key]), F.col("n"), [("test", F.lit(max(1, int(n * fraction))))], "train").drop("n")


def three_way(df: DataFrame, key: str, train: float = 0.7, val: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds `split`: train and val take whole parts of n, test the remainder."""
    n = df.count()
    a, b = int(n * train), int(n * train) + int(n * val)
    return split_by_rank(numbered(df, seeded(key, seed), [key]), F.col("n"), [("train", F.lit(a)), ("val", F.lit(b))], "test").drop("n")


def prefix_split(df: DataFrame, order: str, train_n: int, val_n: int, borrow: int = 10) -> DataFrame:
    """Adds `split`: the first rows train, the next val, the rest test. With val_n 0, up to `borrow` of the first rows are val as well as train's tail."""
    bounds = [("train", F.lit(train_n)), ("val", F.lit(train_n + val_n))] if val_n else [("train", F.lit(max(train_n - borrow, 0))), ("val", F.lit(train_n))]
    return split_by_rank(numbered(df, F.col(order), [order]), F.col("n"), bounds, "test").drop("n")


def matched_and_shuffled(df: DataFrame, key: str, prompt: str, n: int, seed: int = 7) -> DataFrame:
    """`n` rows (position, key, prompt, pair_type): rounds of rows with their own prompt and rounds with another's, in turn."""
    total = df.count()
    if not total:
        return df.select(F.lit(0).cast("long").alias("position"), key, prompt, F.lit("").alias("pair_type"))
    out = None
    for r in range(-(-n // total)):
        base = numbered(df.select(key, prompt), seeded(key, seed + 2 * r), [key], "position")
        if r % 2:
            other = numbered(df.select(F.col(key).alias("_k"), F.col(prompt).alias("_prompt")), seeded("_k", seed + 2 * r + 1), ["_k"], "position")
            rows = base.join(other, "position").select("position", key, F.col("_prompt").alias(prompt), F.lit("shuffled").alias("pair_type"))
        else:
            rows = base.select("position", key, prompt, F.lit("matched").alias("pair_type"))
        rows = rows.withColumn("position", F.col("position") + r * total)
        out = rows if out is None else out.unionByName(rows)
    return out.where(F.col("position") <= n)


def numbered_names(df: DataFrame, order: str, prefix: str = "", suffix: str = ".png", width: int = 6) -> DataFrame:
    """Adds `name`: a zero-padded number from 0 in the order of a column."""
    return numbered(df, F.col(order), [order], "_n").withColumn("name", F.concat(F.lit(prefix), F.lpad((F.col("_n") - 1).cast("string"), width, "0"), F.lit(suffix))).drop("_n")
