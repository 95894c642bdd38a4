"""Cleaning of records: boxes, texts, verdicts, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import boxes as B
from gleaner.functions.text import length_reason


def valid_boxes(df: DataFrame, strict: bool = False, width: str = "img_w", height: str = "img_h") -> DataFrame:
    """Upright boxes, clamped, with an area. Clamping comes before the test, so a box beyond the right or lower border ends
    one pixel wide; `strict` drops it."""
    w, h = F.col(width), F.col(height)
    upright = df.where(B.is_valid(B.Box.of()))
    if strict:
        upright = upright.where((F.col("x1") < w) & (F.col("y1") < h) & (F.col("x2") > 0) & (F.col("y2") > 0))
    box = B.clamp(B.Box.of(), w, h)
    return upright.withColumns(dict(zip(box._fields, box, strict=True))).where(B.is_valid(B.Box.of()))


def fix_tiny(df: DataFrame, width: str = "img_w", height: str = "img_h") -> DataFrame:
    """`df` with boxes that would be tiny moved to the border they are near; adds `tiny` and `was_fixed`."""
    w, h = F.col(width), F.col(height)
    box, near = B.fix_at_border(B.Box.of(), w, h)
    tiny = B.would_be_tiny(B.Box.of(), w, h)
    out = df.withColumns({"tiny": tiny, "was_fixed": tiny & near, **{f"_{n}": c for n, c in zip(box._fields, box, strict=True)}})
    return out.withColumns({n: F.when(F.col("tiny"), F.col(f"_{n}")).otherwise(F.col(n)) for n in box._fields}).drop(*[f"_{n}" for n in box._fields])


def with_points(df: DataFrame, points: str, keys: tuple[str, ...], least: int) -> DataFrame:
    """Rows whose struct of point lists has `least` points under every key."""
    ok = F.lit(True)
    for k in keys:
        ok = ok & (F.coalesce(F.size(F.col(points)[k]), F.lit(-1)) >= least)
    return df.where(ok)


def require_fields(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows where all columns are there and none is blank."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & (F.length(F.trim(F.col(c))) > 0)
    return df.where(ok)


def entropy_gate(df: DataFrame, a: str, b: str, threshold: float = 4.5) -> DataFrame:
    """Adds entropy_a, entropy_b and min_entropy, rounded to 3 places, and `passed`: both reach the threshold."""
    return df.withColumns(
        {
            "passed": (F.col(a) >= threshold) & (F.col(b) >= threshold),
            "entropy_a": F.round(a, 3),
            "entropy_b": F.round(b, 3),
            "min_entropy": F.round(F.least(a, b), 3),
        }
    )


def normalized_verdicts(df: DataFrame, verdict: str, reason: str, confidence: str) -> DataFrame:
    """passed, reason and confidence in one form. A row without a verdict (the model failed) passes as VLM_ERROR at 0."""
    failed = F.col(verdict).isNull()
    return df.withColumns(
        {
            "passed": F.when(failed, F.lit(True)).otherwise(F.lower(F.trim(F.col(verdict))) == "pass"),
            "reason": F.when(failed, "VLM_ERROR").otherwise(F.upper(F.trim(F.coalesce(F.col(reason), F.lit("UNKNOWN"))))),
            "confidence": F.when(failed, F.lit(0.0)).otherwise(F.least(F.greatest(F.coalesce(F.col(confidence), F.lit(0.5)), F.lit(0.0)), F.lit(1.0))),
        }
    )


def next_status(prefilter_reason: Column, passed: Column, skip: Column) -> Column:
    """From pending to rejected or valid: a prefilter's reason rejects, a skipped check accepts, else the verdict decides."""
    return F.when(prefilter_reason.isNotNull(), "rejected").when(skip, "valid").when(passed, "valid").otherwise("rejected")


def adapted(df: DataFrame) -> DataFrame:
    """Fills image_path (from crop_name) and coords (zeros) where they are missing."""
    return df.withColumns({"image_path": F.coalesce("image_path", "crop_name"), "coords": F.coalesce("coords", F.array(*[F.lit(0)] * 4))})


def updated(df: DataFrame, changes: DataFrame, key: str, extra: str = "extra") -> DataFrame:
    """`df` with the changes of matching keys: columns that it has are set, others go into the map `extra`.

    Several changes of a key are made one: each column takes its last value that is not null by a column `seq`, if there is
    one, else the greatest.
    """
    names = [c for c in changes.columns if c not in (key, "seq")]
    last = (lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq")))) if "seq" in changes.columns else F.max
    changes = changes.groupBy(key).agg(*[last(c).alias(c) for c in names]) if names else changes.select(key).distinct()
    known, unknown = [c for c in names if c in df.columns], [c for c in names if c not in df.columns]
    own = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in names])
    out = df.join(own, df[key] == own["_key"], "left")
    out = out.withColumns({c: F.coalesce(f"_{c}", c) for c in known})
    if unknown:
        pairs = F.map_filter(F.map_from_arrays(F.array(*[F.lit(c) for c in unknown]), F.array(*[F.col(f"_{c}").cast("string") for c in unknown])), lambda _, v: v.isNotNull())
        out = out.withColumn(extra, F.map_concat(F.map_filter(extra, lambda k, _: ~F.map_contains_key(pairs, k)), pairs))
    return out.select(df.columns)


def with_skip_reason(df: DataFrame, least: int = 4, most: int = 12) -> DataFrame:
    """Adds skip_reason, the first of: not_passed, missing_crop, no_masks, bad_text; null for rows to train on."""
    bad = length_reason(F.col("texture_a"), F.col("texture_b"), least, most) != "OK"
    reason = F.when(~F.col("passed"), "not_passed").when(F.col("crop_name").isNull(), "missing_crop").when(~F.col("has_masks"), "no_masks").when(bad, "bad_text")
    return df.withColumn("skip_reason", reason)


def with_status(df: DataFrame, status: str, column: str = "status") -> DataFrame:
    return df if status == "all" else df.where(F.col(column) == status)


def feature_rows(df: DataFrame, key: str, columns: list[str], success: str = "success", digits: int = 6) -> DataFrame:
    """Successful rows as a key and one ordered vector."""
    return df.where(F.col(success)).select(key, F.array(*[F.round(c, digits) for c in columns]).alias("features"))
