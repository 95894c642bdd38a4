"""Column functions over paths, names and times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """The last extension with its dot, lower-cased; empty if there is none. A name that only begins with a dot has none."""
    return F.lower(F.regexp_extract(name(path), r"(?<=.)(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(name(path), r"(?<=.)\.[^.]+$", "")


def source_id(path: Column) -> Column:
    """The stem up to its first underscore."""
    return F.substring_index(stem(path), "_", 1)


def epoch_of(checkpoint: Column) -> Column:
    """The number in `..._epoch_<n>`; null for names without one, which sort last."""
    found = F.regexp_extract(checkpoint, r"_epoch_(\d+)", 1)
    return F.when(found != "", found.cast("int"))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def day_label(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd")


def eta(mean_seconds: Column, remaining: Column) -> Column:
    """Time left as an interval of whole seconds."""
    seconds = F.floor(mean_seconds * remaining)
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
