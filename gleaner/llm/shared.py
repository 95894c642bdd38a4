"""Helpers that the operators of this subpackage share: the work folder, written tables and bounded samples."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.sources.tables import shared_folder

_MADE: dict[str, list[str]] = {}
_LEFT: dict[str, list[str]] = {}


def work_path(spark: SparkSession, label: str) -> str:
    """A new address below the shared folder (see `shared_folder`): that which the cluster names in spark.checkpoint.dir."""
    root = shared_folder(spark)
    if "://" not in root and root.startswith("/"):
        root = "file://" + root
    elif root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[len("file:") :]
    path = f"{root}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> int:
    """Deletes what this session has written below `work_path`, and returns how many paths; results must be saved before."""
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    _delete(spark, paths)
    return len(paths)


@contextlib.contextmanager
def leaving(spark: SparkSession) -> Iterator[None]:
    """Notes the paths that are made within, for `drop_left`."""
    made = _MADE.setdefault(spark.sparkContext.applicationId, [])
    before = len(made)
    try:
        yield
    finally:
        _LEFT.setdefault(spark.sparkContext.applicationId, []).extend(made[before:])


def _roots(df: DataFrame) -> list[str]:
    """The folders and files that df's scans were given; not the files in them."""
    leaves, out = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for k in range(leaves.size()):
        with contextlib.suppress(Py4JError):  # a leaf that reads no files
            found = leaves.apply(k).relation().location().rootPaths()
            out += [found.apply(i).toString() for i in range(found.size())]
    return out


def drop_left(spark: SparkSession, unless_read: DataFrame) -> None:
    """Deletes what `leaving` has noted, but not if `unless_read` reads any of it."""
    paths = _LEFT.get(spark.sparkContext.applicationId, [])
    ends = tuple({p.rsplit("/", 1)[1] for p in paths})  # a random name each
    if paths and not any(f"/{end}/" in f"{root}/" for root in _roots(unless_read) for end in ends):
        _delete(spark, paths)
        made = _MADE.get(spark.sparkContext.applicationId, [])
        made[:] = [p for p in made if p not in set(paths)]
        paths.clear()


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of df as a table in the shared folder: lineage ends there, and a lost executor costs no earlier work."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, modulus: int) -> Column:
    """crc32 of an integer column's text, modulo a number; null for null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def share_hash(column: str, salt: int) -> Column:
    """A number in [0, 1) that depends on the column's value alone."""
    return F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(salt)), 11) / F.lit(float(1 << 53))


def class_sample(rows: DataFrame, key: str, label: str, quota: int, salt: int = 11) -> DataFrame:
    """About `quota` rows of each label, chosen by a hash of the key, so that a rerun takes the same rows.

    The first pass counts labels only. `quota` bounds the sample: the expected number per label is at most 1.1 times it.
    """
    counts = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count("*").alias("n")).collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (share_hash(key, salt) < F.lit(1.1 * quota / max(n, 1))))
    return rows.where(keep)
