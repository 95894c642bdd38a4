"""Tables written between steps: stages of a computation, vectors, selections."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}
_MADE: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which the driver and all executors see; on one machine alone, a temporary one."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _ROOTS.setdefault(context.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-gleaner-"))
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession) -> int:
    """Deletes what this session has written to `new_path`s, and returns how many; results must be saved before."""
    made = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in made:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(made)


def staged(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """`df` as a written table. With a path, a table that is already there is read instead, so that a run goes on where it stopped."""
    spark = df.sparkSession
    if path is None:
        path = new_path(spark, label)
        df.write.parquet(path)
    elif not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at))


def save_vectors(df: DataFrame, path: str, key: str, vector: str, metadata: list[str], extra: Column | None = None) -> None:
    """Id, vector (float), known metadata as one struct, and open metadata as a map of strings."""
    none = F.create_map().cast("map<string,string>")
    df.select(F.col(key).alias("id"), F.col(vector).cast("array<float>").alias("vector"), F.struct(*metadata).alias("metadata"), (none if extra is None else extra).alias("extra")).write.mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def upsert(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """`df` with the rows of `changes` in place of those of the same key; the last change wins by position in a column `seq`, if there is one."""
    if "seq" in changes.columns:
        changes = changes.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.struct(*[c for c in changes.columns if c != "seq"]), "seq").alias("_r")).select("_r.*")
    return df.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def export_selection(selected: DataFrame, path: str, key: str, score: str, method: str, weight: float) -> DataFrame:
    """Writes the selected rows as a table and a one-row summary as JSON; returns the summary."""
    selected.write.mode("overwrite").parquet(f"{path}/rows")
    summary = selected.agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_score"), F.min(score).alias("least"), F.max(score).alias("most")).withColumns({"method": F.lit(method), "weight": F.lit(weight)})
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    return selected.sparkSession.read.schema(summary.schema).json(f"{path}/summary")
