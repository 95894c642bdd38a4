"""Structured Streaming jobs that end when their input is drained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.operators.vectors import score_to_reference


def drain(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Appends what the stream has by now to a folder, and stops; a later call goes on from the checkpoint."""
    writer = df.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (writer.partitionBy(*partition_by) if partition_by else writer).start().awaitTermination()


def once_per_key(df: DataFrame, key: str, time: str, late: str) -> DataFrame:
    """First row of each key; keys are remembered for `late` of event time, so that state stays bounded."""
    return df.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def commit_batches(df: DataFrame, path: str, checkpoint: str) -> None:
    """Writes each micro-batch to a folder named by its number, so that a batch that is run again replaces itself."""

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def throughput(df: DataFrame, time: str, width: str, status: str, late: str = "1 hour") -> DataFrame:
    """Per window of event time: rows, ok and errors, and rows a second."""
    windowed = df.withWatermark(time, late) if df.isStreaming else df
    seconds = F.unix_timestamp(F.col("w.end")) - F.unix_timestamp(F.col("w.start"))
    counts = windowed.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col(status) == "error").alias("errors"))
    return counts.select(F.col("w.start").alias("start"), "n", "errors", (F.col("n") - F.col("errors")).alias("ok"), (F.col("n") / seconds).alias("per_second"))


def reason_counts(df: DataFrame, reason: str) -> DataFrame:
    return df.groupBy(reason).agg(F.count("*").alias("n"))


def latest_states(df: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Runs an aggregation in update mode to the end of its input; the last state of each key, from batches written by number."""

    def commit(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    df.writeStream.outputMode("update").foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = df.sparkSession.read.parquet(path)
    names = [c for c in rows.columns if c != "batch"]
    return rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max_by(F.struct(*names), "batch").alias("r")).select("r.*")


def incremental_scores(df: DataFrame, reference: DataFrame, vector: str) -> DataFrame:
    """Rows that have a vector and no score yet, scored against the reference as they arrive."""
    return score_to_reference(df.where(F.col(vector).isNotNull() & F.col("score").isNull()), reference, vector)
