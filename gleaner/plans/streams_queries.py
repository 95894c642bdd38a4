"""Streams (X) and user functions (H). Streams read files that Spark writes from the given tables, and are drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.operators import hooks
from gleaner.operators import vectors as VO
from gleaner.plans import views
from gleaner.plans.aggregates_queries import _SCORED
from gleaner.plans.registry import query
from gleaner.plans.views import duck, table
from gleaner.sources import tables
from gleaner.streaming import jobs

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double"


def _stream(spark, sf_dir, files=8):
    """Events as a stream of files in the order of time.

    A stream takes files in the order in which they were written. They are dealt by ranges at once, and then written one after
    the other: tasks that write side by side end in any order, and a watermark would drop rows of the earlier ranges.
    """
    dealt, path = tables.new_path(spark, "dealt"), tables.new_path(spark, "events")
    rows = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    ranges = rows.repartitionByRange(files, "ts").withColumn("range", F.spark_partition_id())
    ranges.sortWithinPartitions("range", "ts").write.partitionBy("range").parquet(dealt)
    ranges = spark.read.schema(f"{EVENT}, range int").parquet(dealt)
    for k in range(files):
        ranges.where(F.col("range") == k).drop("range").coalesce(1).sortWithinPartitions("ts").write.mode("append").parquet(path)
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 2).parquet(path)


@query("SELECT event_id, value * 2 AS doubled FROM events WHERE event_type <> 'error'")
def x1_stream_results(spark, sf_dir):
    out = tables.new_path(spark, "out")
    rows = _stream(spark, sf_dir).where("event_type <> 'error'").select("event_id", (F.col("value") * 2).alias("doubled"))
    jobs.drain(rows, out, tables.new_path(spark, "state"), "json")
    return spark.read.schema("event_id long, doubled double").json(out)


@query("SELECT event_id, event_type FROM events")
def x2_bounded_write(spark, sf_dir):
    out = tables.new_path(spark, "out")
    jobs.drain(_stream(spark, sf_dir).select("event_id", "event_type"), out, tables.new_path(spark, "state"))
    return spark.read.schema("event_id long, event_type string").parquet(out)


@query("SELECT event_id FROM events")
def x3_resume_stream(spark, sf_dir):
    """Every event arrives twice, in two drains of one checkpoint; each is written once."""
    source, out, state = (tables.new_path(spark, x) for x in ("source", "out", "state"))
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    for part in (events.where("event_id % 2 = 0"), events):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema("event_id long, ts timestamp").parquet(source)
        jobs.drain(jobs.once_per_key(stream, "event_id", "ts", "60 days").select("event_id"), out, state)
    return spark.read.schema("event_id long").parquet(out)


@query(duck("vecs", f"WITH {_SCORED} SELECT vec_id, round(similarity, 6) AS similarity FROM sc WHERE vec_id % 3 <> 0"))
def x4_incremental_score(spark, sf_dir):
    source, out = tables.new_path(spark, "source"), tables.new_path(spark, "out")
    rows = views.vecs(spark, sf_dir)
    rows.select("vec_id", "e", F.when(F.col("vec_id") % 3 == 0, F.lit(0.5)).alias("score")).repartition(4).write.parquet(source)
    reference = tables.staged(VO.centroid(rows.where("label = 0"), "e"), "reference")
    stream = spark.readStream.schema("vec_id long, e array<double>, score double").parquet(source)
    jobs.drain(jobs.incremental_scores(stream, reference, "e").select("vec_id", F.round("similarity", 6).alias("similarity")), out, tables.new_path(spark, "state"))
    return spark.read.schema("vec_id long, similarity double").parquet(out)


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS ids FROM events")
def x5_periodic_commit(spark, sf_dir):
    out = tables.new_path(spark, "out")
    jobs.commit_batches(_stream(spark, sf_dir).select("event_id"), out, tables.new_path(spark, "state"))
    return spark.read.parquet(out).agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("ids"))


@query("SELECT date_trunc('day', ts) AS start, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) FILTER (WHERE event_type <> 'error') AS ok, round(count(*) / 86400, 8) AS per_second FROM events GROUP BY 1")
def x6_throughput(spark, sf_dir):
    windows = jobs.throughput(_stream(spark, sf_dir), "ts", "1 day", "event_type")
    out = jobs.latest_states(windows, tables.new_path(spark, "out"), tables.new_path(spark, "state"), ["start"])
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "errors", "ok", F.round("per_second", 8).alias("per_second"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def x7_stream_reason_counts(spark, sf_dir):
    counts = jobs.reason_counts(_stream(spark, sf_dir), "event_type")
    return jobs.latest_states(counts, tables.new_path(spark, "out"), tables.new_path(spark, "state"), ["event_type"])


@query("SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def h1_map_rows(spark, sf_dir):
    return hooks.map_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda r: {"doc_id": r["doc_id"], "n": len(r["text"])}, "doc_id long, n long")


class Upper:
    """A stand-in for a model with a batch method."""

    def answer_batch(self, values):
        return [v.upper() for v in values]


class Lower:
    """A stand-in for a model without one."""

    def answer(self, value):
        return value.lower()


@query("SELECT doc_id, source, upper(source) AS answer FROM documents")
def h2_map_batches(spark, sf_dir):
    return hooks.map_batches(table(spark, sf_dir, "documents").select("doc_id", "source"), Upper, "source", "doc_id long, source string, answer string")


@query("SELECT doc_id, source, lower(source) AS answer FROM documents")
def h3_model_factory(spark, sf_dir):
    return hooks.map_batches(table(spark, sf_dir, "documents").select("doc_id", "source"), Lower, "source", "doc_id long, source string, answer string")


def _halved(row):
    if row["doc_id"] % 7 == 0:
        raise ValueError("seven")
    return {"doc_id": row["doc_id"], "half": row["doc_id"] // 2}


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN -1 ELSE doc_id // 2 END AS half, CASE WHEN doc_id % 7 = 0 THEN 'ValueError: seven' END AS error FROM documents")
def h4_map_with_errors(spark, sf_dir):
    return hooks.map_with_errors(table(spark, sf_dir, "documents").select("doc_id"), _halved, "doc_id long, half long", policy="pass", fallback={"half": -1})


@query(duck("preds", "SELECT crop_name, round(abs(iou_a - iou_b) * 2, 6) AS cost FROM preds"))
def h5_cost_function(spark, sf_dir):
    return hooks.with_cost(views.preds(spark, sf_dir), lambda p, t: F.round(F.abs(p - t) * 2, 6), "iou_a", "iou_b").select("crop_name", "cost")
