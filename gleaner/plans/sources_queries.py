"""Scans, sources and sinks (S): each writes data that Spark derives from the given tables, and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import boxes as B
from gleaner.operators import selection
from gleaner.plans import views
from gleaner.plans.aggregates_queries import _SCORED, scored
from gleaner.plans.projections_queries import _CATEGORY
from gleaner.plans.registry import query
from gleaner.plans.views import duck, table
from gleaner.sources import files, tables

BOX = "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long"
_BOX = duck("boxes", "SELECT image_id, box_id, x1, y1, x2, y2 FROM boxes")


def _boxes(spark, sf_dir):
    return views.boxes(spark, sf_dir).select("image_id", "box_id", *B.Box._fields)


@query("SELECT o_orderstatus AS category, TRUE AS listed, '.parquet' AS suffix FROM orders GROUP BY 1")
def s1_list_files(spark, sf_dir):
    path = tables.new_path(spark, "listing")
    table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("category")).write.partitionBy("category").parquet(path)
    found = files.list_files(spark, path, [".PARQUET"])
    return found.groupBy(F.regexp_extract("path", "category=([^/]+)", 1).alias("category"), "suffix").agg(F.bool_or(F.col("length") > 0).alias("listed"))


@query(_BOX)
def s2_read_manifest(spark, sf_dir):
    path = tables.new_path(spark, "manifest")
    files.write_manifest(_boxes(spark, sf_dir), path, files=8)
    return files.read_manifest(spark, path, BOX)


@query(duck("boxes", "SELECT count(*) AS n, sum(x1)::BIGINT AS x FROM boxes"))
def s3_write_manifest(spark, sf_dir):
    path = tables.new_path(spark, "manifest")
    files.write_manifest(_boxes(spark, sf_dir), path)
    return files.read_manifest(spark, path, BOX).agg(F.count("*").alias("n"), F.sum("x1").alias("x"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 10 <> 3")
def s4_read_jsonl(spark, sf_dir):
    path = tables.new_path(spark, "lines")
    line = F.expr("CASE WHEN event_id % 10 = 3 THEN concat('{broken ', event_id) ELSE concat('{\"event_id\": ', event_id, ', ', substring(props, 2)) END")
    rows = table(spark, sf_dir, "events").select(line.alias("value"))
    rows.unionByName(rows.limit(5).select(F.lit("  ").alias("value"))).write.option("compression", "gzip").text(path)
    return files.read_jsonl(spark, path, "event_id long, k long")


@query("SELECT count(*) AS written, count(*) AS n FROM events")
def s5_write_jsonl(spark, sf_dir):
    path = tables.new_path(spark, "lines")
    n = files.write_jsonl(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), path, compress=True)
    return files.read_jsonl(spark, path, "event_id long, event_type string, value double", skip_errors=False).agg(F.count("*").alias("n")).withColumn("written", F.lit(n).cast("long"))


@query("SELECT event_id, event_type FROM events")
def s6_jsonl_to_json(spark, sf_dir):
    source, target = tables.new_path(spark, "lines"), tables.new_path(spark, "manifest")
    files.write_jsonl(table(spark, sf_dir, "events").select("event_id", "event_type"), source)
    files.jsonl_to_manifest(spark, source, target, "event_id long, event_type string")
    return files.read_manifest(spark, target, "event_id long, event_type string")


@query(duck("preds", "SELECT crop_name, iou_b, iou_a FROM preds"))
def s7_write_metrics_csv(spark, sf_dir):
    path = tables.new_path(spark, "csv")
    files.write_metrics_csv(views.preds(spark, sf_dir), path, ["crop_name", "iou_b", "iou_a"])
    return spark.read.schema("crop_name string, iou_b double, iou_a double").option("header", True).csv(path)


@query("SELECT concat('/data/', doc_id, '.png') AS image, CASE WHEN doc_id % 2 = 0 THEN concat('/data/m', doc_id) ELSE concat('/abs/', doc_id) END AS conditioning_image, source AS text FROM documents WHERE doc_id % 5 <> 0")
def s8_normalize_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 5 != 0, F.col("source"))
    flat = docs.where("doc_id % 2 = 0").select(F.expr("concat(doc_id, '.png')").alias("image"), F.expr("concat('m', doc_id)").alias("mask"), text.alias("prompt"))
    sample = F.struct(F.expr("concat(doc_id, '.png')").alias("image"), F.expr("concat('/abs/', doc_id)").alias("conditioning_image"), text.alias("text"))
    nested = docs.where("doc_id % 2 = 1").groupBy("lang", F.expr("doc_id DIV 100").alias("g")).agg(F.collect_list(sample).alias("samples")).select("samples")
    columns = ["image", "conditioning_image", "text"]
    return files.normalize_manifest(flat, "/data").select(columns).unionByName(files.normalize_manifest(nested, "/data").select(columns))


@query(duck("boxes", "SELECT image_id AS image, x2 - x1 AS width FROM boxes"))
def s9_detect_and_convert(spark, sf_dir):
    converters = {("samples",): lambda d: d, ("x1", "x2"): lambda d: d.select(F.col("image_id").alias("image"), (F.col("x2") - F.col("x1")).alias("width"))}
    return files.detect_and_convert(views.boxes(spark, sf_dir), converters)


@query("SELECT vec_id AS id, label, round(list_sum([x::DOUBLE for x in embedding]), 5) AS total FROM embeddings")
def s10_save_load_vectors(spark, sf_dir):
    path = tables.new_path(spark, "vectors")
    tables.save_vectors(table(spark, sf_dir, "embeddings"), path, "vec_id", "embedding", ["label"])
    rows = tables.load_vectors(spark, path)
    total = F.aggregate(F.col("vector").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)
    return rows.select("id", F.col("metadata.label").alias("label"), F.round(total, 5).alias("total"))


@query(duck("vecs", f"WITH {_SCORED} SELECT vec_id, round(similarity, 6) AS similarity FROM sc"))
def s11_checkpoint_stage(spark, sf_dir):
    path = tables.new_path(spark, "stage")
    rows = scored(spark, sf_dir).select("vec_id", F.round("similarity", 6).alias("similarity"))
    tables.staged(rows, "scores", path)
    return tables.staged(rows, "scores", path)  # the second time it is read, not computed


@query(duck("vecs", "WITH t AS (SELECT vec_id, score FROM vecs ORDER BY score DESC, vec_id DESC LIMIT 20) SELECT count(*) AS n, round(avg(score), 6) AS mean_score, min(score)::DOUBLE AS least, max(score)::DOUBLE AS most, 'quality' AS method, 0.3::DOUBLE AS weight FROM t"))
def s12_export_selection(spark, sf_dir):
    rows = views.vecs(spark, sf_dir)
    picked = selection.select(rows, "vec_id", "e", "score", 20, "quality")
    return tables.export_selection(rows.join(picked, "vec_id"), tables.new_path(spark, "selection"), "vec_id", "score", "quality", 0.3)


def _by_outcome(spark, sf_dir):
    path = tables.new_path(spark, "outcome")
    box = B.Box.of()
    files.write_by_outcome(views.boxes(spark, sf_dir).withColumn("category", B.size_category(box.width, box.height)[0]), path, ["passed", "category"])
    return path


@query(duck("boxes", f"SELECT passed, {_CATEGORY} AS category, count(*) AS n FROM boxes GROUP BY 1, 2"))
def s13_write_by_outcome(spark, sf_dir):
    return spark.read.parquet(_by_outcome(spark, sf_dir)).groupBy(F.col("passed").cast("boolean").alias("passed"), "category").agg(F.count("*").alias("n"))


@query(duck("boxes", f"SELECT image_id, box_id, category FROM (SELECT *, {_CATEGORY} AS category FROM boxes) t WHERE category IN ('tiny', 'xlarge')"))
def s14_read_categories(spark, sf_dir):
    return files.read_categories(spark, _by_outcome(spark, sf_dir), ["tiny", "xlarge"]).select("image_id", "box_id", "category")


def _runs(spark, sf_dir):
    base = tables.new_path(spark, "runs")
    events = table(spark, sf_dir, "events").select("event_id", "value")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).write.parquet(f"{base}/run_{k}")
    return base


@query("SELECT concat('run_', event_id % 3) AS run, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def s15_read_runs(spark, sf_dir):
    return files.read_runs(spark, _runs(spark, sf_dir), "event_id long, value double").groupBy("run").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("SELECT event_id, 'run_2' AS run FROM events WHERE event_id % 3 = 2")
def s15_latest_run(spark, sf_dir):
    return files.read_runs(spark, _runs(spark, sf_dir), "event_id long, value double", latest=True).select("event_id", "run")


@query(duck("boxes", f"WITH c AS (SELECT {_CATEGORY} AS category, count(*) AS n FROM boxes GROUP BY 1), e AS (SELECT unnest(['tiny', 'small', 'huge']) AS category) SELECT category, coalesce(n, 0) AS n, n IS NULL AS missing, e.category IS NOT NULL AS expected FROM e FULL JOIN c USING (category)"))
def s16_audit_layout(spark, sf_dir):
    return files.audit_layout(spark, _by_outcome(spark, sf_dir), "category", ["tiny", "small", "huge"])


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN concat('old/', d.doc_id, '.png') ELSE concat('new/', d.doc_id, '.png') END AS mask, l.doc_id IS NOT NULL AS updated FROM documents d LEFT JOIN labels l USING (doc_id)")
def s17_update_manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr("concat('old/', doc_id, '.png')").alias("mask"))
    new = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("stem"), F.expr("concat('new/', doc_id, '.png')").alias("path"))
    return files.update_manifest(rows, new, "mask")


@query("SELECT event_id, 'error' AS status, concat('user ', user_id) AS message FROM events WHERE event_type = 'error'")
def s18_error_manifest(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("status"), F.expr("concat('user ', user_id)").alias("message"))
    return files.error_manifest(rows, tables.new_path(spark, "errors"))
