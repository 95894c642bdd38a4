"""Annotated-data tables that the registered queries derive from the given ones, with the DuckDB text of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BOXES = """SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS BIGINT) AS box_id,
 img_w, img_h, x1, y1, x1 + bw AS x2, y1 + bh AS y2, score, passed
FROM (SELECT l_orderkey AS image_id, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
 256 + (l_orderkey % 5) * 128 AS img_w, 256 + (l_orderkey % 3) * 128 AS img_h,
 (l_orderkey * 37) % 400 + l_partkey % 60 - 20 AS x1, (l_orderkey * 53) % 300 + l_suppkey % 60 - 20 AS y1,
 CAST(l_quantity AS BIGINT) * 3 + 40 AS bw, (l_partkey + l_suppkey) % 50 * 3 + 5 AS bh,
 l_extendedprice / 100000 AS score, l_returnflag = 'A' AS passed FROM {lineitem}) t"""
_GRID = """SELECT vec_id AS grid_id, CAST(pos DIV 8 AS BIGINT) AS y, CAST(pos % 8 AS BIGINT) AS x, CAST(v AS DOUBLE) AS v,
 CAST(floor((CAST(v AS DOUBLE) + 1) * 127.5) AS BIGINT) AS gray, CAST(v AS DOUBLE) > 0.05 AS in_a, CAST(v AS DOUBLE) < -0.05 AS in_b
FROM {embeddings} LATERAL VIEW posexplode(embedding) e AS pos, v"""
_PAIRS = r"""SELECT doc_id, array_join(slice(w, 1, CAST(2 + doc_id % 12 AS INT)), ' ') AS texture_a,
 array_join(slice(w, CAST(3 + doc_id % 12 AS INT), size(w)), ' ') AS texture_b, lang, source
FROM (SELECT doc_id, lang, source, split(trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ')), ' ') AS w FROM {documents}) t"""
_PREDS = """SELECT concat('doc_', CAST(d.doc_id AS VARCHAR(20))) AS crop_name, CAST(d.n_chars % 101 AS DOUBLE) / 100 AS iou_a, CAST(d.n_chars % 97 AS DOUBLE) / 96 AS iou_b,
 CAST((d.doc_id * 7919) % 1000 AS DOUBLE) / 1000 AS score, l.quality = 1 AS matched, d.source AS model
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id"""
_RUNLOG = """SELECT event_type AS run, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS step, ts,
 CASE WHEN user_id % 2 = 0 THEN 'train' ELSE 'val' END AS phase, value AS total, value * 0.25 AS part FROM {events}"""

#: DuckDB texts of the views.
DUCK = {
    "boxes": _BOXES.format(lineitem="lineitem"),
    "grid": """SELECT vec_id AS grid_id, (pos - 1) // 8 AS y, (pos - 1) % 8 AS x, v::DOUBLE AS v,
 floor((v::DOUBLE + 1) * 127.5)::BIGINT AS gray, v::DOUBLE > 0.05 AS in_a, v::DOUBLE < -0.05 AS in_b
FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) t""",
    "pairs": r"""SELECT doc_id, array_to_string(w[1 : 2 + doc_id % 12], ' ') AS texture_a,
 array_to_string(w[3 + doc_id % 12 :], ' ') AS texture_b, lang, source
FROM (SELECT doc_id, lang, source, string_split(trim(regexp_replace(text, '[ \t\r\n]+', ' ', 'g')), ' ') AS w FROM documents) t""",
    "preds": _PREDS.format(documents="documents", labels="labels"),
    "runlog": _RUNLOG.format(events="events"),
    "vecs": """SELECT vec_id, label, e, sqrt(list_sum([x * x for x in e])) AS norm, 0.5 + (vec_id * 37 % 500) / 1000.0 AS score
FROM (SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e FROM embeddings) t""",
}


def duck(views: str, body: str) -> str:
    """A DuckDB query over some of the views (names set apart by spaces)."""
    named = ",\n".join(f"{v} AS ({DUCK[v]})" for v in views.split())
    body = body.strip()
    recursive = "RECURSIVE " if body.upper().startswith("WITH RECURSIVE ") else ""
    if body.upper().startswith("WITH "):
        return f"WITH {recursive}{named}, {body[5 + len(recursive) :]}"
    return f"WITH {named}\n{body}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _BOXES, "lineitem")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _GRID, "embeddings")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _PAIRS, "documents")


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _PREDS, "documents", "labels")


def runlog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, _RUNLOG, "events")


def vecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as doubles, their norms, and a quality score derived from the id."""
    text = """SELECT vec_id, label, e, sqrt(aggregate(e, 0D, (s, x) -> s + x * x)) AS norm, 0.5D + CAST(vec_id * 37 % 500 AS DOUBLE) / 1000D AS score
FROM (SELECT vec_id, label, transform(embedding, x -> CAST(x AS DOUBLE)) AS e FROM {embeddings}) t"""
    return _sql(spark, sf_dir, text, "embeddings")
