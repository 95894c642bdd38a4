"""Scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleaner.functions import boxes as B
from gleaner.functions import paths, vectors
from gleaner.functions import text as T
from gleaner.plans import views
from gleaner.plans.registry import query
from gleaner.plans.views import duck, table


def _answers(spark, sf_dir, described: bool):
    """A JSON answer per image, clean, fenced in prose or broken by the image's id."""
    rows = views.boxes(spark, sf_dir)
    item = F.struct(F.concat(F.lit("box "), F.col("box_id").cast("string")).alias("description"), F.array(*B.Box.of()).alias("bbox")) if described else F.array(*[F.greatest(c, F.lit(0)) for c in B.Box.of()])
    listed = rows.groupBy("image_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("box_id", item.alias("item")))), lambda x: x["item"]).alias("items"))
    body = F.to_json("items")
    kind = F.col("image_id") % 3
    return listed.select("image_id", F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Here are the boxes: "), body, F.lit(" as asked."))).otherwise(F.lit("no boxes, sorry")).alias("answer"))


_ITEMS = "SELECT image_id, box_id::INTEGER AS id, {d} AS description, {c} AS coords FROM boxes WHERE image_id % 3 <> 2"


@query(duck("boxes", _ITEMS.format(d="concat('box ', box_id)", c="[x1, y1, x2, y2]")))
def f1_parse_boxes_described(spark, sf_dir):
    rows = _answers(spark, sf_dir, True).select("image_id", F.explode(T.parse_boxes(F.col("answer"))).alias("b"))
    return rows.select("image_id", "b.id", "b.description", "b.coords")


@query(duck("boxes", _ITEMS.format(d="NULL::VARCHAR", c="[greatest(x1, 0), greatest(y1, 0), greatest(x2, 0), greatest(y2, 0)]")))
def f1_parse_boxes_plain(spark, sf_dir):
    rows = _answers(spark, sf_dir, False).select("image_id", F.explode(T.parse_boxes(F.col("answer"))).alias("b"))
    return rows.select("image_id", "b.id", "b.description", "b.coords")


_CLASS = """CASE doc_id % 3 WHEN 0 THEN concat('{"classification": "', CASE WHEN quality = 1 THEN 'texture' ELSE 'Semantic' END, '", "reasoning": "seen"}')
 WHEN 1 THEN concat('I think: classification: ', CASE WHEN quality = 1 THEN 'TEXTURE' ELSE 'semantic' END, ' reasoning: "clear edge"') ELSE 'no idea' END"""


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'UNKNOWN' WHEN quality = 1 THEN 'TEXTURE' ELSE 'SEMANTIC' END AS classification, CASE doc_id % 3 WHEN 0 THEN 'seen' WHEN 1 THEN 'clear edge' ELSE '' END AS reasoning FROM labels")
def f2_parse_classification(spark, sf_dir):
    label, reason = T.parse_classification(F.col("answer"))
    return table(spark, sf_dir, "labels").withColumn("answer", F.expr(_CLASS)).select("doc_id", label.alias("classification"), reason.alias("reasoning"))


_TRANSITION = """concat(CASE WHEN doc_id % 2 = 0 THEN '```json\\n' ELSE '' END, '{"transitions": [{"texture_a": "a', doc_id, '", "texture_b": "b", "colors_a": [[', doc_id % 300, ', 2, 3]], "colors_b": [[4, 5, 6], [7, 8, 9]]}, {"texture_a": "half"}]}', CASE WHEN doc_id % 2 = 0 THEN '\\n```' ELSE '' END)"""


@query("SELECT doc_id, concat('a', doc_id) AS texture_a, (doc_id % 300)::DOUBLE AS red FROM labels WHERE doc_id % 300 <= 255")
def f3_parse_transitions(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("answer", F.expr(_TRANSITION)).select("doc_id", F.explode(T.parse_transitions(F.col("answer"))).alias("t"))
    return rows.select("doc_id", "t.texture_a", F.col("t.colors_a")[0][0].alias("red"))


_FENCED = """CASE doc_id % 3 WHEN 0 THEN concat('```json\\n{"id": ', doc_id, ', "in": {"q": ', quality, '}}\\n```\\nbye') WHEN 1 THEN concat('Sure. {"id": ', doc_id, '} done') ELSE 'nothing' END"""


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN doc_id END AS id, CASE WHEN doc_id % 3 = 0 THEN quality::BIGINT END AS q FROM labels")
def f4_fenced_json(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("answer", F.expr(_FENCED)).withColumn("j", T.fenced_json(F.col("answer")))
    return rows.select("doc_id", F.get_json_object("j", "$.id").cast("long").alias("id"), F.get_json_object("j", "$.in.q").cast("long").alias("q"))


@query(
    duck(
        "pairs",
        """WITH t AS (SELECT doc_id, concat(trim(texture_a), CASE doc_id % 3 WHEN 0 THEN ' <TO> ' WHEN 1 THEN ' to ' ELSE ' ' END, trim(texture_b)) AS t FROM pairs),
p AS (SELECT doc_id, string_split(t, ' to ') AS p FROM t WHERE position(' <TO> ' IN t) = 0 AND position(' to ' IN t) > 0),
e AS (SELECT doc_id, i, len(regexp_extract_all(p[i], '[^ ]+')) AS c, len(p) AS k FROM (SELECT doc_id, p, unnest(range(1, len(p) + 1)) AS i FROM p)),
n AS (SELECT doc_id, i, k, sum(c) OVER (PARTITION BY doc_id ORDER BY i) + i - 1 AS l, sum(c) OVER (PARTITION BY doc_id) + k - 1 AS total FROM e),
best AS (SELECT doc_id, arg_min(i, abs(total - 1 - 2 * l) * 1000000 + i) AS i FROM n WHERE i < k GROUP BY doc_id),
s AS (SELECT doc_id, CASE WHEN position(' <TO> ' IN t) > 0 THEN ' <TO> ' WHEN position(' to ' IN t) > 0 THEN ' to ' WHEN position(' and ' IN t) > 0 THEN ' and ' WHEN position(' vs ' IN t) > 0 THEN ' vs ' WHEN position(' | ' IN t) > 0 THEN ' | ' END AS sep, t, regexp_extract_all(t, '[^ ]+') AS w FROM t)
SELECT s.doc_id, CASE WHEN sep = ' to ' THEN trim(array_to_string(p[1 : i], ' to ')) WHEN sep IS NULL THEN array_to_string(w[1 : len(w) // 2], ' ') ELSE trim(substr(t, 1, position(sep IN t) - 1)) END AS first,
 CASE WHEN sep = ' to ' THEN trim(array_to_string(p[i + 1 :], ' to ')) WHEN sep IS NULL THEN array_to_string(w[len(w) // 2 + 1 :], ' ') ELSE trim(substr(t, position(sep IN t) + length(sep))) END AS second
FROM s LEFT JOIN p ON p.doc_id = s.doc_id LEFT JOIN best ON best.doc_id = s.doc_id""",
    )
)
def f5_split_description(spark, sf_dir):
    sep = F.when(F.col("doc_id") % 3 == 0, " <TO> ").when(F.col("doc_id") % 3 == 1, " to ").otherwise(" ")
    first, second = T.split_description(F.concat(F.trim("texture_a"), sep, F.trim("texture_b")))
    return views.pairs(spark, sf_dir).select("doc_id", first.alias("first"), second.alias("second"))


@query(
    r"""WITH p AS (SELECT page_id, concat('set/run_', page_id % 4, '/img', page_id, '_', page_id % 9, CASE WHEN page_id % 5 = 0 THEN '' ELSE '.tar.GZ' END) AS path FROM pages), n AS (SELECT page_id, regexp_extract(path, '[^/]*$') AS name FROM p)
SELECT page_id, name, CASE WHEN page_id % 5 = 0 THEN '' ELSE '.gz' END AS suffix, CASE WHEN page_id % 5 = 0 THEN name ELSE substr(name, 1, length(name) - 3) END AS stem, concat('img', page_id) AS source_id FROM n"""
)
def f6_path_parts(spark, sf_dir):
    path = F.expr("concat('set/run_', page_id % 4, '/img', page_id, '_', page_id % 9, CASE WHEN page_id % 5 = 0 THEN '' ELSE '.tar.GZ' END)")
    rows = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    c = F.col("path")
    return rows.select("page_id", paths.name(c).alias("name"), paths.suffix(c).alias("suffix"), paths.stem(c).alias("stem"), paths.source_id(c).alias("source_id"))


@query(duck("runlog", "SELECT run, step, CASE WHEN step % 4 = 0 THEN NULL ELSE step::INTEGER END AS epoch, row_number() OVER (PARTITION BY run ORDER BY step % 4 = 0, CASE WHEN step % 4 = 0 THEN NULL ELSE step END, step)::INTEGER AS position FROM runlog"))
def f7_epoch_order(spark, sf_dir):
    name = F.when(F.col("step") % 4 == 0, "best").otherwise(F.concat(F.lit("model_epoch_"), F.col("step").cast("string")))
    rows = views.runlog(spark, sf_dir).select("run", "step", paths.epoch_of(name).alias("epoch"))
    order = Window.partitionBy("run").orderBy(F.col("epoch").isNull(), "epoch", "step")
    return rows.withColumn("position", F.row_number().over(order))


@query(duck("pairs", "SELECT doc_id, concat('A photo of ', texture_a, ' next to ', texture_b, '.') AS prompt, concat('[', doc_id % 256, ', 0, 255] (', CASE WHEN doc_id % 2 = 0 THEN '12.5' ELSE '50.0' END, '%)', chr(10), '[1, 2, 3] (25.0%)') AS colours FROM pairs"))
def f8_render_text(spark, sf_dir):
    share = F.when(F.col("doc_id") % 2 == 0, 0.125).otherwise(0.5)
    colours = F.array(F.struct(F.array(F.col("doc_id") % 256, F.lit(0), F.lit(255)).alias("rgb"), share.alias("share")), F.struct(F.array(F.lit(1).cast("long"), F.lit(2), F.lit(3)).alias("rgb"), F.lit(0.25).alias("share")))
    return views.pairs(spark, sf_dir).select("doc_id", F.format_string("A photo of %s next to %s.", "texture_a", "texture_b").alias("prompt"), T.render_colours(colours).alias("colours"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y%m%d') AS day FROM events")
def f9_time_names(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", paths.stamp(F.col("ts")).alias("stamp"), paths.iso(F.col("ts")).alias("iso"), paths.day_label(F.col("ts")).alias("day"))


@query("SELECT event_id, floor(value * (event_id % 100))::BIGINT AS seconds FROM events")
def f10_eta(spark, sf_dir):
    left = paths.eta(F.col("value"), F.col("event_id") % 100)
    seconds = F.extract(F.lit("DAY"), left) * 86400 + F.extract(F.lit("HOUR"), left) * 3600 + F.extract(F.lit("MINUTE"), left) * 60 + F.extract(F.lit("SECOND"), left)
    return table(spark, sf_dir, "events").select("event_id", seconds.cast("long").alias("seconds"))


@query(duck("vecs", "SELECT vec_id, [round(x / greatest(norm, 1e-8), 6) for x in e[1:4]] AS head FROM vecs"))
def f11_l2_normalize(spark, sf_dir):
    unit = vectors.l2_normalized(F.col("e"))
    return views.vecs(spark, sf_dir).select("vec_id", F.transform(F.slice(unit, 1, 4), lambda x: F.round(x, 6)).alias("head"))


@query(duck("vecs", "SELECT a.vec_id, round(list_sum([a.e[i] * b.e[i] for i in range(1, 65)]) / (a.norm * b.norm), 6) AS cosine, round(list_sum([a.e[i] * b.e[i] for i in range(1, 65)]) / ((a.norm + 1e-8) * (b.norm + 1e-8)), 6) AS eased FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 1"))
def f12_cosine(spark, sf_dir):
    rows = views.vecs(spark, sf_dir)
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f"))
    a, b = F.col("e"), F.col("f")
    return rows.join(other, "vec_id").select("vec_id", F.round(vectors.cosine(a, b), 6).alias("cosine"), F.round(vectors.cosine(a, b, 1e-8), 6).alias("eased"))


_PAIR = """p AS (SELECT a.image_id, a.box_id AS i, b.box_id AS j, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter,
 (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS both_areas, (greatest(a.x2, b.x2) - least(a.x1, b.x1)) * (greatest(a.y2, b.y2) - least(a.y1, b.y1)) AS hull
 FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND b.box_id = a.box_id + 1)"""


def _next_boxes(spark, sf_dir):
    rows = views.boxes(spark, sf_dir)
    other = rows.select("image_id", (F.col("box_id") - 1).alias("box_id"), *[F.col(c).alias(f"{c}_b") for c in B.Box._fields])
    return rows.join(other, ["image_id", "box_id"])


@query(duck("boxes", f"WITH {_PAIR} SELECT image_id, i, round(inter / (both_areas - inter), 6) AS iou, round(inter / greatest(both_areas - inter, 1e-6), 6) AS eased FROM p"))
def f13_box_iou(spark, sf_dir):
    a, b = B.Box.of(), B.Box.of(suffix="_b")
    return _next_boxes(spark, sf_dir).select("image_id", F.col("box_id").alias("i"), F.round(B.iou(a, b), 6).alias("iou"), F.round(B.iou(a, b, 1e-6), 6).alias("eased"))


@query(duck("boxes", f"WITH {_PAIR} SELECT image_id, i, round(inter / (both_areas - inter) - (hull - (both_areas - inter)) / hull, 6) AS giou FROM p"))
def f14_box_giou(spark, sf_dir):
    return _next_boxes(spark, sf_dir).select("image_id", F.col("box_id").alias("i"), F.round(B.giou(B.Box.of(), B.Box.of(suffix="_b")), 6).alias("giou"))


@query("WITH m AS (SELECT o_orderpriority, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std FROM orders GROUP BY 1) SELECT o_orderkey, round(CASE WHEN std = 0 THEN CASE WHEN o_totalprice = mean THEN 1.0 ELSE 0.0 END ELSE greatest(0, 1 - abs((o_totalprice - mean) / std) / 4) END, 6) AS fit FROM orders JOIN m USING (o_orderpriority)")
def f15_fit_score(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    profile = orders.groupBy("o_orderpriority").agg(F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("std"))
    return orders.join(profile, "o_orderpriority").select("o_orderkey", F.round(vectors.fit_score(F.col("o_totalprice"), F.col("mean"), F.col("std")), 6).alias("fit"))


@query(duck("grid", "WITH s AS (SELECT grid_id, y, x, v * CASE WHEN grid_id % 2 = 0 THEN 8 ELSE 1 END AS s FROM grid), m AS (SELECT *, min(s) OVER (PARTITION BY grid_id) < -0.5 OR max(s) OVER (PARTITION BY grid_id) > 1.5 AS logits FROM s) SELECT grid_id, y, x, CASE WHEN logits THEN 1 / (1 + exp(-s)) ELSE s END > 0.5 AS on FROM m").replace(" AS on FROM m", ' AS "on" FROM m'))
def f16_binarize_scores(spark, sf_dir):
    from gleaner.operators.evaluate import binarized

    rows = views.grid(spark, sf_dir).withColumn("s", F.col("v") * F.when(F.col("grid_id") % 2 == 0, 8).otherwise(1))
    return binarized(rows, "grid_id", "s", 0.5).select("grid_id", "y", "x", "on")


@query("SELECT o_orderkey, round(o_totalprice / 7, 3) AS rounded, least(greatest(o_totalprice, 1000), 200000) AS clamped, CASE WHEN o_custkey % 3 > 0 THEN o_totalprice / (o_custkey % 3) ELSE 0 END AS divided FROM orders")
def f17_number_helpers(spark, sf_dir):
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(p / 7, 3).alias("rounded"), F.least(F.greatest(p, F.lit(1000.0)), F.lit(200000.0)).alias("clamped"), vectors.safe_div(p, F.col("o_custkey") % 3).alias("divided"))
