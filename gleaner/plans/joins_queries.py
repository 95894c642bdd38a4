"""Joins (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import boxes as B
from gleaner.operators import grids, joins
from gleaner.operators import vectors as VO
from gleaner.operators.index import VectorIndex
from gleaner.plans import views
from gleaner.plans.aggregates_queries import _SCORED, _SIMS, scored
from gleaner.plans.registry import query
from gleaner.plans.views import duck, table
from gleaner.sources.tables import new_path

_MASKS = "CASE WHEN doc_id % 3 = 0 THEN concat('d', doc_id) ELSE concat('d', doc_id, '_mask') END"


@query(f"WITH m AS (SELECT doc_id, {_MASKS} AS stem, concat('m/', {_MASKS}, '.png') AS path FROM labels WHERE doc_id % 4 <> 1) SELECT d.doc_id, m.path AS mask_path FROM documents d JOIN m ON m.stem IN (concat('d', d.doc_id), concat('d', d.doc_id, '_mask'))")
def j1_pair_by_stem(spark, sf_dir):
    images = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("stem"))
    masks = table(spark, sf_dir, "labels").where("doc_id % 4 <> 1").select(F.expr(_MASKS).alias("stem"), F.expr(f"concat('m/', {_MASKS}, '.png')").alias("path"), F.col("doc_id").alias("n"))
    return joins.pair_by_stem(images, masks, "n").select("doc_id", "mask_path")


@query(duck("boxes", "SELECT image_id, box_id, CASE WHEN box_id % 2 = 0 THEN concat('c', image_id, '_', box_id) END AS crop FROM boxes"))
def j2_attach_crops(spark, sf_dir):
    rows = views.boxes(spark, sf_dir).select("image_id", "box_id")
    crops = rows.where("box_id % 2 = 0").withColumn("crop", F.expr("concat('c', image_id, '_', box_id)"))
    return joins.attach(rows, crops, ["image_id", "box_id"])


def _assembled(spark, sf_dir):
    rows = views.boxes(spark, sf_dir).withColumn("crop", F.expr("concat(image_id, '_', box_id)"))
    verdicts = rows.where("box_id % 4 <> 3").select("crop", "passed")
    boxes = rows.select("image_id", "box_id", "crop", F.when(F.col("box_id") % 5 != 0, F.array("x1", "y1")).alias("points"))
    return joins.assemble(boxes, verdicts, "crop")


_ASSEMBLED = "SELECT image_id, box_id, CASE WHEN box_id % 4 = 3 THEN 'no_verdict' WHEN NOT passed THEN 'not_passed' WHEN box_id % 5 = 0 THEN 'no_points' END AS skip_reason FROM boxes"


@query(duck("boxes", f"SELECT image_id, box_id FROM ({_ASSEMBLED}) t WHERE skip_reason IS NULL"))
def j3_assemble_dataset(spark, sf_dir):
    return _assembled(spark, sf_dir).where("skip_reason IS NULL").select("image_id", "box_id")


@query(duck("boxes", f"SELECT skip_reason, count(*) AS n FROM ({_ASSEMBLED}) t WHERE skip_reason IS NOT NULL GROUP BY 1"))
def j3_skip_counts(spark, sf_dir):
    return _assembled(spark, sf_dir).where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT conv_id AS doc_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT doc_id, l.text FROM labels JOIN l USING (doc_id) WHERE k = 1 AND length(trim(l.text)) > 0")
def j4_attach_text(spark, sf_dir):
    lookup = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    return joins.attach_text(table(spark, sf_dir, "labels").select("doc_id"), lookup, "doc_id", "text", "turn")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j5_attach_back(spark, sf_dir):
    return joins.attach(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id", "quality"), ["doc_id"])


_IOU = """p AS (SELECT a.image_id, a.box_id AS i, b.box_id AS j, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s
 FROM boxes a JOIN boxes b ON a.image_id = b.image_id AND a.box_id < b.box_id)"""


@query(duck("boxes", f"WITH {_IOU} SELECT image_id, i, j, round(inter / (s - inter), 6) AS iou FROM p WHERE inter / (s - inter) >= 0.6"))
def j6_pairwise_iou(spark, sf_dir):
    return joins.overlapping_pairs(views.boxes(spark, sf_dir), "image_id", "box_id", 0.6).withColumn("iou", F.round("iou", 6))


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def j7_skip_processed(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id")
    return joins.skip_processed(events, events.where("event_id % 3 = 0"), "event_id")


@query("SELECT d.doc_id FROM documents d WHERE d.doc_id IN (SELECT doc_id FROM labels)")
def j8_require_existing(spark, sf_dir):
    name = F.expr("concat('d', doc_id, '.png')")
    listing = table(spark, sf_dir, "labels").select(name.alias("path"))
    return joins.require_existing(table(spark, sf_dir, "documents").withColumn("image", name), listing, ["image"]).select("doc_id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN o_orderstatus = 'F' THEN 'kept' WHEN o_orderstatus = 'O' THEN 'diverted' ELSE 'dropped' END AS outcome FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def j9_collect_by_parent(spark, sf_dir):
    parents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus")
    return joins.collect_by_parent(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), parents, "l_orderkey", "o_orderstatus", ["F"], ["O"])


@query(duck("vecs", f"WITH {_SCORED} SELECT vec_id, round(similarity, 6) AS similarity FROM sc"))
def j10_score_to_reference(spark, sf_dir):
    return scored(spark, sf_dir).select("vec_id", F.round("similarity", 6).alias("similarity"))


def _knn_sql(where="", condition="TRUE"):
    return f"""WITH s AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbour_id, round(list_sum([q.e[i] * b.e[i] for i in range(1, 65)]) / (q.norm * b.norm), 9) AS s FROM vecs q JOIN vecs b ON {condition} WHERE q.vec_id % 20 = 0 {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, neighbour_id) AS rank FROM s) SELECT query_id, neighbour_id, round(s, 6) AS similarity, rank::INTEGER AS rank FROM r WHERE rank <= 10"""


def _neighbours(out):
    return out.select("query_id", "neighbour_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(duck("vecs", _knn_sql()))
def j11_knn_join(spark, sf_dir):
    rows = views.vecs(spark, sf_dir)
    return _neighbours(VO.knn(rows.where("vec_id % 20 = 0"), rows, 10, "vec_id", "e"))


@query(duck("vecs", _knn_sql(condition="q.vec_id <> b.vec_id")))
def j12_search_by_id(spark, sf_dir):
    rows = views.vecs(spark, sf_dir)
    return _neighbours(VO.knn(rows.where("vec_id % 20 = 0"), rows, 10, "vec_id", "e", exclude_self=True))


@query(duck("vecs", _knn_sql("AND b.vec_id % 3 <> 0")))
def j13_search_valid(spark, sf_dir):
    rows = views.vecs(spark, sf_dir)
    return _neighbours(VO.knn(rows.where("vec_id % 20 = 0"), rows.where("vec_id % 3 <> 0"), 10, "vec_id", "e"))


@query(duck("vecs", f"WITH {_SIMS} SELECT id_a, id_b, round(s, 6) AS similarity FROM p WHERE s >= 0.35"))
def j14_similarity_pairs(spark, sf_dir):
    return VO.similar_pairs(views.vecs(spark, sf_dir), "vec_id", "e", 0.35).withColumn("similarity", F.round("similarity", 6))


@query()
def j15_ann_join_ivf(spark, sf_dir):
    rows = views.vecs(spark, sf_dir)
    index = VectorIndex.build(rows.where("vec_id % 3 <> 1"), "vec_id", "e", new_path(spark, "index"))
    index.add(rows, "vec_id", "e")  # the rest come later, and those that are there already are left alone
    return _neighbours(index.search(rows.where("vec_id % 20 = 0"), 10, "vec_id", "e"))


@query(
    duck(
        "boxes",
        """WITH RECURSIVE t AS (SELECT image_id, box_id, x1 + 7 AS x1, y1 + 5 AS y1, x2 + 7 AS x2, y2 + 5 AS y2 FROM boxes WHERE box_id % 3 <> 0),
q AS (SELECT a.image_id, a.box_id AS i, b.box_id AS j, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS inter, (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS s FROM boxes a JOIN t b ON a.image_id = b.image_id),
o AS (SELECT image_id, i, j, inter / (s - inter) AS iou, row_number() OVER (PARTITION BY image_id ORDER BY inter / (s - inter) DESC, i, j) AS k FROM q WHERE inter / (s - inter) >= 0.5),
r AS (SELECT DISTINCT image_id, 0::BIGINT AS k, []::BIGINT[] AS ui, []::BIGINT[] AS uj, []::BIGINT[] AS ks FROM o
 UNION ALL SELECT r.image_id, o.k, CASE WHEN list_contains(ui, o.i) OR list_contains(uj, o.j) THEN ui ELSE list_append(ui, o.i) END, CASE WHEN list_contains(ui, o.i) OR list_contains(uj, o.j) THEN uj ELSE list_append(uj, o.j) END, CASE WHEN list_contains(ui, o.i) OR list_contains(uj, o.j) THEN ks ELSE list_append(ks, o.k) END
 FROM r JOIN o ON o.image_id = r.image_id AND o.k = r.k + 1),
z AS (SELECT image_id, unnest(arg_max(ks, k)) AS k FROM r GROUP BY image_id)
SELECT o.image_id, i, j, round(iou, 6) AS iou FROM z JOIN o ON o.image_id = z.image_id AND o.k = z.k""",
    )
)
def j16_match_boxes_greedy(spark, sf_dir):
    rows = views.boxes(spark, sf_dir)
    moved = rows.where("box_id % 3 <> 0").select("image_id", "box_id", F.col("x1") + 7, F.col("y1") + 5, F.col("x2") + 7, F.col("y2") + 5).toDF("image_id", "box_id", *B.Box._fields)
    return joins.match_greedy(rows, moved, "image_id").withColumn("iou", F.round("iou", 6))


@query(
    duck(
        "grid",
        """WITH p AS (SELECT grid_id - 1 AS grid_id, y, x FROM grid WHERE in_a AND grid_id > 0), t AS (SELECT grid_id, y, x FROM grid WHERE in_b),
tp AS (SELECT grid_id, count(*) AS tp FROM p WHERE EXISTS (SELECT 1 FROM t WHERE t.grid_id = p.grid_id AND (t.y - p.y) ** 2 + (t.x - p.x) ** 2 <= 1) GROUP BY 1), np AS (SELECT grid_id, count(*) AS np FROM p GROUP BY 1), nt AS (SELECT grid_id, count(*) AS nt FROM t GROUP BY 1),
h AS (SELECT grid_id, count(*) AS h FROM t WHERE EXISTS (SELECT 1 FROM p WHERE t.grid_id = p.grid_id AND (t.y - p.y) ** 2 + (t.x - p.x) ** 2 <= 1) GROUP BY 1)
SELECT grid_id, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(nt, 0) - coalesce(h, 0) AS fn FROM np FULL JOIN nt USING (grid_id) LEFT JOIN tp USING (grid_id) LEFT JOIN h USING (grid_id)""",
    )
)
def j17_match_points(spark, sf_dir):
    cells = views.grid(spark, sf_dir)
    pred = cells.where("in_a AND grid_id > 0").select((F.col("grid_id") - 1).alias("grid_id"), "y", "x")
    return grids.match_counts(pred, cells.where("in_b").select("grid_id", "y", "x"), 1.0)


_CENTRES = [100.0, 127.0, 150.0]
_LABEL = "CASE WHEN least(abs({v} - 100), abs({v} - 127), abs({v} - 150)) > {c} THEN -1 WHEN abs({v} - 100) <= abs({v} - 127) AND abs({v} - 100) <= abs({v} - 150) THEN 0 WHEN abs({v} - 127) <= abs({v} - 150) THEN 1 ELSE 2 END"


@query(duck("grid", f"SELECT grid_id, y, x, ({_LABEL.format(v='gray', c=20)})::INTEGER AS label FROM grid"))
def j18_assign_nearest(spark, sf_dir):
    return grids.nearest_centre(views.grid(spark, sf_dir), _CENTRES, F.col("gray").cast("double"), 20.0).select("grid_id", "y", "x", F.col("label").cast("int").alias("label"))


@query(duck("grid", """WITH m AS (SELECT grid_id, avg(gray) FILTER (WHERE in_a) AS ma, avg(gray) FILTER (WHERE in_b) AS mb FROM grid GROUP BY 1), d AS (SELECT g.*, coalesce(abs(gray - ma), 1e308) AS da, coalesce(abs(gray - mb), 1e308) AS db FROM grid g JOIN m USING (grid_id))
SELECT grid_id, y, x, CASE WHEN in_a THEN 'a' WHEN in_b THEN 'b' WHEN da <= db AND da <= 14 THEN 'a' WHEN db < da AND db <= 14 THEN 'b' END AS side FROM d"""))
def j19_assign_unlabelled(spark, sf_dir):
    return grids.assign_unlabelled(views.grid(spark, sf_dir), cutoff=14.0).select("grid_id", "y", "x", "side")


@query(duck("pairs", "SELECT doc_id, length(texture_a)::INTEGER AS texture_a_n, length(texture_b)::INTEGER AS texture_b_n FROM pairs"))
def j20_embed_distinct(spark, sf_dir):
    measure = lambda texts: texts.withColumn("n", F.length("text"))
    rows = views.pairs(spark, sf_dir)
    return joins.apply_once(joins.apply_once(rows, "texture_a", measure), "texture_b", measure).select("doc_id", "texture_a_n", "texture_b_n")


@query(duck("preds", "SELECT crop_name, iou_a AS first, iou_b AS second, iou_b - iou_a AS gain FROM preds WHERE score >= 0.1"))
def j21_compare_runs(spark, sf_dir):
    rows = views.preds(spark, sf_dir)
    first = rows.select("crop_name", F.lit("first").alias("run"), F.col("iou_a").alias("iou"))
    second = rows.where("score >= 0.1").select("crop_name", F.lit("second").alias("run"), F.col("iou_b").alias("iou"))
    wide = joins.compare_runs(first.unionByName(second), "crop_name", "run", "iou", ["first", "second"])
    return wide.select("crop_name", "first", "second", (F.col("second") - F.col("first")).alias("gain"))


@query(
    duck(
        "grid",
        """WITH b AS (SELECT DISTINCT grid_id, k AS box_id, k AS x1, (k + grid_id) % 3 AS y1, k + 4 AS x2, (k + grid_id) % 3 + 5 AS y2 FROM grid, range(0, 5) r(k)),
s AS (SELECT b.grid_id, box_id, count(*) FILTER (WHERE in_a) / 20 AS a, count(*) FILTER (WHERE in_b) / 20 AS bb, count(*) FILTER (WHERE abs(v) < 0.03) / 20 AS d FROM b JOIN grid g ON g.grid_id = b.grid_id AND g.x >= x1 AND g.x < x2 AND g.y >= y1 AND g.y < y2 GROUP BY 1, 2)
SELECT grid_id, box_id, round(a, 6) AS frac_a, round(bb, 6) AS frac_b, CASE WHEN least(a, bb) < 0.2 THEN -1 ELSE round(d, 6) END AS score FROM s""",
    )
)
def j22_cells_in_boxes(spark, sf_dir):
    cells = views.grid(spark, sf_dir).withColumn("edge", F.abs("v") < 0.03)
    k = F.col("box_id")
    top = (k + F.col("grid_id")) % 3
    boxes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("grid_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("box_id")).select("grid_id", "box_id", k.alias("x1"), top.alias("y1"), (k + 4).alias("x2"), (top + 5).alias("y2"))
    out = grids.cells_in_boxes(cells, boxes, "edge")
    return out.select("grid_id", "box_id", *[F.round(c, 6).alias(c) for c in ("frac_a", "frac_b", "score")])


@query("WITH i AS (SELECT doc_id * 2 AS vec_id, doc_id AS position FROM documents) SELECT vec_id, position, coalesce(label, -1) AS label FROM i LEFT JOIN embeddings USING (vec_id)")
def j23_lookup(spark, sf_dir):
    ids = table(spark, sf_dir, "documents").select((F.col("doc_id") * 2).alias("vec_id"), F.col("doc_id").alias("position"))
    return joins.lookup(table(spark, sf_dir, "embeddings").select("vec_id", "label"), ids, "vec_id", {"label": F.lit(-1)}).select("vec_id", "position", "label")


@query(duck("grid", f"WITH w AS (SELECT DISTINCT grid_id, {_LABEL.format(v='(grid_id % 60 + 90)', c=40)} AS wanted FROM grid) SELECT g.grid_id, y, x FROM grid g JOIN w ON w.grid_id = g.grid_id AND w.wanted = {_LABEL.format(v='gray', c=60)} AND w.wanted >= 0"))
def j24_select_by_values(spark, sf_dir):
    cells = grids.nearest_centre(views.grid(spark, sf_dir), _CENTRES, F.col("gray").cast("double"), 60.0)
    wanted = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("grid_id"))
    snapped = grids.nearest_centre(wanted, _CENTRES, (F.col("grid_id") % 60 + 90).cast("double"), 40.0).where("label >= 0")
    return cells.join(snapped, ["grid_id", "label"], "left_semi").select("grid_id", "y", "x")
