"""Projections, filters and predicates (P)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import boxes as B
from gleaner.functions import text as T
from gleaner.operators import grids, records
from gleaner.plans import views
from gleaner.plans.registry import query
from gleaner.plans.views import duck, table

IMG = (F.col, "img_w", "img_h")
KEYS = ["image_id", "box_id"]


def _img():
    return F.col("img_w"), F.col("img_h")


_CLAMP = "greatest(0, least(x1, img_w - 1)) AS cx1, greatest(0, least(y1, img_h - 1)) AS cy1, greatest(0, least(x2, img_w)) AS cx2, greatest(0, least(y2, img_h)) AS cy2"


@query(duck("boxes", f"SELECT image_id, box_id, {_CLAMP} FROM boxes"))
def p1_clamp_bbox(spark, sf_dir):
    box = B.clamp(B.Box.of(), *_img())
    return views.boxes(spark, sf_dir).select(*KEYS, *[c.alias(f"c{n}") for c, n in zip(box, box._fields, strict=True)])


@query(duck("boxes", "SELECT image_id, box_id, (x2 - x1) * (y2 - y1) AS area, x2 - x1 AS width, y2 - y1 AS height, (x1 + x2) / 2 AS mid_x, (y1 + y2) / 2 AS mid_y FROM boxes"))
def p2_bbox_measures(spark, sf_dir):
    box = B.Box.of()
    x, y = box.centre
    return views.boxes(spark, sf_dir).select(*KEYS, box.area.alias("area"), box.width.alias("width"), box.height.alias("height"), x.alias("mid_x"), y.alias("mid_y"))


@query(duck("boxes", f"SELECT image_id, box_id, cx1 < cx2 AND cy1 < cy2 AS valid FROM (SELECT *, {_CLAMP} FROM boxes) t"))
def p3_is_valid_bbox(spark, sf_dir):
    return views.boxes(spark, sf_dir).select(*KEYS, B.is_valid(B.clamp(B.Box.of(), *_img())).alias("valid"))


@query(duck("boxes", "SELECT image_id, box_id AS id, [x1, y1, x2, y2] AS coords FROM boxes"))
def p4_convert_coords(spark, sf_dir):
    return views.boxes(spark, sf_dir).select("image_id", F.col("box_id").alias("id"), F.array(*B.Box.of()).alias("coords"))


@query(duck("boxes", "SELECT image_id, box_id, greatest(0, x1 - 16) AS x1, greatest(0, y1 - 24) AS y1, greatest(0, x2 - 16) AS x2, greatest(0, y2 - 24) AS y2 FROM boxes"))
def p5_unpad(spark, sf_dir):
    return views.boxes(spark, sf_dir).select(*KEYS, *B.shift_back(B.Box.of(), F.lit(16), F.lit(24)).named())


@query(
    duck(
        "boxes",
        """WITH s AS (SELECT image_id, box_id, img_w, img_h, CASE WHEN img_w > 512 OR img_h > 512 THEN least(512 / img_w, 512 / img_h) ELSE 1.0 END AS s FROM boxes),
n AS (SELECT image_id, box_id, floor(img_w * s)::BIGINT AS new_w, floor(img_h * s)::BIGINT AS new_h FROM s)
SELECT *, (512 - new_w) // 2 AS off_x, (512 - new_h) // 2 AS off_y FROM n""",
    )
)
def p6_letterbox(spark, sf_dir):
    return views.boxes(spark, sf_dir).select(*KEYS, *[c.alias(n) for n, c in B.letterbox(*_img(), 512).items()])


@query(duck("boxes", "SELECT image_id, box_id, [round(10 * (x2 - x1) / 64 + x1, 6), round(20 * (y2 - y1) / 48 + y1, 6)] AS point FROM boxes"))
def p7_points_to_image(spark, sf_dir):
    points = F.array(F.array(F.lit(10.0), F.lit(20.0)))
    moved = B.points_to_image(points, B.Box.of(), F.lit(64), F.lit(48))
    return views.boxes(spark, sf_dir).select(*KEYS, F.transform(moved[0], lambda c: F.round(c, 6)).alias("point"))


@query(duck("boxes", "SELECT image_id, box_id, round(x1 * 1024 / img_w, 6) AS x1, round(y1 * 1024 / img_h, 6) AS y1, round(x2 * 1024 / img_w, 6) AS x2, round(y2 * 1024 / img_h, 6) AS y2 FROM boxes"))
def p8_scale_to_square(spark, sf_dir):
    box = B.to_square(B.Box.of(), *_img())
    return views.boxes(spark, sf_dir).select(*KEYS, *[F.round(c, 6).alias(n) for c, n in zip(box, box._fields, strict=True)])


# not rounded: halves of pixels lie on ties of six places, which engines round differently
@query(duck("boxes", "SELECT image_id, box_id, (x1 + x2) / 2 / img_w AS cx, (y1 + y2) / 2 / img_h AS cy, (x2 - x1) / img_w AS w, (y2 - y1) / img_h AS h, x1::DOUBLE AS back_x1, y2::DOUBLE AS back_y2 FROM boxes"))
def p9_centre_form(spark, sf_dir):
    form = B.to_centre(B.Box.of(), *_img())
    back = B.from_centre(form["cx"], form["cy"], form["w"], form["h"], *_img())
    return views.boxes(spark, sf_dir).select(*KEYS, *[c.alias(n) for n, c in form.items()], F.round(back.x1, 6).alias("back_x1"), F.round(back.y2, 6).alias("back_y2"))


_CATEGORY = "CASE WHEN greatest(x2 - x1, y2 - y1) < 64 OR (x2 - x1) * (y2 - y1) < 2000 THEN 'tiny' WHEN greatest(x2 - x1, y2 - y1) < 128 OR (x2 - x1) * (y2 - y1) < 8000 THEN 'small' WHEN greatest(x2 - x1, y2 - y1) < 256 OR (x2 - x1) * (y2 - y1) < 32000 THEN 'medium' WHEN greatest(x2 - x1, y2 - y1) < 512 OR (x2 - x1) * (y2 - y1) < 128000 THEN 'large' ELSE 'xlarge' END"


@query(duck("boxes", f"SELECT *, CASE category WHEN 'tiny' THEN 64 WHEN 'small' THEN 128 WHEN 'medium' THEN 256 WHEN 'large' THEN 512 ELSE 1024 END::INTEGER AS target FROM (SELECT image_id, box_id, {_CATEGORY} AS category FROM boxes) t"))
def p10_size_category(spark, sf_dir):
    box = B.Box.of()
    category, target = B.size_category(box.width, box.height)
    return views.boxes(spark, sf_dir).select(*KEYS, category.alias("category"), target.alias("target"))


@query(duck("boxes", "SELECT image_id, box_id, concat('img', image_id, '_', x1, '_', y1, '_', x2, '_', y2, CASE WHEN passed THEN '_FIXED' ELSE '' END, '.jpg') AS crop FROM boxes"))
def p11_crop_key(spark, sf_dir):
    stem = F.concat(F.lit("img"), F.col("image_id").cast("string"))
    return views.boxes(spark, sf_dir).select(*KEYS, B.crop_key(stem, B.Box.of(), F.col("passed")).alias("crop"))


@query(duck("boxes", f"SELECT image_id, box_id, cx1 AS x1, cy1 AS y1, cx2 AS x2, cy2 AS y2 FROM (SELECT *, {_CLAMP} FROM boxes WHERE x1 < x2 AND y1 < y2) t WHERE cx1 < cx2 AND cy1 < cy2"))
def p12_validate_bboxes(spark, sf_dir):
    return records.valid_boxes(views.boxes(spark, sf_dir)).select(*KEYS, *B.Box.of())


_FIX = """WITH n AS (SELECT *, y2 >= img_h - 10 AS nb, y1 <= 10 AS nt, x2 >= img_w - 10 AS nr, x1 <= 10 AS nl, least(x2 - x1, img_w // 4) AS w, least(y2 - y1, img_h // 4) AS h FROM boxes),
v AS (SELECT *, CASE WHEN nb THEN greatest(img_h - h, 0) ELSE y1 END AS by1, CASE WHEN nb THEN CASE WHEN img_h - h < 0 THEN h ELSE img_h END ELSE y2 END AS by2,
 CASE WHEN nr THEN greatest(img_w - w, 0) ELSE x1 END AS bx1, CASE WHEN nr THEN CASE WHEN img_w - w < 0 THEN w ELSE img_w END ELSE x2 END AS bx2 FROM n),
f AS (SELECT image_id, box_id, img_w, img_h, x1 AS ox1, y1 AS oy1, x2 AS ox2, y2 AS oy2, nb OR nt OR nr OR nl AS was_fixed,
 CASE WHEN nl THEN CASE WHEN w > img_w THEN img_w - w ELSE 0 END ELSE bx1 END AS x1, CASE WHEN nt THEN CASE WHEN h > img_h THEN img_h - h ELSE 0 END ELSE by1 END AS y1,
 CASE WHEN nl THEN least(w, img_w) ELSE bx2 END AS x2, CASE WHEN nt THEN least(h, img_h) ELSE by2 END AS y2 FROM v)
"""


@query(duck("boxes", _FIX + "SELECT image_id, box_id, x1, y1, x2, y2, was_fixed FROM f"))
def p13_fix_at_border(spark, sf_dir):
    box, fixed = B.fix_at_border(B.Box.of(), *_img())
    return views.boxes(spark, sf_dir).select(*KEYS, *box.named(), fixed.alias("was_fixed"))


@query(
    duck(
        "boxes",
        _FIX
        + """, g AS (SELECT *, greatest(0, least(ox2, img_w)) - greatest(0, least(ox1, img_w - 1)) < 20 OR greatest(0, least(oy2, img_h)) - greatest(0, least(oy1, img_h - 1)) < 20 AS tiny FROM f)
SELECT image_id, box_id, tiny, tiny AND was_fixed AS was_fixed, CASE WHEN tiny THEN x1 ELSE ox1 END AS x1, CASE WHEN tiny THEN y1 ELSE oy1 END AS y1, CASE WHEN tiny THEN x2 ELSE ox2 END AS x2, CASE WHEN tiny THEN y2 ELSE oy2 END AS y2 FROM g""",
    )
)
def p14_tiny_gate(spark, sf_dir):
    return records.fix_tiny(views.boxes(spark, sf_dir)).select(*KEYS, "tiny", "was_fixed", *B.Box.of())


@query(duck("boxes", "SELECT image_id, box_id FROM boxes WHERE least(x2 - x1, y2 - y1) >= 64"))
def p15_min_size(spark, sf_dir):
    box = B.Box.of()
    return views.boxes(spark, sf_dir).where(F.least(box.width, box.height) >= 64).select(*KEYS)


@query(duck("pairs", "SELECT doc_id FROM pairs WHERE len(regexp_extract_all(texture_a, '[^ ]+')) >= 2 AND len(regexp_extract_all(texture_b, '[^ ]+')) >= 2"))
def p16_valid_points(spark, sf_dir):
    rows = views.pairs(spark, sf_dir)
    points = F.struct(*[F.array_remove(F.split(f"texture_{k}", " "), "").alias(k) for k in "ab"])
    return records.with_points(rows.withColumn("points", points), "points", ("a", "b"), 2).select("doc_id")


@query(duck("pairs", "SELECT doc_id, texture_b FROM pairs WHERE texture_a IS NOT NULL AND length(trim(texture_a)) > 0 AND texture_b IS NOT NULL AND length(trim(texture_b)) > 0"))
def p17_require_fields(spark, sf_dir):
    return records.require_fields(views.pairs(spark, sf_dir), ["texture_a", "texture_b"]).select("doc_id", "texture_b")


_WORDS = "len(regexp_extract_all(texture_a, '[^ ]+')) AS wa, len(regexp_extract_all(texture_b, '[^ ]+')) AS wb"
_LENGTH = "CASE WHEN wa < 4 THEN 'texture_a too short' WHEN wb < 4 THEN 'texture_b too short' WHEN wa > 12 THEN 'texture_a too long' WHEN wb > 12 THEN 'texture_b too long' ELSE 'OK' END"


@query(duck("pairs", f"SELECT doc_id, {_LENGTH} AS reason FROM (SELECT doc_id, {_WORDS} FROM pairs) t"))
def p18_validate_texts(spark, sf_dir):
    return views.pairs(spark, sf_dir).select("doc_id", T.length_reason(F.col("texture_a"), F.col("texture_b")).alias("reason"))


_ENTROPY = """e AS (SELECT doc_id, -sum(n / t * log2(n / t)) AS h FROM (SELECT doc_id, c, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY doc_id) AS t
 FROM (SELECT doc_id, unnest(string_split({col}, '')) AS c FROM {src}) u GROUP BY doc_id, c) v GROUP BY doc_id)"""


@query(
    duck(
        "pairs",
        "WITH "
        + _ENTROPY.format(col="texture_a", src="pairs").replace("e AS", "ea AS")
        + ", "
        + _ENTROPY.format(col="texture_b", src="pairs").replace("e AS", "eb AS")
        + """ SELECT p.doc_id, round(coalesce(ea.h, 0), 3) AS entropy_a, round(coalesce(eb.h, 0), 3) AS entropy_b, round(least(coalesce(ea.h, 0), coalesce(eb.h, 0)), 3) AS min_entropy, coalesce(ea.h, 0) >= 3.5 AND coalesce(eb.h, 0) >= 3.5 AS passed
FROM pairs p LEFT JOIN ea ON p.doc_id = ea.doc_id AND texture_a <> '' LEFT JOIN eb ON p.doc_id = eb.doc_id AND texture_b <> ''""",
    )
)
def p19_entropy_filter(spark, sf_dir):
    rows = views.pairs(spark, sf_dir).select("doc_id", T.entropy(F.col("texture_a")).alias("ea"), T.entropy(F.col("texture_b")).alias("eb"))
    return records.entropy_gate(rows, "ea", "eb", 3.5).select("doc_id", "entropy_a", "entropy_b", "min_entropy", "passed")


_COUNTS = """WITH m AS (SELECT grid_id, count(*) AS cells, count(*) FILTER (WHERE in_a) AS a, count(*) FILTER (WHERE in_b) AS b FROM grid GROUP BY grid_id)
"""


@query(duck("grid", _COUNTS + "SELECT grid_id, round(a / cells, 6) AS cover_a, round(b / cells, 6) AS cover_b, CASE WHEN a / cells < 0.3 OR b / cells < 0.3 THEN 'low_coverage' END AS fail_reason FROM m"))
def p20_coverage_gate(spark, sf_dir):
    return grids.coverage_gate(views.grid(spark, sf_dir), 0.3)


@query(duck("grid", _COUNTS + "SELECT grid_id, CASE WHEN a / cells < 0.25 THEN 'no_boundary_pixels' WHEN b > 26 THEN 'too_fragmented' WHEN a > 26 THEN 'too_many_boundary_components' END AS reason FROM m"))
def p21_prefilter_reason(spark, sf_dir):
    counts = grids.mask_counts(views.grid(spark, sf_dir))
    return counts.select("grid_id", grids.prefilter_reason(F.col("a") / F.col("cells"), F.col("b"), F.col("a"), least=0.25, most_regions=26, most_parts=26).alias("reason"))


_SAID = "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN ' PASS ' ELSE 'Fail' END"


@query(f"SELECT event_id, CASE WHEN verdict IS NULL THEN TRUE ELSE lower(trim(verdict)) = 'pass' END AS passed, CASE WHEN verdict IS NULL THEN 'VLM_ERROR' ELSE upper(trim(event_type)) END AS reason, CASE WHEN verdict IS NULL THEN 0.0 ELSE least(greatest(value / 50, 0), 1) END AS confidence FROM (SELECT *, {_SAID} AS verdict FROM events) t")
def p22_normalize_verdict(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("verdict", F.expr(_SAID)).withColumn("confidence", F.col("value") / 50)
    return records.normalized_verdicts(rows, "verdict", "event_type", "confidence").select("event_id", "passed", "reason", "confidence")


@query("SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'rejected' WHEN doc_id % 5 = 0 THEN 'valid' WHEN quality = 1 THEN 'valid' ELSE 'rejected' END AS status FROM labels")
def p23_advance_status(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("prefilter", F.when(F.col("doc_id") % 11 == 0, "unreadable"))
    return rows.select("doc_id", records.next_status(F.col("prefilter"), F.col("quality") == 1, F.col("doc_id") % 5 == 0).alias("status"))


_ANSWER = "CASE box_id % 4 WHEN 0 THEN 'good_as_is' WHEN 1 THEN concat('Refine: [[', greatest(x1, 0), ', ', greatest(y1, 0), ', ', x2, ', ', y2, ']] ok') WHEN 2 THEN concat('box [', greatest(x1, 0), ',', greatest(y1, 0), ',', x2, ',', y2, ']') ELSE 'NO TRANSITION here' END"


@query(
    duck(
        "boxes",
        """SELECT image_id, box_id, CASE WHEN box_id % 4 = 0 THEN 'keep' WHEN box_id % 4 = 3 THEN 'discard' WHEN x2 < 0 OR y2 < 0 THEN 'keep' WHEN inside THEN 'refine' ELSE 'discard' END AS action,
CASE WHEN box_id % 4 IN (1, 2) AND inside THEN [greatest(x1, 0), greatest(y1, 0), x2, y2] END AS bbox
FROM (SELECT *, greatest(x1, 0) < x2 AND x2 <= img_w AND greatest(y1, 0) < y2 AND y2 <= img_h AS inside FROM boxes) t""",
    )
)
def p24_refine_action(spark, sf_dir):
    rows = views.boxes(spark, sf_dir).withColumn("answer", F.expr(_ANSWER))
    action, bbox = T.refine_action(F.col("answer"), *_img())
    return rows.select(*KEYS, action.alias("action"), bbox.alias("bbox"))


@query(duck("pairs", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE concat('doc_', doc_id) END AS image_path, concat('doc_', doc_id) AS crop_name, [0, 0, 0, 0] AS coords FROM pairs"))
def p25_adapt_entry(spark, sf_dir):
    rows = views.pairs(spark, sf_dir).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("source")).alias("image_path"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("crop_name"), F.lit(None).cast("array<int>").alias("coords"))
    return records.adapted(rows)


@query(
    """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 0.9::DOUBLE ELSE 0.5::DOUBLE END AS quality, CASE WHEN vec_id % 3 = 0 THEN concat('k', vec_id) END AS note FROM embeddings"""
)
def p26_update_metadata(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.lit(0.5).alias("quality"), F.create_map().cast("map<string,string>").alias("extra"))
    changes = rows.where("vec_id % 3 = 0").select("vec_id", F.lit(0.9).alias("quality"), F.concat(F.lit("k"), F.col("vec_id").cast("string")).alias("note"))
    return records.updated(rows, changes, "vec_id").select("vec_id", "quality", F.col("extra")["note"].alias("note"))


_SKIP = f"""WITH w AS (SELECT doc_id, texture_a, texture_b, {_WORDS} FROM pairs),
s AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'not_passed' WHEN doc_id % 17 = 0 THEN 'missing_crop' WHEN doc_id % 19 = 0 THEN 'no_masks' WHEN {_LENGTH} <> 'OK' THEN 'bad_text' END AS skip_reason FROM w)
"""


def _training(spark, sf_dir):
    rows = views.pairs(spark, sf_dir).withColumns({"passed": F.col("doc_id") % 13 != 0, "crop_name": F.when(F.col("doc_id") % 17 != 0, F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))), "has_masks": F.col("doc_id") % 19 != 0})
    return records.with_skip_reason(rows)


@query(duck("pairs", _SKIP + "SELECT doc_id, texture_a, texture_b FROM s WHERE skip_reason IS NULL"))
def p27_training_rows(spark, sf_dir):
    return _training(spark, sf_dir).where("skip_reason IS NULL").select("doc_id", "texture_a", "texture_b")


@query(duck("pairs", _SKIP + "SELECT skip_reason, count(*) AS n FROM s WHERE skip_reason IS NOT NULL GROUP BY 1"))
def p27_skip_counts(spark, sf_dir):
    return _training(spark, sf_dir).where("skip_reason IS NOT NULL").groupBy("skip_reason").agg(F.count("*").alias("n"))


@query(
    duck(
        "grid",
        """WITH m AS (SELECT g.grid_id, count(*) AS cells, count(*) FILTER (WHERE g.in_a) AS a, count(*) FILTER (WHERE h.in_a) AS b, count(*) FILTER (WHERE g.in_a AND h.in_a) AS shared FROM grid g JOIN grid h ON h.grid_id = g.grid_id + 1 AND h.y = g.y AND h.x = g.x GROUP BY 1)
SELECT grid_id, CASE WHEN a < 18 THEN 'mask_a too small' WHEN b < 18 THEN 'mask_b too small' WHEN a / cells < 0.3 OR b / cells < 0.3 THEN 'mask covers too little' WHEN greatest(a, b) / greatest(least(a, b), 1) > 1.4 THEN 'area ratio too extreme'
 WHEN shared / least(a, b) > 0.45 THEN 'masks overlap too much' ELSE '' END AS reason FROM m""",
    )
)
def p28_validate_pair(spark, sf_dir):
    counts = grids.pair_counts(views.grid(spark, sf_dir), F.col("grid_id") + 1)
    reason = grids.pair_reason(F.col("a"), F.col("b"), F.col("both"), F.col("cells"), least_cells=18, least_share=0.3, most_ratio=1.4, most_overlap=0.45)
    return counts.select("grid_id", reason.alias("reason"))


@query(duck("boxes", "SELECT image_id, box_id, CASE WHEN greatest(x2 - x1, y2 - y1) * 2 <= 256 THEN 2 ELSE 1 END::INTEGER AS factor FROM boxes"))
def p29_scale_factor(spark, sf_dir):
    box = B.Box.of()
    return views.boxes(spark, sf_dir).select(*KEYS, grids.scale_factor(box.height, box.width, 256, 2).alias("factor"))


@query(duck("preds", "SELECT crop_name, CASE WHEN (iou_a + iou_b) / 2 >= 0.7 THEN 'good' WHEN (iou_a + iou_b) / 2 >= 0.4 THEN 'medium' ELSE 'bad' END AS band FROM preds"))
def p30_quality_band(spark, sf_dir):
    from gleaner.operators.evaluate import quality_band

    return views.preds(spark, sf_dir).select("crop_name", quality_band((F.col("iou_a") + F.col("iou_b")) / 2).alias("band"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def p31_filter_status(spark, sf_dir):
    return records.with_status(table(spark, sf_dir, "orders"), "F", "o_orderstatus").select("o_orderkey")


@query(duck("grid", _COUNTS.replace("count(*) FILTER (WHERE in_b) AS b", "count(*) FILTER (WHERE v > 0) AS b, count(*) FILTER (WHERE in_a AND v > 0) AS shared") + "SELECT grid_id, CASE WHEN a < floor(0.3 * cells) AND b >= floor(0.3 * cells) THEN 'derive_a' WHEN b < floor(0.3 * cells) AND a >= floor(0.3 * cells) THEN 'derive_b' WHEN least(a, b) > 0 AND shared / least(a, b) > 0.7 THEN CASE WHEN a <= b THEN 'derive_b' ELSE 'derive_a' END ELSE 'as_is' END AS decision FROM m"))
def p32_complementary_rule(spark, sf_dir):
    cells = views.grid(spark, sf_dir).groupBy("grid_id").agg(F.count("*").alias("cells"), F.count_if("in_a").alias("a"), F.count_if(F.col("v") > 0).alias("b"), F.count_if(F.col("in_a") & (F.col("v") > 0)).alias("both"))
    return cells.select("grid_id", grids.complement_decision(F.col("a"), F.col("b"), F.col("both"), F.col("cells"), least=0.3).alias("decision"))


@query(
    duck(
        "grid",
        """WITH b AS (SELECT DISTINCT grid_id, grid_id % 5 - 2 AS x1, grid_id % 7 AS y1, grid_id % 5 + 9 AS x2, grid_id % 7 + 6 AS y2 FROM grid),
c AS (SELECT grid_id, greatest(0, least(x1, 15)) AS x1, greatest(0, least(y1, 11)) AS y1, greatest(0, least(x2, 16)) AS x2, greatest(0, least(y2, 12)) AS y2 FROM b),
t AS (SELECT c.*, i AS tx, j AS ty FROM c, range(0, 16) r(i), range(0, 12) s(j) WHERE i >= x1 AND i < x2 AND j >= y1 AND j < y2)
SELECT t.grid_id, ty AS y, tx AS x, g.v FROM t JOIN grid g ON g.grid_id = t.grid_id AND g.x = (tx - x1) * 8 // (x2 - x1) AND g.y = (ty - y1) * 8 // (y2 - y1)""",
    )
)
def p33_place_cells(spark, sf_dir):
    cells = views.grid(spark, sf_dir)
    box = B.Box(F.col("grid_id") % 5 - 2, F.col("grid_id") % 7, F.col("grid_id") % 5 + 9, F.col("grid_id") % 7 + 6)
    placed = cells.select("grid_id").distinct().select("grid_id", *box.named())
    return grids.placed(cells, placed, 8, 8, 16, 12).select("grid_id", "y", "x", "v")


# what rounds to zero is 0 in both, not -0 (+ 0.0)
@query(duck("grid", "SELECT grid_id, [round(avg(v), 6) + 0.0, round(var_pop(v), 6) + 0.0, round(max(v), 6) + 0.0] AS features FROM grid GROUP BY grid_id HAVING count(*) FILTER (WHERE in_a) >= 20"))
def p34_feature_rows(spark, sf_dir):
    stats = views.grid(spark, sf_dir).groupBy("grid_id").agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"), F.max("v").alias("top"), (F.count_if("in_a") >= 20).alias("success"))
    return records.feature_rows(stats, "grid_id", ["mean", "var", "top"])
