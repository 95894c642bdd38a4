"""Aggregations (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import boxes as B
from gleaner.operators import evaluate, grids, stats
from gleaner.operators import vectors as VO
from gleaner.plans import views
from gleaner.plans.registry import query
from gleaner.plans.projections_queries import _CATEGORY, _CLAMP
from gleaner.plans.views import duck, table


@query(duck("boxes", f"SELECT {_CATEGORY} AS category, count(*) AS n FROM boxes GROUP BY 1"))
def a1_category_counts(spark, sf_dir):
    box = B.Box.of()
    return views.boxes(spark, sf_dir).groupBy(B.size_category(box.width, box.height)[0].alias("category")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total, count(quality) AS processed, sum(quality)::BIGINT AS passed, count(quality) - sum(quality)::BIGINT AS failed, round(100.0 * sum(quality) / count(quality), 1)::DOUBLE AS pass_rate FROM documents LEFT JOIN labels USING (doc_id)")
def a2_pass_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return stats.pass_summary(rows.withColumn("ok", F.col("quality") == 1), "ok")


@query("SELECT event_type AS reason, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM events GROUP BY 1")
def a3_reason_histogram(spark, sf_dir):
    return stats.reason_histogram(table(spark, sf_dir, "events").select(F.col("event_type").alias("reason")), "reason")


@query(duck("boxes", f"SELECT count(*) AS input, (count(*) FILTER (WHERE NOT (cx1 < cx2 AND cy1 < cy2)))::BIGINT AS filtered, (count(*) FILTER (WHERE cx1 < cx2 AND cy1 < cy2 AND passed))::BIGINT AS fixed, (count(*) FILTER (WHERE cx1 < cx2 AND cy1 < cy2))::BIGINT AS output FROM (SELECT *, {_CLAMP} FROM boxes) t"))
def a4_process_stats(spark, sf_dir):
    kept = B.is_valid(B.clamp(B.Box.of(), F.col("img_w"), F.col("img_h")))
    per = views.boxes(spark, sf_dir).groupBy("image_id").agg(F.count("*").alias("input"), F.count_if(~kept).alias("filtered"), F.count_if(kept & F.col("passed")).alias("fixed"), F.count_if(kept).alias("output"))
    return per.agg(*[F.sum(c).alias(c) for c in ("input", "filtered", "fixed", "output")])


@query("SELECT o_orderpriority AS run, o_orderstatus AS iteration, grouping(o_orderpriority, o_orderstatus)::BIGINT AS level, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def a5_rollup_stats(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("iteration"), "o_totalprice")
    return rows.rollup("run", "iteration").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT user_id % 8 AS rank, count(*) FILTER (WHERE event_type <> 'error') AS successful, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) AS n FROM events GROUP BY 1")
def a6_results_per_worker(spark, sf_dir):
    error = F.when(F.col("event_type") == "error", "failed")
    return table(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("rank")).agg(F.count_if(error.isNull()).alias("successful"), F.count_if(error.isNotNull()).alias("failed"), F.count("*").alias("n"))


@query("SELECT o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_pop(o_totalprice), 4) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max, round(quantile_cont(o_totalprice, 0.25), 4) AS p25, round(quantile_cont(o_totalprice, 0.75), 4) AS p75 FROM orders GROUP BY 1")
def a7_distribution_profile(spark, sf_dir):
    out = stats.distribution(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    return out.select("o_orderpriority", *[F.round(c, 4).alias(c) for c in ("mean", "std")], "min", "max", *[F.round(c, 4).alias(c) for c in ("p25", "p75")])


_CENTROID = """c AS (SELECT pos, avg(x) AS m FROM (SELECT unnest(e) AS x, unnest(range(1, 65)) AS pos FROM vecs WHERE label = 0) t GROUP BY pos), cn AS (SELECT sqrt(sum(m * m)) AS n FROM c)"""


@query(duck("vecs", f"WITH {_CENTROID} SELECT (pos - 1)::INTEGER AS pos, round(m / n, 6) AS x FROM c, cn"))
def a8_centroid(spark, sf_dir):
    one = VO.centroid(views.vecs(spark, sf_dir).where("label = 0"), "e")
    return one.select(F.posexplode("centroid").alias("pos", "v")).select("pos", F.round("v", 6).alias("x"))


_SCORED = f"{_CENTROID}, cv AS (SELECT list(m / n ORDER BY pos) AS ce FROM c, cn), sc AS (SELECT vec_id, label, score, (list_sum([e[i] * ce[i] for i in range(1, 65)]) / norm + 1) / 2 AS similarity FROM vecs, cv)"


def scored(spark, sf_dir):
    rows = views.vecs(spark, sf_dir)
    return VO.score_to_reference(rows, VO.centroid(rows.where("label = 0"), "e"), "e")


@query(duck("vecs", f"WITH {_SCORED} SELECT count(*) AS n, round(avg(similarity), 6) AS mean, round(stddev_pop(similarity), 6) AS std, round(min(similarity), 6) AS min, round(max(similarity), 6) AS max FROM sc"))
def a9_score_summary(spark, sf_dir):
    s = F.col("similarity")
    return scored(spark, sf_dir).agg(F.count("*").alias("n"), *[F.round(f(s), 6).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


_SIMS = "p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, list_sum([a.e[i] * b.e[i] for i in range(1, 65)]) / (a.norm * b.norm) AS s FROM vecs a JOIN vecs b ON a.vec_id < b.vec_id)"


@query(duck("vecs", f"WITH {_SIMS} SELECT round(avg(s), 6) AS mean, round(min(s), 6) AS min, round(max(s), 6) AS max FROM p"))
def a10_similarity_summary(spark, sf_dir):
    """The mean by its closed form; extremes over all pairs, met block by block."""
    rows = views.vecs(spark, sf_dir)
    mean = VO.diversity(rows, "e").select(F.round("mean_similarity", 6).alias("mean"))
    ends = VO.similarity_extremes(rows, "vec_id", "e").select(F.round("min", 6).alias("min"), F.round("max", 6).alias("max"))
    return mean.join(ends)  # one row each


@query(duck("vecs", f"WITH {_SIMS} SELECT round(1 - avg(s), 6) AS diversity, (SELECT count(*) FROM vecs) AS n FROM p"))
def a11_diversity_score(spark, sf_dir):
    return VO.diversity(views.vecs(spark, sf_dir), "e").select(F.round("diversity", 6).alias("diversity"), "n")


@query(duck("grid", "SELECT grid_id, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (SELECT grid_id, gray // 8 AS g, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY grid_id) AS t FROM grid GROUP BY 1, 2) u GROUP BY 1"))
def a12_group_entropy(spark, sf_dir):
    rows = views.grid(spark, sf_dir).select("grid_id", F.expr("gray DIV 8").alias("g"))
    return stats.group_entropy(rows, ["grid_id"], "g").select("grid_id", F.round("entropy", 6).alias("entropy"))


@query(
    duck(
        "grid",
        """WITH o AS (SELECT * FROM (VALUES (0, 0, 1), (1, 1, 0), (2, 1, 1)) t(k, dy, dx)),
p AS (SELECT a.grid_id, k, (a.gray // 32)::DOUBLE AS i, (b.gray // 32)::DOUBLE AS j FROM grid a, o JOIN grid b ON a.grid_id = b.grid_id AND b.y = a.y + dy AND b.x = a.x + dx),
s AS (SELECT grid_id, k, i, j, count(*)::DOUBLE AS n FROM (SELECT * FROM p UNION ALL SELECT grid_id, k, j, i FROM p) u GROUP BY 1, 2, 3, 4),
w AS (SELECT *, n / sum(n) OVER (PARTITION BY grid_id, k) AS p FROM s),
f AS (SELECT grid_id, k, sum(p * (i - j) ** 2) AS contrast, sum(p / (1 + (i - j) ** 2)) AS homogeneity, sqrt(sum(p * p)) AS energy, sum(p * i) AS m, sum(p * i * i) AS q, sum(p * i * j) AS c FROM w GROUP BY 1, 2)
SELECT grid_id, round(avg(contrast), 6) AS contrast, round(avg(homogeneity), 6) AS homogeneity, round(avg(energy), 6) AS energy, round(avg(CASE WHEN q - m * m > 1e-12 THEN (c - m * m) / (q - m * m) ELSE 1 END), 6) AS correlation FROM f GROUP BY 1""",
    )
)
def a13_cooccurrence(spark, sf_dir):
    out = grids.cooccurrence(views.grid(spark, sf_dir), F.expr("gray DIV 32"), [(0, 1), (1, 0), (1, 1)])
    return out.select("grid_id", *[F.round(c, 6).alias(c) for c in ("contrast", "homogeneity", "energy", "correlation")])


@query(duck("grid", "WITH i AS (SELECT DISTINCT grid_id FROM grid), s AS (SELECT grid_id, var_pop(v) AS variance, avg(v) AS mean, stddev_pop(v) AS std, max(v) AS top, count(*) FILTER (WHERE in_a) / count(*) AS edge_share FROM grid WHERE v > 0.2 GROUP BY 1) SELECT grid_id, round(variance, 6) AS variance, round(mean, 6) AS mean, round(std, 6) AS std, round(top, 6) AS top, round(edge_share, 6) AS edge_share, mean IS NULL AS empty FROM i LEFT JOIN s USING (grid_id)"))
def a14_band_statistics(spark, sf_dir):
    cells = views.grid(spark, sf_dir).withColumn("band", F.col("v") > 0.2)
    out = grids.band_statistics(cells, table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("grid_id")), "band", "v", "in_a")
    return out.select("grid_id", *[F.round(c, 6).alias(c) for c in ("variance", "mean", "std", "top", "edge_share")], "empty")


def paired(spark, sf_dir):
    """Cells with the masks of the next grid (the last one's is the first) as prediction."""
    cells = views.grid(spark, sf_dir)
    n = table(spark, sf_dir, "embeddings").count()
    other = cells.select(((F.col("grid_id") - 1 + n) % n).alias("grid_id"), "y", "x", F.col("in_a").alias("pa"), F.col("in_b").alias("pb"), F.col("v").alias("pv"))
    return cells.join(other, ["grid_id", "y", "x"])


_PAIRED = "m AS (SELECT g.*, h.in_a AS pa, h.in_b AS pb, h.v AS pv FROM grid g JOIN grid h ON h.grid_id = (g.grid_id + 1) % (SELECT count(*) FROM embeddings) AND h.y = g.y AND h.x = g.x)"


@query(duck("grid", f"WITH {_PAIRED} SELECT grid_id, round(CASE WHEN count(*) FILTER (WHERE pa OR in_a) = 0 THEN 1 ELSE count(*) FILTER (WHERE pa AND in_a) / count(*) FILTER (WHERE pa OR in_a) END, 6) AS iou, round(CASE WHEN count(*) FILTER (WHERE pa) + count(*) FILTER (WHERE in_a) = 0 THEN 1 ELSE 2 * count(*) FILTER (WHERE pa AND in_a) / (count(*) FILTER (WHERE pa) + count(*) FILTER (WHERE in_a)) END, 6) AS dice FROM m GROUP BY 1"))
def a15_overlap_metrics(spark, sf_dir):
    return evaluate.overlap(paired(spark, sf_dir), "pa", "in_a").select("grid_id", F.round("iou", 6).alias("iou"), F.round("dice", 6).alias("dice"))


_ARI = """t AS (SELECT grid_id, p, t, count(*)::DOUBLE AS n FROM lab GROUP BY 1, 2, 3),
sa AS (SELECT grid_id, sum(n * (n - 1) / 2) AS sa FROM (SELECT grid_id, p, sum(n) AS n FROM t GROUP BY 1, 2) u GROUP BY 1), sb AS (SELECT grid_id, sum(n * (n - 1) / 2) AS sb FROM (SELECT grid_id, t, sum(n) AS n FROM t GROUP BY 1, 2) u GROUP BY 1),
s AS (SELECT grid_id, sum(n * (n - 1) / 2) AS s, sum(n) * (sum(n) - 1) / 2 AS q FROM t GROUP BY 1),
ari AS (SELECT s.grid_id, CASE WHEN (sa + sb) / 2 = sa * sb / q THEN 1 ELSE (s - sa * sb / q) / ((sa + sb) / 2 - sa * sb / q) END AS ari FROM s JOIN sa USING (grid_id) JOIN sb USING (grid_id))"""


@query(duck("grid", f"WITH {_PAIRED}, lab AS (SELECT grid_id, CASE WHEN pb THEN 2 WHEN pa THEN 1 ELSE 0 END AS p, CASE WHEN in_b THEN 2 WHEN in_a THEN 1 ELSE 0 END AS t FROM m), {_ARI} SELECT grid_id, round(ari, 6) AS ari FROM ari"))
def a16_adjusted_rand(spark, sf_dir):
    classes = paired(spark, sf_dir).select("grid_id", F.when(F.col("pb"), 2).when(F.col("pa"), 1).otherwise(0).alias("p"), F.when(F.col("in_b"), 2).when(F.col("in_a"), 1).otherwise(0).alias("t"))
    return evaluate.adjusted_rand(classes, "grid_id", "p", "t").select("grid_id", F.round("ari", 6).alias("ari"))


def _iou_sql(p, t):
    return f"count(*) FILTER (WHERE {p} AND {t}) / greatest(count(*) FILTER (WHERE {p} OR {t}), 1)"


def _dice_sql(p, t):
    return f"2 * count(*) FILTER (WHERE {p} AND {t}) / greatest(count(*) FILTER (WHERE {p}) + count(*) FILTER (WHERE {t}), 1)"


@query(
    duck(
        "grid",
        f"""WITH {_PAIRED}, k AS (SELECT grid_id, {_iou_sql("pa", "in_a")} AS aa, {_iou_sql("pb", "in_b")} AS bb, {_iou_sql("pa", "in_b")} AS ab, {_iou_sql("pb", "in_a")} AS ba,
 {_dice_sql("pa", "in_a")} AS daa, {_dice_sql("pb", "in_b")} AS dbb, {_dice_sql("pa", "in_b")} AS dab, {_dice_sql("pb", "in_a")} AS dba FROM m GROUP BY 1),
w AS (SELECT *, ba + ab > aa + bb AS sw FROM k),
lab AS (SELECT m.grid_id, CASE WHEN CASE WHEN sw THEN pa ELSE pb END THEN 2 WHEN CASE WHEN sw THEN pb ELSE pa END THEN 1 ELSE 0 END AS p, CASE WHEN in_b THEN 2 WHEN in_a THEN 1 ELSE 0 END AS t FROM m JOIN w USING (grid_id)), {_ARI}
SELECT grid_id, round(CASE WHEN sw THEN ba ELSE aa END, 6) AS iou_a, round(CASE WHEN sw THEN ab ELSE bb END, 6) AS iou_b, round(CASE WHEN sw THEN ba + ab ELSE aa + bb END / 2, 6) AS mean_iou,
 round(CASE WHEN sw THEN dba ELSE daa END, 6) AS dice_a, round(CASE WHEN sw THEN dab ELSE dbb END, 6) AS dice_b, round(CASE WHEN sw THEN dba + dab ELSE daa + dbb END / 2, 6) AS mean_dice, round(ari, 6) AS ari FROM w JOIN ari USING (grid_id)""",
    )
)
def a17_sample_metrics(spark, sf_dir):
    out = evaluate.sample_metrics(paired(spark, sf_dir), "pa", "pb", "in_a", "in_b")
    return out.select("grid_id", *[F.round(c, 6).alias(c) for c in ("iou_a", "iou_b", "mean_iou", "dice_a", "dice_b", "mean_dice", "ari")])


@query(duck("preds", "SELECT model, round(avg(iou_a), 6) AS iou_a, round(avg(iou_b), 6) AS iou_b, round(avg((iou_a + iou_b) / 2), 6) AS mean_iou, round(avg(CASE WHEN iou_a > 0 THEN score END), 6) AS ari FROM preds GROUP BY 1"))
def a18_aggregate_metrics(spark, sf_dir):
    rows = views.preds(spark, sf_dir).withColumn("ari", F.when(F.col("iou_a") > 0, F.col("score")).otherwise(F.lit(float("nan"))))
    return rows.groupBy("model").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("iou_a", "iou_b")], F.round(F.avg((F.col("iou_a") + F.col("iou_b")) / 2), 6).alias("mean_iou"), F.round(F.avg(F.nanvl("ari", F.lit(None).cast("double"))), 6).alias("ari"))


@query(duck("preds", "WITH a AS (SELECT avg(iou_a) AS base, avg(iou_b) AS new FROM preds) SELECT round(new - base, 6) AS delta, CASE WHEN abs(base) > 1e-8 THEN round(100 * (new - base) / base, 2) ELSE 0 END AS percent FROM a"))
def a19_improvement(spark, sf_dir):
    means = views.preds(spark, sf_dir).agg(F.avg("iou_a").alias("base"), F.avg("iou_b").alias("new"))
    delta, percent = evaluate.improvement(F.col("base"), F.col("new"))
    return means.select(F.round(delta, 6).alias("delta"), percent.alias("percent"))


@query(
    duck(
        "boxes",
        """WITH i AS (SELECT image_id, count(*) FILTER (WHERE passed) AS matched, count(*) FILTER (WHERE box_id % 3 <> 0) AS n_gt, count(*) AS n_pred, coalesce(sum(score) FILTER (WHERE passed), 0) AS iou_sum, max(score) AS mx, avg(score) AS mn FROM boxes GROUP BY 1)
SELECT count(*) AS images, round(avg(matched / greatest(n_gt, 1)), 6) AS recall, round(avg(matched / greatest(n_pred, 1)), 6) AS precision, round(avg(CASE WHEN matched > 0 THEN iou_sum / matched ELSE 0 END), 6) AS mean_iou, round(avg(mx), 6) AS max_confidence, round(avg(mn), 6) AS mean_confidence FROM i""",
    )
)
def a20_detection_metrics(spark, sf_dir):
    per = views.boxes(spark, sf_dir).groupBy("image_id").agg(F.count_if("passed").alias("matched"), F.count_if(F.col("box_id") % 3 != 0).alias("n_gt"), F.count("*").alias("n_pred"), F.coalesce(F.sum(F.when(F.col("passed"), F.col("score"))), F.lit(0.0)).alias("iou_sum"), F.max("score").alias("max_confidence"), F.avg("score").alias("mean_confidence"))
    out = evaluate.detection_metrics(per)
    return out.select("images", *[F.round(c, 6).alias(c) for c in out.columns if c != "images"])


@query(
    duck(
        "preds",
        """WITH r AS (SELECT row_number() OVER w AS rank, sum(matched::INT) OVER (ORDER BY score DESC, crop_name ROWS UNBOUNDED PRECEDING) AS tp FROM preds WINDOW w AS (ORDER BY score DESC, crop_name)), n AS (SELECT sum(matched::INT) AS n FROM preds),
l AS (SELECT lv, coalesce(max(tp / rank), 0) AS p FROM range(0, 101) t(lv) LEFT JOIN (SELECT r.*, floor(tp / n * 100 + 1e-9) AS level FROM r, n) u ON level >= lv GROUP BY 1) SELECT round(avg(p), 6) AS ap FROM l""",
    )
)
def a21_average_precision(spark, sf_dir):
    rows = views.preds(spark, sf_dir)
    truth = rows.agg(F.count_if("matched").alias("n")).first()["n"]
    ranked = evaluate.ranked_counts(rows, "score", "matched", "crop_name")
    return evaluate.average_precision(ranked, truth).select(F.round("ap", 6).alias("ap"))


_SWEEP = """n AS (SELECT count(*) AS n FROM embeddings), sc AS (SELECT g.grid_id, g.y, g.x, g.v + 0.5 * h.v AS score, g.in_a AS truth FROM grid g JOIN grid h ON h.grid_id = (g.grid_id + 1) % (SELECT n FROM n) AND h.y = g.y AND h.x = g.x),
th AS (SELECT i AS t, (i + 1) / 100 AS threshold FROM range(0, 99) r(i)), tr AS (SELECT grid_id, y, x FROM sc WHERE truth),
nr AS (SELECT grid_id, score, EXISTS (SELECT 1 FROM tr WHERE tr.grid_id = sc.grid_id AND abs(tr.y - sc.y) + abs(tr.x - sc.x) <= 1) AS near FROM sc),
mx AS (SELECT tr.grid_id, max(score) AS top FROM tr JOIN sc ON tr.grid_id = sc.grid_id AND abs(tr.y - sc.y) + abs(tr.x - sc.x) <= 1 GROUP BY tr.grid_id, tr.y, tr.x),
np AS (SELECT grid_id, t, count(*) AS np, count(*) FILTER (near) AS tp FROM nr JOIN th ON score >= threshold GROUP BY 1, 2), nt AS (SELECT grid_id, count(*) AS nt FROM tr GROUP BY 1),
hit AS (SELECT grid_id, t, count(*) AS hit FROM mx JOIN th ON top >= threshold GROUP BY 1, 2),
c AS (SELECT i.grid_id, th.t, threshold, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(nt, 0) - coalesce(hit, 0) AS fn FROM (SELECT DISTINCT grid_id FROM sc) i CROSS JOIN th LEFT JOIN np USING (grid_id, t) LEFT JOIN nt USING (grid_id) LEFT JOIN hit USING (grid_id, t)),
prf AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM c),
sweep AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f FROM prf)"""


def _sweep(spark, sf_dir):
    rows = paired(spark, sf_dir).withColumn("score", F.col("v") + 0.5 * F.col("pv"))
    return evaluate.pr_sweep(rows.select("grid_id", "y", "x", "score"), rows.where("in_a").select("grid_id", "y", "x"), [(i + 1) / 100 for i in range(99)], 1.0)


@query(duck("grid", f"WITH {_SWEEP} SELECT grid_id, t::INTEGER AS t, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f, 6) AS f FROM sweep"))
def a22_pr_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir).select("grid_id", "t", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f")])


@query(
    duck(
        "grid",
        f"""WITH {_SWEEP}, d AS (SELECT t, max(threshold) AS threshold, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM sweep GROUP BY t),
dp AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM d), df AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM dp),
o AS (SELECT * FROM df ORDER BY f DESC, t LIMIT 1), b AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY f DESC, t) AS k FROM sweep),
a AS (SELECT sum((r - r0) * (p + p0) / 2) AS ap FROM (SELECT r, p, coalesce(lag(r) OVER (ORDER BY r, t), 0) AS r0, coalesce(lag(p) OVER (ORDER BY r, t), p) AS p0 FROM df) u)
SELECT round(o.f, 6) AS ods_f, round(o.p, 6) AS ods_p, round(o.r, 6) AS ods_r, round(o.threshold, 6)::DOUBLE AS ods_threshold, (SELECT round(avg(f), 6) FROM b WHERE k = 1) AS ois_f, (SELECT round(avg(precision), 6) FROM b WHERE k = 1) AS ois_p, (SELECT round(avg(recall), 6) FROM b WHERE k = 1) AS ois_r, round(least(greatest(a.ap, 0), 1), 6) AS ap FROM o, a""",
    )
)
def a23_ods_ois_ap(spark, sf_dir):
    out = evaluate.ods_ois_ap(_sweep(spark, sf_dir))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_EDGES = [32, 64, 96, 128, 160]
_BUCKET = "CASE WHEN s < 32 THEN '<32' WHEN s < 64 THEN '32-64' WHEN s < 96 THEN '64-96' WHEN s < 128 THEN '96-128' WHEN s < 160 THEN '128-160' ELSE '>=160' END"


def _side():
    box = B.Box.of()
    return F.least(box.width, box.height)


@query(duck("boxes", f"SELECT {_BUCKET} AS bucket, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM (SELECT least(x2 - x1, y2 - y1) AS s FROM boxes) t GROUP BY 1"))
def a24_size_histogram(spark, sf_dir):
    return stats.size_histogram(views.boxes(spark, sf_dir), _side(), _EDGES)


@query(duck("boxes", "WITH r AS (SELECT image_id % 10 AS g, least(x2 - x1, y2 - y1) AS s, row_number() OVER (PARTITION BY image_id % 10 ORDER BY least(x2 - x1, y2 - y1)) AS k, count(*) OVER (PARTITION BY image_id % 10) AS n FROM boxes) SELECT g, round(avg(s), 6) AS mean, max(CASE WHEN k = n // 2 + 1 THEN s END) AS median, min(s) AS least, max(s) AS most FROM r GROUP BY g"))
def a25_size_summary(spark, sf_dir):
    rows = views.boxes(spark, sf_dir).select((F.col("image_id") % 10).alias("g"), _side().alias("s"))
    return stats.upper_median(rows, "s", ["g"]).select("g", F.round("mean", 6).alias("mean"), "median", "least", "most")


@query(duck("boxes", f"SELECT {_BUCKET} AS bucket, factor, count(*) AS n, round(avg(s * factor), 6) AS mean_output FROM (SELECT least(x2 - x1, y2 - y1) AS s, CASE WHEN greatest(x2 - x1, y2 - y1) * 2 <= 256 THEN 2 ELSE 1 END AS factor FROM boxes) t GROUP BY 1, 2"))
def a26_flow_by_bucket(spark, sf_dir):
    box = B.Box.of()
    rows = views.boxes(spark, sf_dir).select(_side().alias("s"), grids.scale_factor(box.height, box.width, 256).alias("factor"))
    label = F.expr(_BUCKET)
    return rows.groupBy(label.alias("bucket"), "factor").agg(F.count("*").alias("n"), F.round(F.avg(F.col("s") * F.col("factor")), 6).alias("mean_output"))


@query(duck("boxes", "SELECT (ceil(quantile_cont(greatest(x2 - x1, y2 - y1), 0.95) / 64) * 64)::BIGINT AS target FROM boxes"))
def a27_optimal_target(spark, sf_dir):
    box = B.Box.of()
    return stats.target_size(views.boxes(spark, sf_dir), F.greatest(box.width, box.height))


@query(
    duck(
        "grid",
        """WITH RECURSIVE h AS (SELECT grid_id, gray::DOUBLE AS v, count(*) AS n, floor(gray / 8) * 8 + 4 AS c FROM grid GROUP BY grid_id, gray),
l AS (SELECT grid_id, list({'v': v, 'n': n, 'c': c} ORDER BY v) AS cells, sum(n) AS total FROM h GROUP BY grid_id),
r AS (SELECT grid_id, 0 AS k, cells AS free, []::DOUBLE[] AS centres FROM l
 UNION ALL SELECT grid_id, k + 1, rest, CASE WHEN len([c FOR c IN centres IF abs(centre - c) <= 30]) = 0 THEN list_append(centres, centre) ELSE centres END
 FROM (SELECT *, list_sum([e.v * e.n FOR e IN near]) / list_sum([e.n FOR e IN near]) AS centre FROM
 (SELECT *, CASE WHEN len([e FOR e IN free IF abs(e.v - seed) <= 20]) > 0 THEN [e FOR e IN free IF abs(e.v - seed) <= 20] ELSE [e FOR e IN free IF e.c = seed] END AS near,
 CASE WHEN len([e FOR e IN free IF abs(e.v - seed) <= 20]) > 0 THEN [e FOR e IN free IF abs(e.v - seed) > 20] ELSE [e FOR e IN free IF e.c <> seed] END AS rest FROM
 (SELECT *, -(list_max([{'s': list_sum([x.n FOR x IN free IF x.c = e.c]), 'c': -e.c} FOR e IN free])).c AS seed FROM r WHERE len(free) > 0) a) b) d),
f AS (SELECT grid_id, unnest(arg_max(centres, k)) AS centre FROM r GROUP BY grid_id),
s AS (SELECT grid_id, centre, list_sum([e.n FOR e IN cells IF abs(e.v - centre) <= 20]) / total AS share FROM f JOIN l USING (grid_id))
SELECT grid_id, row_number() OVER (PARTITION BY grid_id ORDER BY share DESC, centre)::INTEGER AS rank, round(centre, 6) AS centre, round(share, 6) AS share FROM s WHERE share >= 0.05""",
    )
)
def a28_dominant_values(spark, sf_dir):
    return grids.dominant_values(views.grid(spark, sf_dir)).select("grid_id", "rank", F.round("centre", 6).alias("centre"), F.round("share", 6).alias("share"))


@query(duck("grid", "WITH i AS (SELECT DISTINCT grid_id FROM grid), s AS (SELECT grid_id, min(x) AS x1, max(x) + 1 AS x2, min(y) AS y1, max(y) + 1 AS y2 FROM grid WHERE v > 0.25 GROUP BY 1) SELECT grid_id, coalesce((x1 + x2) / 2 / 8, 0.5) AS cx, coalesce((y1 + y2) / 2 / 8, 0.5) AS cy, coalesce((x2 - x1) / 8, 0.1) AS w, coalesce((y2 - y1) / 8, 0.1) AS h FROM i LEFT JOIN s USING (grid_id)"))
def a29_extent(spark, sf_dir):
    on = F.col("v") > 0.25
    x1, x2 = F.min(F.when(on, F.col("x"))), F.max(F.when(on, F.col("x"))) + 1
    y1, y2 = F.min(F.when(on, F.col("y"))), F.max(F.when(on, F.col("y"))) + 1
    half, tenth = F.lit(0.5), F.lit(0.1)
    return views.grid(spark, sf_dir).groupBy("grid_id").agg(F.coalesce((x1 + x2) / 2 / 8, half).alias("cx"), F.coalesce((y1 + y2) / 2 / 8, half).alias("cy"), F.coalesce((x2 - x1) / 8, tenth).alias("w"), F.coalesce((y2 - y1) / 8, tenth).alias("h"))


@query(r"WITH w AS (SELECT source, len(regexp_extract_all(text, '[^ \t\r\n\f\v]+')) AS n FROM documents) SELECT count(*) AS n, count(DISTINCT source) AS sources, round(count(*) / count(DISTINCT source), 6) AS per_source, round(avg(n), 6) AS mean_words, min(n)::BIGINT AS least, max(n)::BIGINT AS most FROM w")
def a30_prompt_stats(spark, sf_dir):
    from gleaner.functions.text import words

    rows = table(spark, sf_dir, "documents").select("source", F.size(words(F.col("text"))).cast("long").alias("n"))
    return rows.agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.round(F.count("*") / F.countDistinct("source"), 6).alias("per_source"), F.round(F.avg("n"), 6).alias("mean_words"), F.min("n").alias("least"), F.max("n").alias("most"))


@query(duck("grid", "WITH p AS (SELECT grid_id, max(v) AS mx, avg(v) AS mn FROM grid GROUP BY 1), e AS (SELECT y, x, bool_or(v > 0.1) AS ever FROM grid GROUP BY 1, 2) SELECT (SELECT round(avg(mx), 6) FROM p) AS mean_max, (SELECT round(avg(mn), 6) FROM p) AS mean_mean, round(stddev_pop(v), 6) AS std, (SELECT count(*) FILTER (WHERE ever) / count(*) FROM e) AS active_share, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.9), 6) AS p90, round(quantile_cont(v, 0.99), 6) AS p99 FROM grid"))
def a31_score_diagnostics(spark, sf_dir):
    out = stats.score_diagnostics(views.grid(spark, sf_dir), "grid_id", ["y", "x"], "v")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query(duck("grid", "SELECT grid_id, round(avg(abs(v + 0.5 - 0.5)), 6) AS distance, count(*) FILTER (WHERE v > 0.1) / count(*) AS coverage, count(*) FILTER (WHERE in_a) / count(*) AS truth_coverage, count(*) FILTER (WHERE in_a AND v > 0.1) / count(*) AS overlap FROM grid GROUP BY 1"))
def a32_mask_diagnostics(spark, sf_dir):
    n, on = F.count("*"), F.col("v") > 0.1
    return views.grid(spark, sf_dir).groupBy("grid_id").agg(F.round(F.avg(F.abs(F.col("v") + 0.5 - 0.5)), 6).alias("distance"), (F.count_if(on) / n).alias("coverage"), (F.count_if("in_a") / n).alias("truth_coverage"), (F.count_if(F.col("in_a") & on) / n).alias("overlap"))


@query(duck("preds", "SELECT model, round(count(*) FILTER (WHERE iou_a >= 0.7) / count(*), 6) AS good, round(count(*) FILTER (WHERE iou_a < 0.4) / count(*), 6) AS bad FROM preds GROUP BY 1"))
def a33_band_shares(spark, sf_dir):
    band = evaluate.quality_band(F.col("iou_a"))
    return views.preds(spark, sf_dir).groupBy("model").agg(F.round(F.count_if(band == "good") / F.count("*"), 6).alias("good"), F.round(F.count_if(band == "bad") / F.count("*"), 6).alias("bad"))


@query(duck("runlog", "WITH a AS (SELECT run, avg(total) FILTER (WHERE phase = 'train') AS t, avg(total) FILTER (WHERE phase = 'val') AS v FROM runlog GROUP BY 1) SELECT run, round(v / t, 6) AS loss_ratio, round(t - v, 6) AS gap, round(t / v, 6) AS generalisation FROM a"))
def a34_learning_health(spark, sf_dir):
    out = stats.learning_health(views.runlog(spark, sf_dir))
    return out.select("run", *[F.round(c, 6).alias(c) for c in ("loss_ratio", "gap", "generalisation")])


@query(duck("runlog", "SELECT run, step, c AS component, round(v / total, 6) AS ratio FROM (SELECT run, step, total, 'part' AS c, part AS v FROM runlog UNION ALL SELECT run, step, total, 'rest', total - part - 1 FROM runlog) t WHERE total > 0 AND v <> 0"))
def a35_loss_ratios(spark, sf_dir):
    rows = views.runlog(spark, sf_dir).withColumn("rest", F.col("total") - F.col("part") - 1)
    return stats.loss_ratios(rows, ["part", "rest"]).withColumn("ratio", F.round("ratio", 6))


@query(
    duck(
        "vecs",
        """WITH p AS (SELECT list_sum([a.e[i] * b.e[i] for i in range(1, 65)]) / (a.norm * b.norm) AS pos, list_sum([a.e[i] * c.e[i] for i in range(1, 65)]) / (a.norm * c.norm) AS neg FROM vecs a JOIN vecs b ON b.vec_id = a.vec_id + 10 JOIN vecs c ON c.vec_id = a.vec_id + 3)
SELECT round(avg(pos), 6) AS mean_positive, round(avg(neg), 6) AS mean_negative, round(count(*) FILTER (WHERE pos > neg) / count(*), 6) AS accuracy FROM p""",
    )
)
def a36_pair_alignment(spark, sf_dir):
    from gleaner.functions.vectors import cosine

    rows = views.vecs(spark, sf_dir).select("vec_id", "e")
    b = rows.select((F.col("vec_id") - 10).alias("vec_id"), F.col("e").alias("p"))
    c = rows.select((F.col("vec_id") - 3).alias("vec_id"), F.col("e").alias("n"))
    sims = rows.join(b, "vec_id").join(c, "vec_id").select(cosine(F.col("e"), F.col("p")).alias("pos"), cosine(F.col("e"), F.col("n")).alias("neg"))
    return sims.agg(F.round(F.avg("pos"), 6).alias("mean_positive"), F.round(F.avg("neg"), 6).alias("mean_negative"), F.round(F.count_if(F.col("pos") > F.col("neg")) / F.count("*"), 6).alias("accuracy"))


@query(duck("pairs", "SELECT count(*) AS n, count(quality) AS labelled, count(*) - count(quality) AS unlabelled, count(item_id) AS in_benchmark FROM pairs LEFT JOIN labels USING (doc_id) LEFT JOIN benchmark ON item_id = doc_id"))
def a37_collection_counts(spark, sf_dir):
    rows = views.pairs(spark, sf_dir).select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left").join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(1).alias("item")), "doc_id", "left")
    return rows.agg(F.count("*").alias("n"), F.count("quality").alias("labelled"), F.count_if(F.col("quality").isNull()).alias("unlabelled"), F.count("item").alias("in_benchmark"))


@query(duck("boxes", "SELECT image_id, img_w, box_id, x2 - x1 AS width, y2 - y1 AS height FROM boxes WHERE score > 0.2"))
def a38_flatten_crops(spark, sf_dir):
    box = B.Box.of()
    crop = F.struct("box_id", box.width.alias("width"), box.height.alias("height"))
    nested = views.boxes(spark, sf_dir).groupBy("image_id", "img_w").agg(F.collect_list(F.when(F.col("score") > 0.2, crop)).alias("crops"))
    return nested.select("image_id", "img_w", F.explode("crops").alias("c")).select("image_id", "img_w", "c.*")


@query("SELECT count(*) AS candidates, count(quality) AS scored, count(toxic) AS assessed, count(*) FILTER (WHERE toxic = 0) AS passed, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS selected FROM documents LEFT JOIN labels USING (doc_id)")
def a39_status_counters(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.agg(F.count("*").alias("candidates"), F.count("quality").alias("scored"), F.count("toxic").alias("assessed"), F.count_if(F.col("toxic") == 0).alias("passed"), F.count_if((F.col("toxic") == 0) & (F.col("quality") == 1)).alias("selected"))




@query(
    duck(
        "grid",
        """WITH o AS (SELECT g.grid_id, g.y, g.x, g.in_a, g.in_b, bool_and(h.in_a) AS ea, bool_and(h.in_b) AS eb FROM grid g JOIN grid h ON h.grid_id = g.grid_id AND abs(h.y - g.y) <= 1 AND abs(h.x - g.x) <= 1 GROUP BY ALL),
pa AS (SELECT grid_id, y, x FROM o WHERE in_a AND NOT ea), pb AS (SELECT grid_id, y, x FROM o WHERE in_b AND NOT eb),
na AS (SELECT grid_id, count(*) AS na FROM pa GROUP BY 1), nb AS (SELECT grid_id, count(*) AS nb FROM pb GROUP BY 1),
sa AS (SELECT grid_id, count(*) AS sa FROM pa WHERE EXISTS (SELECT 1 FROM grid h WHERE h.in_b AND h.grid_id = pa.grid_id AND (h.y - pa.y) ** 2 + (h.x - pa.x) ** 2 <= 2) GROUP BY 1),
sb AS (SELECT grid_id, count(*) AS sb FROM pb WHERE EXISTS (SELECT 1 FROM grid h WHERE h.in_a AND h.grid_id = pb.grid_id AND (h.y - pb.y) ** 2 + (h.x - pb.x) ** 2 <= 2) GROUP BY 1)
SELECT i.grid_id, CASE WHEN na > 0 AND nb > 0 THEN greatest(coalesce(sa, 0), coalesce(sb, 0)) ELSE 0 END AS shared, CASE WHEN na > 0 AND nb > 0 THEN least(na, nb) ELSE 0 END AS perimeter, CASE WHEN na > 0 AND nb > 0 THEN round(greatest(coalesce(sa, 0), coalesce(sb, 0)) / least(na, nb), 6) ELSE 0 END AS ratio
FROM (SELECT DISTINCT grid_id FROM grid) i LEFT JOIN na USING (grid_id) LEFT JOIN nb USING (grid_id) LEFT JOIN sa USING (grid_id) LEFT JOIN sb USING (grid_id)""",
    )
)
def a40_shared_boundary(spark, sf_dir):
    return grids.shared_boundary(views.grid(spark, sf_dir), "in_a", "in_b", 2**0.5).withColumn("ratio", F.round("ratio", 6))
