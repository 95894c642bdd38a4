"""Windows (W), sorts and top-k (T), sets (U), splits (D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions.text import words
from gleaner.operators import evaluate, grids, joins, ordering
from gleaner.plans import views
from gleaner.plans.aggregates_queries import _SCORED, scored
from gleaner.plans.registry import query
from gleaner.plans.views import duck, table


@query(duck("preds", "SELECT crop_name, row_number() OVER w AS rank, (sum(matched::INT) OVER w)::BIGINT AS tp, (row_number() OVER w - sum(matched::INT) OVER w)::BIGINT AS fp FROM preds WINDOW w AS (ORDER BY score DESC, crop_name ROWS UNBOUNDED PRECEDING)"))
def w1_cumulative_tp_fp(spark, sf_dir):
    return evaluate.ranked_counts(views.preds(spark, sf_dir), "score", "matched", "crop_name").select("crop_name", "rank", "tp", "fp")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS 99 PRECEDING), 6) AS rolling FROM events")
def w2_rolling_mean(spark, sf_dir):
    return ordering.rolling_mean(table(spark, sf_dir, "events"), "value", ["event_type"], ["ts", "event_id"]).select("event_id", F.round("rolling", 6).alias("rolling"))


@query(duck("runlog", "SELECT run, step, round(avg(total) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING), 6) AS running FROM runlog"))
def w3_running_mean(spark, sf_dir):
    return ordering.running_mean(views.runlog(spark, sf_dir), "total", ["run"], ["step"]).select("run", "step", F.round("running", 6).alias("running"))


@query(duck("runlog", "SELECT run, step, total > greatest(coalesce(max(total) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS is_best FROM runlog"))
def w4_running_best(spark, sf_dir):
    return ordering.running_best(views.runlog(spark, sf_dir), "total", ["run"], ["step"]).select("run", "step", "is_best")


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def w5_first_per_key(spark, sf_dir):
    return joins.first_per_key(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"], ["doc_id"]).select("doc_id")


@query(duck("boxes", "SELECT image_id, box_id, row_number() OVER (PARTITION BY image_id ORDER BY box_id)::INTEGER AS ordinal FROM boxes"))
def w6_ordinal_ids(spark, sf_dir):
    listed = views.boxes(spark, sf_dir).groupBy("image_id").agg(F.array_sort(F.collect_list("box_id")).alias("boxes"))
    return listed.select("image_id", F.posexplode("boxes").alias("pos", "box_id")).select("image_id", "box_id", (F.col("pos") + 1).alias("ordinal"))


@query(duck("grid", """WITH r AS (SELECT grid_id, y, x, row_number() OVER (PARTITION BY grid_id ORDER BY y, x) - 1 AS i, count(*) OVER (PARTITION BY grid_id) AS n FROM grid WHERE in_a), s AS (SELECT *, i // 4 AS j, ceil(n / 4) AS t FROM r WHERE n >= 4 AND i % 4 = 0)
SELECT grid_id, y, x FROM s WHERE t <= 5 OR j IN (floor(0 * t / 5), floor(1 * t / 5), floor(2 * t / 5), floor(3 * t / 5), floor(4 * t / 5))"""))
def w7_every_nth(spark, sf_dir):
    return ordering.every_nth(views.grid(spark, sf_dir).where("in_a"), ["grid_id"], ["y", "x"], 4, 5).select("grid_id", "y", "x")


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) % 4 AS rank FROM events")
def w8_round_robin(spark, sf_dir):
    rows = ordering.numbered(table(spark, sf_dir, "events"), F.col("event_id"), ["event_id"])
    return rows.select("event_id", ((F.col("n") - 1) % 4).alias("rank"))


@query("SELECT event_id, row_number() OVER (ORDER BY event_id) <= floor((SELECT count(*) FROM events) * 0.3) AS head FROM events")
def w9_head_ratio_split(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    head = int(events.count() * 0.3)
    return ordering.numbered(events, F.col("event_id"), ["event_id"]).select("event_id", (F.col("n") <= head).alias("head"))


@query(duck("vecs", "SELECT vec_id, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS scaled FROM vecs"))
def w10_minmax(spark, sf_dir):
    return ordering.minmax(views.vecs(spark, sf_dir).select("vec_id", "score"), "score").select("vec_id", F.round("scaled", 6).alias("scaled"))


@query(duck("grid", """WITH n AS (SELECT g.grid_id, g.y, g.x, g.in_a, bool_and(h.in_a) AS eroded, bool_or(h.in_a) AS dilated FROM grid g JOIN grid h ON h.grid_id = g.grid_id AND abs(h.y - g.y) <= 1 AND abs(h.x - g.x) <= 1 GROUP BY ALL)
SELECT grid_id, y, x, eroded, dilated, in_a AND NOT eroded AS boundary FROM n"""))
def w11_grid_neighbourhood(spark, sf_dir):
    cells = views.grid(spark, sf_dir).withColumn("m", F.col("in_a").cast("int"))
    low = grids.neighbourhood(cells, F.col("m"), 1, "min").withColumnRenamed("near", "low")
    both = grids.neighbourhood(low, F.col("m"), 1, "max")
    return both.select("grid_id", "y", "x", (F.col("low") == 1).alias("eroded"), (F.col("near") == 1).alias("dilated"), ((F.col("m") == 1) & (F.col("low") == 0)).alias("boundary"))


@query("SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS chunk FROM events")
def w12_chunk(spark, sf_dir):
    rows = ordering.numbered(table(spark, sf_dir, "events"), F.col("event_id"), ["event_id"])
    return rows.select("event_id", F.floor((F.col("n") - 1) / 64).alias("chunk"))


@query(duck("vecs", f"WITH {_SCORED} SELECT vec_id, label, round(similarity, 6) AS similarity FROM sc ORDER BY round(similarity, 9) DESC, vec_id LIMIT 20"))
def t1_top_candidates(spark, sf_dir):
    best = scored(spark, sf_dir).select("vec_id", "label", "similarity").orderBy(F.round("similarity", 9).desc(), "vec_id").limit(20)
    return best.withColumn("similarity", F.round("similarity", 6))


@query(duck("vecs", "SELECT vec_id, score FROM vecs ORDER BY score DESC, vec_id DESC LIMIT 50").replace("SELECT vec_id, score FROM vecs", "SELECT vec_id, score::DOUBLE AS score FROM vecs"))
def t2_greedy_quality(spark, sf_dir):
    return views.vecs(spark, sf_dir).orderBy(F.col("score").desc(), F.col("vec_id").desc()).limit(50).select("vec_id", "score")


@query(duck("preds", "(SELECT crop_name, iou_a, 'best' AS kind FROM preds ORDER BY iou_a DESC, crop_name LIMIT 5) UNION ALL (SELECT crop_name, iou_a, 'worst' AS kind FROM preds ORDER BY iou_a, crop_name LIMIT 5)"))
def t3_best_worst(spark, sf_dir):
    rows = views.preds(spark, sf_dir).select("crop_name", "iou_a")
    best = rows.orderBy(F.col("iou_a").desc(), "crop_name").limit(5).withColumn("kind", F.lit("best"))
    return best.unionByName(rows.orderBy("iou_a", "crop_name").limit(5).withColumn("kind", F.lit("worst")))


@query(duck("preds", "WITH c AS (SELECT *, count(*) FILTER (WHERE score > 0.9) OVER (PARTITION BY model) AS c FROM preds), r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY score DESC, crop_name) AS k FROM c WHERE score > 0.9 OR c = 0) SELECT model, crop_name, score FROM r WHERE k <= 4"))
def t4_confident_top(spark, sf_dir):
    return ordering.confident_top(views.preds(spark, sf_dir), ["model"], "score", ["crop_name"], 0.9, 4).select("model", "crop_name", "score")


@query(duck("preds", "SELECT model, first(crop_name ORDER BY score DESC, crop_name) FILTER (WHERE score IS NOT NULL) AS crop_name, max(score) AS score FROM preds GROUP BY 1"))
def t5_best_per_group(spark, sf_dir):
    return ordering.best_per_group(views.preds(spark, sf_dir), ["model"], "score", "crop_name")


@query("SELECT doc_id FROM documents ORDER BY md5(concat('42:', doc_id)), doc_id LIMIT 100")
def t6_sample_then_sort(spark, sf_dir):
    drawn = table(spark, sf_dir, "documents").select("doc_id").orderBy(ordering.seeded("doc_id", 42), "doc_id").limit(100)
    return drawn.orderBy("doc_id")


@query(
    duck(
        "grid",
        """WITH RECURSIVE o AS (SELECT grid_id, y, x, v, row_number() OVER (PARTITION BY grid_id ORDER BY v DESC, y, x) AS k FROM grid),
r AS (SELECT DISTINCT grid_id, 0::BIGINT AS k, []::STRUCT(y BIGINT, x BIGINT, v DOUBLE)[] AS kept FROM o
 UNION ALL SELECT r.grid_id, o.k, CASE WHEN len(kept) < 4 AND len([b for b in kept if (o.y - b.y) ** 2 + (o.x - b.x) ** 2 <= 4]) = 0 THEN list_append(kept, {'y': o.y, 'x': o.x, 'v': o.v}) ELSE kept END FROM r JOIN o ON o.grid_id = r.grid_id AND o.k = r.k + 1),
f AS (SELECT grid_id, arg_max(kept, k) AS kept FROM r GROUP BY grid_id)
SELECT grid_id, kept[i].y AS y, kept[i].x AS x, i::INTEGER AS rank, kept[i].v AS value FROM f, range(1, 5) t(i) WHERE len(kept) = 4""",
    )
)
def t7_spaced_top_k(spark, sf_dir):
    return grids.spaced_peaks(views.grid(spark, sf_dir), "v", 4, 2.0)


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def t8_limit_first(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(25)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations) SELECT conv_id, turn, substr(text, 1, 200) AS text FROM r WHERE k <= 4 AND role = 'user'")
def t9_recent_messages(spark, sf_dir):
    return ordering.recent_messages(table(spark, sf_dir, "conversations"), 2, "user").select("conv_id", "turn", "text")


@query("SELECT event_id, user_id % 4 AS worker FROM events")
def u1_merge_results(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 4).alias("worker"))
    parts = [events.where(F.col("worker") == k) for k in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(duck("vecs", "SELECT vec_id, vec_id % 50 = 0 AS required FROM vecs WHERE vec_id % 7 <> 3 AND score >= 0.6"))
def u2_apply_constraints(spark, sf_dir):
    from gleaner.operators.selection import constrained

    rows = views.vecs(spark, sf_dir)
    return constrained(rows, "vec_id", include=rows.where("vec_id % 50 = 0"), exclude=rows.where("vec_id % 7 = 3"), score="score", least=0.6).select("vec_id", "required")


@query("SELECT DISTINCT source AS label FROM documents ORDER BY 1")
def u3_distinct_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("label")).distinct().orderBy("label")


@query(duck("grid", "WITH a AS (SELECT grid_id, y, x FROM grid WHERE v > 0.05), b AS (SELECT grid_id, y, x FROM grid WHERE gray > 140 OR gray < 110) SELECT grid_id, y, x, 'and' AS op FROM (SELECT * FROM a INTERSECT SELECT * FROM b) t UNION ALL SELECT *, 'or' FROM (SELECT * FROM a UNION SELECT * FROM b) t UNION ALL SELECT *, 'xor' FROM ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION (SELECT * FROM b EXCEPT SELECT * FROM a)) t"))
def u4_cell_set_ops(spark, sf_dir):
    cells = views.grid(spark, sf_dir)
    a, b = cells.where("v > 0.05").select(grids.CELL), cells.where("gray > 140 OR gray < 110").select(grids.CELL)
    both, either = a.intersect(b), a.union(b).distinct()
    return both.withColumn("op", F.lit("and")).union(either.withColumn("op", F.lit("or"))).union(either.join(both, grids.CELL, "left_anti").withColumn("op", F.lit("xor")))


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) AS n FROM labels WHERE quality = 1) SELECT doc_id, CASE WHEN n <= greatest(1, floor((SELECT count(*) FROM r) * 0.1)) THEN 'test' ELSE 'train' END AS split FROM r")
def d1_train_test_split(spark, sf_dir):
    return ordering.train_test(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", 0.1).select("doc_id", "split")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) AS n FROM documents), c AS (SELECT count(*) AS c FROM documents) SELECT doc_id, CASE WHEN n <= floor(c * 0.7) THEN 'train' WHEN n <= floor(c * 0.7) + floor(c * 0.2) THEN 'val' ELSE 'test' END AS split FROM r, c")
def d2_three_way_split(spark, sf_dir):
    return ordering.three_way(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").select("doc_id", "split")


@query("WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents) SELECT doc_id, CASE WHEN n <= 120 THEN 'train' WHEN n <= 150 THEN 'val' ELSE 'test' END AS split FROM r")
def d3_prefix_split(spark, sf_dir):
    return ordering.prefix_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 120, 30).select("doc_id", "split")


@query(
    duck(
        "pairs",
        """WITH c AS (SELECT count(*) AS c FROM pairs), a AS (SELECT doc_id, texture_a, row_number() OVER (ORDER BY md5(concat('7:', doc_id)), doc_id) AS k FROM pairs), b AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('9:', doc_id)), doc_id) AS k FROM pairs), p AS (SELECT texture_a, row_number() OVER (ORDER BY md5(concat('10:', doc_id)), doc_id) AS k FROM pairs)
SELECT k AS position, doc_id, texture_a, 'matched' AS pair_type FROM a UNION ALL SELECT k + c, b.doc_id, p.texture_a, 'shuffled' FROM b JOIN p USING (k), c WHERE k + c <= floor(c * 1.5)""",
    )
)
def d4_matched_and_shuffled(spark, sf_dir):
    rows = views.pairs(spark, sf_dir).select("doc_id", "texture_a")
    return ordering.matched_and_shuffled(rows, "doc_id", "texture_a", int(rows.count() * 1.5))


@query(duck("pairs", "SELECT doc_id, concat('s_', lpad((row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR, 6, '0'), '.png') AS name FROM pairs WHERE length(texture_b) > 0"))
def d5_numbered_output(spark, sf_dir):
    return ordering.numbered_names(views.pairs(spark, sf_dir).where(F.size(words(F.col("texture_b"))) > 0).select("doc_id"), "doc_id", "s_")
