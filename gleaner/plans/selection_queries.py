"""Selection, suppression and matching (K)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner.functions import boxes as B
from gleaner.operators import selection
from gleaner.operators import vectors as VO
from gleaner.plans import views
from gleaner.plans.projections_queries import _CLAMP, _FIX
from gleaner.plans.registry import query
from gleaner.plans.views import duck, table

K = 8

#: All ordered pairs of unit vectors and their cosines.
_COSINES = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum([a.e[i] * b.e[i] for i in range(1, 65)]) / (a.norm * b.norm) AS s FROM base a, base b)"


def _steps(first: str, following: str, k: int = K, base: str = "SELECT * FROM vecs", before: str = "", required: str = "") -> str:
    """SQL of a greedy selection, a step each for every pick; {chosen} stands for the picks so far."""
    steps = [f"c1 AS ({first})"]
    for i in range(2, k + 1):
        chosen = " UNION ALL ".join(f"SELECT id FROM c{j}" for j in range(1, i))
        steps.append(f"c{i} AS ({following.format(chosen=chosen)})")
    picks = " UNION ALL ".join(f"SELECT {i}::INTEGER AS rank, id AS vec_id FROM c{i}" for i in range(1, k + 1))
    if required:
        n = required.count(",") + 1
        picks = f"SELECT (row_number() OVER (ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id FROM vecs WHERE vec_id IN ({required}) UNION ALL SELECT rank + {n}, vec_id FROM ({picks}) t"
    return duck("vecs", f"WITH base AS ({base}), {_COSINES}{before}, {', '.join(steps)} {picks}")


_FARTHEST = "SELECT a AS id FROM p WHERE b IN ({chosen}) AND a NOT IN ({chosen}) GROUP BY a ORDER BY round(FN(s), 9), a LIMIT 1"
_SCALED = ", q AS (SELECT vec_id, (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) AS q FROM base)"
_QUALITY = "SELECT vec_id AS id FROM q ORDER BY round(q, 9) DESC, vec_id LIMIT 1"
_DIVERSE = "SELECT a AS id FROM p JOIN q ON vec_id = a WHERE b IN ({chosen}) AND a NOT IN ({chosen}) GROUP BY a ORDER BY round(max(q) - 0.3 * max(s), 9) DESC, a LIMIT 1"
_GAIN = "SELECT x.a AS id FROM p x JOIN w ON vec_id = x.a LEFT JOIN (SELECT b, greatest(max(s), 0) AS c FROM p WHERE a IN ({chosen}) GROUP BY b) y ON y.b = x.b WHERE x.a NOT IN ({chosen}) GROUP BY x.a ORDER BY round(sum(greatest(s - coalesce(c, 0), 0)) + 0.01 * max(w), 9) DESC, x.a LIMIT 1"
_OVER = "greatest(0, least(o.x2, b.x2) - greatest(o.x1, b.x1)) * greatest(0, least(o.y2, b.y2) - greatest(o.y1, b.y1))"
_SHARE = f"{_OVER} / ((o.x2 - o.x1) * (o.y2 - o.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_OVER})"


def _nms(source: str, threshold: float, top: int, result: str) -> str:
    """SQL of suppression by score: a recursion down each image's ranking that carries the boxes kept so far."""
    return duck(
        "boxes",
        f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, box_id) AS k FROM ({source}) t),
r AS (SELECT DISTINCT image_id, 0::BIGINT AS k, []::STRUCT(box_id BIGINT, x1 BIGINT, y1 BIGINT, x2 BIGINT, y2 BIGINT, score DOUBLE)[] AS kept FROM o
 UNION ALL SELECT r.image_id, o.k, CASE WHEN len(kept) < {top} AND len([b for b in kept if {_SHARE} > {threshold}]) = 0 THEN list_append(kept, {{'box_id': o.box_id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2, 'score': o.score}}) ELSE kept END FROM r JOIN o ON o.image_id = r.image_id AND o.k = r.k + 1),
n AS (SELECT image_id, unnest(arg_max(kept, k)) AS b FROM r GROUP BY image_id) {result}""",
    )


def _kept(source: str) -> str:
    """CTEs of boxes that list-order suppression at 0.6 keeps, from a table or query."""
    return f"""b AS (SELECT *, (x2 - x1) * (y2 - y1) AS area FROM {source}),
pr AS (SELECT o.image_id, o.box_id AS i, b.box_id AS j, o.area AS ai, b.area AS aj FROM b o JOIN b ON o.image_id = b.image_id AND o.box_id < b.box_id WHERE {_SHARE} >= 0.6),
f AS (SELECT *, min(CASE WHEN ai >= aj THEN i END) OVER (PARTITION BY image_id, j) AS first FROM pr),
gone AS (SELECT image_id, j AS box_id FROM f WHERE ai >= aj UNION SELECT image_id, i FROM f WHERE ai < aj AND (first IS NULL OR i < first)),
kept AS (SELECT b.* FROM b ANTI JOIN gone ON gone.image_id = b.image_id AND gone.box_id = b.box_id)"""


def _picked(spark, sf_dir, method, **options):
    rows = views.vecs(spark, sf_dir).select("vec_id", "e", "score")
    return selection.select(rows, "vec_id", "e", "score", K, method, **options)


@query(_steps("SELECT a AS id FROM p GROUP BY a ORDER BY round(avg(s), 9), a LIMIT 1", _FARTHEST.replace("FN", "max")))
def k1_k_center(spark, sf_dir):
    return _picked(spark, sf_dir, "k_center")


#: From the picks of `k_center`: rows go to their nearest medoid, and each cluster's row with the greatest sum of cosines to it is next, until none changes.
_MEDOIDS = """, m AS (SELECT 0 AS turn, [C] AS med, false AS done
 UNION ALL SELECT turn + 1, next, next = med FROM (SELECT turn, med, [coalesce(new[i], med[i]) FOR i IN range(1, 9)] AS next FROM
 (SELECT turn, med, map_from_entries(list((c, mid))) AS new FROM (SELECT turn, med, c, arg_max(a, (v, -a)) AS mid FROM
 (SELECT turn, med, c, g.a, round(sum(s), 9) AS v FROM (SELECT turn, med, c, unnest(rows) AS a, rows FROM
 (SELECT turn, med, c, list(b) AS rows FROM (SELECT turn, med, b, arg_min(i, (-round(s, 9), i)) AS c FROM (SELECT turn, med, i, med[i] AS mid FROM m, range(1, 9) u(i) WHERE NOT done AND turn < 100) x JOIN p ON p.a = mid GROUP BY turn, med, b) y GROUP BY turn, med, c) z) g
 JOIN p ON p.a = g.a AND list_contains(rows, p.b) GROUP BY turn, med, c, g.a) h GROUP BY turn, med, c) j GROUP BY turn, med) k) l)
SELECT i::INTEGER AS rank, med[i] AS vec_id FROM (SELECT arg_max(med, turn) AS med FROM m) t, range(1, 9) u(i)"""


def _medoids() -> str:
    sql = _steps("SELECT a AS id FROM p GROUP BY a ORDER BY round(avg(s), 9), a LIMIT 1", _FARTHEST.replace("FN", "max"))
    head, _ = sql.rsplit(" SELECT 1::INTEGER AS rank", 1)
    return head.replace("WITH ", "WITH RECURSIVE ", 1) + _MEDOIDS.replace("[C]", "[" + ", ".join(f"(SELECT id FROM c{i})" for i in range(1, K + 1)) + "]")


@query(_medoids())
def k2_k_medoids(spark, sf_dir):
    return _picked(spark, sf_dir, "k_medoids")


@query(_steps("SELECT vec_id AS id FROM base ORDER BY substr(md5(concat('42:', vec_id)), 1, 8) DESC, vec_id LIMIT 1", _FARTHEST.replace("FN", "min")))
def k3_maxmin_diversity(spark, sf_dir):
    return _picked(spark, sf_dir, "maxmin")


@query(_steps("SELECT a AS id FROM p JOIN w ON vec_id = a GROUP BY a ORDER BY round(sum(greatest(s, 0)) + 0.01 * max(w), 9) DESC, a LIMIT 1", _GAIN, before=", w AS (SELECT vec_id, score / max(score) OVER () AS w FROM base)"))
def k4_facility_location(spark, sf_dir):
    return _picked(spark, sf_dir, "facility_location")


@query(_steps(_QUALITY, _DIVERSE, before=_SCALED))
def k5_quality_diversity(spark, sf_dir):
    return _picked(spark, sf_dir, "quality_diversity")


@query(_steps(_QUALITY, _DIVERSE, k=K - 2, base="SELECT * FROM vecs WHERE vec_id NOT IN (0, 1, 2, 3) AND score >= 0.5", before=_SCALED, required="0, 1"))
def k6_select_with_constraints(spark, sf_dir):
    rows = views.vecs(spark, sf_dir)
    return _picked(spark, sf_dir, "quality_diversity", include=rows.where("vec_id IN (0, 1)"), exclude=rows.where("vec_id IN (2, 3)"), least=0.5, weight=0.3)


@query()
def k6_select_partitioned(spark, sf_dir):
    return _picked(spark, sf_dir, "k_center", mode="partitioned", parts=4)


@query(duck("boxes", f"WITH {_kept('boxes')} SELECT image_id, box_id FROM kept"))
def k7_suppress_overlaps(spark, sf_dir):
    return selection.suppress_overlaps(views.boxes(spark, sf_dir))


@query(_nms("SELECT * FROM boxes", 0.3, 1000, "SELECT image_id, b.box_id AS box_id, b.score AS score FROM n"))
def k8_nms(spark, sf_dir):
    return selection.nms(views.boxes(spark, sf_dir))


@query(
    duck(
        "boxes",
        f"""WITH vb AS (SELECT image_id, box_id, img_w, img_h, cx1 AS x1, cy1 AS y1, cx2 AS x2, cy2 AS y2 FROM (SELECT *, {_CLAMP} FROM boxes WHERE x1 < x2 AND y1 < y2) t WHERE cx1 < cx2 AND cy1 < cy2), {_kept("vb")},
{_FIX.strip().removeprefix("WITH ").replace("FROM boxes", "FROM kept")}, g AS (SELECT *, ox2 - ox1 < 20 OR oy2 - oy1 < 20 AS tiny FROM (SELECT image_id, box_id, was_fixed, x1, y1, x2, y2, greatest(0, least(ox1, img_w - 1)) AS cl, ox1, oy1, ox2, oy2 FROM f_) t)
SELECT image_id, box_id, tiny AND was_fixed AS was_fixed, CASE WHEN tiny THEN x1 ELSE ox1 END AS x1, CASE WHEN tiny THEN y1 ELSE oy1 END AS y1, CASE WHEN tiny THEN x2 ELSE ox2 END AS x2, CASE WHEN tiny THEN y2 ELSE oy2 END AS y2 FROM g""".replace("\nf AS (SELECT image_id, box_id, img_w", "\nf_ AS (SELECT image_id, box_id, img_w"),
    )
)
def k9_process_bboxes(spark, sf_dir):
    return selection.process_bboxes(views.boxes(spark, sf_dir)).select("image_id", "box_id", *B.Box._fields, "was_fixed")


@query(_nms("SELECT * FROM boxes WHERE score >= 0.2", 0.3, 5, "SELECT image_id, b.box_id AS box_id, b.score AS score FROM n"))
def k9_rank_crops(spark, sf_dir):
    return selection.rank_crops(views.boxes(spark, sf_dir), "score", least=0.2)


@query(
    duck(
        "grid",
        """WITH RECURSIVE m AS (SELECT grid_id // 50 AS image_id, grid_id AS pair_id, 'a' AS side, y, x FROM grid WHERE in_a UNION ALL SELECT grid_id // 50, grid_id, 'b', y, x FROM grid WHERE in_b),
z AS (SELECT image_id, pair_id, side, count(*) AS n FROM m GROUP BY ALL),
i AS (SELECT p.image_id, p.pair_id AS i, q.pair_id AS j, p.side AS s, q.side AS t, count(*) AS n FROM m p JOIN m q ON p.image_id = q.image_id AND p.y = q.y AND p.x = q.x AND p.pair_id < q.pair_id GROUP BY ALL),
u AS (SELECT i.image_id, i, j, s, t, i.n / (a.n + b.n - i.n) AS iou FROM i JOIN z a ON a.image_id = i.image_id AND a.pair_id = i AND a.side = s JOIN z b ON b.image_id = i.image_id AND b.pair_id = j AND b.side = t),
w AS (SELECT image_id, i, j, max(CASE WHEN s = 'a' AND t = 'a' THEN iou ELSE 0 END) AS aa, max(CASE WHEN s = 'b' AND t = 'b' THEN iou ELSE 0 END) AS bb, max(CASE WHEN s = 'a' AND t = 'b' THEN iou ELSE 0 END) AS ab, max(CASE WHEN s = 'b' AND t = 'a' THEN iou ELSE 0 END) AS ba FROM u GROUP BY ALL),
l AS (SELECT image_id, j, list(i) AS earlier FROM w WHERE (aa > 0.3 AND bb > 0.3) OR (ab > 0.3 AND ba > 0.3) GROUP BY ALL),
o AS (SELECT d.image_id, d.pair_id, coalesce(earlier, []) AS earlier, row_number() OVER (PARTITION BY d.image_id ORDER BY d.pair_id) AS k FROM (SELECT DISTINCT image_id, pair_id FROM m) d LEFT JOIN l ON l.image_id = d.image_id AND l.j = d.pair_id),
r AS (SELECT DISTINCT image_id, 0::BIGINT AS k, []::BIGINT[] AS kept FROM o UNION ALL SELECT r.image_id, o.k, CASE WHEN len([x for x in o.earlier if list_contains(kept, x)]) = 0 THEN list_append(kept, o.pair_id) ELSE kept END FROM r JOIN o ON o.image_id = r.image_id AND o.k = r.k + 1)
SELECT image_id, unnest(arg_max(kept, k)) AS pair_id FROM r GROUP BY image_id""",
    )
)
def k10_dedup_mask_pairs(spark, sf_dir):
    cells = views.grid(spark, sf_dir)
    sides = F.explode(F.array(F.when(F.col("in_a"), "a"), F.when(F.col("in_b"), "b")))
    masks = cells.withColumn("side", sides).where("side IS NOT NULL").select(F.expr("grid_id DIV 50").alias("image_id"), F.col("grid_id").alias("pair_id"), "side", "y", "x")
    return selection.dedup_pairs(masks.select("image_id", "pair_id").distinct(), masks, 0.3)


@query(duck("pairs", "WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY least(lower(trim(texture_a)), lower(trim(texture_b))), greatest(lower(trim(texture_a)), lower(trim(texture_b))) ORDER BY doc_id) AS k FROM pairs) SELECT doc_id FROM r WHERE k = 1"))
def k11_dedup_text_pairs(spark, sf_dir):
    return selection.dedup_text_pairs(views.pairs(spark, sf_dir), "texture_a", "texture_b", "doc_id").select("doc_id")


@query(_nms("SELECT * FROM boxes", 0.6, 1000, ", g AS (SELECT image_id, b.box_id % 2 AS parent_id, list(b.box_id ORDER BY b.box_id) AS ids FROM n GROUP BY 1, 2) SELECT p.image_id, p.parent_id, coalesce(ids, []) AS box_ids FROM (SELECT DISTINCT image_id, box_id % 2 AS parent_id FROM boxes) p LEFT JOIN g ON g.image_id = p.image_id AND g.parent_id = p.parent_id"))
def k12_dedup_across_parents(spark, sf_dir):
    crop = F.struct("box_id", "score", *B.Box._fields)
    nested = views.boxes(spark, sf_dir).groupBy("image_id", (F.col("box_id") % 2).alias("parent_id")).agg(F.collect_list(crop).alias("crops"))
    return selection.dedup_across_parents(nested).select("image_id", "parent_id", F.transform("crops", lambda c: c["box_id"]).alias("box_ids"))


@query("SELECT count(*) AS n, CASE WHEN count(*) < 10000 THEN 'flat' WHEN count(*) < 1000000 THEN 'ivf' ELSE 'graph' END AS kind FROM embeddings")
def k13_choose_index(spark, sf_dir):
    counted = table(spark, sf_dir, "embeddings").agg(F.count("*").alias("n"))
    return counted.withColumn("kind", F.lit(VO.choose_index(counted.first()["n"])))
