"""Loop operators against plain numpy, written from their definitions."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import cells, grids, joins, selection
from gleaner.operators import vectors as VO
from gleaner.plans import views


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    df = views.vecs(spark, sf_dir).select("vec_id", "e", "score").where("vec_id < 200").cache()
    rows = df.orderBy("vec_id").collect()
    x = np.array([r["e"] for r in rows])
    return df, x / np.linalg.norm(x, axis=1, keepdims=True), np.array([r["score"] for r in rows])


def picked(df):
    return [r["vec_id"] for r in df.orderBy("rank").collect()]


def first_max(v, ok):
    v = np.where(ok, np.round(v, 9), -np.inf)
    return int(np.argmax(v))


def greedy(x, k, start, update, value):
    chosen, m = [start], None
    while len(chosen) < k:
        s = x @ x[chosen[-1]]
        m = s if m is None else update(m, s)
        ok = np.ones(len(x), bool)
        ok[chosen] = False
        chosen.append(first_max(value(m), ok))
    return chosen


def test_k_center(vectors):
    df, x, _ = vectors
    start = first_max(-(x @ x.mean(axis=0)), np.ones(len(x), bool))
    assert picked(selection.select(df, "vec_id", "e", "score", 10, "k_center")) == greedy(x, 10, start, np.maximum, lambda m: -m)


@pytest.mark.parametrize("true", [False, True])
def test_maxmin_keeps_the_stated_extreme(vectors, true):
    df, x, _ = vectors
    got = picked(selection.select(df, "vec_id", "e", "score", 6, "maxmin", true_maxmin=true))
    update = np.maximum if true else np.minimum
    assert got == greedy(x, 6, got[0], update, lambda m: -m)


@pytest.mark.parametrize("normalize", [True, False])
def test_quality_diversity(vectors, normalize):
    df, x, score = vectors
    q = (score - score.min()) / (score.max() - score.min()) if normalize else score
    want = greedy(x, 8, first_max(q, np.ones(len(x), bool)), np.maximum, lambda m: q - 0.3 * m)
    assert picked(selection.select(df, "vec_id", "e", "score", 8, "quality_diversity", normalize=normalize)) == want


def test_facility_location(vectors):
    df, x, score = vectors
    s, cover, want = x @ x.T, np.zeros(len(x)), []
    for _ in range(4):
        gain = np.maximum(s - cover, 0).sum(axis=1) + 0.01 * score / score.max()
        ok = np.ones(len(x), bool)
        ok[want] = False
        want.append(first_max(gain, ok))
        cover = np.maximum(cover, s[want[-1]])
    assert picked(selection.select(df, "vec_id", "e", "score", 4, "facility_location")) == want


def test_facility_location_brings_few_vectors_to_the_driver(vectors, monkeypatch):
    df, x, score = vectors
    asked = []
    tried = selection._tried
    monkeypatch.setattr(selection, "_tried", lambda rows, cover, key, ids, *rest: asked.append(len(ids)) or tried(rows, cover, key, ids, *rest))
    monkeypatch.setattr(selection, "QUEUE", 8)
    monkeypatch.setattr(selection, "TRIED", 2)
    monkeypatch.setattr(selection, "TILE_LEAST", 40, raising=False)
    s, cover, want = x @ x.T, np.zeros(len(x)), []
    for _ in range(4):
        gain = np.maximum(s - cover, 0).sum(axis=1) + 0.01 * score / score.max()
        gain[want] = -np.inf
        want.append(first_max(gain, np.ones(len(x), bool)))
        cover = np.maximum(cover, s[want[-1]])
    assert picked(selection.select(df, "vec_id", "e", "score", 4, "facility_location")) == want
    assert sum(asked) < 40  # each pick lowers the gains of all 200


def test_k_medoids(vectors):
    df, x, _ = vectors
    medoids = greedy(x, 5, first_max(-(x @ x.mean(axis=0)), np.ones(len(x), bool)), np.maximum, lambda m: -m)
    for _ in range(100):
        own = np.round(1 - x @ x[medoids].T, 9).argmin(axis=1)
        new = []
        for c in range(5):
            at = np.flatnonzero(own == c)
            total = (1 - x[at] @ x[at].T).sum(axis=1)
            new.append(int(at[np.argmin(np.round(total, 9))]) if len(at) else medoids[c])
        if new == medoids:
            break
        medoids = new
    assert picked(selection.select(df, "vec_id", "e", "score", 5, "k_medoids")) == medoids


def test_constraints_and_partitioned_mode(vectors):
    df, x, score = vectors
    got = picked(selection.select(df, "vec_id", "e", "score", 10, "quality_diversity", include=df.where("vec_id IN (0, 1)"), exclude=df.where("vec_id IN (2, 3)"), least=0.5))
    assert {0, 1} <= set(got) and not {2, 3} & set(got) and len(set(got)) == 10
    exact = picked(selection.select(df, "vec_id", "e", "score", 10, "k_center"))
    two = picked(selection.select(df, "vec_id", "e", "score", 10, "k_center", mode="partitioned", parts=3))
    spread = lambda ids: 1 - (x[ids] @ x[ids].T)[np.triu_indices(len(ids), 1)].mean()
    assert len(set(two)) == 10 and spread(two) > 0.9 * spread(exact)


def boxes(spark, rows):
    return spark.createDataFrame(rows, "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long, score double")


def iou(a, b):
    w, h = min(a[4], b[4]) - max(a[2], b[2]), min(a[5], b[5]) - max(a[3], b[3])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[4] - a[2]) * (a[5] - a[3]) + (b[4] - b[2]) * (b[5] - b[3]) - w * h)


@pytest.fixture(scope="module")
def many(spark):
    r = np.random.default_rng(4)
    rows = []
    for g in range(30):
        for b in range(12):
            x, y = r.integers(0, 60, 2).tolist()
            w, h = r.integers(20, 60, 2).tolist()
            rows.append((g, b, x, y, x + w, y + h, round(float(r.random()), 2)))
    return rows


def groups(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("most", [64, 11, 0])
def test_boxes_of_small_groups_are_paired_without_squares(spark, many, monkeypatch, most):
    monkeypatch.setattr(joins, "PAIRED_ROWS", most, raising=False)
    rows = [r for r in many if r[0] % 3 or r[1] < 9]  # groups of 9 and of 12
    want = {(a[0], a[1], b[1]) for g in groups(rows).values() for a in g for b in g if a[1] < b[1] and iou(a, b) >= 0.2}
    out = joins.overlapping_pairs(boxes(spark, rows), "image_id", "box_id", 0.2)
    assert sorted((r["image_id"], r["i"], r["j"]) for r in out.collect()) == sorted(want)
    assert ("Generate" in out._jdf.queryExecution().optimizedPlan().toString()) == (most < 12)
    own, other = boxes(spark, rows), boxes(spark, [(g, b, x1 + 3, y1 + 2, x2 + 3, y2 + 2, s) for g, b, x1, y1, x2, y2, s in rows])
    monkeypatch.setattr(joins, "PAIRED_ROWS", 1000, raising=False)
    whole = sorted(joins.match_greedy(own, other, "image_id").select("image_id", "i", "j").collect())
    monkeypatch.setattr(joins, "PAIRED_ROWS", most, raising=False)
    assert sorted(joins.match_greedy(own, other, "image_id").select("image_id", "i", "j").collect()) == whole and whole


def test_suppress_overlaps(spark, many):
    want = set()
    for g, rows in groups(many).items():
        gone = set()
        for i, a in enumerate(rows):
            for j in range(i + 1, len(rows)):
                if j not in gone and iou(a, rows[j]) >= 0.4:
                    area = lambda b: (b[4] - b[2]) * (b[5] - b[3])
                    gone.add(i if area(a) < area(rows[j]) else j)
        want |= {(g, r[1]) for i, r in enumerate(rows) if i not in gone}
    assert {tuple(r) for r in selection.suppress_overlaps(boxes(spark, many), threshold=0.4).collect()} == want


def test_removed_box_still_removes(spark):
    # the first is removed by the larger second, and still removes the third
    rows = [(0, 0, 0, 0, 10, 10, 0.1), (0, 1, 0, 0, 10, 12, 0.1), (0, 2, 0, -3, 10, 9, 0.1)]
    assert iou(rows[1], rows[2]) < 0.65 <= iou(rows[0], rows[2])
    left = {r["box_id"] for r in selection.suppress_overlaps(boxes(spark, rows), threshold=0.65).collect()}
    assert left == {1, 2} or left == {1}
    assert 0 not in left


def test_nms_is_strict(spark, many):
    want = set()
    for g, rows in groups(many).items():
        kept = []
        for r in sorted(rows, key=lambda r: (-r[6], r[1])):
            if all(iou(r, k) <= 0.3 for k in kept):
                kept.append(r)
        want |= {(g, r[1]) for r in kept}
    got = {(r["image_id"], r["box_id"]) for r in selection.nms(boxes(spark, many)).collect()}
    assert got == want
    touching = [(0, 0, 0, 0, 10, 10, 0.9), (0, 1, 0, 0, 10, 5, 0.8)]
    assert selection.nms(boxes(spark, touching), threshold=0.5).count() == 2


def test_match_greedy(spark, many):
    truth = [(g, b, x1 + 4, y1 + 3, x2 + 4, y2 + 3, s) for g, b, x1, y1, x2, y2, s in many if b % 3]
    want = set()
    by = groups(truth)
    for g, rows in groups(many).items():
        pairs = sorted(((-iou(a, b), a[1], b[1]) for a in rows for b in by[g] if iou(a, b) >= 0.5))
        used_i, used_j = set(), set()
        for _, i, j in pairs:
            if i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                want.add((g, i, j))
    got = {(r["image_id"], r["i"], r["j"]) for r in joins.match_greedy(boxes(spark, many), boxes(spark, truth), "image_id").collect()}
    assert got == want


def test_spaced_peaks(spark, sf_dir):
    cells = views.grid(spark, sf_dir).where("grid_id < 20")
    got = {}
    for r in grids.spaced_peaks(cells, "v", 4, 2.0).orderBy("grid_id", "rank").collect():
        got.setdefault(r["grid_id"], []).append((r["y"], r["x"]))
    for g, rows in groups([(r["grid_id"], r["y"], r["x"], r["v"]) for r in cells.collect()]).items():
        want = []
        for _, y, x, _ in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
            if all(((y - a) ** 2 + (x - b) ** 2) ** 0.5 > 2.0 for a, b in want):
                want.append((y, x))
            if len(want) == 4:
                break
        assert got.get(g, []) == (want if len(want) == 4 else [])


def masks(spark, grids_=6, side=40):
    """Grids with one high plateau of more than 64 cells and smaller peaks far from it."""
    rows = []
    for g in range(grids_):
        for y in range(side):
            for x in range(side):
                top = 10.0 if y < 9 and x < 9 else 0.0
                rows.append((g, y, x, top + ((y * 37 + x * 101 + g * 53) % 97) / 97))
    return spark.createDataFrame(rows, "grid_id long, y long, x long, v double")


@pytest.mark.parametrize("metric", ["euclidean", "manhattan"])
def test_spaced_peaks_are_found_among_all_cells(spark, metric):
    cells = masks(spark)
    got = {}
    for r in grids.spaced_peaks(cells, "v", 4, 15.0, metric).orderBy("grid_id", "rank").collect():
        got.setdefault(r["grid_id"], []).append((r["y"], r["x"]))
    far = (lambda y, x, a, b: abs(y - a) + abs(x - b)) if metric == "manhattan" else (lambda y, x, a, b: ((y - a) ** 2 + (x - b) ** 2) ** 0.5)
    for g, rows in groups([(r["grid_id"], r["y"], r["x"], r["v"]) for r in cells.collect()]).items():
        want = []
        for _, y, x, _ in sorted(rows, key=lambda r: (-r[3], r[1], r[2])):
            if len(want) < 4 and all(far(y, x, a, b) > 15.0 for a, b in want):
                want.append((y, x))
        assert len(want) == 4 and got[g] == want


def test_spaced_peaks_are_filled_at_random(spark):
    cells = masks(spark, 2, 10)
    assert grids.spaced_peaks(cells, "v", 6, 12.0).count() == 0
    got = grids.spaced_peaks(cells, "v", 6, 12.0, "manhattan", fill=True).orderBy("grid_id", "rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3, 4, 5, 6] * 2 and len({(r["grid_id"], r["y"], r["x"]) for r in got}) == 12
    again = grids.spaced_peaks(cells.repartition(3), "v", 6, 12.0, "manhattan", fill=True).orderBy("grid_id", "rank").collect()
    assert got == again


def test_nms_of_large_groups_is_that_of_small_ones(spark):
    draw = np.random.default_rng(11)
    rows = [(g, i, x, y, x + int(draw.integers(20, 90)), y + int(draw.integers(20, 90)), float(draw.integers(0, 50)) / 50) for g, n in ((0, 300), (1, 6), (2, 40)) for i, (x, y) in enumerate(draw.integers(0, 300, (n, 2)).tolist())]
    df = spark.createDataFrame(rows, "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long, score double")
    for top in (None, 5):
        one, other = (sorted(map(tuple, selection.nms(df, top=top, pass_rows=n).collect())) for n in (1000, 30))
        assert one == other and one


def test_blocks_do_not_change_neighbours(spark, vectors, monkeypatch):
    df, u, _ = vectors
    pairs = {(r["id_a"], r["id_b"]) for r in VO.similar_pairs(df, "vec_id", "e", 0.3, size=30).collect()}
    s = u @ u.T
    assert pairs == {(i, j) for i in range(len(u)) for j in range(i + 1, len(u)) if s[i, j] >= 0.3}
    ends = VO.similarity_extremes(df, "vec_id", "e", size=30).first()
    off = s[~np.eye(len(u), dtype=bool)]
    assert abs(ends["min"] - off.min()) < 1e-12 and abs(ends["max"] - off.max()) < 1e-12
    monkeypatch.setattr(VO, "QUERIES", 9)
    monkeypatch.setattr(VO, "ROWS", 31)
    got = {(r["query_id"], r["rank"]): r["neighbour_id"] for r in VO.knn(df.where("vec_id % 5 = 0"), df, 4, "vec_id", "e", exclude_self=True).collect()}
    for q in range(0, 200, 5):
        order = sorted((-round(s[q, i], 9), i) for i in range(200) if i != q)[:4]
        assert [got[q, k + 1] for k in range(4)] == [i for _, i in order]


def test_search_in_an_empty_base(spark, vectors):
    df, _, _ = vectors
    assert VO.knn(df.limit(3), df.where("false"), 4, "vec_id", "e").count() == 0
    assert VO.knn(df.where("false"), df, 4, "vec_id", "e").count() == 0


def test_dominant_values_of_two_levels(spark):
    cells = spark.createDataFrame([(0, y, x, 20 if x < 3 else 200) for y in range(4) for x in range(4)], "grid_id long, y long, x long, gray long")
    got = [(r["centre"], r["share"]) for r in grids.dominant_values(cells).orderBy("rank").collect()]
    assert got == [(20.0, 0.75), (200.0, 0.25)]


def test_dedup_pairs_either_way_round(spark):
    cells = []
    for pair, (a, b) in enumerate([((0, 1, 2), (5, 6)), ((5, 6), (0, 1, 2)), ((0, 9), (7, 8))]):
        cells += [(0, pair, "a", 0, x) for x in a] + [(0, pair, "b", 0, x) for x in b]
    c = spark.createDataFrame(cells, "image_id long, pair_id long, side string, y long, x long")
    for most in (100, 2):  # in one pass, and in rounds
        got = [r["pair_id"] for r in selection.dedup_pairs(c.select("image_id", "pair_id").distinct(), c, 0.5, most).orderBy("pair_id").collect()]
        assert got == [0, 2]


def test_empty_tables(spark):
    none = boxes(spark, [])
    assert selection.nms(none).count() == 0
    assert selection.suppress_overlaps(none).count() == 0
    assert joins.match_greedy(none, none, "image_id").count() == 0
    assert joins.overlapping_pairs(none, "image_id", "box_id", 0.5).count() == 0
    assert VO.similar_pairs(spark.createDataFrame([], "id long, v array<double>"), "id", "v", 0.5).count() == 0


def test_selected_centroid_of_nothing_is_null_safe(spark):
    assert VO.centroid(spark.createDataFrame([], "id long, v array<double>"), "v").select(F.col("centroid")).count() <= 1


def jobs_of(spark, f):
    """What f returns, and how many jobs it ran."""
    sc = spark.sparkContext
    group = f"counted-{uuid.uuid4().hex}"
    sc.setJobGroup(group, group)
    try:
        return f(), len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


@pytest.fixture(scope="module")
def cloud(spark):
    """Vectors in clusters and without, with copies and a zero vector."""
    r = np.random.default_rng(11)
    x = np.concatenate([r.normal(size=(20, 12))[r.integers(0, 20, 400)] + 0.2 * r.normal(size=(400, 12)), r.normal(size=(400, 12))])
    x[50:80] = x[3]
    x[700] = 0.0
    score = r.random(800).round(3)
    df = spark.createDataFrame([(k, [float(y) for y in v], float(q)) for k, (v, q) in enumerate(zip(x, score, strict=True))], "vec_id long, e array<double>, score double").repartition(5).cache()
    return df, x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12), score


@pytest.mark.parametrize("few", [7, 512])
def test_many_picks_a_job(spark, cloud, monkeypatch, few):
    """The picks of the loop that takes one at a time, and far fewer jobs than picks."""
    df, x, score = cloud
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "MANY", few)
    k = 120 if few > 7 else 20
    start = first_max(-(x @ x.mean(axis=0)), np.ones(len(x), bool))
    got, jobs = jobs_of(spark, lambda: selection.k_center(df, "vec_id", "e", k))
    assert got == greedy(x, k, start, np.maximum, lambda m: -m)
    assert few == 7 or jobs < k / 6
    q = (score - score.min()) / (score.max() - score.min())
    got, jobs = jobs_of(spark, lambda: selection.quality_diversity(df, "vec_id", "e", "score", k))
    assert got == greedy(x, k, first_max(q, np.ones(len(x), bool)), np.maximum, lambda m: q - 0.3 * m)
    assert few == 7 or jobs < k / 6


@pytest.mark.parametrize("probes, lowest", [(2, 3), (256, 16)])
def test_farthest_of_any_by_lists(spark, cloud, monkeypatch, probes, lowest):
    df, x, _ = cloud
    monkeypatch.setattr(selection, "PROBES", probes)
    monkeypatch.setattr(selection, "LOWEST", lowest)
    k = 60 if probes > 2 else 9
    got, jobs = jobs_of(spark, lambda: selection.maxmin(df, "vec_id", "e", k))
    assert got == greedy(x, k, got[0], np.minimum, lambda m: -m)
    assert probes == 2 or jobs < k


def coverage(x, score, k, least):
    s = x @ x.T
    np.fill_diagonal(s, 1.0)
    s = np.where(s >= max(least, 1e-12), s, 0.0)
    c, picked = np.zeros(len(x)), []
    for _ in range(k):
        gain = np.maximum(s - c, 0).sum(axis=1) + 0.01 * score / score.max()
        ok = np.ones(len(x), bool)
        ok[picked] = False
        picked.append(first_max(gain, ok))
        c = np.maximum(c, s[picked[-1]])
    return picked


@pytest.mark.parametrize("tried, queue, least", [(48, 4096, -1.0), (48, 4096, 0.7), (5, 12, 0.7)])
def test_lazy_facility_location(spark, cloud, monkeypatch, tried, queue, least):
    df, x, score = cloud
    monkeypatch.setattr(selection, "TRIED", tried)
    monkeypatch.setattr(selection, "QUEUE", queue)
    k = 25 if tried > 10 else 4
    got, jobs = jobs_of(spark, lambda: selection.facility_location(df, "vec_id", "e", "score", k, least))
    assert got == coverage(x, score, k, least)
    assert tried < 48 or least < 0 or jobs < 4 * k


def small(monkeypatch):
    """Sizes at which 800 rows are many, and meet in tiles; returns the calls of the pass over all pairs, as they come."""
    for name, value in (("QUEUE", 64), ("TRIED", 8), ("TILE_LEAST", 100)):
        monkeypatch.setattr(selection, name, value)
    calls, gains = [], VO.coverage_gains
    monkeypatch.setattr(VO, "coverage_gains", lambda *a: calls.append(a[-1]) or gains(*a))
    return calls


def test_facility_location_meets_all_pairs_once_for_many_picks(spark, cloud, monkeypatch):
    df, x, score = cloud
    calls = small(monkeypatch)
    assert selection.facility_location(df, "vec_id", "e", "score", 8) == coverage(x, score, 8, -1.0)
    assert calls == [False]  # once, in single precision


@pytest.mark.parametrize("right", [0, 1, 3])
def test_facility_location_with_wrong_guesses(spark, cloud, monkeypatch, right):
    """Picks are those of the exact gains, whatever is guessed."""
    df, x, score = cloud
    calls, want = small(monkeypatch), coverage(x, score, 6, -1.0)

    def guess(cover, key, count, gone, n):
        ids = [*want[len(gone) : len(gone) + right], *[i for i in range(100, 120) if i not in want]][:count]
        return (np.array(ids), x[ids]) if ids else None

    monkeypatch.setattr(selection, "_guessed", guess)
    assert selection.facility_location(df, "vec_id", "e", "score", 6) == want
    assert len(calls) <= 7 - right


def test_facility_location_with_more_copies_than_the_queue_holds(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 12))
    x[r.permutation(400)[:200]] = x[7] = x.mean(axis=0) + 0.1
    df = spark.createDataFrame([(k, [float(y) for y in v], 1.0) for k, v in enumerate(x)], "vec_id long, e array<double>, score double").repartition(5)
    calls = small(monkeypatch)
    got = selection.facility_location(df, "vec_id", "e", "score", 4)
    assert got == coverage(x / np.linalg.norm(x, axis=1, keepdims=True), np.ones(400), 4, -1.0)
    assert True in calls  # bounds in single precision cannot tell 200 copies apart


def test_facility_location_of_no_rows(spark):
    df = spark.createDataFrame([(1, None, 0.5)], "vec_id long, e array<double>, score double")
    assert selection.facility_location(df, "vec_id", "e", "score", 3) == []


@pytest.mark.parametrize("least", [1e-12, 0.6])
def test_coverage_gains(spark, cloud, least):
    """Gains of all rows beside none, one and two more: exact, or bounds that are above by little, also near the threshold."""
    df, x, _ = cloud
    c = np.random.default_rng(2).random(800) * 0.2
    both = df.select("vec_id", "e").join(spark.createDataFrame(list(enumerate(c.tolist())), "vec_id long, c double"), "vec_id")
    filed, tiles = (cells.dealt if least < 0.1 else cells.tiled)(both, "vec_id", "e", 150)
    assert len(tiles.rows) > 4
    rows = filed.join(both.select(F.col("vec_id").alias("id"), "c"), "id").select("tile", "id", "v", "c")
    s = x @ x.T
    np.fill_diagonal(s, 1.0)
    s = np.where(s >= least, s, 0.0)
    covers = [c, np.maximum(c, s[5]), np.maximum(np.maximum(c, s[5]), s[700])]
    want = np.array([np.maximum(s - y, 0).sum(axis=1) for y in covers])
    for exact in (True, False):
        found = sorted(VO.coverage_gains(rows, tiles, least, (np.array([5, 700]), x[[5, 700]]), exact).collect())
        got = np.array([r[1:] for r in found]).T
        assert [r["id"] for r in found] == list(range(800))
        assert np.abs(got - want).max() < (1e-9 if exact else 0.05) and (exact or (got >= want).all())


def test_partitioned_query_by_brute_force(spark, sf_dir):
    """The query's own picks: k_center within each hash group, then among what those chose."""
    from gleaner.plans import registry, selection_queries

    rows = views.vecs(spark, sf_dir).select("vec_id", "e", F.expr("pmod(hash(CAST(vec_id AS BIGINT)), 4)").alias("part")).orderBy("vec_id").collect()
    x = np.array([r["e"] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    k, ids = selection_queries.K, np.array([r["vec_id"] for r in rows])

    def centre(at):
        own = x[at]
        start = first_max(-(own @ own.mean(axis=0)), np.ones(len(at), bool))
        return [at[i] for i in greedy(own, min(k, len(at)), start, np.maximum, lambda m: -m)]

    union = sorted(i for p in range(4) for i in centre([j for j, r in enumerate(rows) if r["part"] == p]))
    assert picked(registry.queries()["k6_select_partitioned"](spark, sf_dir)) == [int(ids[i]) for i in centre(union)]


def test_one_image_of_many_boxes(spark):
    """100,000 boxes of one image, decided in squares by a bounded number of jobs; the same as a list pass in numpy."""
    r = np.random.default_rng(8)
    n = 100_000
    x, y = r.integers(0, 20_000, n), r.integers(0, 20_000, n)
    w, h = r.integers(20, 120, n), r.integers(20, 120, n)
    score = r.random(n).round(3)
    import pandas as pd

    df = spark.createDataFrame(pd.DataFrame({"image_id": 1, "box_id": np.arange(n), "x1": x, "y1": y, "x2": x + w, "y2": y + h, "score": score}))
    got, jobs = jobs_of(spark, lambda: {r["box_id"] for r in selection.nms(df).select("box_id").collect()})
    order = np.lexsort((np.arange(n), -score))
    want, cell = set(), {}
    for k in order.tolist():
        near = [o for gy in range(y[k] // 128 - 1, y[k] // 128 + 2) for gx in range(x[k] // 128 - 1, x[k] // 128 + 2) for o in cell.get((gy, gx), ())]
        if all(iou((0, 0, x[k], y[k], x[k] + w[k], y[k] + h[k]), (0, 0, x[o], y[o], x[o] + w[o], y[o] + h[o])) <= 0.3 for o in near):
            want.add(k)
            cell.setdefault((y[k] // 128, x[k] // 128), []).append(k)
    assert got == want and jobs < 150


def test_large_groups_are_matched_in_rounds(spark, many):
    """Ties, chains of pairs and groups of any size give the matches of one pass over all pairs, best first."""
    left, right = boxes(spark, many), boxes(spark, [(g, b, x1 + 3, y1 + 2, x2 + 3, y2 + 2, s) for g, b, x1, y1, x2, y2, s in many])
    found = [sorted(map(tuple, joins.match_greedy(left, right, "image_id", 0.1, n).collect())) for n in (100_000, 12, 0)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 200
    by = groups(many)
    want = []
    for g, rows in by.items():
        pairs = sorted((-v, a[1], b[1]) for a in rows for b in rows if (v := iou(a[:2] + a[2:6], (b[0], b[1], b[2] + 3, b[3] + 2, b[4] + 3, b[5] + 2))) >= 0.1)
        used = set()
        for v, i, j in pairs:
            if ("i", i) not in used and ("j", j) not in used:
                used |= {("i", i), ("j", j)}
                want.append((g, i, j, -v))
    assert [(g, i, j) for g, i, j, _ in found[0]] == sorted((g, i, j) for g, i, j, _ in want)


@pytest.mark.parametrize("pass_rows", [2000, 10])
def test_parents_keep_their_crops_without_joins(spark, many, pass_rows):
    rows = [r for r in many if r[0] % 3 or r[1] < 9]  # images of 9 and of 12
    crops = boxes(spark, rows).groupBy("image_id", (F.col("box_id") % 3).alias("parent_id")).agg(F.collect_list(F.struct("box_id", "score", "x1", "y1", "x2", "y2")).alias("crops"))
    bare = spark.createDataFrame([(1, 7, []), (99, 0, [])], crops.schema)
    stays = {(r["image_id"], r["box_id"]) for r in selection.nms(boxes(spark, rows), threshold=0.3).collect()}
    want = {(g, p): sorted(r[1] for r in rows if r[0] == g and r[1] % 3 == p and (g, r[1]) in stays) for g in range(30) for p in range(3)} | {(1, 7): [], (99, 0): []}
    out = selection.dedup_across_parents(crops.unionByName(bare), 0.3, pass_rows=pass_rows)
    found = [((r["image_id"], r["parent_id"]), [c["box_id"] for c in r["crops"]]) for r in out.collect()]
    assert len(found) == len(want) and dict(found) == want
    assert ("Join" in out._jdf.queryExecution().optimizedPlan().toString()) == (pass_rows < 12)
