"""Exact joins of vectors by cell bounds: equal to numpy, and fewer rows sent where vectors have clusters."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import cells
from gleaner.operators import vectors as VO


def clusters(n, groups, noise, seed=0, width=16):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(groups, width))
    return centre[rng.integers(0, groups, n)] + noise * rng.normal(size=(n, width))


def table(spark, x):
    return spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "id long, e array<double>").repartition(3)


def products(x):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    return u @ u.T


@pytest.fixture(scope="module", params=["clusters", "none", "copies"])
def some(request, spark):
    x = clusters(600, 12, 0.15) if request.param == "clusters" else np.random.default_rng(1).normal(size=(600, 16))
    if request.param == "copies":
        x[100:320] = x[7]  # a third of all rows are one vector
        x[[3, 500]] = 0.0
    return table(spark, x).cache(), products(x)


def test_bounds_hold(spark):
    x = clusters(500, 6, 0.3)
    x[4] = 0.0
    rows, tiles = cells.tiled(table(spark, x), "id", "e", 40)
    found = rows.collect()
    assert sorted(r["id"] for r in found) == list(range(500)) and len(tiles.rows) > 10
    assert sum(tiles.rows) >= 500 and max(np.bincount([r["tile"] for r in found])) <= 80
    m = np.array([r["v"] for r in found])
    least, most = tiles.ends(m)
    real = cells.angle(m @ m.T)
    tile = np.array([r["tile"] for r in found])
    for t in range(len(tiles.rows)):
        if (tile == t).any():
            assert (least[:, t] <= real[:, tile == t].min(axis=1)).all() and (real[:, tile == t].max(axis=1) <= most[:, t]).all()


@pytest.mark.parametrize("threshold", [-1.0, 0.0, 0.4, 0.9, 1.0])
def test_similar_pairs(some, threshold):
    df, s = some
    got = {(r["id_a"], r["id_b"]): r["similarity"] for r in VO.similar_pairs(df, "id", "e", threshold, size=50).collect()}
    i, j = np.nonzero(np.triu(s >= threshold + 1e-12, 1))
    assert set(zip(i.tolist(), j.tolist(), strict=True)) <= set(got)
    assert all(k[0] < k[1] and s[k] >= threshold - 1e-12 and abs(s[k] - v) < 1e-12 for k, v in got.items())


def test_similarity_extremes(some):
    df, s = some
    off = s[~np.eye(len(s), dtype=bool)]
    got = VO.similarity_extremes(df, "id", "e", size=50).first()
    assert abs(got["min"] - off.min()) < 1e-12 and abs(got["max"] - off.max()) < 1e-12


@pytest.mark.parametrize("itself", [False, True])
def test_neighbours(some, monkeypatch, itself):
    df, s = some
    monkeypatch.setattr(VO, "ROWS", 40)
    monkeypatch.setattr(VO, "QUERIES", 15)
    got = {}
    for r in VO.knn(df.where("id % 5 = 0"), df, 7, "id", "e", exclude_self=itself).collect():
        got[r["query_id"], r["rank"]] = r["neighbour_id"]
    assert len(got) == 7 * 120
    for q in range(0, 600, 5):
        want = sorted((-round(s[q, i], 9), i) for i in range(600) if not itself or i != q)[:7]
        have = [got[q, k + 1] for k in range(7)]
        assert np.allclose([s[q, i] for i in have], [-v for v, _ in want], atol=2e-9)
        if not (np.diff([v for v, _ in want]) == 0).any():
            assert have == [i for _, i in want]


def test_clusters_meet_their_own_kind(spark):
    """Of vectors in clusters few tiles meet, and a row is sent to few tiles; a query goes on to few."""
    df = table(spark, clusters(2000, 20, 0.08))
    met, count = VO.meetings(df, "id", "e", 0.9, 50)
    meets, sent = met.select("meet").distinct().count(), met.count()
    assert count >= 40 and meets < 0.25 * count * (count + 1) / 2 and sent < 2000 * count * 0.25
    rows, tiles = cells.tiled(df, "id", "e", 50)
    asked = rows.where("id % 20 = 0").select("tile", "id", "v", F.lit(0.95).alias("worst"))
    assert cells.reaching(asked, tiles, VO._nearer, pairs=False).count() < 0.25 * 100 * count


def test_no_rows(spark):
    none = spark.createDataFrame([], "id long, e array<double>")
    assert VO.similar_pairs(none, "id", "e", 0.5).count() == 0
    assert VO.similarity_extremes(none, "id", "e").first()["min"] is None
    few = table(spark, np.eye(3))
    assert VO.knn(few, none, 2, "id", "e").count() == VO.knn(none, few, 2, "id", "e").count() == 0
    assert VO.similar_pairs(few.union(spark.createDataFrame([(9, None)], "id long, e array<double>")), "id", "e", -0.5).count() == 3


def test_the_best_of_a_block_keep_near_ties():
    r = np.random.default_rng(3)
    s = r.integers(0, 40, (50, 300)) / 40 + r.integers(-2, 3, (50, 300)) * 1e-10
    s[0] = -np.inf
    s[1] = 0.5
    ids = r.permutation(1000)[:300]
    for k in (1, 5, 290):
        order = lambda a, i: np.lexsort((i, -a.round(9)), axis=1)[:, :k]
        wide = np.broadcast_to(ids, s.shape)
        a, i = VO._best(s, ids, k)
        assert (np.take_along_axis(i, order(a, i), 1) == np.take_along_axis(wide, order(s, wide), 1)).all()


def test_rows_go_to_tiles_a_few_at_a_time(spark, monkeypatch):
    """However many tiles a row goes to, a task gives out SPREAD rows at a time."""
    tiles = cells.Tiles(np.zeros((40, 2)), np.full(40, 4.0), np.full(40, 9))
    rows = spark.createDataFrame([(k % 40, k, [1.0, 0.0]) for k in range(500)], "tile long, id long, v array<double>").coalesce(1)
    monkeypatch.setattr(cells, "SPREAD", 64)
    made = []
    real = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema: made.append(f) or real(self, f, schema))
    cells.reaching(rows, tiles, lambda own, m, _: np.ones((len(m), 40), bool), pairs=True)
    sizes = [b.num_rows for b in made[0](iter(rows.toArrow().combine_chunks().to_batches()))]
    assert sum(sizes) == 500 * 40 and max(sizes) <= 64
