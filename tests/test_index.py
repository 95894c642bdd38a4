"""The stored index: recall of its query, what it scans, and rows that are added later."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleaner.operators import index as index_module
from gleaner.operators import vectors as VO
from gleaner.operators.index import VectorIndex
from gleaner.plans import registry
from gleaner.sources.tables import new_path


def pairs(df):
    return {(r["query_id"], r["neighbour_id"]) for r in df.select("query_id", "neighbour_id").collect()}


@pytest.mark.parametrize("where", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, where):
    """At the query's own parameters, with what is read: codes of a byte a component, and few vectors of eight bytes each."""
    sf_dir = f"/root/testdata/{where}"
    exact, found = (pairs(registry.queries()[q](spark, sf_dir)) for q in ("j11_knn_join", "j15_ann_join_ivf"))
    assert len(found & exact) / len(exact) >= 0.9 and len(found) == len(exact)


def clusters(n, seed):
    r = np.random.default_rng(seed)
    return np.random.default_rng(0).normal(size=(30, 32))[r.integers(0, 30, n)] + 0.15 * r.normal(size=(n, 32))


def test_of_clusters_a_fifth_is_scanned(spark):
    x = clusters(3000, 1)
    df = spark.createDataFrame([(k, [float(y) for y in v]) for k, v in enumerate(x)], "id long, e array<double>")
    own = VectorIndex.build(df, "id", "e", new_path(spark, "index"))
    queries = df.where("id % 20 = 0")
    exact, found = pairs(VO.knn(queries, df, 10, "id", "e")), pairs(own.search(queries, 10, "id", "e", probes=5))
    assert len(found & exact) / len(exact) >= 0.9
    sizes = {r["list"]: r["count"] for r in own.codes().groupBy("list").count().collect()}
    m = np.array([x[k] for k in range(0, 3000, 20)])
    near = own.centres.nearest(m / np.linalg.norm(m, axis=1, keepdims=True), 5, len(own.centres.tops))[0]
    assert len(sizes) > 40 and np.mean([sum(sizes.get(c, 0) for c in row) for row in near.tolist()]) <= 3000 / 5


def test_rows_added_later(spark, monkeypatch):
    """What is loaded again and added to finds what one built at once of the same centres finds; known ids are left alone."""
    monkeypatch.setattr(index_module, "CODES", 50)
    monkeypatch.setattr(index_module, "QUERIES", 7)
    x = clusters(400, 2)
    rows = [(k, [float(y) for y in v]) for k, v in enumerate(x)] + [(900, None)]
    df = spark.createDataFrame(rows, "id long, e array<double>")
    path = new_path(spark, "index")
    own = VectorIndex.build(df.where("id < 300"), "id", "e", path, lists=12)
    assert own.rows().count() == 300
    again = VectorIndex.load(spark, path)
    assert np.array_equal(again.centres.own, own.centres.own) and np.array_equal(again.centres.top_of, own.centres.top_of)
    other = df.withColumn("e", F.when(F.col("id") < 5, F.reverse("e")).otherwise(F.col("e")))
    assert again.add(other, "id", "e") == 100 and again.add(df, "id", "e") == 0
    whole = again.search(df.where("id % 7 = 0"), 5, "id", "e", probes=12, read=80, exclude_self=True)
    assert pairs(whole) == pairs(VO.knn(df.where("id % 7 = 0"), df, 5, "id", "e", exclude_self=True))
    few = again.search(df.where("id % 7 = 0"), 5, "id", "e", probes=3)
    exact = pairs(VO.knn(df.where("id % 7 = 0"), df, 5, "id", "e"))
    assert len(pairs(few) & exact) / len(exact) > 0.85


def test_empty_index(spark):
    none = spark.createDataFrame([], "id long, e array<double>")
    some = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, e array<double>")
    own = VectorIndex.build(none, "id", "e", new_path(spark, "index"))
    assert own.search(some, 3, "id", "e").count() == 0
    assert own.add(some, "id", "e") == 2
    assert [(r["query_id"], r["neighbour_id"]) for r in own.search(some, 1, "id", "e").orderBy("query_id").collect()] == [(1, 1), (2, 2)]
