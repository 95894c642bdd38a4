"""Decided behaviours on hand-made rows, and properties of metrics and splits."""

import math

import pytest
from pyspark.sql import functions as F

from gleaner.functions import boxes as B
from gleaner.functions import paths, vectors
from gleaner.functions import text as T
from gleaner.operators import evaluate, grids, joins, ordering, records, selection, stats
from gleaner.operators import vectors as VO
from gleaner.sources import files, tables

BOX = "image_id long, box_id long, x1 long, y1 long, x2 long, y2 long, img_w long, img_h long"


def one(spark, value):
    return spark.range(1).select(value.alias("v")).first()["v"]


def test_clamping_before_the_bounds_test(spark):
    rows = [(0, 0, 700, 10, 800, 20, 640, 480), (0, 1, -50, 10, -10, 20, 640, 480), (0, 2, 30, 10, 20, 20, 640, 480), (0, 3, 1, 1, 9, 9, 640, 480)]
    df = spark.createDataFrame(rows, BOX)
    kept = {r["box_id"]: (r["x1"], r["x2"]) for r in records.valid_boxes(df).collect()}
    assert kept == {0: (639, 640), 3: (1, 9)}
    assert {r["box_id"] for r in records.valid_boxes(df, strict=True).collect()} == {3}


def test_near_edge_wins_and_size_is_cut(spark):
    rows = [(0, 0, 0, 200, 15, 470, 640, 480), (0, 1, 5, 475, 10, 479, 640, 480)]
    got = {r["box_id"]: r for r in records.fix_tiny(spark.createDataFrame(rows, BOX)).collect()}
    assert (got[0]["x1"], got[0]["x2"], got[0]["was_fixed"]) == (0, 15, True)
    assert (got[0]["y1"], got[0]["y2"]) == (360, 480)  # bottom, cut to a quarter of the height
    assert (got[1]["y1"], got[1]["y2"]) == (476, 480)


def test_maxmin_variants_differ(spark):
    v = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [0.7, -0.7])]
    df = spark.createDataFrame([(i, e, 1.0) for i, e in v], "id long, e array<double>, score double")
    loose = [r["id"] for r in selection.select(df, "id", "e", "score", 4, "maxmin").orderBy("rank").collect()]
    strict = [r["id"] for r in selection.select(df, "id", "e", "score", 4, "maxmin", true_maxmin=True).orderBy("rank").collect()]
    assert sorted(loose) == sorted(strict) == [0, 1, 2, 3] and loose[0] == strict[0]


def test_upsert_last_write_wins(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, v string")
    changes = spark.createDataFrame([(2, "x", 0), (2, "y", 1), (3, "z", 0)], "id long, v string, seq int")
    assert {(r["id"], r["v"]) for r in tables.upsert(df, changes, "id").collect()} == {(1, "a"), (2, "y"), (3, "z")}


def test_parent_table_missing_or_empty(spark):
    children = spark.createDataFrame([(1,), (2,)], "k long")
    empty = spark.createDataFrame([], "k long, label string")
    outcome = lambda p: {r["outcome"] for r in joins.collect_by_parent(children, p, "k", "label", ["T"], ["S"]).collect()}
    assert outcome(None) == {"kept"} and outcome(empty) == {"dropped"}


def test_population_deviation_and_upper_median(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (10.0,)], "x double")
    d = stats.distribution(df, "x").first()
    assert d["std"] == pytest.approx(3.5355339) and (d["p25"], d["p75"]) == (1.75, 4.75)
    assert stats.upper_median(df, "x").first()["median"] == 3.0


def test_empty_masks(spark):
    cells = spark.createDataFrame([(0, 0, 0, False, False)], "grid_id long, y long, x long, p boolean, t boolean")
    assert evaluate.overlap(cells, "p", "t").first()["iou"] == 1.0
    assert evaluate.overlap(cells, "p", "t", empty=0.0).first()["iou"] == 0.0


def test_zero_vectors(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0])], "id long, e array<double>")
    ref = spark.createDataFrame([([1.0, 0.0],)], "centroid array<double>")
    assert {r["id"]: r["similarity"] for r in VO.score_to_reference(df, ref, "e").collect()} == {0: 0.5, 1: 1.0}
    assert one(spark, vectors.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


@pytest.mark.parametrize(
    ("text", "a", "b"),
    [("x <TO> y to z", "x", "y to z"), ("a b to c d", "a b", "c d"), ("a to b c d to e f g", "a to b c d", "e f g"), ("one and two and three", "one", "two and three"), ("p vs q", "p", "q"), ("p | q", "p", "q"), ("w x y", "w", "x y"), ("", "", "")],
)
def test_split_description(spark, text, a, b):
    first, second = T.split_description(F.lit(text))
    assert (one(spark, first), one(spark, second)) == (a, b)


def test_split_description_at_the_first(spark):
    first, second = T.split_description(F.lit("a to b c d to e f g"), mode="first")
    assert (one(spark, first), one(spark, second)) == ("a", "b c d to e f g")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[[1,2,3,4],[5,6,7]]", [(1, None, [1, 2, 3, 4])]),
        ('[{"bbox":[1,2,3,4]},{"description":"d","bbox":[5,6,7,8]}]', [(1, "Transition 1", [1, 2, 3, 4]), (2, "d", [5, 6, 7, 8])]),
        ("see [[1, 2, 3, 4]] there", [(1, None, [1, 2, 3, 4])]),
        ("nothing", []),
        ("", []),
    ],
)
def test_parse_boxes(spark, text, want):
    assert [(r["id"], r["description"], r["coords"]) for r in one(spark, T.parse_boxes(F.lit(text)))] == want


def test_entropy(spark):
    assert one(spark, T.entropy(F.lit("abab"))) == pytest.approx(1.0)
    assert one(spark, T.entropy(F.lit("aaaa"))) == pytest.approx(0.0)
    assert one(spark, T.entropy(F.lit(""))) == 0.0
    assert one(spark, T.entropy(F.lit("abcdefgh"))) == pytest.approx(3.0)


def test_path_parts(spark):
    for path, name, stem, suffix in (("a/b.tar.GZ", "b.tar.GZ", "b.tar", ".gz"), ("x/.hidden", ".hidden", ".hidden", ""), ("plain", "plain", "plain", "")):
        c = F.lit(path)
        assert (one(spark, paths.name(c)), one(spark, paths.stem(c)), one(spark, paths.suffix(c))) == (name, stem, suffix)


def test_iou_is_symmetric_and_bounded(spark):
    import random

    draw = random.Random(1)
    rows = []
    for i in range(200):
        a = [draw.randint(-5, 30) for _ in range(4)]
        rows.append((i, a[0], a[1], a[0] + draw.randint(1, 20), a[1] + draw.randint(1, 20), a[2], a[3], a[2] + draw.randint(1, 20), a[3] + draw.randint(1, 20)))
    df = spark.createDataFrame(rows, "i long, x1 long, y1 long, x2 long, y2 long, x1_b long, y1_b long, x2_b long, y2_b long")
    a, b = B.Box.of(), B.Box.of(suffix="_b")
    for r in df.select(B.iou(a, b).alias("p"), B.iou(b, a).alias("q"), B.giou(a, b).alias("g")).collect():
        assert r["p"] == r["q"] and 0 <= r["p"] <= 1 and -1 <= r["g"] <= r["p"] + 1e-12
    assert df.where(B.iou(a, a) != 1).count() == 0


def test_rand_index_of_equal_labels(spark):
    df = spark.createDataFrame([(0, i % 3, i % 3) for i in range(30)] + [(1, 0, i % 2) for i in range(10)], "g long, a int, b int")
    got = {r["g"]: r["ari"] for r in evaluate.adjusted_rand(df, "g", "a", "b").collect()}
    assert got[0] == 1.0 and abs(got[1]) < 1e-12


def test_splits_cover_and_part(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    rows = ordering.three_way(df, "k").collect()
    by = {s: sum(r["split"] == s for r in rows) for s in ("train", "val", "test")}
    assert by == {"train": 700, "val": 200, "test": 100} and len({r["k"] for r in rows}) == 1000
    assert ordering.train_test(df.limit(3), "k", 0.01).where("split = 'test'").count() == 1
    borrowed = ordering.prefix_split(df.limit(100), "k", 50, 0)
    assert {r["split"]: r["n"] for r in borrowed.groupBy("split").agg(F.count("*").alias("n")).collect()} == {"train": 40, "val": 10, "test": 50}


def test_numbers_are_a_permutation_of_order(spark):
    df = spark.createDataFrame([(x,) for x in (5, -3, 10**12, 5, 0, None, -(10**15))], "x long")
    rows = ordering.numbered(df, F.col("x"), ["x"]).orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 8))
    known = [r["x"] for r in rows if r["x"] is not None]
    assert known == sorted(known)


def test_numbers_of_an_order_with_outliers_and_nulls(spark):
    values = [None, None, 10**15, *[5] * 300, *range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x long").repartition(5)
    got = {r["n"]: r["id"] for r in ordering.numbered(df, F.col("x"), ["id"]).collect()}
    want = sorted(range(len(values)), key=lambda i: (values[i] is not None, values[i] or 0, i))
    assert [got[k + 1] for k in range(len(values))] == want


def test_chunks_of_a_group_carry_on(spark):
    rows = [(g, i, float((i * 31 + 7) % 23)) for g in ("a", "b", None) for i in range(57)]
    df = spark.createDataFrame(rows, "g string, i long, v double")
    for chunk in (9, 1000):
        rolling = {(r["g"], r["i"]): r["rolling"] for r in ordering.rolling_mean(df, "v", ["g"], ["i"], n=6, chunk=chunk).collect()}
        running = {(r["g"], r["i"]): r["running"] for r in ordering.running_mean(df, "v", ["g"], ["i"], chunk=chunk).collect()}
        best = {(r["g"], r["i"]): r["is_best"] for r in ordering.running_best(df, "v", ["g"], ["i"], chunk=chunk).collect()}
        for g in ("a", "b", None):
            v = [x for h, _, x in rows if h == g]
            for i in range(57):
                assert abs(rolling[g, i] - sum(v[max(0, i - 5) : i + 1]) / len(v[max(0, i - 5) : i + 1])) < 1e-9
                assert abs(running[g, i] - sum(v[: i + 1]) / (i + 1)) < 1e-9
                assert best[g, i] == (v[i] > max([0.0, *v[:i]]))


def test_scores_that_many_rows_share_are_ranked(spark):
    from gleaner.operators import evaluate

    df = spark.createDataFrame([(f"k{i:03}", 0.5 if i % 3 else i / 300, i % 2 == 0) for i in range(300)], "k string, s double, m boolean")
    rows = sorted(((-r["s"], r["k"], r["m"]) for r in df.collect()))
    got = {r["k"]: (r["rank"], r["tp"], r["fp"]) for r in evaluate.ranked_counts(df.repartition(4), "s", "m", "k").collect()}
    hits = 0
    for n, (_, k, m) in enumerate(rows, 1):
        hits += m
        assert got[k] == (n, hits, n - hits)


def test_points_within_are_those_of_all_pairs(spark):
    import random

    draw = random.Random(2)
    make = lambda n: sorted({(0, draw.randint(0, 40), draw.randint(0, 40)) for _ in range(n)})
    p, t = make(120), make(80)
    schema = "grid_id long, y long, x long"
    for d in (1.0, 2.5, 4.0):
        got = {tuple(r) for r in grids.within(spark.createDataFrame(p, schema), spark.createDataFrame(t, schema), d).collect()}
        assert got == {a for a in p if any(math.dist(a[1:], b[1:]) <= d for b in t)}


def test_malformed_lines(spark, tmp_path):
    path = str(tmp_path / "lines")
    spark.createDataFrame([('{"a": 1}',), ("{",), ("  ",), ('{"a": "x"}',), ('{"a": 2, "b": 3}',)], "value string").coalesce(1).write.text(path)
    assert sorted(r["a"] for r in files.read_jsonl(spark, path, "a long").collect()) == [1, 2]
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_jsonl(spark, path, "a long", skip_errors=False).collect()


def test_stage_is_computed_once(spark, tmp_path):
    path = f"file://{tmp_path}/stage"
    first = tables.staged(spark.range(3).select(F.rand().alias("r")), "s", path).collect()
    assert tables.staged(spark.range(3).select(F.rand().alias("r")), "s", path).collect() == first


def test_clear_deletes_what_a_session_wrote(spark):
    tables.staged(spark.range(3), "gone")
    path = tables.new_path(spark, "other")
    spark.range(2).write.parquet(path)
    assert tables.exists(spark, path) and tables.clear(spark) >= 2
    assert not tables.exists(spark, path) and tables.clear(spark) == 0
