"""Where queries and their SQL could differ: signs of zero, ties, and the order in which a stream's files come."""

import os

import pytest

from gleaner.plans import registry, streams_queries
from gleaner.sources.tables import shared_folder
from tests.oracle import connect


def folder(tmp_path, sf_dir, **tables):
    """The given tables, with some replaced."""
    for name in os.listdir(sf_dir):
        if name.removesuffix(".parquet") not in tables:
            os.symlink(f"{sf_dir}/{name}", tmp_path / name)
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        (part,) = (tmp_path / f"{name}.parquet").glob("part-*")
        part.rename(tmp_path / "part")
        for f in (tmp_path / f"{name}.parquet").iterdir():
            f.unlink()
        (tmp_path / f"{name}.parquet").rmdir()
        (tmp_path / "part").rename(tmp_path / f"{name}.parquet")
    return str(tmp_path)


def both(spark, path, name):
    ours = sorted(repr(tuple(r)) for r in registry.queries()[name](spark, path).collect())
    return ours, sorted(repr(tuple(r)) for r in connect(path).sql(registry.oracle_sql()[name]).fetchall())


def test_features_have_no_negative_zero(spark, sf_dir, tmp_path):
    rows = [(0, [0.25] * 32 + [-0.25] * 31 + [-0.250004], 1), (1, [0.125] * 64, 1)]
    path = folder(tmp_path, sf_dir, embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    ours, theirs = both(spark, path, "p34_feature_rows")
    assert len(ours) == 2 and ours == theirs


def test_the_best_of_equal_scores_is_the_smallest_key(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    copies = docs.unionByName(docs.selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")).orderBy("n_chars")
    labels = copies.selectExpr("doc_id", "1 AS quality", "0 AS toxic")
    path = folder(tmp_path, sf_dir, documents=copies, labels=labels)
    ours, theirs = both(spark, path, "t5_best_per_group")
    assert ours and ours == theirs
    # in any order of the rows
    again = folder(tmp_path / "again", sf_dir, documents=copies.orderBy("doc_id"), labels=labels) if not (tmp_path / "again").mkdir() else None
    assert ours == both(spark, again, "t5_best_per_group")[0]


@pytest.mark.parametrize("files", [8])
def test_files_of_a_stream_come_in_the_order_of_time(spark, oracle_dir, monkeypatch, files):
    made = []
    new_path = streams_queries.tables.new_path
    monkeypatch.setattr(streams_queries.tables, "new_path", lambda s, label: made.append((label, new_path(s, label))) or made[-1][1])
    streams_queries._stream(spark, oracle_dir, files)
    path = dict(made)["events"].removeprefix("file://")
    assert path.startswith(shared_folder(spark).removeprefix("file://"))
    names = sorted((f for f in os.listdir(path) if f.startswith("part-")), key=lambda f: os.stat(f"{path}/{f}").st_mtime_ns)
    ends = [spark.read.parquet(f"file://{path}/{f}").selectExpr("min(ts)", "max(ts)").first() for f in names]
    assert len(ends) == files and all(a[1] <= b[0] for a, b in zip(ends, ends[1:], strict=False))
