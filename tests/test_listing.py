"""Listing by tasks: the rows of Spark's own listing, on deep and wide trees, and no folder opened by the driver."""

import os

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from gleaner.sources import files
from gleaner.sources.tables import new_path

COLUMNS = ["path", "length", "modified"]


def tree(spark, wide=150):
    root = new_path(spark, "tree").removeprefix("file://")
    odd = ["a b", "c%20d", "日本", "category=x", "_part=1", "_hidden", ".dot", "plain"]
    names = ["one.PNG", "two.png", "three.jpg", ".four.png", "_five.png", "no_suffix", "six.tar.png"]
    for k in range(wide):
        folder = f"{root}/{odd[k % len(odd)]}/{k}/{'deep/' * (k % 4)}"
        os.makedirs(folder)
        for j, name in enumerate(names[: 1 + k % len(names)]):
            with open(f"{folder}/{name}", "wb") as f:
                f.write(b"x" * (k + j + 1))
    os.makedirs(f"{root}/empty/empty")
    with open(f"{root}/top.png", "wb") as f:
        f.write(b"top")
    return root


def by_spark(spark, root):
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return rows.select("path", "length", F.col("modificationTime").alias("modified"))


def in_a_task(address):
    assert TaskContext.get() is not None
    return files._local(address)


@pytest.mark.parametrize("opener", [None, in_a_task])
def test_equal_to_a_listing_by_spark(spark, opener):
    root = tree(spark)
    want = sorted(map(tuple, by_spark(spark, root).where(F.lower("path").endswith(".png")).collect()))
    found = files.list_files(spark, root, [".png"], opener=opener)
    assert sorted(map(tuple, found.select(COLUMNS).collect())) == want and len(want) > 100
    assert "BinaryFile" not in found._jdf.queryExecution().toString()
    assert {r["suffix"] for r in found.select("suffix").distinct().collect()} == {".png"}


def test_many_folders_are_dealt_to_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(files, "FOLDERS", 8)
    monkeypatch.setattr(files, "ENTRIES", 3)
    root = tree(spark, 300)
    made, staged = [], files.tables.staged

    def noted(df, label):
        made.append(df.rdd.getNumPartitions())
        return staged(df, label)

    monkeypatch.setattr(files.tables, "staged", noted)
    got = files.list_files(spark, root, [".png", ".jpg"]).count()
    assert got == by_spark(spark, root).where(F.lower("path").rlike(r"\.(png|jpg)$")).count()
    assert max(made) >= 8 and len(made) == 6  # a round for each level of folders


def test_top_level_one_file_patterns_and_none(spark):
    root = tree(spark, 10)
    assert [r["name"] for r in files.list_files(spark, root, [".png"], recursive=False).collect()] == ["top.png"]
    assert [r["length"] for r in files.list_files(spark, f"{root}/top.png", [".PNG"]).collect()] == [3]
    assert files.list_files(spark, f"{root}/empty", [".png"]).count() == 0
    open(f"{root}/empty/none.png", "wb").close()
    assert [r["length"] for r in files.list_files(spark, f"{root}/empty", [".png"]).collect()] == [0]
    assert [r["stem"] for r in files.list_files(spark, f"{root}/to*.png", [".png"]).collect()] == ["top"]
    with pytest.raises(FileNotFoundError):
        files.list_files(spark, f"{root}/absent", [".png"])
