"""Texts that are gone through once a row, and split and measured as they always were."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleaner.functions import text as T

SPLITS = {
    None: (None, None),
    " to ": ("", ""),
    "a\tb to \x0bc to d": ("a\tb", "\x0bc to d"),
    " é to 日本 b to c ": ("é", "日本 b to c"),
    "a to to b": ("a", "to b"),
    "a b c\x1cd e": ("a b", "c\x1cd e"),
    "x and y | z <TO>  w": ("x and y | z", "w"),
}
ENTROPIES = [None, "", "a", "aab", "é日本é", "a😀😀b", "  \t"]


def once(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("ArrowEvalPython") == 1 and "lambda" not in plan


def test_odd_texts_are_split_once(spark):
    first, second = T.split_description(F.col("t"))
    out = spark.createDataFrame([(t,) for t in SPLITS], "t string").select("t", first.alias("a"), second.alias("b"))
    assert {r["t"]: (r["a"], r["b"]) for r in out.collect()} == SPLITS
    assert once(out)


def test_odd_texts_are_counted_once(spark):
    out = spark.createDataFrame([(t,) for t in ENTROPIES], "t string").select("t", T.entropy(F.col("t")).alias("h"))
    found = {r["t"]: r["h"] for r in out.collect()}
    for t in ENTROPIES:
        n = Counter(t or "")
        assert found[t] == pytest.approx(-sum(c / n.total() * math.log2(c / n.total()) for c in n.values()))
    assert once(out)
