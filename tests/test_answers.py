"""Boxes in answers: searched for once a row, and read as they always were."""

from pyspark.sql import functions as F

from gleaner.functions import text as T

ANSWERS = {
    "good as is [1,2,3,4]": ("keep", None),
    "no transition": ("discard", None),
    None: ("keep", None),
    "": ("keep", None),
    "[[1, 2,\t30 , 40]] [5,6,7,8]": ("refine", [1, 2, 30, 40]),
    "[5,6,7,8] [[1,2,30,40]]": ("refine", [1, 2, 30, 40]),
    "[1,2,3]": ("keep", None),
    "[[1,2,3,4]": ("refine", [1, 2, 3, 4]),
    "x [9,9,3,4] [1,2,3,4]": ("discard", None),
    "[[1,2,900,4]]": ("discard", None),
}


def test_an_answer_is_searched_once(spark):
    rows = spark.createDataFrame([(a, 100, 100) for a in ANSWERS], "answer string, w long, h long")
    action, bbox = T.refine_action(F.col("answer"), F.col("w"), F.col("h"))
    out = rows.select("answer", action.alias("action"), bbox.alias("bbox"))
    assert {r["answer"]: (r["action"], r["bbox"]) for r in out.collect()} == ANSWERS
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract(") <= 4  # two searches, which two columns name
