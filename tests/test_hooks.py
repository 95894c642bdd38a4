"""User functions get values as they are: null longs as None, nested values, and schemas with commas inside."""

from gleaner.operators import hooks


def test_null_longs_and_nested_schemas(spark):
    df = spark.createDataFrame([(1, None, [1, None]), (2, 2**60 + 1, None)], "id long, n long, xs array<int>")
    schema = "id long, pair struct<p:long,q:decimal(10,2)>, m map<string,long>, seen string"

    def f(r):
        from decimal import Decimal

        assert r["n"] is None or isinstance(r["n"], int)
        return {"id": r["id"], "pair": {"p": r["n"], "q": Decimal("1.50")}, "m": {"x": len(r["xs"] or [])}, "seen": repr(r["n"])}

    got = {r["id"]: r.asDict(recursive=True) for r in hooks.map_rows(df, f, schema).collect()}
    assert got[1]["pair"]["p"] is None and got[1]["seen"] == "None" and got[1]["m"] == {"x": 2}
    assert got[2]["pair"]["p"] == 2**60 + 1 and str(got[2]["pair"]["q"]) == "1.50"


def test_errors_of_rows(spark):
    df = spark.createDataFrame([(1, None), (2, 5)], "id long, n long")
    for policy, other in (("fail_row", None), ("pass", -1)):
        got = {r["id"]: (r["half"], r["error"]) for r in hooks.map_with_errors(df, lambda r: {"id": r["id"], "half": r["n"] // 2}, "id long, half long", policy, {"half": -1}).collect()}
        assert got[2] == (2, None) and got[1][0] == other and got[1][1].startswith("TypeError")


class Lengths:
    def answer_batch(self, values):
        assert len(values) <= 2
        return [None if v is None else v + 1 for v in values]


def test_models_keep_nulls(spark):
    df = spark.createDataFrame([(k, None if k % 3 else k) for k in range(7)], "id long, n long")
    got = {r["id"]: (r["n"], r["more"]) for r in hooks.map_batches(df, Lengths, "n", "id long, n long, more long", batch_size=2).collect()}
    assert got == {k: (None, None) if k % 3 else (k, k + 1) for k in range(7)}
