"""User functions over DataFrames, in Arrow batches: values reach them as Python's own, null as None, nested ones as lists and dicts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def _schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def map_rows(df: DataFrame, f: Callable[[dict], dict], schema: str) -> DataFrame:
    """`f` of each row as a dict; what it leaves out of `schema` is null. Rows keep their place within a partition; carry a key to order them."""
    out = _schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([f(r) for r in batch.to_pylist()], out)

    return df.mapInArrow(run, schema)


def map_batches(df: DataFrame, model: Callable[[], object], column: str, schema: str, batch_size: int = 256) -> DataFrame:
    """Adds a model's answers as the last column of `schema`. The model is built once for each task, by `model()`.

    It is asked through `answer_batch(list)` where it has that, `batch_size` values at a time, else one by one through `answer(value)`.
    """
    out = _schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = model()
        for batch in batches:
            values = batch.column(batch.schema.get_field_index(column)).to_pylist()
            if hasattr(built, "answer_batch"):
                answers = [a for i in range(0, len(values), batch_size) for a in built.answer_batch(values[i : i + batch_size])]
            else:
                answers = [built.answer(v) for v in values]
            given = [batch.column(batch.schema.get_field_index(n)).cast(out.field(n).type) for n in out.names[:-1]]
            yield pa.RecordBatch.from_arrays([*given, pa.array(answers, out.types[-1])], schema=out)

    return df.mapInArrow(run, schema)


def map_with_errors(df: DataFrame, f: Callable[[dict], dict], schema: str, policy: str = "fail_row", fallback: dict | None = None) -> DataFrame:
    """`map_rows` with a column `error` (string): an exception of a row is its message there.

    Under `fail_row` the row's other new columns are null; under `pass` they are those of `fallback`.
    """
    whole = f"{schema}, error string"
    out = _schema(whole)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    rows.append({**f(r), "error": None})
                except Exception as e:  # any failure of a user's function belongs to its row
                    base = {n: r.get(n) for n in out.names}
                    rows.append({**base, **((fallback or {}) if policy == "pass" else {}), "error": f"{type(e).__name__}: {e}"})
            yield _batch(rows, out)

    return df.mapInArrow(run, whole)


def with_cost(df: DataFrame, cost, pred: str, truth: str) -> DataFrame:
    """Adds `cost` by a callable of two columns that gives a column: a pairing cost stays in Spark's plan."""
    from pyspark.sql import functions as F

    return df.withColumn("cost", cost(F.col(pred), F.col(truth)))
