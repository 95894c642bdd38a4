"""JSON arrays read by byte ranges: borders within strings, records over many ranges, and the same rows as a whole read."""

import json
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gleaner.sources import arrays, files
from gleaner.sources.tables import new_path

SCHEMA = "id long, text string, box struct<a:array<long>,m:map<string,string>>, n double"


def objects(n):
    r = np.random.default_rng(4)
    odd = ["}", "{", '"', "\\", '\\"', "},{", "[1]", '"}', "\\\\", "é}日", "\n", "x" * 40]
    for k in range(n):
        text = "".join(odd[int(i)] for i in r.integers(0, len(odd), int(r.integers(0, 9))))
        yield {"id": k, "text": text * (60 if k % 37 == 5 else 1), "box": {"a": [k, -k], "m": {"}": text, "{": "]"}}, "n": k / 4}


def written(spark, indent):
    path = new_path(spark, "arrays").removeprefix("file://")
    os.makedirs(path)
    rows = list(objects(120))
    for name, some in (("a", rows[:80]), ("b", rows[80:]), ("empty", [])):
        with open(f"{path}/{name}.json", "w", encoding="utf-8") as f:
            json.dump(some, f, indent=indent, ensure_ascii=bool(indent))
    return "file://" + path, rows


@pytest.mark.parametrize("size, indent", [(211, None), (4096, 1), (1 << 26, None)])
def test_ranges_give_the_rows_of_whole_files(spark, size, indent):
    path, rows = written(spark, indent)
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        tasks = spark.read.option("lineSep", "}").text(path).select("_metadata.file_block_start").distinct().count()
        got = sorted((r.asDict(recursive=True) for r in arrays.read_arrays(spark, path, SCHEMA).collect()), key=lambda r: r["id"])
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == rows and (size > 5000 or tasks > 2)


def test_marks():
    data = np.frombuffer(rb'{"a\\":"}\"","b":[{}]}', np.uint8)
    quotes, _ = arrays.marks(data)
    assert [int(q) for q in quotes] == [1, 5, 7, 11, 13, 15]
    assert arrays.records(np.frombuffer(b'[{"a":1},{"b', np.uint8), False, 0) == ([(1, 8)], None, (9, 12))
    assert arrays.records(np.frombuffer(b'}"},{"c":2}', np.uint8), True, 2) == ([(4, 11)], (0, 3), None)


def test_a_manifest_of_large_files(spark, sf_dir, monkeypatch):
    """What the library writes it reads alike in both ways."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    path = new_path(spark, "manifest")
    files.write_manifest(df, path, files=2)
    monkeypatch.setattr(files, "WHOLE_BYTES", 1)
    large = files.read_manifest(spark, path, "doc_id long, text string, source string")
    assert large.exceptAll(df).count() == df.exceptAll(large).count() == 0 and large.where(F.col("text").isNull()).count() == df.where(F.col("text").isNull()).count()


@pytest.mark.parametrize("piece", [1, 50, 1000])
def test_a_range_is_read_piece_by_piece(spark, monkeypatch, piece):
    """Records over many pieces and ranges, and lists between them, which are left out."""
    rows = list(objects(150))
    texts = [x for r in rows for x in (json.dumps(r), json.dumps([[1, {"id": 7}], "]"]))]
    raw = ("[" + ",\n".join(texts) + "]").encode()
    monkeypatch.setattr(arrays, "PIECE", piece)

    def batches(low, high):
        values = raw[low:high].removesuffix(b"}").split(b"}")
        yield pa.record_batch([pa.array(values, pa.binary()), pa.array(["f"] * len(values)), pa.array([low] * len(values))], ["value", "file", "start"])

    cuts = [0, *[raw.index(b"}", at) + 1 for at in range(700, len(raw) - 700, 700)], len(raw)]
    ranges = sorted(set(zip(cuts, cuts[1:], strict=False)) - {(c, c) for c in cuts})
    within, depth, begins, held = False, 0, {}, []
    for low, high in ranges:
        (b,) = arrays._changes(batches(low, high))
        begins["f", low] = (within, depth)
        depth += b.column("inside" if within else "outside")[0].as_py()
        within ^= bool(b.column("odd")[0].as_py())
    got, parts, most = [], [], 0
    for low, high in ranges:
        for b in arrays._elements(begins)(batches(low, high)):
            most = max(most, sum(map(len, b.column("value").to_pylist())))
            for p, v in zip(b.column("part").to_pylist(), b.column("value").to_pylist(), strict=True):
                if p is None:
                    got.append(v)
                elif p:
                    parts.append(v)
                else:
                    parts[-1] += v
    found = [json.loads(v) for v in got + [p for p in parts if p.startswith(b"{")]]
    assert sorted(found, key=lambda r: r["id"]) == rows and (piece > 50 or most < 5000)
