"""A stored search structure for vectors: lists around centres, codes of a byte a component, and the vectors themselves.

A search scans the codes of the lists nearest to a query and reads the vectors of the best of them alone, so what it gives is
approximate in what it finds and exact in what it says of it. Rows can be added at any time; the centres stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleaner.functions import vectors as V
from gleaner.operators import cells

#: A row is in the two nearest lists if the second centre's angle is at most this much of the first's.
BORDER = 1.15
#: Codes and queries of a group, about: what one task holds.
CODES, QUERIES = 32_768, 4096
#: Rows that a task gives out at a time when it sends queries to lists.
SPREAD = 4096
#: Share of the lists that a search goes through, and vectors read for each row asked for.
PROBED, READ = 0.42, 4


def encoded(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as signed bytes, and what a unit of each row's bytes stands for."""
    scale = np.maximum(np.abs(m).max(axis=1, initial=0.0), 1e-12) / 127
    return np.rint(m / scale[:, None]).astype(np.int8), scale.astype(np.float32)


@dataclass(frozen=True)
class VectorIndex:
    """An index below `path`: tables `centres`, `codes` (list, id, code, scale) and `vectors` (id, v)."""

    spark: SparkSession
    path: str
    centres: cells.Centres

    @classmethod
    def build(cls, df: DataFrame, key: str, vector: str, path: str, lists: int | None = None) -> VectorIndex:
        """Draws centres from a bounded sample, by default the root of the rows in number (cells.CENTRES at most), and adds all rows."""
        n = df.count()
        centres = cells.fitted(df, key, vector, lists or max(1, round(n**0.5)))
        rows = [(True, int(k), int(k), c.tolist()) for k, c in enumerate(centres.tops)]
        rows += [(False, int(k), int(t), c.tolist()) for k, (t, c) in enumerate(zip(centres.top_of, centres.own, strict=True))]
        spark = df.sparkSession
        spark.createDataFrame(rows, "top boolean, place int, top_of int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")
        for name, schema in (("codes", _CODES), ("vectors", _VECTORS)):
            spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/{name}")
        out = cls(spark, path, centres)
        out.add(df, key, vector)
        return out

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> VectorIndex:
        rows = spark.read.parquet(f"{path}/centres").orderBy("top", "place").collect()  # cells.CENTRES and their root
        tops, own = ([r for r in rows if r["top"] == t] for t in (True, False))
        vectors = lambda some: np.array([r["centre"] for r in some]).reshape(len(some), -1)
        return cls(spark, path, cells.Centres(vectors(tops), vectors(own), np.array([r["top_of"] for r in own], np.int64)))

    def rows(self) -> DataFrame:
        return self.spark.read.schema(_VECTORS).parquet(f"{self.path}/vectors")

    def codes(self) -> DataFrame:
        return self.spark.read.schema(_CODES).parquet(f"{self.path}/codes")

    def add(self, df: DataFrame, key: str, vector: str) -> int:
        """Adds the rows whose id the index does not have, and returns how many these are; null vectors are left out.

        Codes are written before vectors, which say what the index has: after a failure between them the rows are added again,
        and a search takes their codes as one.
        """
        had = self.rows()
        new = cells.units(df, key, vector).dropDuplicates(["id"]).join(had.select("id"), "id", "left_anti")
        before = had.count()
        sent = self.spark.sparkContext.broadcast(self.centres)

        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                m = cells.matrix(batch.column(1))
                code, scale = encoded(m)
                if len(own.own) and len(m):
                    near, product = own.nearest(m, 2, 6)
                    to = cells.angle(product)
                    both = (near[:, 1] >= 0) & (to[:, 1] <= BORDER * to[:, 0])
                    row = np.concatenate([np.arange(len(m)), np.flatnonzero(both)])
                    place = np.concatenate([near[:, 0], near[both, 1]])
                else:
                    row, place = np.arange(len(m)), np.zeros(len(m), np.int64)
                blobs = pa.array([c.tobytes() for c in code], pa.binary())
                at = pa.array(row)
                yield pa.record_batch([pa.array(place), batch.column(0).take(at), blobs.take(at), pa.array(scale[row])], ["list", "id", "code", "scale"])

        new.mapInArrow(file, _CODES).repartition("list").sortWithinPartitions("list").write.mode("append").parquet(f"{self.path}/codes")
        new.select("id", F.col("v").cast("array<double>")).write.mode("append").parquet(f"{self.path}/vectors")
        return self.rows().count() - before

    def search(self, queries: DataFrame, k: int, key: str, vector: str, probes: int | None = None, read: int = READ, exclude_self: bool = False) -> DataFrame:
        """(query_id, neighbour_id, similarity, rank): the k best rows by cosine that the search finds; ties by id.

        The codes of `probes` lists are scanned (by default a fixed share of all lists) and `read * k` vectors read for a query.
        Lists of many rows are dealt into parts. Queries with a null vector are left out.
        """
        count = max(len(self.centres.own), 1)
        probes = min(count, probes or max(8, round(PROBED * count)))
        step = max(1, SPREAD // probes)
        sent = self.spark.sparkContext.broadcast(self.centres)

        def asking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                for low in range(0, batch.num_rows, step):
                    some = batch.slice(low, step)
                    m = cells.matrix(some.column(1))
                    near = own.nearest(m, probes, len(own.tops))[0] if len(own.own) else np.zeros((len(m), 1), np.int64)
                    at = pa.array(np.repeat(np.arange(len(m)), near.shape[1]))
                    yield pa.record_batch([*(c.take(at) for c in some.columns), pa.array(near.reshape(-1))], ["id", "v", "list"])

        asked = cells.units(queries, key, vector)
        spread = asked.mapInArrow(asking, "id long, v array<double>, list long")
        codes = self.codes()
        sizes = codes.groupBy("list").agg(F.ceil(F.count("*") / CODES).alias("parts"))
        many = spread.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).alias("blocks"))
        both = sizes.join(many, "list")
        each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
        q = spread.join(both, "list").select("id", "v", "list", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), each("parts").alias("part"))
        c = codes.join(both, "list").select("id", "code", "scale", "list", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"), each("blocks").alias("block"))
        take = read * k + exclude_self

        def scan(left: pa.Table, right: pa.Table) -> pa.Table:
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            if left.num_rows and right.num_rows:
                ids, own = left["id"].to_numpy(), right["id"].to_numpy()
                m = cells.matrix(left["v"].combine_chunks()).astype(np.float32)
                code = np.frombuffer(b"".join(right["code"].to_pylist()), np.int8).reshape(len(own), -1).astype(np.float32) * right["scale"].to_numpy()[:, None]
                for low in range(0, len(ids), 256):
                    s = m[low : low + 256] @ code.T
                    n = min(take, s.shape[1])
                    best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                    out.append((np.repeat(ids[low : low + 256], n), own[best].reshape(-1), np.take_along_axis(s, best, 1).reshape(-1).astype(float)))
            columns = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
            return pa.table([pa.array(x) for x in columns], ["query_id", "id", "about"])

        keys = ("list", "part", "block")
        found = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(scan, "query_id long, id long, about double").dropDuplicates(["query_id", "id"])
        found = found.where(F.col("query_id") != F.col("id")) if exclude_self else found
        best = Window.partitionBy("query_id").orderBy(F.col("about").desc(), "id")
        found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= read * k)
        exact = found.join(self.rows(), "id").join(asked.select(F.col("id").alias("query_id"), F.col("v").alias("_q")), "query_id")
        exact = exact.select("query_id", F.col("id").alias("neighbour_id"), V.dot(F.col("_q"), F.col("v")).alias("similarity"))
        order = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), "neighbour_id")
        return exact.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


_CODES, _VECTORS = "list long, id long, code binary, scale float", "id long, v array<double>"
