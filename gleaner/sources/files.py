"""Listings, manifests, logs and layouts as DataFrames. All paths are read and written by Spark, on any store that it knows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gleaner.functions import paths
from gleaner.sources import arrays, tables

CORRUPT = "_corrupt"


#: Opens an address in a task: the file system, and the path on it.
Opener = Callable[[str], tuple[fs.FileSystem, str]]
#: Entries that a task returns at a time, and folders that a task lists in a round, about.
ENTRIES, FOLDERS = 10_000, 64
_ENTRY = "path string, folder boolean, length long, modified timestamp"


def list_files(spark: SparkSession, root: str, suffixes: list[str], recursive: bool = True, opener: Opener | None = None) -> DataFrame:
    """path, name, stem, suffix, length and modified of files by suffix, in any case. Contents are not read.

    Folders are listed in rounds, one for each level, by tasks that write what they find; the driver holds no names. One
    folder is one task's, which holds its entries. Tasks open `file:` addresses themselves, others with `opener`. Where there
    is none, or for a pattern of names, Spark lists on the driver, and leaves out files of no bytes.
    Names that Spark's readers pass over (with a leading dot or underscore) are passed over.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    address = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    local = opener is None and address.startswith("file:")
    if any(c in root for c in "*?[{") or not (local or opener):
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
        rows = reader.load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    else:
        rows = _listed(spark, address, recursive, opener or _local)
    c = F.col("path")
    return rows.select("path", paths.name(c).alias("name"), paths.stem(c).alias("stem"), paths.suffix(c).alias("suffix"), "length", "modified").where(F.col("suffix").isin([s.lower() for s in suffixes]))


def _local(address: str) -> tuple[fs.FileSystem, str]:
    return fs.LocalFileSystem(), "/" + address.removeprefix("file:").lstrip("/")


def _listed(spark: SparkSession, root: str, recursive: bool, opener: Opener) -> DataFrame:
    """path, length and modified of the files below a folder, as tables written round by round."""
    if not tables.exists(spark, root):
        raise FileNotFoundError(root)
    folders, rounds = spark.createDataFrame([(root,)], "path string"), []
    count = 1
    while count:
        parts = min(-(-count // FOLDERS), 4 * spark.sparkContext.defaultParallelism) if count > FOLDERS else count
        rounds.append(tables.staged(folders.repartition(parts).mapInArrow(_entries(opener), _ENTRY), "listing"))
        folders = rounds[-1].where("folder").select("path")
        count = folders.count() if recursive else 0
    return reduce(DataFrame.unionByName, rounds).where("NOT folder").select("path", "length", "modified")


def _entries(opener: Opener) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What is in each folder; a file has itself."""

    def batch_of(found: list[tuple[str, bool, int | None, int]]) -> pa.RecordBatch:
        path, folder, length, modified = zip(*found, strict=True)
        at = pa.array(modified, pa.int64()).cast(pa.timestamp("us", "UTC"))
        return pa.record_batch([pa.array(path), pa.array(folder), pa.array(length, pa.int64()), at], ["path", "folder", "length", "modified"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for batch in batches:
            for address in batch.column(0).to_pylist():
                store, path = opener(address)
                whole = store.get_file_info(path).is_file
                for e in [store.get_file_info(path)] if whole else store.get_file_info(fs.FileSelector(path)):
                    name = e.base_name
                    if not whole and (name.startswith(".") or name.startswith("_") and "=" not in name):
                        continue
                    own = address if whole else f"{address.rstrip('/')}/{name}"
                    held.append((own, not e.is_file, e.size if e.is_file else None, (e.mtime_ns or 0) // 1_000_000 * 1_000))
                    if len(held) == ENTRIES:
                        yield batch_of(held)
                        held = []
        if held:
            yield batch_of(held)

    return run


#: Bytes of a file up to which one task reads it whole.
WHOLE_BYTES = 64 << 20


def read_manifest(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Records of files that hold one JSON array each. Small files are read whole; if there is a larger one, all go by byte ranges."""
    sizes = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    if (sizes.agg(F.max("length").alias("n")).first()["n"] or 0) > WHOLE_BYTES:
        return arrays.read_arrays(spark, path, schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_manifest(df: DataFrame, path: str, files: int | None = None) -> None:
    """Writes files of one JSON array each, one per partition, as text; a record is held at a time."""

    def framed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead = "["
        for batch in batches:
            lines = batch.column(0).to_pylist()
            if lines:
                yield pa.record_batch([pa.array([(lead if i == 0 else ",") + x for i, x in enumerate(lines)])], ["value"])
                lead = ","
        yield pa.record_batch([pa.array(["[]" if lead == "[" else "]"])], ["value"])

    rows = (df if files is None else df.repartition(files)).select(F.to_json(F.struct(*df.columns)).alias("value"))
    rows.mapInArrow(framed, "value string").write.mode("overwrite").text(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, skip_errors: bool = True) -> DataFrame:
    """Rows of line-delimited JSON, plain or gzipped. Malformed and blank lines are dropped, or fail the job."""
    if not skip_errors:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    fields = T._parse_datatype_string(schema)
    parsed = F.from_json("value", T.StructType([*fields.fields, T.StructField(CORRUPT, T.StringType())]), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(parsed.alias("r")).where(F.col(f"r.{CORRUPT}").isNull()).select("r.*").drop(CORRUPT)


def write_jsonl(df: DataFrame, path: str, compress: bool = False) -> int:
    """Appends rows as lines; returns how many, counted while they are written."""
    from pyspark.sql import Observation

    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append")
    (out.option("compression", "gzip") if compress else out).json(path)
    return int(seen.get["n"])


def jsonl_to_manifest(spark: SparkSession, source: str, target: str, schema: str) -> None:
    write_manifest(read_jsonl(spark, source, schema), target)


def write_metrics_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """A header and the named columns in that order."""
    df.select(*fields).write.mode("overwrite").option("header", True).csv(path)


def normalize_manifest(df: DataFrame, root: str) -> DataFrame:
    """Records with image, conditioning_image and text, from rows or from rows of `samples`.

    `mask` and `prompt` stand in for missing columns; relative paths go below the root; records without all three go.
    """
    if "samples" in df.columns:
        df = df.select(F.explode("samples").alias("s")).select("s.*")

    def first(*names: str) -> Column:
        there = [F.col(n) for n in names if n in df.columns]
        return F.coalesce(*there) if there else F.lit(None).cast("string")

    def absolute(c: Column) -> Column:
        return F.when(c.startswith("/") | c.contains("://"), c).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), c))

    out = df.withColumns({"image": absolute(first("image")), "conditioning_image": absolute(first("conditioning_image", "mask")), "text": first("text", "prompt")})
    return out.dropna(subset=["image", "conditioning_image", "text"])


def detect_and_convert(df: DataFrame, converters: dict[tuple[str, ...], object]) -> DataFrame:
    """Applies the first converter whose columns are all there; the schema alone decides."""
    for needed, convert in converters.items():
        if set(needed) <= set(df.columns):
            return convert(df)
    raise ValueError(f"no converter for columns {df.columns}")


def write_by_outcome(df: DataFrame, path: str, columns: list[str]) -> None:
    df.write.mode("overwrite").partitionBy(*columns).parquet(path)


def read_categories(spark: SparkSession, path: str, categories: list[str], column: str = "category") -> DataFrame:
    """Rows of the named categories; other folders are not opened, and absent ones give no rows."""
    return spark.read.parquet(path).where(F.col(column).isin(categories))


def read_runs(spark: SparkSession, base: str, schema: str, latest: bool = False) -> DataFrame:
    """Rows of all `run_*` folders with their `run`, or of the last by name."""
    rows = spark.read.schema(schema).parquet(f"{base}/run_*").withColumn("run", F.regexp_extract(F.col("_metadata.file_path"), r"(run_[^/]+)", 1))
    if not latest:
        return rows
    last = list_runs(spark, base).agg(F.max("run").alias("run")).first()["run"]
    return rows.where(F.col("run") == last)


def list_runs(spark: SparkSession, base: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{base}/run_*").select("path", "length")
    return files.select(F.regexp_extract("path", r"(run_[^/]+)", 1).alias("run"), "length").groupBy("run").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))


def audit_layout(spark: SparkSession, root: str, column: str, expected: list[str]) -> DataFrame:
    """Per expected value of a partition column: rows, and whether its folder is missing; unexpected ones are listed as well."""
    found = spark.read.parquet(root).groupBy(column).agg(F.count("*").alias("n"))
    wanted = spark.createDataFrame([(e,) for e in expected], f"{column} string")
    both = wanted.withColumn("expected", F.lit(True)).join(found, column, "full")
    return both.select(column, F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNull().alias("missing"), F.coalesce("expected", F.lit(False)).alias("expected"))


def update_manifest(df: DataFrame, new_paths: DataFrame, column: str) -> DataFrame:
    """`df` with the new path of each stem in `column` where there is one; `updated` tells which. Rows stay as many as they were."""
    known = new_paths.groupBy("stem").agg(F.max("path").alias("_p"))
    out = df.withColumn("_s", paths.stem(F.col(column))).join(known.withColumnRenamed("stem", "_s"), "_s", "left")
    return out.withColumn("updated", F.col("_p").isNotNull()).withColumn(column, F.coalesce("_p", column)).drop("_s", "_p")


def error_manifest(df: DataFrame, path: str, status: str = "status") -> DataFrame:
    """Writes the rows whose status is `error` as JSON lines of their own, and returns what was written."""
    rows = df.where(F.col(status) == "error")
    rows.write.mode("overwrite").json(path)
    return df.sparkSession.read.schema(rows.schema).json(path)
