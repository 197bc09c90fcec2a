"""File sources: JSON lines, CSV with spelled nulls, mixed query files, package folders.

Missing keys and nulls are the same; a malformed JSON line is an error unless the caller
asks for it to be kept aside. Nothing is inferred: schemas are given."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.functions import text as tx


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, bad_lines: str = "fail") -> DataFrame:
    """One row per non-blank line. ``bad_lines``: ``fail``, ``drop``, or ``keep`` (the line
    is then in ``_corrupt``, with nulls beside it)."""
    reader = spark.read.schema(schema)
    if bad_lines == "keep":
        full = T.StructType([*(T._parse_datatype_string(schema) if isinstance(schema, str) else schema).fields, T.StructField("_corrupt", T.StringType())])
        reader = spark.read.schema(full).option("columnNameOfCorruptRecord", "_corrupt")
    mode = {"fail": "FAILFAST", "drop": "DROPMALFORMED", "keep": "PERMISSIVE"}[bad_lines]
    return reader.option("mode", mode).json(path)


def read_jsonl_ordered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``read_jsonl``, with ``_ord``, the number of the line in its file (from 0), and
    ``_file``. Each file is read by one task, so files should be split by package."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("_file"), F.posexplode(F.split("value", "\n")).alias("_ord", "line"))
    return lines.where(F.trim("line") != "").select("_file", "_ord", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("_file", "_ord", "r.*")


def read_csv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """CSV with a header, all strings, spelled nulls as null, byte order mark ignored. A
    missing file is an empty table of the given columns."""
    if not _exists(spark, path):
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns or ["value"]))
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    df = df.select(*[tx.none_if_null(F.col(f"`{c}`")).alias(c) for c in df.columns])
    if columns is None:
        return df
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``query``: lines that begin with a brace are JSON with query or question, others the query itself."""
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "^﻿", "")).alias("line")).where("line <> ''")
    parsed = F.from_json("line", "query string, question string")
    return lines.select(F.when(F.startswith("line", F.lit("{")), F.coalesce(parsed["query"], parsed["question"])).otherwise(F.col("line")).alias("query")).where("query is not null")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that fit a pattern, sorted, on whatever file system it names."""
    files, where = _file_system(spark, pattern)
    return sorted(f.getPath().toString() for f in files.globStatus(where) or [])


def package_paths(spark: SparkSession, root: str, marker: str) -> list[str]:
    """The root itself if it holds the marker file, else its sub-folders that do, sorted."""
    if list_files(spark, f"{root}/{marker}"):
        return [root]
    return [p[: -len(marker) - 1] for p in list_files(spark, f"{root}/*/{marker}")]


def first_found(spark: SparkSession, patterns: list[str]) -> list[str]:
    """The files of the first pattern that has any: a file, a folder's own, its packages'."""
    return next((found for pattern in patterns if (found := list_files(spark, pattern))), [])


def units_files(spark: SparkSession, path: str) -> list[str]:
    """Unit files by precedence: the path itself if a file, main/units.jsonl in it, in its
    packages, then older layouts."""
    if path.endswith(".jsonl"):
        return list_files(spark, path)
    return first_found(spark, [f"{path}/main/units.jsonl", f"{path}/*/main/units.jsonl", f"{path}/*/units.jsonl", f"{path}/units.jsonl"])


def one_per_package(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Per package the file of the first name it has; a file of one of the names in the root wins."""
    own = first_found(spark, [f"{root}/{name}" for name in names])
    if own:
        return own[:1]
    best: dict[str, str] = {}
    for name in names:
        for path in list_files(spark, f"{root}/*/{name}"):
            best.setdefault(path.rsplit("/", 1)[0], path)
    return [best[k] for k in sorted(best)]


def read_json(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Whole JSON documents: an array gives a row per element. A missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_packages(spark: SparkSession, root: str, marker: str, schema: str) -> DataFrame:
    """All packages' rows with ``package_id``, the folder's name."""
    paths = [f"{p}/{marker}" for p in package_paths(spark, root, marker)]
    if not paths:
        return spark.createDataFrame([], schema).withColumn("package_id", F.lit(None).cast("string"))
    return spark.read.schema(schema).json(paths).withColumn("package_id", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def keyed_sentences(rows: DataFrame, order: str) -> DataFrame:
    """``row_key`` and the last row of each: by sentence id, else source unit, else passage."""
    key = F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in ("sentence_id", "source_unit_id", "passage_id")])
    keyed = rows.withColumn("row_key", key).where("row_key is not null")
    return keyed.groupBy("row_key").agg(F.max_by(F.struct(*rows.columns), order).alias("_r")).select("row_key", "_r.*")


def _exists(spark: SparkSession, path: str) -> bool:
    return bool(list_files(spark, path))


def union_with_defaults(frames: list[DataFrame], defaults: dict[str, str]) -> DataFrame:
    """Rows of several tables by name, absent columns null, then the defaults where null."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    for column, value in defaults.items():
        out = out.withColumn(column, F.coalesce(F.col(column), F.lit(value)) if column in out.columns else F.lit(value))
    return out
