"""File sources and sinks with declared schemas."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.sampling import numbered


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """JSON lines. ``strict``: a missing path or a bad line raises; else a missing path is an empty table."""
    if not strict and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_documents(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """One JSON document per file, with ``file_name`` for their order."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("file_name", F.col("_metadata.file_name"))


def read_map(spark: SparkSession, path: str) -> DataFrame:
    """``key, value`` of files that are one JSON object each, values as text; files that are none give no rows."""
    d = spark.read.text(path, wholetext=True)
    return d.select(F.explode(F.from_json("value", "map<string,string>")).alias("key", "value"))


def read_bodies(spark: SparkSession, path: str, glob: str = "*.xml") -> DataFrame:
    """``file_name, title, appendix, body`` of text files such as one XML per title; ``usc05A.xml`` is title 5, appendix."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.decode("content", "UTF-8").alias("body"))
    number = F.regexp_extract(F.lower("file_name"), "([0-9]+)(a?)[^0-9]*$", 1)
    return d.select("file_name", F.regexp_replace(number, "^0+", "").alias("title"), (F.regexp_extract(F.lower("file_name"), "([0-9]+)(a?)[^0-9]*$", 2) == "a").alias("appendix"), "body")


def with_positions(df: DataFrame, order: list[str], prefix: str = "M", width: int = 5, out: str = "mandate_id") -> DataFrame:
    """Positional ids from 0 over the whole table in ``order``, without one task holding it; rows equal in all of ``order`` follow each
    other anyhow."""
    d = numbered(df, F.struct(*order), "_place")
    return d.withColumn(out, F.format_string(f"{prefix}%0{width}d", F.col("_place") - 1)).drop("_place")


def prefer_format(files: DataFrame, key: str, kind: str, order: list[str]) -> DataFrame:
    """One file per key: the kind that comes first in ``order``."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(kind))
    rest = [c for c in files.columns if c != key]
    return files.filter(rank > 0).groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(rank, *[c for c in rest if c != kind])).alias("_r")).select(key, "_r.*")


def missing(listed: DataFrame, landed: DataFrame, key: str, forced: DataFrame | None = None) -> DataFrame:
    """Keys to fetch: listed but not landed, plus forced ones, each once."""
    out = listed.select(key).distinct().join(landed.select(key), key, "left_anti")
    return out if forced is None else out.unionByName(forced.select(key)).distinct()


def build_if_missing(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at ``path``, made by ``build()`` first if it isn't there."""
    if not exists(spark, path):
        build().write.parquet(path)
    return spark.read.parquet(path)


def write(df: DataFrame, path: str, kind: str = "jsonl", columns: list[str] | None = None, order: list[str] | None = None) -> None:
    """Overwrite as ``jsonl``, ``json`` (one array per file), ``csv`` (with header) or ``parquet``, with chosen columns
    and total order if given."""
    d = df.select(*columns) if columns else df
    d = d.orderBy(*order) if order else d
    w = d.write.mode("overwrite")
    if kind == "jsonl":
        w.json(path)
    elif kind == "csv":
        w.option("header", True).option("escape", '"').csv(path)
    elif kind == "parquet":
        w.parquet(path)
    elif kind == "json":
        d.select(F.to_json(F.struct(*d.columns)).alias("value")).mapInArrow(_bracketed, "value string").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {kind}")


def _bracketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a task as one JSON array, a row per line; a task without rows gives none."""
    mark = "["
    for b in batches:
        lines = [(mark if i == 0 else ",") + v for i, v in enumerate(b.column(0).to_pylist())]
        if lines:
            mark = ","
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
    if mark == ",":
        yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])


def write_pair(df: DataFrame, path: str, columns: list[str], order: list[str]) -> None:
    """The same chosen columns in the same order as JSON lines and as CSV with header, under ``path``."""
    for kind in ("jsonl", "csv"):
        write(df, f"{path}/{kind}", kind, columns, order)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small result as a Markdown table; more than ``most`` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)])
