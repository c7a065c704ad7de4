"""Append-only logs: last record per key, work that remains, consensus; batch and Structured Streaming forms."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def last_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest record of every key. One aggregation with map-side combine; ``order`` should be unique per key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def first_per_key(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The earliest record of every key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*")


def work_left(items: DataFrame, log: DataFrame, keys: list[str], order: list[str], done: Column) -> DataFrame:
    """Items whose latest record isn't done: failed and null results are tried again, absent ones too."""
    finished = last_per_key(log, keys, order).filter(F.coalesce(done, F.lit(False))).select(*keys)
    return items.join(finished, keys, "left_anti")


def never_ended(log: DataFrame, keys: list[str], ended: Column) -> DataFrame:
    """Keys of which no record has ``ended``: a success or refusal of any attempt is final, nulls and errors are tried again."""
    return log.groupBy(*keys).agg(F.max(F.coalesce(ended, F.lit(False))).alias("_e")).filter("not _e").select(*keys)


def majority(votes: DataFrame, keys: list[str], label: str, usable: list[str]) -> DataFrame:
    """Consensus by unanimity: fewer than two usable votes or any disagreement give ``unclear``. Columns ``n, verdict``."""
    v = F.when(F.col(label).isin(usable), F.col(label))
    g = votes.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    return g.select(*keys, "n", F.when((F.col("n") >= 2) & (F.col("_lo") == F.col("_hi")), F.col("_lo")).otherwise("unclear").alias("verdict"))


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON-lines log whose last line may be torn: unreadable lines are left out, blank ones skipped."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").json(path).filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def stream_log(spark: SparkSession, path: str, schema: T.StructType, files: int = 100) -> DataFrame:
    """The same log as a stream of newly landed files, ``files`` per micro-batch."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.readStream.schema(full).option("maxFilesPerTrigger", files).option("mode", "PERMISSIVE").json(path).filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")


def append_batches(stream: DataFrame, out: str, checkpoint: str, process: Callable[[DataFrame], DataFrame] | None = None):
    """Run all that is there in micro-batches, appending each batch's result once; a batch that is retried after a
    failure overwrites its own folder, so nothing is written twice."""

    def write(batch: DataFrame, number: int) -> None:
        (process(batch) if process else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_latest(stream: DataFrame, key: str, order: str, value: str, value_type: str = "string"):
    """Stateful last-wins: emits ``key, value, seq`` when a key's first non-null value arrives or is superseded by a
    later one; null values (failed attempts) change nothing. State is one record per key."""
    out = f"{key} string, {value} {value_type}, seq long"

    def update(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else (None, -1)
        before = best
        for pdf in batches:
            live = pdf[pdf[value].notna()]
            if len(live):
                i = live[order].idxmax()
                if int(live.loc[i, order]) > best[1]:
                    best = (live.loc[i, value], int(live.loc[i, order]))
        if best != before:
            state.update(best)
            yield pd.DataFrame({key: [k[0]], value: [best[0]], "seq": [best[1]]})

    return stream.groupBy(key).applyInPandasWithState(update, out, f"{value} {value_type}, seq long", "update", "NoTimeout")
