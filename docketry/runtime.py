"""Session helpers shared by all operators: shared scratch tables, skew-safe joins, distributed ranks."""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: A key is hot when it holds more than this share of the rows, so there are never more than 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 256


def session(app: str = "docketry", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A local session with the settings the operators assume; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where the setting is absent and the master is local, a temporary folder is made once for the session; on a
    cluster its absence is an error, since a machine-local folder would be lost with the machine.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="docketry-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    spark.sparkContext.setCheckpointDir(f"file://{made}")
    return f"file://{made}"


def ship(spark: SparkSession) -> None:
    """Make this package importable in every Python worker, once per Spark context; the driver serves the archive."""
    sc = spark.sparkContext
    if getattr(sc, "_docketry_shipped", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="docketry-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/docketry.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(f"{folder}/docketry.zip")
    sc._docketry_shipped = True


_roots: list[tuple[SparkSession, str]] = []
_registered = False


def sweep() -> None:
    """Delete this process's scratch tables. Called at exit; a job that stops Spark itself calls it before, since folders that are no
    plain files can be reached through Spark only."""
    while _roots:
        spark, root = _roots.pop()
        try:
            _delete(spark, root)
        except Exception:
            if root.startswith(("file:", "/")):
                shutil.rmtree(root.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Scratch:
    """Tables written to the shared folder to cut lineage. A lost executor never takes one with it."""

    def __init__(self, spark: SparkSession, label: str):
        ship(spark)
        global _registered
        if not _registered:
            atexit.register(sweep)
            _registered = True
        self.spark, self.root = spark, f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        _roots.append((spark, self.root))

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return a scan of the copy."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._docketry_path = path
        return out

    def drop(self, df: DataFrame | None) -> None:
        """Delete a table that ``put`` returned and that nothing will read again."""
        path = getattr(df, "_docketry_path", None)
        if path:
            _delete(self.spark, path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> list:
    """Values of ``key`` that hold more than ``share`` of the rows: at most ``1 / share`` of them, whatever the input. One pass;
    null keys are left out but count as rows."""
    seen = Observation()
    counts = df.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n")).observe(seen, F.sum("n").alias("total"))
    top = counts.filter(F.col("k").isNotNull()).orderBy(F.desc("n")).limit(math.ceil(1 / share)).collect()
    total = (seen.get["total"] or 0) if top else 0
    return [r["k"] for r in top if r["n"] > max(1, total * share)]


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "left", hot: list | None = None) -> DataFrame:
    """Join ``left`` with ``right``, whose ``key`` is unique, without sending a hot key's rows to one task.

    The right rows of hot keys (no more than ``1 / HOT_SHARE``) are broadcast; all others meet in a shuffle join.
    Null keys match nothing; a left join keeps their rows.
    """
    hot = hot_keys(left, key) if hot is None else hot
    if not hot:
        return left.join(right, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    near = left.filter(is_hot).join(F.broadcast(right.filter(F.col(key).isin(hot))), key, how)
    far = left.filter(~is_hot).join(right, key, how)
    return far.unionByName(near)


def fan_join(left: DataFrame, right: DataFrame, key: str, hot: list, parts: int = 64) -> DataFrame:
    """Inner join of ``left`` with a ``right`` that may have very many rows of the ``hot`` keys (a bounded list).

    Right rows of a hot key are dealt to ``parts`` salts and the left rows of it repeated for each, so no task gets them
    all; other keys have the one salt 0. Null keys match nothing.
    """
    if not hot:
        return left.join(right, key)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    rest = F.xxhash64(*[c for c in right.columns if c != key]) if len(right.columns) > 1 else F.lit(0).cast("long")
    dealt = right.withColumn("_salt", F.when(is_hot, F.pmod(rest, F.lit(parts))).otherwise(F.lit(0)).cast("int"))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    return left.withColumn("_salt", F.explode(salts)).join(dealt, [key, "_salt"]).drop("_salt")


def spread(df: DataFrame, keys: list[str], order: Column, tie: Column, weight: Column | None = None, rows: int | None = None, rank: str = "rank", total: str = "group_total") -> DataFrame:
    """Add each row's position in its group, and the group's total, without collecting a group into one task.

    ``order`` is a uniformly spread long (a hash). Its leading bits cut every group into buckets; bucket sums give
    offsets, and only a bucket is sorted in a task. With ``weight``, ``rank`` is the exclusive running sum of the
    weights and ``total`` their sum; without, the 0-based row number and the row count. Null weights count as 0.
    Keys must not be null.
    """
    rows = df.count() if rows is None else rows
    bits = max(3, math.ceil(math.log2(max(1, rows) / 50_000 + 1)))
    w = F.lit(1).cast("long") if weight is None else F.coalesce(weight, F.lit(0)).cast("long")
    d = df.withColumn("_h", order).withColumn("_w", w).withColumn("_b", F.shiftright("_h", 64 - bits))
    sums = d.groupBy(*keys, "_b").agg(F.sum("_w").alias("_s"))
    by = Window.partitionBy(*keys)
    offsets = sums.select(
        *keys, "_b",
        (F.sum("_s").over(by.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_s")).alias("_o"),
        F.sum("_s").over(by).alias(total),
    )
    joined = d.join(offsets, [*keys, "_b"])
    inner = Window.partitionBy(*keys, "_b").orderBy("_h", tie).rowsBetween(Window.unboundedPreceding, 0)
    return joined.withColumn(rank, F.col("_o") + F.sum("_w").over(inner) - F.col("_w")).drop("_h", "_w", "_b", "_o")


def empty(spark: SparkSession, schema: str | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)
