"""Samples, splits and numbered orders by hash or key: deterministic, monotone in size, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import spread


def hash_key(key: Column, seed: int) -> Column:
    """MD5 of key and seed: the same order in every engine."""
    return F.md5(F.concat_ws("\u001f", key.cast("string"), F.lit(str(seed))))


def _leading(h: Column) -> Column:
    """The first 64 bits of an MD5 in hex, as a long that sorts like it."""
    high, low = (F.conv(F.substring(h, i, 8), 16, 10).cast("long") for i in (1, 9))
    return F.shiftleft(high - F.lit(1 << 31), 32).bitwiseOR(low)


def simple_sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows; a larger ``n`` gives a superset. Top-n by hash, which keeps only ``n`` rows per task."""
    return df.orderBy(hash_key(F.col(key), seed), key).limit(n)


def first_of(df: DataFrame, bucket: list[str], order: Column, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every bucket by ``order`` (unique), numbered. Every task keeps ``n`` of each bucket before the shuffle: the
    ranks within salts cut a bucket that holds a third of all rows down to ``n`` rows per salt."""
    salt = F.pmod(F.xxhash64(order), F.lit(64))
    w = Window.partitionBy(*bucket, "_s").orderBy("_o")
    d = df.withColumn("_o", order).withColumn("_s", salt).withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n)
    whole = Window.partitionBy(*bucket).orderBy("_o")
    return d.withColumn(rank, F.row_number().over(whole)).filter(F.col(rank) <= n).drop("_o", "_s", "_rn")


def per_bucket(df: DataFrame, bucket: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of every bucket in hash order."""
    return first_of(df, bucket, F.struct(hash_key(F.col(key), seed).alias("h"), F.col(key).alias("k")), n, "_rank").drop("_rank")


def equal_allocation(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows allotted equally: every stratum gets the whole part of ``n`` over the number of strata, or all it has."""
    k = df.select(*strata).distinct().count()
    return per_bucket(df, strata, key, n // k, seed) if k else df


def paired(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``group, first_id, second_id``: two rows each of ``n`` groups that have two or more; groups by the least hash of their rows."""
    d = df.select(group, key).withColumn("_h", hash_key(F.col(key), seed))
    two = first_of(d, [group], F.struct("_h", key), 2, "_r").groupBy(group).agg(F.min("_h").alias("_h"), F.max(F.when(F.col("_r") == 1, F.col(key))).alias("first_id"), F.max(F.when(F.col("_r") == 2, F.col(key))).alias("second_id"))
    return two.filter("second_id is not null").orderBy("_h", group).limit(n).drop("_h")


def excluding(df: DataFrame, other: DataFrame, key: str, n: int, seed: int = 0, by: str | None = None) -> DataFrame:
    """Uniform sample of rows whose ``key`` isn't in ``other``; ``by`` orders rows whose key repeats."""
    return simple_sample(df.join(other.select(key).distinct(), key, "left_anti"), by or key, n, seed)


def most_common(df: DataFrame, value: str, n: int) -> DataFrame:
    """The ``n`` most frequent values with count and place; ties by value. Counts are made before anything is sorted."""
    top = df.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), value).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), value)))  # n rows


def numbered(df: DataFrame, key: Column, out: str = "place") -> DataFrame:
    """Add the row's place (from 1) in the whole table's order by ``key`` (unique). Range partitions are sorted apart and offset by the
    rows before them, so no task holds more than its range."""
    d = df.withColumn("_k", key).repartitionByRange("_k").sortWithinPartitions("_k").withColumn("_p", F.spark_partition_id())

    def count(batches):
        import pyarrow as pa

        at: dict[int, int] = {}
        for b in batches:
            p = b.column(b.schema.get_field_index("_p")).to_pylist()
            first = [at.get(x, 0) for x in p[:1]]
            start = first[0] if first else 0
            place = pa.array(range(start + 1, start + len(p) + 1), pa.int64())
            if p:
                at[p[0]] = start + len(p)
            yield pa.RecordBatch.from_arrays([*b.columns, place], [*b.schema.names, "_i"])

    from ..runtime import Scratch

    schema = T.StructType([*d.drop("_k").schema.fields, T.StructField("_i", T.LongType())])
    inside = Scratch(df.sparkSession, "numbered").put(d.drop("_k").mapInArrow(count, schema), "rows")
    sizes = inside.groupBy("_p").agg(F.count("*").alias("_n"))
    before = sizes.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_b"))  # as many rows as partitions
    return inside.join(F.broadcast(before), "_p").withColumn(out, F.col("_b") + F.col("_i")).drop("_p", "_i", "_b")


def running(df: DataFrame, keys: list[str], order: str, value: str, place: str = "place", most: str = "most", per: int = 50_000) -> DataFrame:
    """Add each row's ``place`` (from 1) in its group by ``order`` (a unique long) and the greatest ``value`` up to it.

    ``order`` is cut into stretches with some ``per`` rows of the table each; counts and greatest values of earlier stretches
    are carried over, so a group that holds any part of the rows is sorted stretch by stretch. Keys must not be null; null values don't count.
    """
    n, low, high = df.agg(F.count("*"), F.min(order), F.max(order)).first()
    width = max(1, ((high or 0) - (low or 0)) // max(1, -(-n // per)) + 1)
    d = df.withColumn("_b", F.floor((F.col(order) - F.lit(low or 0)) / F.lit(width)).cast("long"))
    ends = d.groupBy(*keys, "_b").agg(F.count("*").alias("_n"), F.max(value).alias("_m"))
    past = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(*keys, "_b", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_n"), F.max("_m").over(past).alias("_m"))
    inside = Window.partitionBy(*keys, "_b").orderBy(order)
    d = d.join(before, [*keys, "_b"])
    upto = F.max(value).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn(place, F.col("_n") + F.row_number().over(inside)).withColumn(most, F.greatest(upto, F.col("_m"))).drop("_b", "_n", "_m")


def stratified_split(df: DataFrame, strata: list[str], key: str, shares: list[tuple[str, float]], seed: int = 0) -> DataFrame:
    """Add ``split``: in every stratum the shares of rows, rounded, in hash order; the last split takes the rest. Places in a
    stratum come from hash buckets with offsets, so a stratum may hold any part of the rows. Null strata are one."""
    safe = [f"_s{i}" for i in range(len(strata))]
    d = df.withColumns({s: F.coalesce(F.to_json(F.struct(c)), F.lit("")) for s, c in zip(safe, strata)})
    h = hash_key(F.col(key), seed)
    d = spread(d, safe, _leading(h), F.struct(h.alias("h"), F.col(key).alias("k")), rank="_rn", total="_n")
    split, upto = None, 0.0
    for name, share in shares[:-1]:
        upto += share
        hit = F.col("_rn") < F.round(F.col("_n") * F.lit(upto))
        split = F.when(hit, name) if split is None else split.when(hit, name)
    last = F.lit(shares[-1][0])
    return d.withColumn("split", last if split is None else split.otherwise(last)).drop("_rn", "_n", *safe)


def hold_out(df: DataFrame, key: str, percent: int, seed: int = 0) -> DataFrame:
    """Add ``held_out``: a row's hash bucket decides, so it never changes when rows are added."""
    bucket = F.conv(F.substring(hash_key(F.col(key), seed), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("held_out", bucket < percent)
