from pyspark.sql import functions as F

from docketry.runtime import fan_join, hot_keys, shared_dir, skew_join, spread


def test_shared_dir_is_stable(spark):
    assert shared_dir(spark) == shared_dir(spark)


def test_skew_join_keeps_every_row(spark):
    left = spark.range(1000).select(F.when(F.col("id") < 400, "hot").when(F.col("id") < 990, F.concat(F.lit("k"), F.col("id"))).otherwise(F.lit(None)).alias("k"), "id")
    right = left.filter("k is not null").select("k").distinct().withColumn("v", F.length("k"))
    out = skew_join(left, right, "k")
    assert hot_keys(left, "k") == ["hot"]
    assert out.count() == 1000 and out.filter("v is null").count() == 10
    assert skew_join(left, right, "k", "inner").count() == 990


def test_spread_ranks_without_gaps_and_sums_weights(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), "id", (F.col("id") % 7).alias("w"))
    ranks = spread(df, ["g"], F.xxhash64("id"), F.col("id")).collect()
    for g in range(3):
        own = sorted(r["rank"] for r in ranks if r["g"] == g)
        assert own == list(range(len(own))) and {r["group_total"] for r in ranks if r["g"] == g} == {len(own)}
    rows = sorted(spread(df, ["g"], F.xxhash64("id"), F.col("id"), F.col("w"), rank="start").filter("g = 1 and w > 0").collect(), key=lambda r: r["start"])
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["w"]
    assert at == rows[0]["group_total"]


def test_spread_of_nothing(spark):
    assert spread(spark.range(0).withColumn("g", F.lit(1)), ["g"], F.xxhash64("id"), F.col("id")).count() == 0


def test_fan_join_is_a_join(spark):
    left = spark.createDataFrame([("h", 1), ("h", 2), ("c", 3), (None, 4), ("z", 5)], "k string, l int")
    right = spark.range(300).select(F.when(F.col("id") < 290, "h").when(F.col("id") < 295, "c").alias("k"), F.col("id").alias("r"))
    out = fan_join(left, right, "k", ["h"], parts=7)
    assert out.columns == ["k", "l", "r"] and out.count() == 290 * 2 + 5 == out.distinct().count()
    assert fan_join(left, right, "k", []).count() == 585
