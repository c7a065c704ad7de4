import random

import pytest
from pyspark.sql import functions as F

from docketry.llm.mixing import mix_sources

TARGETS = [("m", "big", 3.0, 1), ("m", "mid", 2.0, 2), ("m", "tiny", 1.0, 4), ("m", "absent", 1.0, 9), ("n", "mid", 0.5, 1), ("n", "tiny", 0.5, 3)]


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(8)
    rows = [(i, "big", r.randint(10, 400)) for i in range(3000)] + [(i, "mid", r.randint(10, 400)) for i in range(3000, 3600)] + [(i, "tiny", r.randint(1, 50)) for i in range(4000, 4200)]
    return spark.createDataFrame([*rows, (9000, None, 5), (9001, "unnamed", 5), (9002, "mid", 0), (9003, "mid", None)], "id int, src string, n int")


def test_shares_and_caps(spark, scratch, texts):
    out = mix_sources(texts, "id", "src", "n", TARGETS, scratch, block=512)
    s = {(r["mix_name"], r["source_name"]): r for r in out.shares.collect()}
    assert s["m", "absent"]["tokens"] == 0 and abs(s["m", "big"]["actual_share"] - 0.5) < 0.01 and abs(s["m", "mid"]["actual_share"] - 1 / 3) < 0.02 and abs(s["n", "tiny"]["actual_share"] - 0.5) < 0.03
    assert all(r["most_used"] <= r["max_repeats"] for r in s.values())
    use = {(r["mix_name"], r["id"]): r["times_used"] for r in out.usage.collect()}
    assert not any(i in (9000, 9001) for _, i in use) and use["m", 9002] == use["m", 9003] == 0
    for mix in "mn":  # within a source no text is used twice more than another
        for src, ids in (("mid", range(3000, 3600)), ("tiny", range(4000, 4200))):
            n = [use[mix, i] for i in ids]
            assert max(n) - min(n) <= 1
    plan = {}
    for r in out.schedule.collect():
        plan[r["mix_name"], r["id"]] = plan.get((r["mix_name"], r["id"]), 0) + 1
    assert plan == {k: v for k, v in use.items() if v}


def test_prefixes_keep_the_shares(spark, scratch, texts):
    sched = mix_sources(texts, "id", "src", "n", TARGETS, scratch, block=256).schedule.filter("mix_name = 'm'")
    half = sched.agg(F.max("slot")).first()[0] / 2
    t = {r["source"]: r["t"] for r in sched.filter(F.col("slot") < half).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    assert abs(t["big"] / sum(t.values()) - 0.5) < 0.05


def test_given_total_is_capped(spark, scratch, texts):
    s = {(r["mix_name"], r["source_name"]): r for r in mix_sources(texts, "id", "src", "n", TARGETS, scratch, total={"n": 10**9}).shares.collect()}
    assert s["n", "mid"]["most_used"] == 1 and s["n", "tiny"]["most_used"] == 3


def test_nothing_to_mix(spark, scratch, texts):
    out = mix_sources(texts.limit(0), "id", "src", "n", TARGETS, scratch)
    assert out.usage.count() == 0 and out.schedule.count() == 0 and {r["tokens"] for r in out.shares.collect()} == {0}


@pytest.mark.parametrize(("targets", "total"), [([("m", "big", 0.7, 1), ("m", "mid", 0.299, 9), ("m", "tiny", 0.001, 4)], None), ([("m", "big", 1.0, 2), ("m", "mid", 0.5, 9), ("m", "tiny", 3.0, 1)], {"m": 10**6}), ([("m", "big", 1.0, 1), ("m", "tiny", 1e-12, 1)], {"m": 10**15})])
def test_every_block_is_placed_once(spark, scratch, texts, targets, total):
    out = mix_sources(texts, "id", "src", "n", targets, scratch, total=total, block=512)
    rows, plan, tokens = out.schedule.collect(), {}, {}
    for r in rows:
        plan[r["id"]] = plan.get(r["id"], 0) + 1
        tokens[r["source"]] = tokens.get(r["source"], 0) + r["n_tokens"]
    assert plan == {r["id"]: r["times_used"] for r in out.usage.collect() if r["times_used"]}
    shares = {r["source_name"]: r for r in out.shares.collect()}
    assert all(r["quota"] <= tokens.get(s, 0) < r["quota"] + 400 for s, r in shares.items())
    assert len({(r["source"], r["block_no"]) for r in rows}) == len({(r["slot"], r["source"], r["block_no"]) for r in rows}) == len({r["slot"] for r in rows})
