import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from docketry.llm.packing import pack, plan
from docketry.llm.tokens import encoder, parts, with_token_counts

LIMITS = [("short", 64, 1), ("standard", 256, 1), ("long", 1024, 2)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_each_item_once(seed):
    r = random.Random(seed)
    caps, joins = [100, 40], [r.choice([0, 1, 2]), 1]
    hist = [Counter(r.randint(41 if i == 0 else 0, c) for _ in range(400)) for i, c in enumerate(caps)]
    groups = plan([dict(h) for h in hist], caps, joins)
    placed, seen = Counter(), set()
    for g in groups:
        assert g.load <= caps[g.tier] and g.items == sum(q for *_, q in g.contents)
        assert g.load == sum(s * q for _, s, _, q in g.contents) + (g.items - 1) * joins[g.tier]
        for t, s, first, q in g.contents:
            for k in range(first, first + q * g.count):
                assert (t, s, k) not in seen
                seen.add((t, s, k))
                placed[t, s] += 1
    assert placed == Counter({(i, s): n for i, h in enumerate(hist) for s, n in h.items()})
    for t in (0, 1):
        ids = sorted(x for g in groups if g.tier == t for x in range(g.first, g.first + g.count))
        assert ids == list(range(len(ids)))


@pytest.mark.parametrize("together", [False, True])
def test_pack(spark, scratch, together):
    r = random.Random(3)
    sizes = [(i, r.choice([30, 30, r.randint(0, 300), r.randint(900, 3000)])) for i in range(2000)] + [(5000, None), (5001, 0), (5001, 0)]
    out = pack(spark.createDataFrame(sizes, "id int, n int"), "id", "n", LIMITS, scratch, together, per_step=8).collect()
    caps, joins = {n: c for n, c, _ in LIMITS}, {n: j for n, _, j in LIMITS}
    held, texts = {}, {}
    for x in out:
        held.setdefault((x["pack_name"], x["tier"], x["container_id"]), []).append(x)
        texts.setdefault((x["pack_name"], x["id"]), []).append(x["n_tokens"])
    for (_, tier, _), xs in held.items():
        load = sum(x["n_tokens"] for x in xs) + (len(xs) - 1) * joins[tier]
        assert load + xs[0]["unused"] == caps[tier] and xs[0]["unused"] >= 0 and {x["container_items"] for x in xs} == {len(xs)}
    want = Counter()
    for i, n in sizes:
        want[i] += n or 0
    for (_, i), got in texts.items():
        assert sum(got) == want[i]
    assert len(texts) == len(want) * (1 if together else 3)
    for (p, i), got in texts.items():
        most = 1024 if together else caps[p]
        if want[i] <= most and i != 5001:
            assert len(got) == 1
    # nearly as few containers as the tokens need
    for name in {x["pack_name"] for x in out}:
        own = [xs for (p, _, _), xs in held.items() if p == name]
        assert sum(xs[0]["unused"] for xs in own) < 0.06 * sum(caps[xs[0]["tier"]] for xs in own)


def test_pack_of_nothing(spark, scratch):
    assert pack(spark.createDataFrame([], "id int, n int"), "id", "n", LIMITS, scratch, False).count() == 0


def test_token_counts(spark):
    enc = encoder()
    long = "Not later than 30 days after enactment, é " * 5000
    assert sum(len(x) for x in enc.encode_ordinary_batch(parts(long))) == len(enc.encode_ordinary(long))
    d = spark.createDataFrame([(1, "hello world", 7), (2, "", 7), (3, None, 7), (4, long, 7)], "id int, text string, n_tokens int")
    out = {r["id"]: r["n_tokens"] for r in with_token_counts(d).collect()}
    assert out == {1: 2, 2: 0, 3: 0, 4: len(enc.encode_ordinary(long))}
    assert with_token_counts(d.filter(F.col("id") > 9)).count() == 0
