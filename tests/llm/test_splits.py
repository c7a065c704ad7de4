import random

from pyspark.sql import functions as F

from docketry.llm.components import components
from docketry.llm.splits import assign_splits, section_records

TARGETS = {"train": 0.7, "validation": 0.12, "test": 0.18}


def brute(edges):
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components_match_brute_force(spark, scratch):
    r = random.Random(5)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)] + [(None, 1), (7, 7)]
    out = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long"), scratch).collect()}
    assert out == brute(edges)
    assert components(spark.createDataFrame([], "a string, b string"), scratch).count() == 0


def test_shared_keys_share_splits(spark, scratch):
    r = random.Random(1)
    rows = [(i, r.choice([f"s{r.randint(0, 400)}", None, "hot", " "]), r.choice([f"a{r.randint(0, 900)}", None]), r.choice("xyz")) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, source string, author string, kind string")
    out = assign_splits(df, "id", ["source", "author"], TARGETS, scratch, balance=["kind"])
    got = out.records.collect()
    assert len(got) == 3000 and {x["split"] for x in got} == set(TARGETS) and {x["status"] for x in got} == {"assigned"}
    for k in ("source", "author"):
        seen = {}
        for x in got:
            if x[k] and x[k].strip():
                assert seen.setdefault(x[k], x["split"]) == x["split"]
    edges = [(f"0:{x['source']}", f"1:{x['author']}") for x in got if x["source"] and x["source"].strip() and x["author"]]
    comp = brute(edges)
    for x in got:
        if x["source"] and x["source"].strip() and x["author"]:
            assert comp[f"0:{x['source']}"] == x["component"]


def test_sizes_keep_to_shares(spark, scratch):
    df = spark.range(6000).select("id", F.when(F.col("id") < 2000, "hot").when(F.col("id") < 5500, F.concat(F.lit("k"), F.col("id") % 900)).alias("k"), (F.col("id") % 4).alias("stratum"))
    out = assign_splits(df, "id", ["k"], TARGETS, scratch, balance=["stratum"]).records
    n = {r["split"]: r["count"] for r in out.groupBy("split").count().collect()}
    assert all(abs(n[s] / 6000 - t) < 0.02 for s, t in TARGETS.items())


def test_later_batches(spark, scratch):
    a = spark.createDataFrame([(i, f"k{i % 40}", None) for i in range(400)], "id int, k string, l string")
    one = assign_splits(a, "id", ["k", "l"], TARGETS, scratch)
    was = {r["k"]: r["split"] for r in one.records.collect()}
    other = next(k for k, s in was.items() if s != was["k0"])
    same = next(k for k, s in was.items() if s == was["k0"] and k != "k0")
    b = spark.createDataFrame([(1000, "k0", "x"), (1001, other, "x"), (1002, "k1", None), (1003, "new", None), (1004, None, None)], "id int, k string, l string")
    two = assign_splits(b, "id", ["k", "l"], TARGETS, scratch, state=one.state)
    got = {r["id"]: (r["split"], r["status"]) for r in two.records.collect()}
    assert got[1000] == got[1001] == ("quarantine", "quarantined")
    assert got[1002] == (was["k1"], "assigned") and got[1003][0] in TARGETS and got[1004][0] in TARGETS
    state = {r["key"]: r for r in two.state.collect()}
    assert state["0:k0"]["split"] == state[f"0:{other}"]["split"] == "quarantine" and state["0:k1"]["n"] == 11 and "0:new" in state
    c = spark.createDataFrame([(2000, "k0", None), (2001, "k1", "y"), (2002, same, "z")], "id int, k string, l string")
    three = {r["id"]: r["split"] for r in assign_splits(c, "id", ["k", "l"], TARGETS, scratch, state=two.state).records.collect()}
    assert three[2000] == "quarantine" and three[2001] == was["k1"]


def test_merge_of_one_split_is_kept(spark, scratch):
    one = assign_splits(spark.createDataFrame([(i, f"k{i}") for i in range(60)], "id int, k string"), "id", ["k"], TARGETS, scratch)
    by = {}
    for r in one.records.collect():
        by.setdefault(r["split"], []).append(r["k"])
    x, y = by["train"][:2]
    b = spark.createDataFrame([(100, x, None), (101, x, "j"), (102, y, "j")], "id int, k string, l string")
    got = assign_splits(b, "id", ["k", "l"], TARGETS, scratch, state=one.state)
    assert {r["split"] for r in got.records.collect()} == {"train"}
    assert len({r["component"] for r in got.state.filter(F.col("key").isin(f"0:{x}", f"0:{y}")).collect()}) == 1


def test_odd_records(spark, scratch):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (3, "x" * 50_000), (3, "x" * 50_000)], "id int, k string")
    out = assign_splits(df, "id", ["k"], TARGETS, scratch).records.collect()
    assert len(out) == 5 and len({r["split"] for r in out if r["id"] == 3}) == 1
    empty = assign_splits(df.limit(0), "id", ["k"], TARGETS, scratch)
    assert empty.records.count() == 0 and empty.state.count() == 0


def test_sections(spark):
    d = spark.createDataFrame([(1, "/us/usc/t5/s1/a", "x", True), (2, "5 U.S.C. 1 note", "x", True), (3, None, None, None)], "gold_id long, uslm_id string, stratum string, gold_congressional boolean")
    assert [r["section_id"] for r in section_records(d).orderBy("gold_id").collect()] == ["/us/usc/t5/s1", "/us/usc/t5/s1", None]


def test_clashing_columns(spark, scratch):
    df = spark.createDataFrame([(i, f"k{i % 9}", "a", "b", i, "c", "d") for i in range(90)] + [(None, None, None, None, None, None, None)], "id int, key string, split string, component string, n int, _key string, status string")
    out = assign_splits(df, "id", ["key"], TARGETS, scratch, balance=["split"]).records
    assert out.columns == ["id", "key", "n", "_key", "component", "component_n", "split", "status"]
    assert out.count() == 91 and out.filter("id = 3 and _key = 'c' and n = 3").count() == 1
    assert out.filter("key is not null").select("key", "split").distinct().count() == 9


def test_a_replayed_batch_changes_nothing(spark, scratch, tmp_path):
    from docketry.llm.splits import Store

    a = spark.createDataFrame([(i, f"k{i % 50}") for i in range(300)] + [(i, None) for i in range(900, 960)], "id int, k string")
    b = spark.createDataFrame([(i, f"k{i % 70}") for i in range(300, 500)], "id int, k string")
    store = Store(spark, f"file://{tmp_path}/store")
    run = lambda name, df: sorted((r["id"], r["split"]) for r in store.assign(name, df, "id", ["k"], TARGETS, scratch).collect())
    assert store.load() is None
    one, two = run("a", a), run("b", b)
    table = sorted(tuple(r) for r in store.load().collect())
    assert sum(r[2] for r in table) == 560 and sum(r[2] for r in table if r[0].startswith("none:")) == 60
    assert run("a", a) == one and run("b", b) == two and sorted(tuple(r) for r in store.load().collect()) == table and len(store.versions()) == 2
    seen = {}
    for i, split in [x for x in one + two if x[0] < 900]:
        assert seen.setdefault(i % 50 if i < 300 else i % 70, split) == split
    fresh = Store(spark, f"file://{tmp_path}/store")  # another job
    assert sorted(tuple(r) for r in fresh.load().collect()) == table


def test_keyless_records_count_in_later_deficits(spark, scratch):
    a = spark.createDataFrame([(i, None) for i in range(1000)], "id int, k string")
    one = assign_splits(a, "id", ["k"], {"x": 1.0}, scratch)
    b = spark.createDataFrame([(i, f"k{i}") for i in range(5000, 6000)], "id int, k string")
    two = assign_splits(b, "id", ["k"], {"x": 0.5, "y": 0.5}, scratch, state=one.state)
    assert {r["split"] for r in two.records.collect()} == {"y"}
