import pytest

from docketry.llm import canonical as K

LIST = [(1, "Department of the Harbor & Canal", ("DHC",)), (2, "Park Commission", (None,)), (3, "Bureau of Forest Survey", ("BFS",)), (4, "United States Coal Agency", ("USCA",)), (5, "Weather Administration", (None,)), (6, "Rescue Weather Administration", ("RWA",)), (7, "Bureau of Fish Soil", ("BFS",))]


@pytest.fixture(scope="module")
def canon():
    return K.Canon(LIST, 0.72)


@pytest.mark.parametrize(
    ("value", "entry"),
    [
        ("DEPARTMENT OF THE HARBOR AND CANAL", 1), ("Dept. of the Harbor & Canal", 1), ("Harbor and Canal Department", 1), ("Harbor & Canal, Department of the", 1), ("D.H.C.", 1), ("d h c", 1), ("DHC - Department of the Harbor & Canal", 1),
        ("Deprtment of the Harbbor & Canal", 1), ("Department of the Harbor & Canal – Office of the Inspector General", 1), ("Department 0f the Harb0r & Canal", 1), ("Park Comm. 1/", 2), ('"Park Commission"', 2), ("The Park Commission *", 2),
        ("PC", 2), ("Bureau_of_Forest_Survey", 3), ("U.S. Coal Agency", 4), ("US Coal Agy", 4), ("Weather Administration", 5), ("Rescue Weather Administration / Region IV", 6), ("Weather Administration, Rescue", 6),
        ("Saddle Park Commission", None), ("Park Violin Commission", None), ("Harbor Commission", None), ("BFS", None), ("N/A", None), ("Not specified", None), ("x" * 5000, None), ("???", None),
        ("Secretary of the Department of the Harbor & Canal", 1), ("Inspector General, Park Commission", 2), ("Chief Counsel within Park Commission", 2), ("Secretary of the Dept of the Harbr & Canal", 1), ("Park Commission Mirror", None), ("Commission", None),
    ],
)
def test_values(canon, value, entry):
    assert canon.find(value)[0] == entry


def test_table(spark):
    entries = spark.createDataFrame([(i, n, a[0]) for i, n, a in LIST], "id long, name string, short string")
    d = spark.createDataFrame([("a", "park commission", "z"), ("b", None, "z"), ("c", " ", "z"), ("d", "violin", "z")] + [(f"h{i}", "Park Comm.", "z") for i in range(40)], "k string, v string, how string")
    out = {r["k"]: (r["id"], r["how"]) for r in K.map_values(d, "v", entries, "id", "name", ["short"], out="id").collect()}
    assert len(out) == 44 and out["a"] == (2, "exact") and out["b"] == out["c"] == out["d"] == (None, "none") and out["h7"] == (2, "similar")
    assert K.map_values(d.limit(0), "v", entries, "id", "name", ["short"]).count() == 0
    assert K.map_values(d, "v", entries.limit(0), "id", "name", ["short"]).filter("entry_id is not null").count() == 0


def test_value_column_named_like_the_answer(spark):
    entries = spark.createDataFrame([(i, n) for i, n, _ in LIST], "id long, name string")
    out = K.map_values(spark.createDataFrame([("park commission",), ("x",)], "how string"), "how", entries, "id", "name", [], out="id")
    assert sorted((r["id"] or 0, r["how"]) for r in out.collect()) == [(0, "none"), (2, "exact")]


def test_bound_is_checked(spark, monkeypatch):
    monkeypatch.setattr(K, "MOST_ENTRIES", 3)
    with pytest.raises(ValueError):
        K.map_values(spark.createDataFrame([("x",)], "v string"), "v", spark.createDataFrame([(i, n, None) for i, n, _ in LIST], "id long, name string, a string"), "id", "name", ["a"])


def test_distance():
    assert K.Canon.distance("abcd", "abdc", 3) == 1 and K.Canon.distance("abc", "abc", 2) == 0 and K.Canon.distance("kitten", "sitting", 3) == 3 and K.Canon.distance("a", "abcdef", 2) == 3


def test_long_names_may_be_misspelt():
    words = ["amber", "birch", "cedar", "delta", "ember", "flint", "grove", "heron", "inlet", "joint", "kettle", "lumber", "marsh", "north", "otter", "prairie", "quarry", "ridge", "summit", "timber", "upland", "valley", "willow", "yonder", "zephyr", "meadow", "canyon", "orchard"]
    canon = K.Canon([*LIST, (9, " ".join(words), (None,))], 0.72)
    assert canon.find(" ".join(w.replace("prairie", "prarie").replace("orchard", "orchrad") for w in words)) == (9, "similar")
    assert canon.find(" ".join(words[:14] + ["violin"] * 14))[0] is None and canon.find("violin " * 20_000)[0] is None


def test_recall_of_noisy_names():
    """Names with a letter dropped, doubled or swapped, a word cut short, a unit behind: held out from nothing, made by chance."""
    import random

    r = random.Random(8)
    first, second = "harbor canal forest copper weather museum ferry volcano prairie dental".split(), "survey credit lending patent textile archive poultry nursing theater pension".split()
    names = [f"{a} {b} {c}".title() for a in first for b in r.sample(second, 4) for c in [r.choice(["commission", "administration", "council", "services board"])]]
    canon = K.Canon([(i, n, (None,)) for i, n in enumerate(names)], 0.72)
    right = asked = 0
    for i, n in enumerate(names):
        for _ in range(10):
            words = n.split()
            k = r.randrange(len(words))
            w, at = words[k], r.randrange(1, len(words[k]) - 1)
            words[k] = r.choice([w[:at] + w[at + 1 :], w[:at] + w[at] + w[at:], w[: at - 1] + w[at] + w[at - 1] + w[at + 1 :], w[: max(3, at)] + "."])
            asked += 1
            right += canon.find(" ".join(words) + r.choice(["", " - Budget Division", " (Region IV)"]))[0] == i
    assert right / asked > 0.95
