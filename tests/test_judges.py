import pytest
from pyspark.sql import functions as F

from docketry.operators import glyphs as G
from docketry.operators import judges as J


def test_judge_fails_to_null(spark):
    def moody(prompt):
        if "bad" in prompt:
            raise RuntimeError("down")
        return {"verdict": "same"} if "good" in prompt else None

    d = spark.createDataFrame([(1, "good", "x"), (2, "bad", "x"), (3, "odd", "x"), (4, None, "x")], "i int, p string, verdict string")
    out = {r["i"]: (r["verdict"], r["error"]) for r in J.judge(d, "p", moody).collect()}
    assert out == {1: ("same", None), 2: (None, "RuntimeError: down"), 3: (None, "no verdict"), 4: (None, "no prompt")}
    assert J.judge(d.limit(0), "p", "stub").count() == 0


def test_prompt_and_guard(spark):
    d = spark.createDataFrame([("abc", None), ("", "z")], "a string, b string").select(J.prompt(("A", F.col("a")), ("B", F.col("b")), most=2).alias("p"))
    assert [r["p"] for r in d.collect()] == ["A: ab", "B: z"]
    v = spark.createDataFrame([("same",)] * 97 + [(None,)] * 3, "v string")
    with pytest.raises(ValueError):
        J.guard_unparsed(v, "v")
    assert J.guard_unparsed(v, "v", 0.05).count() == 100 and J.guard_unparsed(v.limit(0), "v").count() == 0


def test_embed_halves_refused_batches(spark):
    def model(texts):
        if len(texts) > 2 or "no" in texts:
            raise ValueError
        return [[float(len(t))] for t in texts]

    d = spark.createDataFrame([(1, "a"), (2, "bb"), (3, "no"), (4, None), (5, "x" * 600)], "i int, t string")
    assert {r["i"]: r["vector"] for r in J.embed(d, "i", "t", model).collect()} == {1: [1.0], 2: [2.0], 3: None, 4: None, 5: [512.0]}


def test_law_resolution(spark):
    d = spark.createDataFrame([(99, "1", True, True), (110, "1", None, True), (110, None, True, True), (110, "1", True, True), (110, "1", True, False)], "c int, s string, p boolean, f boolean")
    assert [r[0] for r in d.select(J.law_resolution(F.col("c"), F.col("s"), 104, F.col("p"), F.col("f"))).collect()] == ["out_of_collection", "package_missing", "section_unspecified", "section", "section_not_found"]


def test_pages(spark):
    rows = [(1, c, float(i), 5.0, False) for i, c in enumerate("REPORTS TO BE MADE")] + [(2, c, float(i), 5.0, True) for i, c in enumerate("Reports to be made x")] + [(3, c, float(i), 5.0, True) for i, c in enumerate("Index of reports to be made")]
    d = spark.createDataFrame(rows, "page int, text string, x0 double, top double, upright boolean")
    assert sorted(map(tuple, G.data_pages(d, "Reports to be made").collect())) == [(1, True), (2, False)]
    w = spark.createDataFrame([(1, "Nature", 1.0, 9.0, 3.0), (1, "of", 10.0, 12.0, 3.0), (2, "Nature", 1.0, 9.0, 3.0)], "page int, text string, x0 double, x1 double, top double")
    assert sorted(map(tuple, G.header_box(w, "Nature of").collect())) == [(1, 1.0, 12.0, 3.0)]
