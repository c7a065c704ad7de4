import pytest
from pyspark.sql import functions as F

from docketry.functions import citations as C
from docketry.functions import rules as R
from docketry.functions import text as X
from docketry.operators import judges as G
from docketry.operators import linkage as J
from docketry.operators import pages as P
from docketry.operators import sampling as M
from docketry.plans import stages as Q
from docketry.sources import landing as S
from docketry.streaming import logs as L


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_requirements_lead_to_mandates(spark, tmp_path):
    """Titles' citations before references; confident, candidate and rejected pairs; nothing in common."""
    report = [("M1", "Agency A", "Annual audit of harbor dredging contracts", "42 U.S.C. 100; Pub. L. 110-5"), ("M2", "Agency B", "Annual audit of harbor dredging contracts", "42 U.S.C. 100"), ("M3", "Agency B", "Something else altogether", "7 U.S.C. 9"), ("M4", None, None, None)]
    cite = "usc array<array<string>>, plaw array<array<string>>, stat array<array<string>>"
    subs = [
        ("P1", "Audit of harbor dredging contracts", "Agency A", ["10"], ([["42", "100"]], [["110", "5"]], None), "2020-01-01", 1), ("P2", "Other title under 7 U.S.C. 9", "Agency A", ["20", None], ([["42", "100"]], None, None), "2020-01-01", 1),
        ("P3", None, None, ["30"], None, None, 1), ("P4", "  ", "Agency B", ["40"], ([["7", "9"]], None, None), None, 1), ("P5", "x", "Agency B", None, None, None, 1),
    ]
    d = str(tmp_path)
    spark.createDataFrame(report, "mandate_id string, reporting_entity string, nature_of_report string, authority string").write.parquet(f"{d}/report.parquet")
    s = spark.createDataFrame(subs, f"package_id string, title string, government_author string, requirement_numbers array<string>, cite_refs struct<{cite.replace(' array', ':array')}>, date_issued string, fetched_at int")
    s.selectExpr("*", "'x' as is_on_time", "'x' as doc_class", "'x' as organization_full").write.parquet(f"{d}/submissions.parquet")
    got = {r["requirement_number"]: (r["mandate_id"], r["verdict"], r["reason"]) for r in Q.q_link_verdict_a(spark, d).collect()}
    assert got["10"][:2] == ("M1", "confident") and got["10"][2].startswith("2 kinds of citation; similarity 1.000; same agency")
    assert got["20"][:2] == (None, "no_match") and got["20"][2].startswith("best rejected") and got["30"] == (None, "no_match", "no citation in common") and got["40"][:2] == ("M3", "candidate")
    assert rows(Q.q_attach_stage_a(spark, d)) == [("P1", "M1", False)]
    assert [r[0] for r in rows(Q.q_all_requirements_unmatched(spark, d))] == ["P2", "P3", "P5"]


def test_a_citation_in_a_third_of_all_rows(spark):
    key = lambda c: F.array(F.struct(F.lit("usc").alias("kind"), F.lit("1").alias("a"), c.alias("b")))
    a = spark.range(6).select(F.col("id").cast("string").alias("a"), key(F.when(F.col("id") == 0, "hot").otherwise(F.col("id").cast("string"))).alias("k"))
    b = spark.range(3000).select(F.col("id").cast("string").alias("b"), key(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 97).cast("string"))).alias("k"))
    out = J.shared_citations(a, b, "a", "b", "k")
    assert out.filter("a = '0'").count() == 1000 and out.filter("a <> '0'").count() == sum(1 for i in range(3000) if i % 3 and i % 97 in (1, 2, 3, 4, 5)) and out.filter("kinds <> 1").count() == 0
    own = J.blocked(a.select("a", F.col("k")[0]["b"].alias("e")), b.select("b", F.col("k")[0]["b"].alias("e"), (F.col("b") == "7").alias("wide")), "e", F.col("wide"))
    assert own.filter("a = '0'").count() == 1001


def test_best_then_candidates(spark):
    d = spark.createDataFrame([(1, 1, "confident"), (1, 2, "candidate"), (2, 2, "candidate"), (2, 3, "candidate"), (3, 1, "candidate"), (3, 2, "confident")], "g int, r int, v string")
    assert rows(J.best_then_candidates(d, ["g"], "r", "v").select("g", "r")) == [(1, 1), (2, 2), (2, 3), (3, 1)]


def test_note_grades(spark):
    c = spark.createDataFrame([("a", "s1", ["1-2"], ["3/4"]), ("b", "s1", ["9-9"], ["3/4"]), ("c", "s1", [], None), ("d", "s2", ["1-2"], []), ("e", None, ["1-2"], [])], "cite_id string, section_id string, laws array<string>, stats array<string>")
    n = spark.createDataFrame([("s1", ["1-2", "1-2"], []), ("s1", ["1-2"], ["3/4"]), ("s1", None, None)], "section_id string, laws array<string>, stats array<string>")
    assert rows(J.note_grades(c, n).select("cite_id", "grade", "selection", "notes")) == [("a", "note", "law", 2), ("b", "note", "stat", 1), ("c", "note_unmatched", "unmatched", 3), ("d", "note_absent", "absent", 0), ("e", "note_absent", "absent", 0)]


def test_listed_tier(spark):
    d = spark.createDataFrame([(1, ["a"], ["x"]), (2, ["b"], ["x"]), (3, [], ["y"]), (4, None, None)], "id int, u array<string>, l array<string>")
    u, x = spark.createDataFrame([("a",), ("a",)], "k string"), spark.createDataFrame([("x",), (None,)], "k string")
    assert rows(J.listed_tier(d, "id", [("code", "u", u), ("law", "l", x)], "novel")) == [(1, "code"), (2, "law"), (3, "novel"), (4, "novel")]


def test_orders_and_samples(spark):
    d = spark.range(5000).select(F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 40).cast("string")).alias("g"))
    n = {r["id"]: r["place"] for r in M.numbered(d, -F.col("id")).collect()}
    assert len(n) == 5000 and all(n[i] == 5000 - i for i in n) and M.numbered(d.limit(0), F.col("id")).count() == 0
    top = M.first_of(d, ["g"], F.col("id"), 3)
    assert [r["id"] for r in top.filter("g = 'hot'").orderBy("rank").collect()] == [0, 3, 6] and top.groupBy("g").count().filter("count > 3").count() == 0
    assert M.equal_allocation(d, ["g"], "id", 82).groupBy("g").count().filter("count <> 2").count() == 0 and M.equal_allocation(d.limit(0), ["g"], "id", 5).count() == 0
    pairs = M.paired(d.unionByName(spark.createDataFrame([(9999, "alone")], "id long, g string")), "g", "id", 100)
    assert pairs.count() == 41 and pairs.filter("first_id = second_id or g = 'alone'").count() == 0
    assert [tuple(r) for r in M.most_common(d, "g", 2).select("g", "n", "place").collect()] == [("hot", 1667, 1), ("1", 84, 2)]
    split = M.stratified_split(d.withColumn("g", F.when(F.col("g") != "0", F.col("g"))), ["g"], "id", [("a", 0.5), ("b", 0.5)])
    assert abs(split.filter("split = 'a' and g = 'hot'").count() - 833.5) < 1 and split.count() == 5000 and split.columns == ["id", "g", "split"]


def test_running_values_over_stretches(spark):
    import random

    r = random.Random(2)
    data = [(i * 7, "hot" if i % 3 else f"g{i % 5}", r.choice(["a", "b", "c", None, "d" if i > 400 else "a"])) for i in range(600)]
    d = spark.createDataFrame(data, "i long, g string, v string")
    want, state = {}, {}
    for i, g, v in data:
        n, m = state.get(g, (0, None))
        state[g] = want[i] = (n + 1, max((x for x in (m, v) if x is not None), default=None))
    for per in (50, 10_000):
        assert {x["i"]: (x["place"], x["most"]) for x in M.running(d, ["g"], "i", "v", per=per).collect()} == want
    assert M.running(d.limit(0), ["g"], "i", "v").count() == 0


def test_refusals_are_final(spark):
    log = spark.createDataFrame([("a", "same"), ("a", None), ("b", None), ("c", "refused"), ("c", None), ("d", "n/a")], "k string, v string")
    assert rows(L.never_ended(log, ["k"], F.col("v").isin("same", "refused"))) == [("b",), ("d",)]


def test_small_functions(spark):
    one = lambda f, *v: spark.range(1).select(f(*map(F.lit, v)).alias("x")).first()["x"]
    assert one(C.citation, "/us/usc/t5a/pl/95/452/s8/b/1") == "Pub. L. 95-452, § 8(b)(1) (5 U.S.C. App.)" and one(C.citation, "/us/usc/t42/s300gg–111/a/2") == "42 U.S.C. 300gg-111(a)(2)" and one(C.citation, "row 7") == "row 7"
    assert one(C.code_url, "/us/usc/t42/s300gg–111/a").endswith("title42-section300gg-111&num=0&edition=prelim") and one(C.code_url, "/us/usc/t5a/s3") is None
    assert [tuple(x) for x in one(C.credit_pages, "80 Stat. 944; 132 Stat. 2257")] == [(80, 944), (132, 2257)]
    assert one(lambda c: X.replace_once(c, "b", "x"), "abc") == "axc" and one(lambda c: X.replace_once(c, "b", "x"), "abcb") is None and one(lambda c: X.replace_once(c, "b", "x"), "a") is None
    assert one(lambda a, b, c: X.agency_keys(a, b, c), "Dept of X - Unit Y (UY)", "Dept of X", "") == ["dept of x unit y uy", "dept of x", "unit y"]
    assert tuple(one(lambda b, c: X.agency_names(F.array().cast("array<string>"), b, c), "D", None)) == ("", "D", "")
    assert one(X.descending, "b") < one(X.descending, "a") and one(X.descending, "ab") < one(X.descending, "a")
    assert [one(R.orphan_tag, *a) for a in ((False, True, 0.9), (True, True, 0.1), (True, True, 0.3), (True, False, 0.2), (True, False, 0.1))] == ["agency_absent", "cited_but_unlike", "near_miss", "weak", "none"]
    page = """<A class=x HREF="/a@118-9.zip">a</a> <a href='/b?x=1&amp;y=2'>b</a><a name="n">c</a><a href=/c@119-102.zip>d</a>"""
    assert one(S.html_links, page) == ["/a@118-9.zip", "/b?x=1&y=2", "/c@119-102.zip"] and tuple(one(lambda p: S.newest_release(S.html_links(p)), page)) == (119, 102)
    assert one(S.html_links, "") == [] and one(lambda p: S.newest_release(S.html_links(p)), "<a href=x>") is None


def test_picks_are_held_to_the_options(spark):
    def f(text):
        if text == "boom":
            raise RuntimeError("down")
        return {"picked": text, "alternates": ["a", "zz", text], "reasoning": "r"}

    d = spark.createDataFrame([("a", ["a", "b"]), ("q", ["a"]), ("none", ["a"]), ("boom", ["a"]), ("a", []), (None, ["a"]), ("a", None)], "p string, o array<string>")
    got = [tuple(r) for r in G.pick(d.coalesce(1), "p", "o", f).select("picked", "alternates", "error").collect()]
    assert got[0] == ("a", [], None) and got[1] == (None, [], "unknown id q") and got[2] == ("none", ["a"], None) and got[3][2].startswith("RuntimeError") and got[4][0] == got[6][0] == "none" and got[5][2] == "no prompt"
    assert [r[0] for r in G.pick(d.coalesce(1), "p", "o", f, unknown="none").select("picked").collect()][1] == "none"
    with pytest.raises(ValueError):
        G.pick(d, "p", "o", f, unknown="x")


def test_answers_are_held_to_a_schema():
    f = G.checked(lambda t: {"label": t, "note": "n"}, {"label": ("yes", "no"), "note": str}, "label")
    assert f("yes")["verdict"] == "yes" and G.ask(f, "maybe", tries=1)[0] is None and G.checked(lambda t: None, {}, "x")("y") is None
    e = G.Endpoints()
    e.add("m", lambda t: {"verdict": t}, 4, probe="x")
    assert e.judge("m")("abcdef") == {"verdict": "abcd"}
    with pytest.raises(ConnectionError):
        e.add("dead", lambda t: None, 4, probe="x")


CHARS = "doc_id string, page int, is_rotated boolean, text string, x0 double, top double, fontname string"
LINES = "doc_id string, page int, is_rotated boolean, height double, x0 double, x1 double, top double, bottom double"


def _page(page, turned, rows_, foot="12"):
    """Glyphs and rules of a page: columns from 0, 200 and 400 along, header above 100 down; every glyph is stamped twice."""
    glyphs, rules = [], []

    def put(along, down, text, font="Plain"):
        for i, c in enumerate(text):
            for shift in (0.0, 0.4):
                a, b = along + 6 * i + shift, down + shift
                glyphs.append(("d", page, turned, c, b if turned else a, 700 - a if turned else b, font))

    put(0, 50, "Title")
    for k, (font, cells) in enumerate(rows_):
        for at, text in zip((0, 200, 400), cells):
            put(at, 120 + 12 * k, text, font)
    put(300, 500, foot)
    for x in (190, 390):
        for k in range(3):
            rules.append(("d", page, turned, 800.0, 110.0 + k if turned else float(x), 130.0 + k if turned else float(x), 700.0 - x if turned else 110.0 + k, 700.0 - x if turned else 130.0 + k))
    if turned:
        rules += [("d", page, turned, 800.0, float(x), float(x), 100.0, 690.0) for x in (80, 100)]
    else:
        rules.append(("d", page, turned, 800.0, 0.0, 500.0, 100.0, 100.0))
    return glyphs, rules


@pytest.mark.parametrize("turned", [False, True])
def test_tables_on_pages(spark, turned):
    one = _page(1, turned, [("Bold", ("Dept of X", "", "")), ("Plain", ("Report on", "1 U.S.C. 2", "Annually")), ("Plain", ("things.......", "(3 Stat. 4)", ""))])
    two = _page(2, turned, [("Plain", ("Next", "5 U.S.C. 6 (7)", "Monthly")), ("Bold", ("Dept of Y", "", "")), ("Plain", ("Last", "8 U.S.C. 9", "x"))])
    chars, lines = spark.createDataFrame(one[0] + two[0], CHARS), spark.createDataFrame(one[1] + two[1][:1], LINES)  # the second page has too few rules and takes the first one's
    lay = {r["page"]: (r["right"] - r["left"], r["cutoff"]) for r in P.layout(lines).collect()}
    assert lay[1] == lay[2] == (200.0, 100.0 if turned else 101.0)
    out = P.table_rows(chars, lines).orderBy("ord").collect()
    assert [(r["page"], r["entity"], r["nature_of_report"], r["authority"], r["when_expected"]) for r in out] == [
        (1, "Dept of X", "Report on things", "1 U.S.C. 2 (3 Stat. 4)", "Annually"), (2, "Dept of X", "Next", "5 U.S.C. 6 (7)", "Monthly"), (2, "Dept of Y", "Last", "8 U.S.C. 9", "x"),
    ]
    layers = {r["layer"]: r["count"] for r in P.glyph_layers(chars, P.layout(lines)).groupBy("layer").count().collect()}
    assert layers["header"] == 2 * 2 * 5 and layers["kept"] > 0 and layers["dropped"] > 0
