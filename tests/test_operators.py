import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from docketry.operators import glyphs as G
from docketry.operators import linkage as J
from docketry.operators import metrics as V
from docketry.operators import sampling as M
from docketry.operators import statutes as S
from docketry.operators import units as U
from docketry.plans.links import every_20th


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_inverted_index(spark):
    a = spark.createDataFrame([(1, ["x", "y", "y"]), (2, []), (3, None)], "a int, k array<string>")
    b = spark.createDataFrame([(7, ["y", "x"]), (8, ["y"])], "b int, k array<string>")
    assert rows(J.shared_keys(a, b, "a", "b", "k")) == [(1, 7, 2), (1, 8, 1)]
    s = J.token_scores(a, b, "a", "b", "k").filter("b = 8").first()
    assert s["jaccard"] == pytest.approx(1 / 3)  # sizes count the array as given; callers pass sets


def test_shared_citations(spark):
    k = "k array<struct<kind:string,a:string,b:string>>"
    a = spark.createDataFrame([(1, [("usc", "1", "2"), ("plaw", "3", "4")])], f"a int, {k}")
    b = spark.createDataFrame([(7, [("plaw", "3", "4")]), (8, [("usc", "1", "2"), ("plaw", "3", "4"), ("stat", "1", "2")])], f"b int, {k}")
    out = {r["b"]: (r["kinds"], r["law_only"]) for r in J.shared_citations(a, b, "a", "b", "k").collect()}
    assert out == {7: (1, True), 8: (2, False)}


def test_prefer_topk_all_of_blocked(spark):
    d = spark.createDataFrame([(1, 1, True), (1, 2, False), (2, 1, False), (2, 2, None)], "g int, o int, f boolean")
    assert rows(J.prefer(d, ["g"], F.col("f"), [F.col("o")]).select("g", "o")) == [(1, 1), (2, 1)]
    assert rows(J.top_k(d.select("g", "o"), ["g"], [F.desc("o")], 1)) == [(1, 2, 1), (2, 2, 1)]
    assert rows(J.best_one(d, ["g"], F.struct("o"), "o")) == [(1, 2), (2, 2)]
    assert rows(J.all_of(d, "g", F.col("f"))) == []
    left = spark.createDataFrame([(1, "a"), (2, None)], "l int, e string")
    right = spark.createDataFrame([(7, "a", False), (8, "m", True), (9, None, False)], "r int, e string, wide boolean")
    assert rows(J.blocked(left, right, "e", F.col("wide")).select("l", "r")) == [(1, 7), (1, 8), (2, 8)]


def test_resolve_and_notes(spark):
    c = spark.createDataFrame([("/s1/a", "/s1"), ("/S1/B", "/S1"), ("/s1/x", "/s1"), ("/s9", "/s9")], "u string, s string")
    n = spark.createDataFrame([("/s1", 1), ("/s1/a", 2), ("/s1/b", 3)], "u string, o int")
    assert rows(J.resolve(c, n, "u", "s", "o").select("u", "resolved_id", "resolved_at")) == [("/S1/B", "/s1/b", "folded"), ("/s1/a", "/s1/a", "exact"), ("/s1/x", "/s1", "section"), ("/s9", None, "none")]
    d = spark.createDataFrame([(["Pub. L. 1–2", "b"], ["Pub. L. 1-2"], []), (["a 5 Stat. 6"], ["x"], ["5 Stat. 6"]), (["a"], [], []), ([], [], [])], "n array<string>, l array<string>, s array<string>")
    out = d.select(J.select_notes(F.col("n"), F.col("l"), F.col("s")).alias("x")).select("x.*").collect()
    assert [(r["selection"], len(r["notes"])) for r in out] == [("law", 1), ("stat", 1), ("unmatched", 1), ("absent", 0)]


def test_stated_query_set(spark):
    d = spark.createDataFrame([("CMR-00000040",), ("CMR-00000041",), (None,), ("x",)], "p string")
    assert rows(d.filter(every_20th(F.col("p")))) == [("CMR-00000040",)]


XML = """<m xmlns="http://x"><section identifier="/us/usc/t5/s1"><num>1</num><heading>Reports</heading><chapeau>The Secretary shall—</chapeau>
<subsection identifier="/us/usc/t5/s1/a"><content>submit a <ref>full</ref> report to Congress each year on all the matters that it deems right</content></subsection>
<sourceCredit>(Pub. L. 1-2)</sourceCredit><notes><note topic="amendments" role="x"><p>This apparatus note is left out although it is long enough.</p></note>
<note topic="misc"><p>An operative note that is long enough to count as text.</p></note><note topic="misc" role="crossHeading"><p>A heading across that is long enough to count as text.</p></note></notes></section></m>"""


def test_xml(spark):
    files = spark.createDataFrame([(XML,), ("<broken",), (None,)], "body string")
    n = {r["uslm_id"]: r for r in S.node_index(files).collect()}
    assert set(n) == {"/us/usc/t5/s1", "/us/usc/t5/s1/a"} and len(n["/us/usc/t5/s1"]["statutory_notes"]) == 1 and n["/us/usc/t5/s1/a"]["statutory_notes"] == []
    assert n["/us/usc/t5/s1/a"]["text"].startswith("submit a full report to Congress")
    p = {r["uslm_id"]: (r["text"], r["source"]) for r in S.provision_stream(files, low=20, high=300).collect()}
    assert p["/us/usc/t5/s1/a"][0].startswith("1 Reports The Secretary shall— submit") and p["/us/usc/t5/s1/note/0"][1] == "note"
    assert S.provision_stream(files, low=20, high=300, context="never").filter("uslm_id like '%/a'").first()["text"].startswith("submit")
    assert rows(S.credit_index(files)) == [("/us/usc/t5/s1", "(Pub. L. 1-2)")]


def test_law_sections():
    xml = "<law><section><enum>101.</enum><text>First.</text></section><section><enum>102.</enum><text>Second.</text></section></law>"
    assert S.law_section_xml(xml, "102").endswith("Second.") and S.law_section_xml(xml, "9") is None and S.law_section_xml("<", "1") is None
    page = "<pre>\nSec. 1. Short title.\nSec. 2. Reports.\n\n SEC. 2. REPORTS.\n The &lt;&lt;NOTE: x&gt;&gt; agency shall report &amp; tell.\n SEC. 3. END.</pre>"
    assert S.law_section_html(page, "2") == "SEC. 2. REPORTS. The agency shall report & tell." and S.law_section_html(page, "7") is None


@pytest.mark.parametrize(
    ("text", "where"),
    [
        ("shall submit to the Committee on Rules a report", "committee"), ("in consultation with the Committee on Rules, shall submit to Congress", "congress"), ("shall transmit to the Speaker of the House and the Committee on Rules", "chamber"),
        ("shall notify the Congress", "congress"), ("shall report to the President", "unknown"), ("", "unknown"), (None, "unknown"), ("transmit to the Congress, including the Committee on Rules", "congress"),
    ],
)
def test_destination(spark, text, where):
    assert spark.createDataFrame([(text,)], "t string").select(S.destination(F.col("t"))).first()[0] == where


def test_overlapping_spans(spark):
    said = spark.createDataFrame([("submit to A and transmit to B, then notify " + "c" * 500,), (None,)], "t string").select(S.recipient_spans(F.col("t")).alias("s")).collect()
    assert [len(x) for x in said[0]["s"]] == [240, 240, 240] and said[0]["s"][0].startswith(" A and transmit to B") and said[0]["s"][1].startswith(" B, then") and said[1]["s"] == []


def test_a_node_between_stops_the_fold(spark):
    """The nearest flagged ancestor decides: where it isn't alike, no higher one is asked."""
    f = [("/us/usc/t5/s1/a", "", "annual", ""), ("/us/usc/t5/s1/a/1", "", "quarterly", ""), ("/us/usc/t5/s1/a/1/A", "", "annual", ""), ("/us/usc/t5/s1/a/1/A/i", "", "annual", "")]
    out = {r["uslm_id"]: (r["unit_id"], r["rule"]) for r in U.collapse(spark.createDataFrame(f, "uslm_id string, entity string, cadence string, text string")).collect()}
    top = "/us/usc/t5/s1/a/1/A"
    assert out[top] == (top, "own") and out[top + "/i"] == (top, "ancestor") and out["/us/usc/t5/s1/a/1"][1] == "own"


def test_units_match_a_plain_fold(spark):
    """Against the two rules done one row at a time, on random trees."""
    import random
    import re

    r = random.Random(6)
    duty = "The head shall, every year, submit a report on "
    nodes = {}
    for _ in range(400):
        parts = [r.choice("ab"), r.choice("12"), r.choice("AB"), r.choice("xyz")][: r.randint(0, 4)]
        i = "/".join([f"/us/usc/t5/s{r.randint(1, 12)}", *parts])
        nodes[i] = (r.choice(["secretary", "secretary of state", "", "board", "secretary of war"]), r.choice(["annual", "monthly"]), r.choice([duty + "a", duty + "b", "heading a", "heading b"]))
    like = lambda a, b: not a or not b or a.startswith(b) or b.startswith(a)
    up = lambda i: None if i.count("/") == 4 else i.rsplit("/", 1)[0]
    owner = {}
    for i in sorted(nodes, key=lambda i: i.count("/")):
        p = up(i)
        while p and p not in nodes:
            p = up(p)
        owner[i] = owner[p] if p and nodes[p][1] == nodes[i][1] and like(nodes[p][0], nodes[i][0]) else i
    unit, families = dict(owner), {}
    for i in sorted(i for i in nodes if owner[i] == i and up(i)):
        some = families.setdefault((up(i), nodes[i][1]), [])
        home = next((c for c in some if like(nodes[c[0]][0], nodes[i][0])), None)
        some.append([i]) if home is None else home.append(i)
    for c in (c for some in families.values() for c in some if len(c) > 1):
        texts = [nodes[i][2] for i in c]
        shared = next((min(texts)[:k] for k in range(len(min(texts)), -1, -1) if all(t.startswith(min(texts)[:k]) for t in texts)), "")
        if re.search(r"\bshall\b[^.;]{0,200}?\bsubmit", shared):
            for i in nodes:
                if owner[i] in c:
                    unit[i] = c[0]
    got = {x["uslm_id"]: x["unit_id"] for x in U.collapse(spark.createDataFrame([(i, *v) for i, v in nodes.items()], "uslm_id string, entity string, cadence string, text string")).collect()}
    assert got == unit and len(set(unit.values())) < len(nodes)


def test_xml_blocks_and_notes(spark):
    long = "long enough to count as the text of an operative note"
    xml = f"""<m><section identifier="/us/usc/t1/s2"><heading>H</heading><subsection identifier="/us/usc/t1/s2/a"><num>(a)</num><subheading>Sub</subheading><content>one<proviso>two</proviso><quotedContent>three</quotedContent>four <i>fi</i>ve</content></subsection>
    <notes><note topic="shortTitle"><p>{long}</p></note><note topic="effectiveDate"><p>{long}</p></note><note><heading>N</heading><p>{long}</p><note topic="misc"><p>{long}</p></note></note></notes></section></m>"""
    n = {r["uslm_id"]: r for r in S.node_index(spark.createDataFrame([(xml,)], "body string")).collect()}
    assert n["/us/usc/t1/s2/a"]["text"] == "(a) Sub onetwo three four five"
    notes = n["/us/usc/t1/s2"]["statutory_notes"]
    assert len(notes) == 1 and notes[0]["topic"] == "" and notes[0]["text"].count(long) == 2


def test_units(spark):
    duty = "The Secretary shall submit a report to Congress on "
    f = [
        ("/us/usc/t5/s1", "Secretary", "annual", "x"), ("/us/usc/t5/s1/a", "Secretary of State", "annual", "y"), ("/us/usc/t5/s1/a/1", "", "annual", "z"), ("/us/usc/t5/s1/b", "Board", "annual", "w"),
        ("/us/usc/t5/s2/a", "Board", "annual", duty + "a"), ("/us/usc/t5/s2/b", "Board", "annual", duty + "b"), ("/us/usc/t5/s2/c", "Board", "monthly", duty + "c"),
        ("/us/usc/t5/s3/a", "Board", "annual", "Reports a"), ("/us/usc/t5/s3/b", "Board", "annual", "Reports b"), (None, "x", "x", "x"), ("/us/usc/t5/s3/b", "Board", "annual", "Reports b"),
    ]
    out = {r["uslm_id"]: (r["unit_id"], r["rule"]) for r in U.collapse(spark.createDataFrame(f, "uslm_id string, entity string, cadence string, text string")).collect()}
    assert out["/us/usc/t5/s1/a"] == ("/us/usc/t5/s1", "ancestor") and out["/us/usc/t5/s1/a/1"][0] == "/us/usc/t5/s1" and out["/us/usc/t5/s1/b"][1] == "own"
    assert out["/us/usc/t5/s2/b"] == ("/us/usc/t5/s2/a", "sibling") and out["/us/usc/t5/s2/c"][1] == "own" and out["/us/usc/t5/s3/b"][1] == "own" and len(out) == 9


def test_units_of_repeated_ids_do_not_depend_on_arrival(spark):
    f = [(1, "/us/usc/t5/s1", "Board", "annual", "x"), (2, "/us/usc/t5/s1/a", "Secretary", "annual", "y"), (3, "/us/usc/t5/s1/a", "Board", "annual", "z")]
    schema = "n long, uslm_id string, entity string, cadence string, text string"
    run = lambda f, *order: rows(U.collapse(spark.createDataFrame(f, schema).coalesce(1), *order))
    assert run(f) == run(f[::-1])
    assert run(f, ("n",)) == run(f[::-1], ("n",)) == [("/us/usc/t5/s1", "/us/usc/t5/s1", "own"), ("/us/usc/t5/s1/a", "/us/usc/t5/s1", "ancestor")]
    assert run([(-n, *r) for n, *r in f], ("n",))[1] == ("/us/usc/t5/s1/a", "/us/usc/t5/s1/a", "own")


def test_glyph_rows(spark):
    chars = spark.createDataFrame([(1, float(i), t) for i, t in enumerate([10.0, 10.5, 12.4, 15.0])], "page int, x0 double, top double")
    assert [r["cluster"] for r in G.gap_clusters(chars, ["page"], "top", 2.0, "x0").orderBy("top").collect()] == [0, 0, 0, 1]
    line = spark.createDataFrame([(1, 1, 4.0 * i, c) for i, c in enumerate("a......b.c")], "page int, row int, x0 double, text string")
    assert "".join(r["text"] for r in G.drop_leaders(line).orderBy("x0").collect()) == "ab.c"
    pages = spark.createDataFrame([("d", 1), ("d", 2), ("d", 3)], "doc_id string, page int")
    assert rows(G.carry_layout(pages, spark.createDataFrame([(2, 1.0, 2.0)], "page int, left double, right double"))) == [("d", 1, 1.0, 2.0), ("d", 2, 1.0, 2.0), ("d", 3, 1.0, 2.0)]


def test_double_stamps(spark):
    pdf = pd.DataFrame({"page": [1] * 4, "text": list("aaab"), "x0": [1.0, 1.5, 9.0, 1.2], "top": [1.0, 1.2, 1.0, 1.0]})
    assert sorted(G.dedupe_glyphs(pdf).text) == ["a", "a", "b"]


def test_logical_rows(spark):
    h, n = "entity_header", "data_line"
    lines = [("d", 1, 0, h, "Dept", None, None, None), ("d", 1, 1, h, "of X", None, None, None), ("d", 1, 2, n, None, "Report on", "1 U.S.C. 2", "Annually"), ("d", 2, 3, n, None, "things", "(3 Stat. 4)", None), ("d", 2, 4, n, None, "Next", "(5 Stat. 6)", "Monthly"), ("d", 2, 5, n, None, "and more", None, None), ("d", 2, 6, h, "Y", None, None, None), ("d", 2, 7, n, None, "Last", "(1)", "x")]
    out = G.merge_rows(spark.createDataFrame(lines, "doc_id string, page int, ord long, type string, text string, nature string, authority string, when_expected string")).orderBy("ord").collect()
    assert [(r["entity"], r["nature_of_report"], r["authority"]) for r in out] == [("Dept of X", "Report on things", "1 U.S.C. 2 (3 Stat. 4)"), ("Dept of X", "Next and more", "(5 Stat. 6)"), ("Y", "Last", "(1)")]


def test_samples(spark):
    d = spark.range(200).withColumn("g", F.col("id") % 3)
    small, large = {r["id"] for r in M.simple_sample(d, "id", 10).collect()}, {r["id"] for r in M.simple_sample(d.repartition(7), "id", 30).collect()}
    assert small < large and small != {r["id"] for r in M.simple_sample(d, "id", 10, seed=1).collect()}
    assert {r["count"] for r in M.per_bucket(d, ["g"], "id", 4).groupBy("g").count().collect()} == {4}
    assert not small & {r["id"] for r in M.excluding(d, M.simple_sample(d, "id", 10), "id", 50).collect()}
    s = {r["split"]: r["count"] for r in M.stratified_split(d, ["g"], "id", [("a", 0.4), ("b", 0.25), ("c", 0.35)]).groupBy("split").count().collect()}
    assert sum(s.values()) == 200 and abs(s["a"] - 80) <= 3
    held = {r["id"] for r in M.hold_out(d, "id", 20).filter("held_out").collect()}
    assert 20 <= len(held) <= 60 and held == {r["id"] for r in M.hold_out(d.filter("id < 500"), "id", 20).filter("held_out").collect()}


def test_measures(spark):
    d = spark.createDataFrame([("a", True, True), ("a", True, False), ("a", False, True), ("a", None, True), ("b", False, False)], "s string, t boolean, g boolean")
    c = {r["s"]: r for r in V.confusion(d, F.col("t"), F.col("g"), ["s"]).collect()}
    assert (c["a"]["tp"], c["a"]["fp"], c["a"]["fn"]) == (1, 1, 1) and c["b"]["recall"] is None and c["a"]["f2"] == pytest.approx(0.5)
    sizes = spark.createDataFrame([("a", 30), ("b", 10), ("z", 60)], "s string, size int")
    assert V.weighted_rate(d, "s", F.col("t"), sizes, "size").first()["rate"] == pytest.approx(0.3 * 2 / 3)
    assert V.weighted_rate(d, "s", F.col("t"), sizes, "size", renormalize=True).first()["rate"] == pytest.approx(0.75 * 2 / 3)
    r = spark.createDataFrame([(i, i % 2 == 0) for i in range(10)], "i int, rel boolean")
    assert rows(V.recall_at(r, F.col("rel"), [F.col("i")], [1, 4])) == [(1, 0.2), (4, 0.4)]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [2.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0])], "i int, v array<float>")
    ref = spark.createDataFrame([([1.0, 1.0],), ([5.0, 0.0],)], "v array<float>")
    out = {r["i"]: r["cosine"] for r in V.max_cosine(v, "i", "v", ref).collect()}
    assert out[1] == pytest.approx(1.0) and out[2] == 0.0 and out[3] is None and out[4] is None
    assert V.max_cosine(v, "i", "v", ref.limit(0)).filter("cosine is not null").count() == 0
    assert {r["i"]: r["cosine"] for r in V.max_cosine(v, "i", "v", ref, most=1).collect()} == out  # more than one block
    assert not any(math.isnan(x) for x in out.values() if x is not None)


@pytest.mark.parametrize(("score", "least", "block", "cells"), [("jaccard", 1, 20_000, 1 << 24), ("sum", 2, 7, 50)])
def test_search_is_exact(spark, monkeypatch, score, least, block, cells):
    import random

    from docketry.operators import search

    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "CELLS", cells)
    monkeypatch.setattr(search, "HELD", 60)
    r = random.Random(6)
    make = lambda p, n: [(f"{p}{i:03d}", sorted({f"w{int(r.paretovariate(0.7))}" for _ in range(r.randint(0, 8))})) for i in range(n)]
    a, b = make("q", 40), make("r", 150) + [("rz", None)]
    got = search.top_k_overlap(spark.createDataFrame(a, "q string, t array<string>"), spark.createDataFrame(b, "r string, t array<string>").repartition(3), "q", "r", "t", 3, score=score, least=least)
    want = []
    for q, x in a:
        found = []
        for k, y in b:
            n = len(set(x) & set(y or []))
            if n >= least:
                found.append((-round(n / len(set(x) | set(y)) + (n / max(min(len(x), len(y)), 1) if score == "sum" else 0), 6), k, n))
        want += [(q, k, -s, n, i + 1) for i, (s, k, n) in enumerate(sorted(found)[:3])]
    assert rows(got) == sorted(want, key=repr)
    assert search.top_k_overlap(spark.createDataFrame(a, "q string, t array<string>").limit(0), spark.createDataFrame(b, "r string, t array<string>"), "q", "r", "t", 3).count() == 0


def test_united_search_keeps_pairs_that_share_only_a_key(spark):
    import random

    from docketry.operators import search

    r = random.Random(9)
    make = lambda p, n: [(f"{p}{i:03d}", sorted({f"w{int(r.paretovariate(0.7))}" for _ in range(r.randint(0, 6))}), sorted({f"c{r.randint(0, 40)}" for _ in range(r.randint(0, 3))})) for i in range(n)]
    a, b = make("q", 30), make("r", 120)
    a, b = a + [("qz", [], ["c99"])], b + [("rz", [], ["c99"]), ("ry", ["w1"], ["c99"]), ("rx", None, None)]
    schema = "%s string, t array<string>, keys array<string>"
    got = search.top_k_united(spark.createDataFrame(a, schema % "q"), spark.createDataFrame(b, schema % "r").repartition(3), "q", "r", "t", "keys", 4)
    want = []
    for q, x, c in a:
        found = []
        for k, y, e in b:
            x, y = set(x), set(y or [])
            hits, n = len(set(c) & set(e or [])), len(x & y)
            if hits or n >= 2:
                jaccard = n / len(x | y) if x or y else 1.0
                found.append((-round(2 * hits + n / (min(len(x), len(y)) or 1) + jaccard, 6), k, hits, n))
        want += [(q, k, -s, h, n, i + 1) for i, (s, k, h, n) in enumerate(sorted(found)[:4])]
    assert rows(got.select("q", "r", "score", "hits", "shared", "rank")) == sorted(want, key=repr)
    assert any(h and n < 2 for _, _, _, h, n, _ in want)


@pytest.mark.parametrize("tol", [1.0, 1.5])
def test_double_stamps_of_long_rows(tol):
    import random

    leaders = [(5.0 * i, 100.0 + t, ".") for i in range(150) for t in (0.0, 0.8)]
    assert len(G.dedupe_glyphs(pd.DataFrame(leaders, columns=["x0", "top", "text"]), tol)) == 150
    r = random.Random(4)
    page = [(r.randint(0, 300) / 10, r.randint(0, 300) / 10, r.choice(".a")) for _ in range(900)]
    want = []
    for x, y, c in sorted(page):
        if not any(c == k and abs(x - a) <= tol and abs(y - b) <= tol for a, b, k in want):
            want.append((x, y, c))
    got = G.dedupe_glyphs(pd.DataFrame([*page, (None, 1.0, "a")], columns=["x0", "top", "text"]), tol)
    assert sorted(map(tuple, got.dropna().to_numpy().tolist())) == want and got.x0.isna().sum() == 1
