import pytest
from pyspark.sql import functions as F

from docketry.functions import citations as C
from docketry.functions import rules as R
from docketry.functions import text as X


def one(spark, f, *values):
    names = [f"c{i}" for i in range(len(values))]
    schema = ", ".join(f"{n} {'array<string>' if isinstance(v, list) else 'int' if isinstance(v, int) else 'double' if isinstance(v, float) else 'string'}" for n, v in zip(names, values))
    return spark.createDataFrame([tuple(values)], schema).select(f(*[F.col(n) for n in names]).alias("x")).first()["x"]


def test_text_keys(spark):
    assert one(spark, X.normalize_text, " Été  à\nPáris!! ") == "ete a paris"
    assert one(spark, X.normalize_text, None) is None
    assert one(spark, X.basic_key, "A & B-C") == "a and b c"
    assert one(spark, X.token_set, "Annual report on the Broadband broadband x") == ["broadband"]
    assert one(spark, X.token_set, None) == []
    assert one(spark, X.stem, "FY 2023 Report on Foo 2023, part 2") == "report on foo part"
    assert one(spark, X.clean_cell, "abc ..... 12 . ") == "abc 12"
    assert one(spark, X.entity_key, "The Secretary of State of the United States") == "secretary of state"
    assert one(spark, X.loose_json, 'x {"a": {"b": 1}} y') == '{"a": {"b": 1}}'
    assert one(spark, X.row_id, "a", None).startswith("r-")


@pytest.mark.parametrize(("low", "high", "prefix"), [("abc", "abd", "ab"), ("abc", "abc", "abc"), ("", "abc", ""), ("x", "y", ""), ("ab", "abc", "ab")])
def test_common_prefix(spark, low, high, prefix):
    assert one(spark, X.common_prefix, low, high) == prefix


def test_jaccard_of_empty_sets(spark):
    assert one(spark, X.jaccard, [], []) == 1.0 and one(spark, X.jaccard, [], ["a"]) == 0.0 and one(spark, X.jaccard, ["a"], ["a", "b"]) == 0.5


def test_parent_split(spark):
    d = spark.createDataFrame([("Dept - Unit - Sub (DU)",), ("Dept",), (None,)], "a string").select(*[c.alias(n) for c, n in zip(X.split_parent(F.col("a")), "pu")]).collect()
    assert [tuple(r) for r in d] == [("Dept", "Unit - Sub"), ("Dept", ""), (None, "")]


@pytest.mark.parametrize(
    ("text", "address"),
    [
        ("/us/usc/t42/s300zz-7/a/5", "/us/usc/t42/s300zz-7"), ("/us/usc/t42/s300ZZ—7#note-3", "/us/usc/t42/s300zz-7"), ("us//usc/T5a/s102", "/us/usc/t5a/s102"),
        ("48 U.S.C. § 104a(a)", "/us/usc/t48/s104a"), ("2 USC 101 note", "/us/usc/t2/s101"), (" 39 U.S.C 107gg(a)\n", "/us/usc/t39/s107gg"), ("5 U.S.C. App. 7", "/us/usc/t5a/s7"),
        ("/us/usc/t05/s0101-1", "/us/usc/t5/s101-1"), ("/us/usc/t5/s101a/note/2/", "/us/usc/t5/s101a"), ("", None), (None, None), ("page 7", None),
    ],
)
def test_section_address(spark, text, address):
    assert one(spark, C.section_address, text) == address


def test_citations(spark):
    text = "42 U.S.C. § 300gg—111(a)(1)(B) note; 5 USC App. 3; Pub. L. 101-510, Sec. 502(a) (as added by Pub. L. 112–260, Sec. 301(f), Sec. 4); (133 Stat. 763); 42 U.S.C. 300gg-111"
    c = one(spark, C.parse_citations, text)
    assert {(x["a"], x["b"]) for x in c["usc"]} == {("42", "300gg-111")} and {(x["a"], x["b"]) for x in c["plaw"]} == {("101", "510"), ("112", "260")} and [tuple(x) for x in c["stat"]] == [("133", "763")]
    a = one(spark, C.parse_authority, text)
    assert [x["uslm_id"] for x in a] == ["/us/usc/t42/s300gg-111", "/us/usc/t5a/s3", "/us/usc/t42/s300gg-111"] and a[0]["is_note"] and a[1]["is_appendix"]
    assert [tuple(x) for x in one(spark, C.plaw_sections, text)] == [(101, 510, "502"), (112, 260, "301")]
    assert [tuple(x) for x in one(spark, C.credit_keys, text)] == [(101, 510, "502"), (112, 260, "301"), (112, 260, "4")]
    assert one(spark, C.parse_citations, None)["usc"] == [] and one(spark, C.plaw_sections, "") == []


def test_paths(spark):
    assert one(spark, C.ancestors, "/us/usc/t5/s101/a/1/B") == ["/us/usc/t5/s101/a/1", "/us/usc/t5/s101/a", "/us/usc/t5/s101"]
    assert one(spark, C.ancestors, "/us/usc/t5/s101") == [] and one(spark, C.ancestors, "/us/usc/t5/s101/note/2") == [] and one(spark, C.ancestors, "x") == []
    assert one(spark, C.citation, "/us/usc/t5a/s3/b/1") == "5a U.S.C. 3(b)(1)" and one(spark, C.citation, "/us/usc/t5/s3/note/1") == "5 U.S.C. 3 note"


def test_years(spark):
    assert one(spark, C.terminal_year, "annually through fiscal year 2019 and until December 31, 2023") == 2023
    assert one(spark, C.terminal_year, "in 2019") is None and one(spark, C.deadline_year, "by July 27, 2021 or 2022; x20231") == 2022


@pytest.mark.parametrize(
    ("text", "label"),
    [("Annually", "annual"), ("every other year", "biennial"), ("semi-annual", "semiannual"), ("each fiscal quarter", "quarterly"), ("Not later than July 1, 2021", "one_time"), ("whenever", "event_driven"), ("", "other"), (None, "other"), ("biannual", "other")],
)
def test_cadence(spark, text, label):
    assert one(spark, R.cadence, text) == label


@pytest.mark.parametrize(("text", "label"), [("one-time and annual", "annual"), ("every three years", "multi-year"), ("event-driven", "event-driven"), ("unknown", "unknown"), (None, "unknown"), ("odd", "other"), ("biannual", "annual")])
def test_frequency(spark, text, label):
    assert one(spark, R.frequency, text) == label


def test_currency(spark):
    f = lambda text, end, note: one(spark, lambda t, e, n: R.currency(t, e, 2024, n == "y"), text, end, note)
    assert f("x", 2020, "n") == "expired" and f("Repealed.", 2030, "y") == "expired" and f("Repealed.", 2030, "n") == "current" and f("This section shall terminate on", 2030, "n") == "review"


def test_verdicts(spark):
    a = lambda k, s, ag, e: one(spark, lambda k, s, ag, e: R.stage_a(k, s, ag == 1, e == 1), k, s, ag, e)
    assert [a(2, 0.4, 0, 0), a(1, 0.4, 1, 0), a(1, 0.4, 0, 0), a(1, 0.2, 0, 0), a(0, 0.7, 0, 0), a(0, 0.6, 1, 0), a(2, 0.0, 1, 1), a(1, 0.0, 1, 1), a(1, 1.0, 0, 1)] == [
        "confident", "confident", "candidate", "candidate", "candidate", "reject", "confident", "candidate", "reject",
    ]
    assert one(spark, R.stage_b2, 0.5) == "confident" and one(spark, R.stage_b2, 0.25) == "candidate" and one(spark, R.stage_b2, 0.1) == "no_match"
