import itertools
import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketry.llm import lookalike as L

ALIKE = [
    ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("é", "é"), ("no break space", "no break space"), ("ze​ro﻿­", "zero"), ("АСΕ", "ACE"), ("oﬃce Ⅳ", "office IV"),
    ("Ångström", "Ångström"), ("ạ́", "ạ́"), ("re‐do‑it", "re-do-it"), ("й", "й"), ("가", "가"), ("сух", "cyx"),
]
UNLIKE = [("resume", "résumé"), ("a", "A"), ("x²", "x2"), ("a’s", "a's"), ("1-2", "1–2"), ("a b", "ab"), ("a\nb", "a b"), ("ø", "o"), ("l", "1"), ("ж", "x")]


def form(*texts):
    return L.canonical_array(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize(("a", "b"), ALIKE)
def test_alike(a, b):
    assert form(a)[0] == form(b)[0]


@pytest.mark.parametrize(("a", "b"), UNLIKE)
def test_unlike(a, b):
    assert form(a)[0] != form(b)[0]


def slow(text):
    """The same form, character by character."""
    t = L.tables()
    seq = [chr(x) for c in text for x in t.out[t.start[ord(c)] : t.start[ord(c)] + t.length[ord(c)]]]
    out = []
    for _, run in itertools.groupby(enumerate(seq), key=lambda p, n=itertools.count(): next(n) if not unicodedata.combining(p[1]) else -1):
        out += sorted((c for _, c in run), key=unicodedata.combining)
    return unicodedata.normalize("NFC", "".join(out))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aeoAZ ̧̣́̈é​ａаіﬁ\n中\U0001f600", max_size=12), max_size=8))
def test_same_as_the_slow_way(texts):
    assert form(*texts) == [unicodedata.normalize("NFC", slow(t)) for t in texts] if texts else True


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=40))
def test_stable(text):
    once = form(text)[0]
    assert form(once)[0] == once


def test_rows_do_not_touch():
    assert form("a", "́", None, "", "é") == ["a", "́", None, "", "é"]
    big = "x́" * 2_000_000
    assert form(big, "y")[1] == "y" and len(form(big)[0]) == 4_000_000
    assert L.canonical_array(pa.array(["q", "ａ", None, "b"]).slice(1, 2)).to_pylist() == ["a", None]


def test_tables(spark, scratch):
    d = spark.createDataFrame([(1, "ab", "z"), (2, "a​b", "z"), (3, "аb", "z"), (4, "ab", "z"), (5, None, "z"), (6, "", "z"), (7, "​", "z"), (8, "AB", "z")], "doc_id long, text string, canonical string")
    out = {r["doc_id"]: r["canonical"] for r in L.canonicalize(d).collect()}
    assert out == {1: "ab", 2: "ab", 3: "ab", 4: "ab", 5: None, 6: "", 7: "", 8: "AB"}
    assert sorted(tuple(r) for r in L.alike_pairs(d, scratch).collect()) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 4), (6, 7)]
    assert L.alike_pairs(d.limit(0), scratch).count() == 0
    assert L.canonicalize(d, "text", "text").filter("doc_id = 3").first()["text"] == "ab"


def test_groups_agree_with_pairs(spark, scratch):
    from docketry.llm.lookalike import alike_groups, alike_pairs

    texts = ["caf\u00e9", "cafe\u0301", "caf\u00e9", "a b", "a\u00a0b", "x", None, ""] + ["hot"] * 40 + ["h\u200bot"] * 2
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["group_id"], r["members"], r["variants"]) for r in alike_groups(d, scratch).collect()}
    assert got[0] == got[1] == got[2] == (0, 3, 2) and got[3] == got[4] == (3, 2, 2) and got[5] == (5, 1, 1) and 6 not in got and got[7] == (7, 1, 1) and got[8] == (8, 42, 2)
    pairs = {tuple(r) for r in alike_pairs(d, scratch).collect()}
    assert pairs == {(a, b) for a in got for b in got if a < b and got[a][0] == got[b][0] and texts[a] != texts[b]}
    assert alike_groups(d.limit(0), scratch).count() == 0
