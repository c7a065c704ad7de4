import random
import re

import pytest
from pyspark.sql import functions as F

from docketry.llm import neardup as N


def brute(rows, t):
    sets = [(k, frozenset(re.findall("[a-z0-9]+", " ".join(x or "" for x in texts).lower()))) for k, *texts in rows]
    out = set()
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and len(x & y) >= t * len(x | y) - 1e-12:
                out.add((min(a, b), max(a, b)))
    return out


def made(n, seed=4, words=400):
    r = random.Random(seed)
    base = [[f"w{int(r.paretovariate(0.6)) % words}" for _ in range(r.randint(1, 30))] for _ in range(n // 3)]
    rows = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            w[r.randrange(len(w))] = f"x{r.randint(0, 50)}"
        r.shuffle(w)
        half = len(w) // 2
        rows.append((f"M{i:04d}", " ".join(w[:half]).upper(), ", ".join(w[half:])))
    return rows


@pytest.mark.parametrize(("t", "hot", "tile"), [(0.7, 1024, 20_000), (0.7, 5, 20), (0.5, 5, 20_000), (0.9, 3, 7), (0.4, 4, 9)])
def test_all_pairs_found(spark, scratch, monkeypatch, t, hot, tile):
    monkeypatch.setattr(N, "HOT_WORD", hot)
    monkeypatch.setattr(N, "TILE", tile)
    rows = made(500)
    out = [tuple(r) for r in N.near_duplicate_pairs(spark.createDataFrame(rows, "k string, a string, b string"), "k", N.word_set(F.col("a"), F.col("b")), t, scratch).collect()]
    assert len(out) == len(set(out)) and set(out) == brute(rows, t)


def test_groups(spark, scratch):
    rows = made(300, seed=9)
    df = spark.createDataFrame(rows, "k string, a string, b string")
    got = {r["k"]: r for r in N.near_duplicate_groups(df, "k", N.word_set(F.col("a"), F.col("b")), 0.7, scratch).collect()}
    assert len(got) == 300
    root = {k: k for k in got}
    for a, b in sorted(brute(rows, 0.7)):
        x, y = root[a], root[b]
        if x != y:
            for k in root:
                if root[k] == max(x, y):
                    root[k] = min(x, y)
    assert {k: r["group_id"] for k, r in got.items()} == root
    assert all((r["class_id"] == k) or got[r["class_id"]]["class_id"] == r["class_id"] for k, r in got.items())


def test_odd_rows(spark, scratch):
    rows = [("a", None, None), ("b", "", "!!"), ("c", "x", None), ("d", None, "X"), ("e", "x " * 20_000, "y"), ("f", "y", "x"), ("g", "w " + " ".join(f"q{i}" for i in range(3000)), ""), ("h", " ".join(f"q{i}" for i in range(3000)), "z")]
    out = {tuple(r) for r in N.near_duplicate_pairs(spark.createDataFrame(rows, "k string, a string, b string"), "k", N.word_set(F.col("a"), F.col("b")), 0.7, scratch).collect()}
    assert out == {("c", "d"), ("e", "f"), ("g", "h")}
    none = spark.createDataFrame([], "k string, a string, b string")
    assert N.near_duplicate_pairs(none, "k", N.word_set(F.col("a")), 0.7, scratch).count() == 0 and N.near_duplicate_groups(none, "k", N.word_set(F.col("a")), 0.7, scratch).count() == 0


def test_copies_of_a_third(spark, scratch):
    rows = [(f"k{i:03d}", "one two three four", "five") for i in range(60)] + made(100, seed=2)
    out = N.near_duplicate_groups(spark.createDataFrame(rows, "k string, a string, b string"), "k", N.word_set(F.col("a"), F.col("b")), 0.7, scratch)
    assert out.filter("copies = 60 and class_id = 'k000'").count() == 60
