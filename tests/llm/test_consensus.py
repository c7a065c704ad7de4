import math
import random

import pytest
from pyspark.sql import functions as F

from docketry.llm.consensus import latest_votes, message_passing, verdict_class


def made(n, judges, classes, copies=(), seed=2, deny=0.3):
    r = random.Random(seed)
    truth, rows = {}, []
    for i in range(n):
        t = truth[i] = r.choice(classes)
        said = {}
        for j, p in judges.items():
            said[j] = t if r.random() < p else r.choice([c for c in classes if c != t])
        for a, b in copies:
            if r.random() < 0.8:
                said[a] = said[b]
        rows += [(i, j, v) for j, v in said.items() if r.random() > deny]
    return truth, rows


def accuracy(out, truth):
    got = {r["i"]: r["label"] for r in out.items.collect()}
    return sum(got.get(i) == t for i, t in truth.items() if i in got) / len(got)


def test_beats_the_majority(spark, scratch):
    judges = {"a": 0.95, "b": 0.9, "c": 0.55, "d": 0.55, "e": 0.25, "f": 0.3, "g": 0.55}
    truth, rows = made(3000, judges, ["same", "different"])
    out = message_passing(spark.createDataFrame(rows, "i int, j string, v string"), ["i"], "j", "v", ["same", "different"], scratch)
    votes = {}
    for i, _, v in rows:
        votes.setdefault(i, []).append(v)
    plain = sum(max(sorted(set(vs)), key=vs.count) == truth[i] for i, vs in votes.items()) / len(votes)
    assert accuracy(out, truth) > plain + 0.05 and out.rounds < 60
    skill = {r["annotator"]: (r["sensitivity"] + r["specificity"]) / 2 for r in out.annotators.collect()}
    assert all(abs(skill[j] - p) < 0.06 for j, p in judges.items())


def test_copying_judges_count_once(spark, scratch):
    judges = {"a": 0.6, "b": 0.6, "c": 0.6, "d": 0.85, "e": 0.85, "f": 0.8, "g": 0.8}
    truth, rows = made(4000, judges, ["same", "different"], copies=[("a", "c"), ("b", "c")], deny=0.2)
    out = message_passing(spark.createDataFrame(rows, "i int, j string, v string"), ["i"], "j", "v", ["same", "different"], scratch)
    assert {r["depends_on"] for r in out.annotators.filter("annotator in ('a', 'b', 'c')").collect()} == {"a,b,c"}
    assert out.annotators.filter("annotator not in ('a', 'b', 'c') and depends_on is not null").count() == 0
    # as good as with the true reliabilities of those that copy nobody
    odds = {j: math.log(judges[j] / (1 - judges[j])) for j in "defg"}
    belief = dict.fromkeys(truth, 0.0)
    for i, j, v in rows:
        belief[i] += odds.get(j, 0.0) * (1 if v == "same" else -1)
    best = sum((b >= 0) == (truth[i] == "same") for i, b in belief.items()) / len(truth)
    assert accuracy(out, truth) > best - 0.01


def test_several_classes(spark, scratch):
    truth, rows = made(2000, {"a": 0.9, "b": 0.85, "c": 0.8, "d": 0.4}, ["x", "y", "z"])
    out = message_passing(spark.createDataFrame(rows, "i int, j string, v string"), ["i"], "j", "v", ["x", "y", "z"], scratch)
    assert accuracy(out, truth) > 0.88 and {r["class"] for r in out.annotators.collect()} == {"x", "y", "z"}


def test_odd_votes(spark, scratch):
    v = spark.createDataFrame([(1, "a", "same"), (2, "a", "unclear"), (3, "a", "same"), (3, "b", "different")], "i int, j string, v string")
    out = {r["i"]: r for r in message_passing(v, ["i"], "j", "v", ["same", "different"], scratch).items.collect()}
    assert out[1]["label"] == "same" and out[1]["agreement"] is None and out[2]["label"] is None and out[3]["agreement"] == 0.0 and out[3]["votes"] == 2
    empty = message_passing(v.limit(0), ["i"], "j", "v", ["same", "different"], scratch)
    assert empty.items.count() == 0 and empty.annotators.count() == 0


def test_latest_usable_vote(spark):
    log = spark.createDataFrame([(1, "a", "same", 1), (1, "a", "different", 2), (1, "a", None, 3), (None, "a", "same", 1), (1, None, "same", 1), (2, "a", "same", 5), (2, "a", "same", 5)], "i int, j string, v string, t int")
    assert sorted(tuple(r) for r in latest_votes(log, ["i"], "j", "v", ["t"]).collect()) == [(1, "a", "different"), (2, "a", "same")]


@pytest.mark.parametrize(("said", "cls"), [(' "Same." ', "same"), ("same mandate", "same"), ("not same", "different"), ("Not the same", "different"), ("diff", "different"), ("DIFFERENT.", "different"), ("Unclear", "unclear"), ("refused", None), ("n/a", None), ("", None), (None, None)])
def test_verdicts(spark, said, cls):
    assert spark.createDataFrame([(said,)], "v string").select(verdict_class(F.col("v"))).first()[0] == cls


def test_both_forms_agree(spark, scratch, monkeypatch):
    truth, rows = made(600, {"a": 0.9, "b": 0.8, "c": 0.7, "d": 0.3, "e": 0.6}, ["same", "different"])
    votes = spark.createDataFrame(rows, "i int, j string, v string")
    few = {r["i"]: r["score"] for r in message_passing(votes, ["i"], "j", "v", ["same", "different"], scratch).items.collect()}
    monkeypatch.setattr("docketry.llm.consensus.LOOKUP", 3)
    many = {r["i"]: r["score"] for r in message_passing(votes, ["i"], "j", "v", ["same", "different"], scratch).items.collect()}
    assert few.keys() == many.keys() and all(abs(few[i] - many[i]) < 1e-9 for i in few)


def test_panels_grown_where_judges_disagree(spark, scratch):
    """Good judges called in where the first ones leave it open: they agree by their skill, not by copying."""
    r = random.Random(4)
    skill = {"a": 0.97, "b": 0.95, "c": 0.97, "d": 0.85, "e": 0.83, "f": 0.72, "g": 0.5, "h": 0.2}
    odds = {j: math.log(p / (1 - p)) for j, p in skill.items()}
    truth, rows = {}, []
    for i in range(6000):
        t = truth[i] = r.choice(["same", "different"])
        panel, said, total = r.sample("abdefgh", r.randint(3, 5)), {}, 0.0
        for j in [*panel, *[x for x in "cab" if x not in panel]]:
            if len(said) >= len(panel) and abs(total) > 2:
                break
            said[j] = t if r.random() < skill[j] else {"same": "different", "different": "same"}[t]
            total += odds[j] * (1 if said[j] == "same" else -1)
        rows += [(i, j, v) for j, v in said.items()]
    out = message_passing(spark.createDataFrame(rows, "i int, j string, v string"), ["i"], "j", "v", ["same", "different"], scratch, joint=False)
    best = {i: 0.0 for i in truth}
    for i, j, v in rows:
        best[i] += odds[j] * (1 if v == "same" else -1)
    known = sum((best[i] >= 0) == (truth[i] == "same") for i in truth) / len(truth)
    assert accuracy(out, truth) > known - 0.005
