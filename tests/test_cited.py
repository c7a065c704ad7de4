import random
from collections import defaultdict

import pytest

from docketry.operators import cited as D
from docketry.plans import stages as Q


def written(spark, run):
    """Records that the stages of ``run`` write to shuffles."""
    sc = spark.sparkContext._jsc.sc()

    def total():
        sc.listenerBus().waitUntilEmpty(30_000)
        seen = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (seen.apply(i) for i in range(seen.size()))}

    before = total()
    out = run()
    return out, sum(n for k, n in total().items() if k not in before)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Sixty requirements whose filings all cite a section that two thousand mandates name."""
    d, r = str(tmp_path_factory.mktemp("cited")), random.Random(5)
    words = [f"word{i}" for i in range(12)]
    text = lambda: " ".join(r.sample(words, r.randint(1, 5)))
    report = [(f"M{i:04}", r.choice(["A", "B", "C", None, Q.MULTI]), text() if i % 9 else None, "1 U.S.C. 1" + ("; Pub. L. 110-5" if i % 4 == 0 else "") + ("; 3 Stat. 7" if i % 10 == 0 else "")) for i in range(2000)]
    subs = []
    for i in range(120):
        refs = ([["1", "1"]], [["110", "5"]] if i % 3 == 0 else None, [["3", "7"]] if i % 7 == 0 else None) if i < 110 else None
        subs.append((f"P{i:03}", None if i % 11 == 0 else " " if i % 13 == 0 else text() if i % 5 else f"other{i}", r.choice(["A", "B", None]), [str(i % 60)], refs, "2020-01-01", 1))
    spark.createDataFrame(report, "mandate_id string, reporting_entity string, nature_of_report string, authority string").coalesce(3).write.parquet(f"{d}/report.parquet")
    cite = "struct<usc:array<array<string>>,plaw:array<array<string>>,stat:array<array<string>>>"
    s = spark.createDataFrame(subs, f"package_id string, title string, government_author string, requirement_numbers array<string>, cite_refs {cite}, date_issued string, fetched_at int").coalesce(2)
    s.selectExpr("*", "'x' as is_on_time", "'x' as doc_class", "'x' as organization_full").write.parquet(f"{d}/submissions.parquet")
    return d, report, subs


def brute(report, subs):
    """requirement: [(v, -kinds, -thousandths, mandate, agency)], sorted."""
    tokens = lambda t: set((t or "").split())
    by = defaultdict(list)
    for s in sorted(subs):
        by[s[3][0]].append(s)
    out = {}
    for q, own in by.items():
        title = next((s[1] for s in own if (s[1] or "").strip()), "")
        cited = {k for s in own for k, refs in enumerate(s[4] or ()) if refs}
        out[q] = []
        for m, e, n, a in report:
            kinds = len({k for k, name in enumerate(("U.S.C.", "Pub.", "Stat.")) if name in a} & cited)
            x, y = tokens(title), tokens(n)
            shared, either, agency = len(x & y), len(x | y), e == Q.MULTI or e is not None and e in {s[2] for s in own}
            j = shared / either if either else 1.0
            v = (0 if kinds >= 2 and agency else 1 if agency else 2) if not title else (0 if j >= 0.4 and (kinds >= 2 or agency) else 1 if j >= 0.2 else 2)
            if kinds:
                out[q].append((v, -kinds, -((2000 * shared + either) // (2 * either) if either else 1000), m, agency))
        out[q].sort()
    return out


@pytest.mark.parametrize("block", [1024, 20])
def test_a_citation_of_all_requirements_and_mandates(spark, tables, monkeypatch, block):
    """120,000 pairs and more share a citation; what is shuffled are a few rows per requirement."""
    monkeypatch.setattr(D, "BLOCK", block)
    monkeypatch.setattr(D, "TILE", 1000)
    d, report, subs = tables
    want = brute(report, subs)
    live = {q for q, rows in want.items() if rows and rows[0][0] < 2}
    assert 0 < len(live) < 60
    got, n = written(spark, lambda: {r[0] for r in Q.q_all_requirements_unmatched(spark, d).collect()})
    assert got == {s[0] for s in subs if s[3][0] not in live} and n < 20_000


def test_filings_attach_to_confident_mandates(spark, tables):
    """Those of the filing's agency, else the first of its requirement; no pair is shuffled that isn't confident."""
    d, report, subs = tables
    entity, nature, sure = {m[0]: m[1] for m in report}, {m[0]: m[2] for m in report}, {q: [x[3] for x in rows if x[0] == 0] for q, rows in brute(report, subs).items()}
    want = set()
    for p, title, author, (q,), *_ in subs:
        fits = [m for m in sure[q] if author is not None and entity[m] == author] or sorted(sure[q])[:1]
        for m in fits:
            x, y = {*(title or "").split()}, {*(nature[m] or "").split()}
            want.add((p, m, (len(x & y) / len(x | y) if x | y else 1.0) < 0.1))
    got, n = written(spark, lambda: {tuple(r) for r in Q.q_attach_stage_a(spark, d).collect()})
    assert got == want and want and n < 100_000


def test_best_mandate_of_every_requirement(spark, tables):
    """By verdict, kinds, similarity and id; a requirement that shares nothing has none."""
    d, report, subs = tables
    want = {}
    for q, rows in brute(report, subs).items():
        if not rows:
            want[q] = (None, "no_match", "no citation in common")
            continue
        v, k, j, m, agency = rows[0]
        why = f"{'best rejected: ' * (v == 2)}{-k} kinds of citation; similarity {-j / 1000:.3f}" + "; same agency" * agency
        want[q] = (m if v < 2 else None, ("confident", "candidate", "no_match")[v], why)
    got, n = written(spark, lambda: {r[0]: tuple(r[1:]) for r in Q.q_link_verdict_a(spark, d).collect()})
    assert got == want and n < 20_000
