"""Queries that compose others: live rows and why the rest fell out, the list of units, review checks, judges side by side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import rules as R
from ..functions import text as X
from ..operators.sampling import excluding
from ..operators.units import collapse
from ..runtime import table
from ..streaming import logs as L
from . import catalogue
from .catalogue import query
from .attach import STEM
from .links import EVERY, FILINGS, every_20th, filings, unit_sql
from .logs import LAST, USABLE, _hash, log
from .reports import FINAL, count_if, final_pairs
from .texts import CODE_NODE, END, FOLD, LAW_NODE, ONCE, SQUEEZED, YEAR, q, sql_case, sql_keys

#: Rhythms of a duty that keeps coming; event-driven duties are kept too.
RECURRING = ["weekly", "monthly", "quarterly", "semiannual", "annual", "biennial", "multi-year", "periodic", "other"]
LIVE = [*RECURRING, "event-driven"]
FREQUENCY = sql_case("lower(trim(coalesce(text, '')))", R.FREQUENCIES, "CASE WHEN lower(trim(coalesce(text, ''))) IN ('', 'unknown', 'none') THEN 'unknown' ELSE 'other' END", whole=False)
CURRENCY = f"""CASE WHEN coalesce(list_max(list_transform(regexp_extract_all(coalesce(text, ''), {q(END)}, 1), lambda y: CAST(y AS INT))) < {YEAR}, false) THEN 'expired' WHEN coalesce(contains(uslm_id, '/note'), false) AND contains({SQUEEZED.format('text')}, 'repeal') THEN 'expired'
    WHEN regexp_matches({SQUEEZED.format('text')}, {q(R.bounded(R.DOUBTFUL))}) THEN 'review' ELSE 'current' END"""
FATE = f"CASE WHEN {CURRENCY} <> 'current' THEN 'currency:' || ({CURRENCY}) WHEN {FREQUENCY} NOT IN ({', '.join(map(q, LIVE))}) THEN 'cadence:' || ({FREQUENCY}) ELSE 'live' END"


def fate() -> Column:
    """Of an adjudicated row (``uslm_id, text``): ``live``, or what it is dropped for, its currency first."""
    note = F.coalesce(F.col("uslm_id").contains("/note"), F.lit(False))
    now, when = R.currency(F.col("text"), C.terminal_year(F.col("text")), YEAR, note), R.frequency(F.col("text"))
    return F.when(now != "current", F.concat(F.lit("currency:"), now)).when(~when.isin(LIVE), F.concat(F.lit("cadence:"), when)).otherwise("live")


@query(f"SELECT {FATE} AS fate, count(*) AS n FROM mandate_gold WHERE gold.is_mandate GROUP BY 1")
def q_live_rows(spark: SparkSession, d: str) -> DataFrame:
    """Mandates that are in force and keep coming, and how many fall out for what."""
    return table(spark, d, "mandate_gold").filter("gold.is_mandate").groupBy(fate().alias("fate")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT lower(trim(coalesce(stratum, '?'))) AS stratum, {FREQUENCY} AS f FROM mandate_gold WHERE gold.is_mandate)
    SELECT stratum, count(*) AS every, count(*) FILTER (f NOT IN ('one-time', 'unknown')) AS standing, count(*) FILTER (f NOT IN ('one-time', 'unknown', 'event-driven')) AS scheduled FROM c GROUP BY 1""")
def q_candidate_scope(spark: SparkSession, d: str) -> DataFrame:
    """Mandates per stratum in three scopes: all, those that stand, those that stand and don't wait for an event."""
    f = R.frequency(F.col("text"))
    c = table(spark, d, "mandate_gold").filter("gold.is_mandate").select(F.lower(F.trim(F.coalesce("stratum", F.lit("?")))).alias("stratum"), f.alias("f"))
    return c.groupBy("stratum").agg(F.count("*").alias("every"), count_if(~F.col("f").isin("one-time", "unknown")).alias("standing"), count_if(~F.col("f").isin("one-time", "unknown", "event-driven")).alias("scheduled"))


@query(f"""WITH RECURSIVE {unit_sql(f"gold.is_mandate AND ({FATE}) = 'live'")}, m AS (SELECT unit, count(*) AS members FROM u GROUP BY 1),
    x AS (SELECT unit, members, translate(unit, {FOLD}) AS v FROM m), y AS (SELECT *, regexp_extract(v, {q(LAW_NODE)}, ['t', 'c', 'n', 's', 'r']) AS l, regexp_extract(v, {q(CODE_NODE)}, ['t', 's', 'r']) AS k FROM x)
    SELECT y.unit AS uslm_id, CASE WHEN l.t <> '' THEN 'Pub. L. ' || l.c || '-' || l.n || ', § ' || l.s || regexp_replace(l.r, '/([^/]+)', '(\\1)', 'g') || ' (' || rtrim(l.t, 'a') || ' U.S.C. App.)'
      WHEN k.t <> '' THEN k.t || ' U.S.C. ' || k.s || CASE WHEN regexp_matches(k.r, '(^|/)note/[^/]+$') THEN ' note' ELSE regexp_replace(k.r, '/([^/]+)', '(\\1)', 'g') END ELSE y.unit END AS citation, n.c AS cadence, members FROM y JOIN n ON n.id = y.unit""")
def q_discovered_list(spark: SparkSession, d: str) -> DataFrame:
    """Live mandates as units: node, citation, rhythm and how many rows each stands for."""
    g = table(spark, d, "mandate_gold").filter("gold.is_mandate").filter(fate() == "live")
    rows = g.select("gold_id", "uslm_id", X.entity_key(F.coalesce("gold.recipient", F.lit(""))).alias("entity"), R.frequency(F.col("text")).alias("cadence"), "text")
    units = collapse(rows, ("gold_id",)).groupBy("unit_id").agg(F.count("*").alias("members"))
    last = L.last_per_key(rows.filter("uslm_id is not null").select("uslm_id", "cadence", "gold_id"), ["uslm_id"], ["gold_id"])
    return units.join(last, F.col("unit_id") == F.col("uslm_id")).select("uslm_id", C.citation(F.col("uslm_id")).alias("citation"), "cadence", "members")


@query(f"""WITH {LAST}, v AS (SELECT judge, count(*) AS judged, count(*) FILTER (verdict = 'same') AS same, count(*) FILTER (verdict = 'different') AS different, count(*) FILTER (verdict = 'unclear') AS unclear, count(*) FILTER (verdict IS NULL OR verdict NOT IN ('same', 'different', 'unclear')) AS unusable FROM t GROUP BY 1)
    SELECT *, round(same / nullif(same + different, 0), 6) AS same_share FROM v""")
def q_judge_summary(spark: SparkSession, d: str) -> DataFrame:
    """Judges side by side: latest verdicts by kind, and the part that says "same" of those that decide."""
    t = L.last_per_key(log(spark, d).select("candidate_id", "judge", "verdict", "log_seq"), ["candidate_id", "judge"], ["log_seq"])
    v = F.col("verdict")
    g = t.groupBy("judge").agg(F.count("*").alias("judged"), *[count_if(v == k).alias(k) for k in USABLE], count_if(~F.coalesce(v.isin(USABLE), F.lit(False))).alias("unusable"))
    return g.withColumn("same_share", F.round(F.try_divide(F.col("same"), F.col("same") + F.col("different")), 6))


CADENCE = sql_case("t", R.CADENCES, f"CASE WHEN {ONCE} THEN 'one_time' ELSE 'other' END")


@query(f"""WITH r AS (SELECT mandate_id, lower(coalesce(when_expected, '')) AS t, list_max(list_transform(list_filter(string_split(regexp_replace(coalesce(when_expected, ''), '[^0-9A-Za-z]+', ' ', 'g'), ' '), lambda y: regexp_full_match(y, '20[0-9]{{2}}')), lambda y: CAST(y AS INT))) AS y FROM report),
    c AS (SELECT mandate_id, y, CASE WHEN t = '' THEN 'other' ELSE {CADENCE} END AS c FROM r)
    SELECT mandate_id, CASE WHEN c IN ('on_demand', 'event_driven', 'other') THEN c WHEN c <> 'one_time' THEN 'recurring' WHEN y BETWEEN {YEAR} AND {YEAR + 1} THEN 'one_time_in' WHEN y > {YEAR + 1} THEN 'one_time_future' ELSE 'one_time_out' END AS reason FROM c""")
def q_window_reason(spark: SparkSession, d: str) -> DataFrame:
    """Whether and why every mandate falls due in a stretch of years."""
    w = F.col("when_expected")
    return table(spark, d, "report").select("mandate_id", R.window_reason(R.cadence(w), C.deadline_year(w), YEAR, YEAR + 1).alias("reason"))


@query(f"""WITH r AS (SELECT mandate_id, translate(coalesce(authority, ''), {FOLD}) AS a FROM report), x AS (SELECT mandate_id, unnest(list_zip(regexp_extract_all(a, {q(C.USC_PATH)}, 1), regexp_extract_all(a, {q(C.USC_PATH)}, 2), regexp_extract_all(a, {q(C.USC_PATH)}, 3), regexp_extract_all(a, {q(C.USC_PATH)}, 4), regexp_extract_all(a, {q(C.USC_PATH)}, 5))) AS m FROM r)
    SELECT DISTINCT mandate_id, 'usc' AS kind, m[1] || ' U.S.C. ' || CASE WHEN m[2] <> '' THEN 'App. ' ELSE '' END || m[3] || m[4] || CASE WHEN m[5] <> '' THEN ' note' ELSE '' END AS cite FROM x
    UNION ALL SELECT mandate_id, 'plaw', unnest(list_transform({sql_keys('authority', C.PLAW)}, lambda k: 'Pub. L. ' || replace(k, '/', '-'))) FROM report UNION ALL SELECT mandate_id, 'stat', unnest(list_transform({sql_keys('authority', C.STAT)}, lambda k: replace(k, '/', ' Stat. '))) FROM report""")
def q_authority_cites(spark: SparkSession, d: str) -> DataFrame:
    """Everything that each mandate rests on, as it is cited."""
    return table(spark, d, "report").select("mandate_id", F.explode(C.authority(F.col("authority"))).alias("x")).select("mandate_id", "x.kind", "x.cite")


@query("""WITH s AS (SELECT count(*) FILTER (stage = 'A') AS a, count(*) FILTER (stage = 'A_validation') AS v, count(*) FILTER (stage = 'B') AS b, count(DISTINCT candidate_id) AS c FROM candidates)
    SELECT CAST(to_json(struct_pack(mandates := (SELECT count(*) FROM report), filings := struct_pack("rows" := (SELECT count(*) FROM submissions), packages := (SELECT count(DISTINCT package_id) FROM submissions)), candidates := struct_pack("pairs" := c, stages := struct_pack(a := a, a_validation := v, b := b)))) AS VARCHAR) AS document FROM s""")
def q_summary_document(spark: SparkSession, d: str) -> DataFrame:
    """Counters of all tables as one nested JSON document."""
    stage = lambda k: count_if(F.col("stage") == k)
    c = table(spark, d, "candidates").agg(F.struct(F.countDistinct("candidate_id").alias("pairs"), F.struct(stage("A").alias("a"), stage("A_validation").alias("a_validation"), stage("B").alias("b")).alias("stages")).alias("candidates"))
    s = table(spark, d, "submissions").agg(F.struct(F.count("*").alias("rows"), F.countDistinct("package_id").alias("packages")).alias("filings"))
    m = table(spark, d, "report").agg(F.count("*").alias("mandates"))
    return m.crossJoin(s).crossJoin(c).select(F.to_json(F.struct("mandates", "filings", "candidates")).alias("document"))  # one-row tables


@query(f"""WITH {FINAL}, {FILINGS}, o AS (SELECT * FROM f ANTI JOIN p USING (package_id)), gc AS (SELECT government_author, {STEM} AS stem, unnest(list_distinct(list_transform(list_filter(cite_refs.usc, lambda x: x[1] IS NOT NULL AND x[2] IS NOT NULL), lambda x: x[1] || '/' || x[2]))) AS cite FROM o)
    SELECT government_author, stem, cite, count(*) AS filings FROM gc GROUP BY 1, 2, 3""")
def q_gap_cites(spark: SparkSession, d: str) -> DataFrame:
    """What the unattached filings of each author and title cite: the union of a cluster's citations, a row for each."""
    o = filings(spark, d).join(final_pairs(spark, d), "package_id", "left_anti")
    usc = F.filter(C.flatten_references(F.col("cite_refs")), lambda x: x["kind"] == "usc")
    x = o.select("government_author", X.stem(F.col("title")).alias("stem"), F.explode(usc).alias("x"))
    return x.groupBy("government_author", "stem", F.concat("x.a", F.lit("/"), "x.b").alias("cite")).agg(F.count("*").alias("filings"))


@query(f"WITH {FINAL}, {FILINGS} SELECT government_author, {STEM} AS stem, package_id FROM f ANTI JOIN p USING (package_id)")
def q_gap_members(spark: SparkSession, d: str) -> DataFrame:
    """Unattached filings with the cluster each is in, a row per filing."""
    o = filings(spark, d).join(final_pairs(spark, d), "package_id", "left_anti")
    return o.select("government_author", X.stem(F.col("title")).alias("stem"), "package_id")


@query(f"""WITH r AS ({catalogue._SQL['q_first_requirement']}), t AS ({catalogue._SQL['q_link_top1']}), {FILINGS}
    SELECT f.package_id, coalesce(r.mandate_id, t.mandate_id) AS mandate_id, CASE WHEN r.mandate_id IS NOT NULL THEN 'requirement' WHEN t.mandate_id IS NOT NULL THEN 'title' ELSE 'none' END AS via FROM f LEFT JOIN r USING (package_id) LEFT JOIN t USING (package_id) WHERE {EVERY}""")
def q_one_mandate(spark: SparkSession, d: str) -> DataFrame:
    """One mandate for each filing: of its first requirement, else the one most like its title."""
    known = catalogue.queries()
    r = known["q_first_requirement"](spark, d).select("package_id", F.col("mandate_id").alias("r"))
    t = known["q_link_top1"](spark, d).select("package_id", F.col("mandate_id").alias("t"))
    f = filings(spark, d).filter(every_20th(F.col("package_id"))).select("package_id").join(r, "package_id", "left").join(t, "package_id", "left")
    return f.select("package_id", F.coalesce("r", "t").alias("mandate_id"), F.when(F.col("r").isNotNull(), "requirement").when(F.col("t").isNotNull(), "title").otherwise("none").alias("via"))


@query(f"WITH {FINAL}, o AS (SELECT DISTINCT package_id FROM submissions ANTI JOIN p USING (package_id)) SELECT package_id FROM o WHERE package_id NOT IN (SELECT package_id FROM candidates WHERE package_id IS NOT NULL) ORDER BY {_hash('package_id')}, package_id LIMIT 200")
def q_work_sample(spark: SparkSession, d: str) -> DataFrame:
    """Work for a trial run: two hundred filings without a match and never judged, in hash order."""
    o = table(spark, d, "submissions").select("package_id").distinct().join(final_pairs(spark, d), "package_id", "left_anti")
    return excluding(o, table(spark, d, "candidates").filter("package_id is not null"), "package_id", 200)


#: Checks of a reviewer, each a query whose rows are what it finds.
CHECKS = ["q_multi_attach", "q_dup_groups", "q_zero_coverage", "q_agency_without_rows", "q_pattern_counts", "q_uncovered", "q_orphans"]


def _checks() -> str:
    known = catalogue._SQL
    return " UNION ALL ".join(f"SELECT '{name.removeprefix('q_')}' AS finding, count(*) AS n FROM ({known[name]})" for name in CHECKS)


@query(_checks())
def q_audit_checks(spark: SparkSession, d: str) -> DataFrame:
    """How much each check of a review finds; the checks themselves are queries of their own."""
    known, out = catalogue.queries(), None
    for name in CHECKS:
        one = known[name](spark, d).agg(F.count("*").alias("n")).select(F.lit(name.removeprefix("q_")).alias("finding"), "n")
        out = one if out is None else out.unionByName(one)
    return out
