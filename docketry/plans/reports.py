"""Report-level aggregates, measures and vector queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rules as R
from ..operators import metrics as V
from ..runtime import table
from ..streaming import logs as L
from .catalogue import query
from .links import FILINGS, filings
from .logs import LAST, USABLE, log
from .texts import sql_case

AS_OF = "2025-06-30"


def count_if(c: Column) -> Column:
    return F.sum(F.coalesce(c, F.lit(False)).cast("long"))


def day(c: Column) -> Column:
    """ISO date of a string, null if it is none; other orders and impossible days are no dates."""
    return F.when(c.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c))


SQL_DAY = "CASE WHEN regexp_matches({0}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST({0} AS DATE) END"


def final_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that hold: two judges or more, all saying "same"; one row per mandate and package, with the stages."""
    last = L.last_per_key(log(spark, d).select("candidate_id", "mandate_id", "package_id", "stage", "judge", "verdict", "log_seq"), ["candidate_id", "judge"], ["log_seq"])
    v = L.majority(last, ["candidate_id", "mandate_id", "package_id", "stage"], "verdict", USABLE).filter("verdict = 'same' and package_id is not null")
    return v.groupBy("mandate_id", "package_id").agg(F.min("stage").alias("via"))


FINAL = f"""{LAST}, c AS (SELECT candidate_id, mandate_id, package_id, stage, count(*) FILTER (verdict IN ('same', 'different', 'unclear')) AS n, count(DISTINCT verdict) FILTER (verdict IN ('same', 'different', 'unclear')) AS k, min(verdict) FILTER (verdict IN ('same', 'different', 'unclear')) AS v FROM t GROUP BY 1, 2, 3, 4),
    p AS (SELECT mandate_id, package_id, min(stage) AS via FROM c WHERE n >= 2 AND k = 1 AND v = 'same' AND package_id IS NOT NULL GROUP BY 1, 2)"""


@query(f"WITH {FINAL} SELECT mandate_id, package_id, via FROM p")
def q_final_matches(spark: SparkSession, d: str) -> DataFrame:
    """Matches after judging, each pair once."""
    return final_pairs(spark, d)


@query(f"WITH {FINAL} SELECT mandate_id FROM report ANTI JOIN p USING (mandate_id)")
def q_uncovered(spark: SparkSession, d: str) -> DataFrame:
    """Mandates without a match."""
    return table(spark, d, "report").select("mandate_id").join(final_pairs(spark, d), "mandate_id", "left_anti")


@query(f"WITH {FINAL} SELECT DISTINCT package_id FROM submissions ANTI JOIN p USING (package_id)")
def q_orphans(spark: SparkSession, d: str) -> DataFrame:
    """Filings without a match."""
    return table(spark, d, "submissions").select("package_id").distinct().join(final_pairs(spark, d), "package_id", "left_anti")


@query(f"""WITH {FINAL} SELECT mandate_id, count(package_id) AS submission_count, coalesce(string_agg(package_id, ',' ORDER BY package_id), '') AS packages FROM report LEFT JOIN p USING (mandate_id) GROUP BY 1""")
def q_nest_edges(spark: SparkSession, d: str) -> DataFrame:
    """Packages of every mandate, with the mandates that have none."""
    e = final_pairs(spark, d).groupBy("mandate_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("package_id")), ",").alias("p"))
    return table(spark, d, "report").select("mandate_id").join(e, "mandate_id", "left").select("mandate_id", F.coalesce("n", F.lit(0)).alias("submission_count"), F.coalesce("p", F.lit("")).alias("packages"))


@query(f"""WITH {FINAL}, m AS (SELECT r.mandate_id, reporting_entity, count(package_id) AS n FROM report r LEFT JOIN p USING (mandate_id) GROUP BY 1, 2)
    SELECT reporting_entity, count(*) AS mandates, count(*) FILTER (n > 0) AS covered, CAST(sum(n) AS BIGINT) AS submissions, round(count(*) FILTER (n > 0) / count(*), 6) AS share FROM m GROUP BY 1 HAVING count(*) >= 3""")
def q_entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Mandates, covered ones and filings per entity with three mandates or more."""
    n = final_pairs(spark, d).groupBy("mandate_id").agg(F.count("*").alias("n"))
    m = table(spark, d, "report").select("mandate_id", "reporting_entity").join(n, "mandate_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    g = m.groupBy("reporting_entity").agg(F.count("*").alias("mandates"), count_if(F.col("n") > 0).alias("covered"), F.sum("n").alias("submissions"))
    return g.filter("mandates >= 3").withColumn("share", F.round(F.col("covered") / F.col("mandates"), 6))


@query(f"""WITH {FINAL} SELECT (SELECT count(*) FROM report) AS mandates, (SELECT count(DISTINCT package_id) FROM submissions) AS packages, (SELECT count(*) FROM p) AS pairs, (SELECT count(DISTINCT mandate_id) FROM p) AS covered, (SELECT count(DISTINCT package_id) FROM p) AS attached""")
def q_summary(spark: SparkSession, d: str) -> DataFrame:
    """Counters of the whole linkage in one row."""
    p = final_pairs(spark, d).agg(F.count("*").alias("pairs"), F.countDistinct("mandate_id").alias("covered"), F.countDistinct("package_id").alias("attached"))
    m, s = table(spark, d, "report").agg(F.count("*").alias("mandates")), table(spark, d, "submissions").agg(F.countDistinct("package_id").alias("packages"))
    return m.crossJoin(s).crossJoin(p)  # three one-row tables


@query(f"""WITH {FINAL}, {FILINGS}, newest AS (SELECT p.mandate_id, max({SQL_DAY.format('f.date_issued')}) AS latest FROM p JOIN f USING (package_id) GROUP BY 1),
    r AS (SELECT mandate_id, lower(coalesce(when_expected, '')) AS t FROM report), k AS (SELECT mandate_id, {sql_case('t', R.CADENCES, "'other'")} AS c FROM r),
    w AS (SELECT mandate_id, c AS cadence, CASE c {' '.join(f"WHEN '{k}' THEN {v}" for k, v in R.FRESHNESS.items())} END AS fresh_days FROM k)
    SELECT mandate_id, cadence, CAST(fresh_days AS INT) AS fresh_days, date_diff('day', latest, DATE '{AS_OF}') AS days_since, CASE WHEN latest IS NULL THEN 'never' ELSE 'stale' END AS reason
    FROM w LEFT JOIN newest USING (mandate_id) WHERE fresh_days IS NOT NULL AND (latest IS NULL OR date_diff('day', latest, DATE '{AS_OF}') > fresh_days)""")
def q_overdue_staleness(spark: SparkSession, d: str) -> DataFrame:
    """Recurring mandates whose latest filing is older than their rhythm allows on a given day."""
    latest = final_pairs(spark, d).join(filings(spark, d).select("package_id", day(F.col("date_issued")).alias("at")), "package_id").groupBy("mandate_id").agg(F.max("at").alias("latest"))
    r = table(spark, d, "report").select("mandate_id", R.cadence(F.col("when_expected")).alias("cadence")).withColumn("fresh_days", R.freshness_days(F.col("cadence"))).filter("fresh_days is not null")
    out = r.join(latest, "mandate_id", "left").withColumn("days_since", F.datediff(F.lit(AS_OF).cast("date"), "latest").cast("long"))
    return out.filter("latest is null or days_since > fresh_days").select("mandate_id", "cadence", "fresh_days", "days_since", F.when(F.col("latest").isNull(), "never").otherwise("stale").alias("reason"))


@query(f"""WITH {FILINGS} SELECT government_author, count(*) AS n, count(*) FILTER (lower(is_on_time) = 'true') AS on_time, count(*) FILTER (lower(is_on_time) IN ('true', 'false')) AS known,
    round(count(*) FILTER (lower(is_on_time) = 'true') / nullif(count(*) FILTER (lower(is_on_time) IN ('true', 'false')), 0), 6) AS rate FROM f GROUP BY 1""")
def q_on_time_rate(spark: SparkSession, d: str) -> DataFrame:
    """On-time rate per author, unknown states left out."""
    t = F.lower("is_on_time")
    g = filings(spark, d).groupBy("government_author").agg(F.count("*").alias("n"), count_if(t == "true").alias("on_time"), count_if(t.isin("true", "false")).alias("known"))
    return g.withColumn("rate", F.round(F.try_divide("on_time", "known"), 6))


@query("""SELECT nature_of_report, authority, count(*) AS n, min(mandate_id) AS first_id FROM report GROUP BY 1, 2 HAVING count(*) > 1""")
def q_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of rows that state the same duty exactly."""
    g = table(spark, d, "report").groupBy("nature_of_report", "authority").agg(F.count("*").alias("n"), F.min("mandate_id").alias("first_id"))
    return g.filter("n > 1")


@query("""SELECT source, count(*) FILTER (doc_kind = 'provision') AS provision, count(*) FILTER (doc_kind = 'note') AS note, count(*) FILTER (coalesce(doc_kind, '') NOT IN ('provision', 'note')) AS other FROM documents GROUP BY 1""")
def q_pivot_agency(spark: SparkSession, d: str) -> DataFrame:
    """Documents per source and kind."""
    k = F.coalesce(F.col("doc_kind"), F.lit(""))
    return table(spark, d, "documents").groupBy("source").agg(count_if(k == "provision").alias("provision"), count_if(k == "note").alias("note"), count_if(~k.isin("provision", "note")).alias("other"))


@query(f"""WITH {FINAL}, {FILINGS}, e AS (SELECT reporting_entity AS entity, count(*) AS n FROM report WHERE reporting_entity IS NOT NULL GROUP BY 1), a AS (SELECT government_author AS entity, count(*) AS m FROM f GROUP BY 1)
    SELECT (SELECT count(DISTINCT mandate_id) FROM p) AS floor, CAST(sum(least(n, coalesce(m, 0))) AS BIGINT) AS ceiling FROM e LEFT JOIN a USING (entity)""")
def q_floor_ceiling(spark: SparkSession, d: str) -> DataFrame:
    """Covered mandates, and how many could be at most by filings at hand per entity."""
    e = table(spark, d, "report").filter("reporting_entity is not null").groupBy(F.col("reporting_entity").alias("entity")).agg(F.count("*").alias("n"))
    a = filings(spark, d).groupBy(F.col("government_author").alias("entity")).agg(F.count("*").alias("m"))
    top = e.join(a, "entity", "left").agg(F.sum(F.least("n", F.coalesce("m", F.lit(0)))).alias("ceiling"))
    return final_pairs(spark, d).agg(F.countDistinct("mandate_id").alias("floor")).crossJoin(top)  # two one-row tables


FUNNEL = [("no_entity", "trim(coalesce(reporting_entity, '')) = ''"), ("no_authority", "trim(coalesce(authority, '')) = ''"), ("no_timing", "trim(coalesce(when_expected, '')) = ''"), ("no_page", "page is null")]


@query("SELECT CASE " + " ".join(f"WHEN {p} THEN '{k}'" for k, p in FUNNEL) + " ELSE 'kept' END AS screen, count(*) AS n FROM report GROUP BY 1")
def q_scope_funnel(spark: SparkSession, d: str) -> DataFrame:
    """Rows by the first screen they fail."""
    screen = None
    for k, p in FUNNEL:
        screen = F.when(F.expr(p), k) if screen is None else screen.when(F.expr(p), k)
    return table(spark, d, "report").groupBy(screen.otherwise("kept").alias("screen")).agg(F.count("*").alias("n"))


@query(f"WITH {FINAL}, had AS (SELECT DISTINCT mandate_id, true AS covered FROM p), r AS (SELECT * FROM report LEFT JOIN had USING (mandate_id)) " + " UNION ALL ".join(f"SELECT '{k}' AS rule, count(*) FILTER ({p}) AS n, count(*) FILTER (({p}) AND covered) AS covered FROM r" for k, p in FUNNEL))
def q_scope_sensitivity(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping screens side by side, in one pass over the rows."""
    c = final_pairs(spark, d).select("mandate_id").distinct().withColumn("covered", F.lit(True))
    r = table(spark, d, "report").select("mandate_id", "reporting_entity", "authority", "when_expected", "page").join(c, "mandate_id", "left")
    one = r.agg(*[x for k, p in FUNNEL for x in (count_if(F.expr(p)).alias(f"n_{k}"), count_if(F.expr(p) & F.col("covered")).alias(f"c_{k}"))])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"n_{k}").alias("n"), F.col(f"c_{k}").alias("covered")) for k, _ in FUNNEL]))
    return one.select(rows.alias("x")).select("x.*")


@query(f"WITH {FINAL} SELECT package_id, count(*) AS mandates FROM p GROUP BY 1 HAVING count(*) > 1")
def q_multi_attach(spark: SparkSession, d: str) -> DataFrame:
    """Packages attached to several mandates."""
    return final_pairs(spark, d).groupBy("package_id").agg(F.count("*").alias("mandates")).filter("mandates > 1")


@query(f"""WITH {FINAL}, {FILINGS} SELECT reporting_entity, government_author, count(*) AS n FROM p JOIN report USING (mandate_id) JOIN f USING (package_id) WHERE reporting_entity IS DISTINCT FROM government_author GROUP BY 1, 2""")
def q_pattern_counts(spark: SparkSession, d: str) -> DataFrame:
    """Matched pairs whose agencies are written differently, by pattern."""
    r, f = table(spark, d, "report").select("mandate_id", "reporting_entity"), filings(spark, d).select("package_id", "government_author")
    x = final_pairs(spark, d).join(r, "mandate_id").join(f, "package_id").filter(~F.col("reporting_entity").eqNullSafe(F.col("government_author")))
    return x.groupBy("reporting_entity", "government_author").agg(F.count("*").alias("n"))


@query(f"""WITH {LAST} SELECT least(n, 3) AS judges, count(*) AS candidates FROM (SELECT candidate_id, count(*) AS n FROM t GROUP BY 1) GROUP BY 1""")
def q_capped_hist(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by number of judges, three and more together."""
    last = log(spark, d).select("candidate_id", "judge").distinct().groupBy("candidate_id").agg(F.count("*").alias("n"))
    return last.groupBy(F.least("n", F.lit(3)).alias("judges")).agg(F.count("*").alias("candidates"))


@query(f"""WITH {LAST} SELECT judge, count(*) AS attempts, CAST(sum(latency_ms) AS BIGINT) AS latency_ms, count(*) FILTER (verdict IN ('same', 'different', 'unclear')) AS usable FROM l GROUP BY 1""")
def q_usage_totals(spark: SparkSession, d: str) -> DataFrame:
    """Attempts, time and usable verdicts per judge."""
    return log(spark, d).groupBy("judge").agg(F.count("*").alias("attempts"), F.sum("latency_ms").alias("latency_ms"), count_if(F.col("verdict").isin(USABLE)).alias("usable"))


STRATUM = "regexp_replace(lower(trim(stratum)), '[^a-z0-9]+', '_', 'g')"


def _gold(spark: SparkSession, d: str) -> DataFrame:
    s = F.regexp_replace(F.lower(F.trim("stratum")), "[^a-z0-9]+", "_").alias("stratum")
    return table(spark, d, "mandate_gold").select("gold_id", s, F.col("gold.is_mandate").alias("truth"), F.col("gold_congressional").alias("guess"))


@query(f"""WITH g AS (SELECT {STRATUM} AS stratum, gold.is_mandate AS t, gold_congressional AS g FROM mandate_gold), c AS (SELECT stratum, count(*) FILTER (t AND g) AS tp, count(*) FILTER (NOT t AND g) AS fp, count(*) FILTER (t AND NOT g) AS fn, count(*) FILTER (NOT t AND NOT g) AS tn FROM g WHERE t IS NOT NULL AND g IS NOT NULL GROUP BY 1)
    SELECT stratum, tp, fp, fn, tn, tp / nullif(tp + fn, 0) AS recall, tp / nullif(tp + fp, 0) AS precision, 5 * tp / nullif(5 * tp + 4 * fn + fp, 0) AS f2, (tp + tn) / nullif(tp + fp + fn + tn, 0) AS accuracy FROM c""")
def q_confusion_f2(spark: SparkSession, d: str) -> DataFrame:
    """Confusion matrix and its measures per stratum."""
    return V.confusion(_gold(spark, d), F.col("truth"), F.col("guess"), ["stratum"])


@query(f"""WITH g AS (SELECT {STRATUM} AS stratum, gold.is_mandate AS t FROM mandate_gold WHERE stratum IS NOT NULL), s AS (SELECT stratum, count(*) AS size, count(t) AS n, avg(CAST(t AS DOUBLE)) AS p FROM g GROUP BY 1), w AS (SELECT *, size / sum(size) OVER () AS w FROM s)
    SELECT round(sum(w * p), 9) AS rate, round(1.96 * sqrt(sum(w * w * p * (1 - p) / n)), 9) AS half_width FROM w WHERE n > 0""")
def q_weighted_ci(spark: SparkSession, d: str) -> DataFrame:
    """Stratum-weighted rate with its interval."""
    g = _gold(spark, d).filter("stratum is not null")
    out = V.weighted_rate(g, "stratum", F.col("truth"), g.groupBy("stratum").agg(F.count("*").alias("size")), "size")
    return out.select(F.round("rate", 9).alias("rate"), F.round("half_width", 9).alias("half_width"))


KS = [50, 100, 500]
RANKED = "length(nature_of_report) DESC NULLS LAST, mandate_id"


@query("WITH r AS (SELECT mandate_id, coalesce(contains(lower(authority), 'note'), false)::INT AS rel, row_number() OVER (ORDER BY " + RANKED + ") AS rank FROM report) " + " UNION ALL ".join(f"SELECT {k} AS k, round(sum(rel) FILTER (rank <= {k}) / sum(rel), 9) AS recall FROM r" for k in KS))
def q_recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    """Part of the rows citing a note among the longest duties."""
    r = table(spark, d, "report").select("mandate_id", F.length("nature_of_report").alias("n"), F.coalesce(F.lower("authority").contains("note"), F.lit(False)).alias("rel"))
    out = V.recall_at(r, F.col("rel"), [F.desc_nulls_last("n"), F.col("mandate_id")], KS)
    return out.select("k", F.round("recall", 9).alias("recall"))


@query("""WITH q AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 20 = 0), r AS (SELECT vec_id AS id, embedding AS x FROM embeddings WHERE label = 0)
    SELECT q.vec_id, round(max(list_dot_product(CAST(e AS DOUBLE[]), CAST(x AS DOUBLE[])) / (greatest(sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))), 1e-12) * greatest(sqrt(list_dot_product(CAST(x AS DOUBLE[]), CAST(x AS DOUBLE[]))), 1e-12))), 5) AS cosine FROM q CROSS JOIN r GROUP BY 1""")
def q_vec_max_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Greatest cosine of every twentieth vector to those of one label."""
    e = table(spark, d, "embeddings")
    out = V.max_cosine(e.filter("vec_id % 20 = 0"), "vec_id", "embedding", e.filter("label = 0"))
    return out.select("vec_id", F.round("cosine", 5).alias("cosine"))


@query("""SELECT mandate_id AS id, 'report' AS source FROM report WHERE page IS NULL UNION ALL SELECT package_id, 'submissions' FROM submissions WHERE cite_refs IS NULL""")
def q_union_sources(spark: SparkSession, d: str) -> DataFrame:
    """Union of two candidate streams with an origin."""
    a = table(spark, d, "report").filter("page is null").select(F.col("mandate_id").alias("id"), F.lit("report").alias("source"))
    return a.unionByName(table(spark, d, "submissions").filter("cite_refs is null").select(F.col("package_id").alias("id"), F.lit("submissions").alias("source")))


@query("SELECT mandate_id FROM candidates WHERE stage = 'A' INTERSECT SELECT mandate_id FROM candidates WHERE stage = 'B'")
def q_intersect(spark: SparkSession, d: str) -> DataFrame:
    """Mandates judged in both stages."""
    c = table(spark, d, "candidates").select("mandate_id", "stage")
    return c.filter("stage = 'A'").select("mandate_id").intersect(c.filter("stage = 'B'").select("mandate_id"))


@query("SELECT mandate_id FROM report EXCEPT SELECT mandate_id FROM candidates")
def q_except(spark: SparkSession, d: str) -> DataFrame:
    """Mandates never judged."""
    return table(spark, d, "report").select("mandate_id").subtract(table(spark, d, "candidates").select("mandate_id"))


@query(f"""WITH {LAST}, w AS (SELECT candidate_id, verdict FROM t QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY log_seq DESC) = 1), every AS (SELECT DISTINCT candidate_id, stage FROM l)
    SELECT candidate_id, stage, CASE WHEN verdict IN ('same', 'different', 'unclear') THEN verdict ELSE CASE WHEN stage = 'A_validation' THEN 'same' ELSE 'unclear' END END AS verdict FROM every JOIN w USING (candidate_id)""")
def q_override_coalesce(spark: SparkSession, d: str) -> DataFrame:
    """Gate's default overridden by the latest usable verdict."""
    x = log(spark, d).select("candidate_id", "stage", "verdict", "log_seq")
    last = L.last_per_key(x, ["candidate_id"], ["log_seq"])
    default = F.when(F.col("stage") == "A_validation", "same").otherwise("unclear")
    return last.select("candidate_id", "stage", F.when(F.col("verdict").isin(USABLE), F.col("verdict")).otherwise(default).alias("verdict"))
