"""Queries that attach filings to mandates through requirements, and reports on what stays unattached."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import rules as R
from ..functions import text as X
from ..operators import judges, linkage
from ..operators.sampling import running
from ..runtime import table
from .catalogue import query
from .links import FILINGS, MULTI, filings
from .logs import LAST, log
from .reports import FINAL, count_if, final_pairs
from .texts import q, sql_keys, sql_tokens

#: Confident requirements: pairs of stage A whose latest verdict of some judge is "same".
REQUIRED = f"{LAST}, req AS (SELECT DISTINCT mandate_id, requirement_number FROM t WHERE stage = 'A' AND verdict = 'same' AND requirement_number IS NOT NULL)"


def required(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.logs import last_per_key

    x = log(spark, d).select("candidate_id", "judge", "mandate_id", "requirement_number", "stage", "verdict", "log_seq")
    last = last_per_key(x, ["candidate_id", "judge"], ["log_seq"])
    return last.filter("stage = 'A' and verdict = 'same' and requirement_number is not null").select("mandate_id", "requirement_number").distinct()


def package_requirements(spark: SparkSession, d: str) -> DataFrame:
    return filings(spark, d).select("package_id", "government_author", F.posexplode("requirement_numbers").alias("pos", "requirement_number")).filter("requirement_number is not null")


PACKAGE_REQUIREMENTS = "pr AS (SELECT package_id, government_author, unnest(requirement_numbers) AS requirement_number, unnest(range(0, len(requirement_numbers))) AS pos FROM f), pq AS (SELECT * FROM pr WHERE requirement_number IS NOT NULL)"
CHOICE = f"""ch AS (SELECT pq.package_id, pq.pos, pq.requirement_number, req.mandate_id, coalesce(pq.government_author = r.reporting_entity, false) AS fits FROM pq JOIN req USING (requirement_number) JOIN report r USING (mandate_id))"""


def _choices(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "report").select("mandate_id", "reporting_entity")
    x = package_requirements(spark, d).join(required(spark, d), "requirement_number").join(r, "mandate_id")
    return x.withColumn("fits", F.coalesce(F.col("government_author") == F.col("reporting_entity"), F.lit(False)))


@query(f"""WITH {REQUIRED}, {FILINGS}, {PACKAGE_REQUIREMENTS}, {CHOICE},
    w AS (SELECT *, max(fits::INT) OVER (PARTITION BY package_id, pos) AS any_fit, row_number() OVER (PARTITION BY package_id, pos ORDER BY mandate_id) AS rn FROM ch)
    SELECT DISTINCT package_id, mandate_id FROM w WHERE fits OR (any_fit = 0 AND rn = 1)""")
def q_attach_by_requirement(spark: SparkSession, d: str) -> DataFrame:
    """Filings attached through each of their requirements: to mandates of the same agency, else to the first."""
    c = _choices(spark, d).select("package_id", "pos", "mandate_id", "fits")
    return linkage.prefer(c, ["package_id", "pos"], F.col("fits"), [F.col("mandate_id")]).select("package_id", "mandate_id").distinct()


@query(f"""WITH {REQUIRED}, {FILINGS}, {PACKAGE_REQUIREMENTS}, {CHOICE}
    SELECT package_id, mandate_id, requirement_number FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY pos, fits DESC, mandate_id) AS rn FROM ch) WHERE rn = 1""")
def q_first_requirement(spark: SparkSession, d: str) -> DataFrame:
    """One mandate per filing: of its first requirement that has some, the agency's own first."""
    c = _choices(spark, d).withColumn("off", (~F.col("fits")).cast("int"))
    best = c.groupBy("package_id").agg(F.min(F.struct("pos", "off", "mandate_id", "requirement_number")).alias("b"))
    return best.select("package_id", "b.mandate_id", "b.requirement_number")


@query(f"""WITH {REQUIRED}, {FILINGS}, {PACKAGE_REQUIREMENTS} SELECT package_id FROM f ANTI JOIN (SELECT DISTINCT package_id FROM pq WHERE requirement_number IN (SELECT requirement_number FROM req)) USING (package_id)""")
def q_eligible_without_requirement(spark: SparkSession, d: str) -> DataFrame:
    """Filings without requirement, or with none that leads to a mandate."""
    hit = package_requirements(spark, d).join(required(spark, d).select("requirement_number").distinct(), "requirement_number", "left_semi").select("package_id").distinct()
    return filings(spark, d).select("package_id").join(hit, "package_id", "left_anti")


def _shared(kind: str, pattern: str) -> str:
    return f"len(list_intersect(list_distinct(list_transform(list_filter(coalesce(f.cite_refs.{kind}, []), lambda x: x[1] IS NOT NULL AND x[2] IS NOT NULL), lambda x: x[1] || '/' || x[2])), {sql_keys('r.authority', pattern)}))"


@query(f"""WITH {FINAL}, {FILINGS}, z AS (SELECT p.mandate_id, p.package_id, {_shared('usc', C.USC)} AS usc, {_shared('plaw', C.PLAW)} AS plaw, {_shared('stat', C.STAT)} AS stat, coalesce(f.government_author = r.reporting_entity, false) AS same_agency, {sql_tokens('f.title')} AS x, {sql_tokens('r.nature_of_report')} AS y FROM p JOIN report r USING (mandate_id) JOIN f USING (package_id))
    SELECT mandate_id, package_id, usc, plaw, stat, same_agency, round(CASE WHEN len(list_distinct(x || y)) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END, 6) AS similarity FROM z""")
def q_corroboration(spark: SparkSession, d: str) -> DataFrame:
    """What else speaks for each match: shared citations per kind, agency, similarity."""
    f = filings(spark, d).select("package_id", "government_author", C.flatten_references(F.col("cite_refs")).alias("k"), X.token_set(F.col("title")).alias("x"))
    r = table(spark, d, "report").select("mandate_id", "reporting_entity", C.parse_citations(F.col("authority")).alias("c"), X.token_set(F.col("nature_of_report")).alias("y"))
    z = final_pairs(spark, d).join(r, "mandate_id").join(f, "package_id")
    of = lambda kind: F.size(F.array_intersect(F.transform(F.filter("k", lambda x: x["kind"] == kind), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))), F.col(f"c.{kind}"))).cast("long").alias(kind)
    same = F.coalesce(F.col("government_author") == F.col("reporting_entity"), F.lit(False)).alias("same_agency")
    return z.select("mandate_id", "package_id", of("usc"), of("plaw"), of("stat"), same, F.round(X.jaccard(F.col("x"), F.col("y")), 6).alias("similarity"))


STEM = "array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(coalesce(title, '')), '(fiscal year|fy) ?[0-9]*|(19|20)[0-9][0-9]', ' ', 'g'), '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> '')[1:8], ' ')"


@query(f"""WITH {FINAL}, {FILINGS}, o AS (SELECT * FROM f ANTI JOIN p USING (package_id)), listed AS (SELECT DISTINCT unnest({sql_keys('authority', C.USC)}) AS k FROM report),
    oc AS (SELECT package_id, unnest(list_distinct(list_transform(list_filter(cite_refs.usc, lambda x: x[1] IS NOT NULL AND x[2] IS NOT NULL), lambda x: x[1] || '/' || x[2]))) AS k FROM o),
    h AS (SELECT package_id, count(*) AS cites, count(*) FILTER (k IN (SELECT k FROM listed)) AS present FROM oc GROUP BY 1)
    SELECT government_author, {STEM} AS stem, count(*) AS filings, CASE WHEN sum(coalesce(cites, 0)) = 0 THEN 'no_cite' WHEN sum(coalesce(present, 0)) > 0 THEN 'present' ELSE 'absent' END AS tier FROM o LEFT JOIN h USING (package_id) GROUP BY 1, 2""")
def q_gap_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Unattached filings by author and edition-free title, with whether the law they cite is on any list."""
    o = filings(spark, d).join(final_pairs(spark, d), "package_id", "left_anti")
    listed = table(spark, d, "report").select(F.explode(C.parse_citations(F.col("authority"))["usc"]).alias("k")).distinct().withColumn("on", F.lit(1))
    cites = o.select("package_id", F.explode(F.filter(C.flatten_references(F.col("cite_refs")), lambda x: x["kind"] == "usc")).alias("x")).select("package_id", F.struct(F.col("x.a").alias("a"), F.col("x.b").alias("b")).alias("k")).distinct()
    h = cites.join(listed, "k", "left").groupBy("package_id").agg(F.count("*").alias("cites"), F.count("on").alias("present"))
    g = o.join(h, "package_id", "left").groupBy("government_author", X.stem(F.col("title")).alias("stem")).agg(F.count("*").alias("filings"), F.sum("cites").alias("c"), F.sum("present").alias("p"))
    return g.select("government_author", "stem", "filings", F.when(F.coalesce("c", F.lit(0)) == 0, "no_cite").when(F.col("p") > 0, "present").otherwise("absent").alias("tier"))


@query(f"WITH {FILINGS} SELECT government_author, count(*) AS filings FROM f WHERE government_author IS NOT NULL AND government_author NOT IN (SELECT reporting_entity FROM report WHERE reporting_entity IS NOT NULL) GROUP BY 1")
def q_agency_without_rows(spark: SparkSession, d: str) -> DataFrame:
    """Authors of filings that no mandate names."""
    r = table(spark, d, "report").select(F.col("reporting_entity").alias("government_author")).filter("government_author is not null").distinct()
    return filings(spark, d).filter("government_author is not null").join(r, "government_author", "left_anti").groupBy("government_author").agg(F.count("*").alias("filings"))


@query(f"WITH {FINAL}, req AS (SELECT DISTINCT mandate_id FROM t WHERE stage = 'A' AND verdict = 'same'), u AS (SELECT mandate_id, 1 AS s FROM (SELECT DISTINCT mandate_id FROM p) UNION ALL SELECT mandate_id, 2 FROM req) SELECT mandate_id, count(*) AS sources FROM u GROUP BY 1")
def q_covered_ids(spark: SparkSession, d: str) -> DataFrame:
    """Mandates covered by a match or a requirement, and by how many of the two."""
    u = final_pairs(spark, d).select("mandate_id").distinct().unionByName(required(spark, d).select("mandate_id").distinct())
    return u.groupBy("mandate_id").agg(F.count("*").alias("sources"))


@query(f"""WITH a AS (SELECT {sql_keys('authority', C.USC)} AS u, {sql_keys('authority', C.PLAW)} AS p FROM report)
    SELECT count(*) AS mandates, count(*) FILTER (len(u) > 0) AS codified, count(*) FILTER (len(u) = 0 AND len(p) > 0) AS law_only, (SELECT count(DISTINCT k) FROM (SELECT unnest(u) AS k FROM a)) AS sections, (SELECT count(DISTINCT k) FROM (SELECT unnest(p) AS k FROM a)) AS laws FROM a""")
def q_authority_stats(spark: SparkSession, d: str) -> DataFrame:
    """Coverage of citations in one row, distinct counts exact."""
    c = table(spark, d, "report").select(C.parse_citations(F.col("authority")).alias("c"))
    n = lambda k: F.size(F.col(f"c.{k}"))
    base = c.agg(F.count("*").alias("mandates"), count_if(n("usc") > 0).alias("codified"), count_if((n("usc") == 0) & (n("plaw") > 0)).alias("law_only"))
    of = lambda k, name: c.select(F.explode(f"c.{k}").alias("k")).agg(F.countDistinct("k").alias(name))
    return base.crossJoin(of("usc", "sections")).crossJoin(of("plaw", "laws"))  # one-row tables


@query(f"""WITH {FINAL}, {FILINGS}, m AS (SELECT reporting_entity, count(*) AS mandates, count(DISTINCT p.mandate_id) AS covered FROM report LEFT JOIN (SELECT DISTINCT mandate_id FROM p) p USING (mandate_id) GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT p.mandate_id) = 0),
    s AS (SELECT government_author, count(*) AS filings FROM f GROUP BY 1) SELECT reporting_entity, mandates, coalesce(filings, 0) AS filings FROM m LEFT JOIN s ON s.government_author = m.reporting_entity""")
def q_zero_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Entities with three mandates or more of which none is covered, with the filings under their name."""
    covered = final_pairs(spark, d).select("mandate_id").distinct().withColumn("c", F.lit(1))
    m = table(spark, d, "report").select("mandate_id", "reporting_entity").join(covered, "mandate_id", "left").groupBy("reporting_entity").agg(F.count("*").alias("mandates"), F.count("c").alias("covered"))
    s = filings(spark, d).groupBy(F.col("government_author").alias("reporting_entity")).agg(F.count("*").alias("filings"))
    return m.filter("mandates >= 3 and covered = 0").join(s, "reporting_entity", "left").select("reporting_entity", "mandates", F.coalesce("filings", F.lit(0)).alias("filings"))


FAMILIES = [("foundation", "foundation"), ("centers", "centers"), ("bureau", "bureau"), ("department", "department|dept"), ("office", "office"), ("commission", "commission"), ("administration", "administration"), ("board", "board|council"), ("corporate", "corporation|institute|agency")]


@query("SELECT family, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(reporting_entity, '')), {q(R.bounded(p))}) THEN '{k}'" for k, p in FAMILIES) + " ELSE 'other' END AS family FROM report) GROUP BY 1")
def q_regex_family(spark: SparkSession, d: str) -> DataFrame:
    """Mandates by the first family of names that their entity fits."""
    family = R.first_match(F.lower(F.coalesce("reporting_entity", F.lit(""))), FAMILIES, F.lit("other"))
    return table(spark, d, "report").groupBy(family.alias("family")).agg(F.count("*").alias("n"))


@query(f"""WITH {LAST} SELECT candidate_id, count(*) AS judges, string_agg(judge || '=' || coalesce(verdict, '?'), ';' ORDER BY judge) AS said FROM t GROUP BY 1""")
def q_judge_pairing(spark: SparkSession, d: str) -> DataFrame:
    """What each judge said last on each candidate."""
    from ..streaming.logs import last_per_key

    last = last_per_key(log(spark, d).select("candidate_id", "judge", "verdict", "log_seq"), ["candidate_id", "judge"], ["log_seq"])
    said = F.transform(F.array_sort(F.collect_list(F.struct("judge", F.coalesce("verdict", F.lit("?")).alias("v")))), lambda s: F.concat(s["judge"], F.lit("="), s["v"]))
    return last.filter("judge is not null").groupBy("candidate_id").agg(F.count("*").alias("judges"), F.array_join(said, ";").alias("said"))


@query("""WITH p AS (SELECT mandate_id, concat_ws(chr(10), CASE WHEN trim(coalesce(reporting_entity, '')) <> '' THEN 'Entity: ' || trim(reporting_entity) END, CASE WHEN trim(coalesce(nature_of_report, '')) <> '' THEN 'Duty: ' || trim(nature_of_report) END) AS prompt FROM report)
    SELECT mandate_id, CASE CAST('0x' || left(md5(prompt), 8) AS BIGINT) % 3 WHEN 0 THEN 'same' WHEN 1 THEN 'different' ELSE 'unclear' END AS verdict FROM p""")
def q_stub_judge(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts of the deterministic test judge on assembled prompts."""
    p = table(spark, d, "report").select("mandate_id", judges.prompt(("Entity", F.col("reporting_entity")), ("Duty", F.col("nature_of_report"))).alias("prompt"))
    return judges.judge(p, "prompt", "stub").select("mandate_id", "verdict")


@query(f"""WITH {FILINGS}, n AS (SELECT count(*) AS multi FROM report WHERE reporting_entity = {q(MULTI)}), e AS (SELECT reporting_entity AS k, count(*) AS own FROM report GROUP BY 1)
    SELECT package_id, least(coalesce(own, 0), 400) + multi AS slice FROM f CROSS JOIN n LEFT JOIN e ON e.k = f.government_author AND e.k <> {q(MULTI)}""")
def q_agency_slice(spark: SparkSession, d: str) -> DataFrame:
    """Size of the slice of mandates each filing is shown: its agency's own up to 400, and those of several agencies."""
    e = table(spark, d, "report").groupBy(F.col("reporting_entity").alias("government_author")).agg(F.count("*").alias("own"))
    multi = e.filter(F.col("government_author") == MULTI).agg(F.coalesce(F.sum("own"), F.lit(0)).alias("multi"))
    f = filings(spark, d).select("package_id", "government_author").join(e.filter(F.col("government_author") != MULTI), "government_author", "left")
    return f.crossJoin(F.broadcast(multi)).select("package_id", (F.least(F.coalesce("own", F.lit(0)), F.lit(400)) + F.col("multi")).alias("slice"))  # one row


@query(f"""WITH {LAST} SELECT stage, count(*) AS n, count(*) FILTER (verdict IS NULL OR verdict NOT IN ('same', 'different', 'unclear')) AS unparsed FROM t GROUP BY 1""")
def q_unparsed_share(spark: SparkSession, d: str) -> DataFrame:
    """Latest verdicts that can't be used, per stage."""
    from ..streaming.logs import last_per_key

    last = last_per_key(log(spark, d).select("candidate_id", "judge", "stage", "verdict", "log_seq"), ["candidate_id", "judge"], ["log_seq"])
    return last.groupBy("stage").agg(F.count("*").alias("n"), count_if(~F.coalesce(F.col("verdict").isin("same", "different", "unclear"), F.lit(False))).alias("unparsed"))


@query("""SELECT doc_id, max(text) OVER w = text AS last_of_run, row_number() OVER w AS place FROM (SELECT doc_id, text, uslm_id, doc_kind FROM documents WHERE uslm_id IS NOT NULL) WINDOW w AS (PARTITION BY uslm_id, doc_kind ORDER BY doc_id)""")
def q_running_rank(spark: SparkSession, d: str) -> DataFrame:
    """Place of each document among those of its node and kind, and whether its text sorts last so far."""
    x = table(spark, d, "documents").filter("uslm_id is not null").select("doc_id", "text", "uslm_id", F.coalesce("doc_kind", F.lit("")).alias("kind"))
    out = running(x, ["uslm_id", "kind"], "doc_id", "text")
    return out.select("doc_id", (F.col("most") == F.col("text")).alias("last_of_run"), "place")
