"""Queries of the linkage operators. Searches take every filing or mandate whose number is divisible by 20."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import rules as R
from ..functions import text as X
from ..operators import linkage as J
from ..operators.search import top_k_overlap, top_k_united
from ..operators.units import DUTY, collapse, nearest_ancestor
from ..operators.within import best_within
from ..runtime import table
from .catalogue import query
from .texts import FOLD, q, sql_case, sql_keys, sql_norm, sql_tokens

#: Fixed value: name of the entry that stands for several agencies at once.
MULTI = "Combined Departments Reporting Jointly"
ROUND = 6


def every_20th(c: Column) -> Column:
    """Stated query set of a search: the number in an id is divisible by 20."""
    return F.regexp_extract(c, "([0-9]+)$", 1).try_cast("long") % 20 == 0


def filings(spark: SparkSession, d: str) -> DataFrame:
    """One row per package: the first fetch."""
    keep = ("title", "government_author", "requirement_numbers", "cite_refs", "date_issued", "is_on_time", "doc_class", "organization_full")
    s = table(spark, d, "submissions")
    return s.groupBy("package_id").agg(F.min_by(F.struct(*keep), F.struct("fetched_at", "title")).alias("s")).select("package_id", "s.*")


FILINGS = """f AS (SELECT package_id, r.title AS title, r.government_author AS government_author, r.requirement_numbers AS requirement_numbers, r.cite_refs AS cite_refs, r.date_issued AS date_issued, r.is_on_time AS is_on_time, r.doc_class AS doc_class
    FROM (SELECT package_id, arg_min(struct_pack(title := title, government_author := government_author, requirement_numbers := requirement_numbers, cite_refs := cite_refs, date_issued := date_issued, is_on_time := is_on_time, doc_class := doc_class), struct_pack(a := fetched_at, b := title)) AS r FROM submissions GROUP BY 1))"""
EVERY = "CAST(regexp_extract(package_id, '([0-9]+)$', 1) AS BIGINT) % 20 = 0"


def _token_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    left = filings(spark, d).filter(every_20th(F.col("package_id"))).select("package_id", X.token_set(F.col("title")).alias("t"))
    right = table(spark, d, "report").select("mandate_id", X.token_set(F.col("nature_of_report")).alias("t"))
    return left, right


TOKEN_PAIRS = f"""{FILINGS}, l AS (SELECT package_id, {sql_tokens('title')} AS t FROM f WHERE {EVERY}), r AS (SELECT mandate_id, {sql_tokens('nature_of_report')} AS t FROM report),
    lt AS (SELECT package_id, len(t) AS ln, unnest(t) AS k FROM l), rt AS (SELECT mandate_id, len(t) AS rn, unnest(t) AS k FROM r),
    p AS (SELECT package_id, mandate_id, any_value(ln) AS ln, any_value(rn) AS rn, count(*) AS shared FROM lt JOIN rt USING (k) GROUP BY 1, 2)"""


@query(f"""WITH {TOKEN_PAIRS}, s AS (SELECT *, shared / (ln + rn - shared) AS j, row_number() OVER (PARTITION BY package_id ORDER BY round(shared / (ln + rn - shared), {ROUND}) DESC, mandate_id) AS rank FROM p)
    SELECT package_id, mandate_id, round(j, {ROUND}) AS similarity FROM s WHERE rank = 1""")
def q_link_top1(spark: SparkSession, d: str) -> DataFrame:
    """Most similar mandate of each filing by content words; ties go to the smaller id."""
    left, right = _token_sides(spark, d)
    best = top_k_overlap(left, right, "package_id", "mandate_id", "t", 1, digits=ROUND)
    return best.select("package_id", "mandate_id", F.col("score").alias("similarity"))


@query(f"""WITH {TOKEN_PAIRS}, s AS (SELECT package_id, mandate_id, round(shared / (ln + rn - shared), {ROUND}) AS similarity, row_number() OVER (PARTITION BY package_id ORDER BY round(shared / (ln + rn - shared), {ROUND}) DESC, mandate_id) AS rank FROM p)
    SELECT package_id, mandate_id, similarity, CAST(rank AS INT) AS rank FROM s WHERE rank <= 3""")
def q_link_top3(spark: SparkSession, d: str) -> DataFrame:
    """Three most similar mandates of each filing by content words; ties go to the smaller id."""
    left, right = _token_sides(spark, d)
    best = top_k_overlap(left, right, "package_id", "mandate_id", "t", 3, digits=ROUND)
    return best.select("package_id", "mandate_id", F.col("score").alias("similarity"), "rank")


@query(f"""WITH {TOKEN_PAIRS}, m AS (SELECT package_id, mandate_id, round(shared / (ln + rn - shared) + shared / greatest(least(ln, rn), 1), {ROUND}) AS score, shared FROM p WHERE shared >= 2),
    s AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY score DESC, mandate_id) AS rank FROM m) SELECT package_id, mandate_id, score, shared, CAST(rank AS INT) AS rank FROM s WHERE rank <= 20""")
def q_link_topk_score(spark: SparkSession, d: str) -> DataFrame:
    """Twenty best mandates of each filing with two words or more in common: Jaccard plus overlap coefficient. Words only;
    ``q_link_candidates`` is the search by citations and words."""
    left, right = _token_sides(spark, d)
    return top_k_overlap(left, right, "package_id", "mandate_id", "t", 20, score="sum", least=2, digits=ROUND)


def _cite_sides(spark: SparkSession, d: str, every: bool = False) -> tuple[DataFrame, DataFrame]:
    asked = filings(spark, d) if every else filings(spark, d).filter(every_20th(F.col("package_id")))
    left = asked.select("package_id", C.flatten_references(F.col("cite_refs")).alias("keys"))
    return left, table(spark, d, "report").select("mandate_id", C.tagged_keys(C.parse_citations(F.col("authority"))).alias("keys"))


def _refs(kind: str, which: str = EVERY) -> str:
    return f"SELECT package_id, '{kind}' AS kind, unnest(list_transform(list_filter(cite_refs.{kind}, lambda x: x[1] IS NOT NULL AND x[2] IS NOT NULL), lambda x: x[1] || '/' || x[2])) AS k FROM f WHERE {which}"


def _cites(kind: str, pattern: str) -> str:
    return f"SELECT mandate_id, '{kind}' AS kind, unnest({sql_keys('authority', pattern)}) AS k FROM report"


CITE_PAIRS = f"""{FILINGS}, l AS (SELECT DISTINCT * FROM ({_refs('usc')} UNION ALL {_refs('plaw')} UNION ALL {_refs('stat')})),
    r AS ({_cites('usc', C.USC)} UNION ALL {_cites('plaw', C.PLAW)} UNION ALL {_cites('stat', C.STAT)}),
    p AS (SELECT package_id, mandate_id, count(*) FILTER (kind = 'usc') AS usc, count(*) FILTER (kind = 'plaw') AS plaw, count(*) FILTER (kind = 'stat') AS stat FROM l JOIN r USING (kind, k) GROUP BY 1, 2)"""


@query(f"WITH {CITE_PAIRS} SELECT package_id, mandate_id, usc, plaw, stat, CAST((usc > 0)::INT + (plaw > 0)::INT + (stat > 0)::INT AS INT) AS kinds, plaw > 0 AND usc = 0 AND stat = 0 AS law_only FROM p")
def q_cite_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Citations in common of filings and mandates, by kind, met through an inverted index."""
    left, right = _cite_sides(spark, d)
    return J.shared_citations(left, right, "package_id", "mandate_id", "keys")


def _title_keys(kind: str, pattern: str) -> str:
    return f"SELECT package_id, '{kind}' AS kind, unnest({sql_keys('title', pattern)}) AS k FROM f WHERE {EVERY}"


@query(f"""WITH {FILINGS}, l AS (SELECT package_id, {sql_tokens('title')} AS x FROM f WHERE {EVERY}), r AS (SELECT mandate_id, {sql_tokens('nature_of_report')} AS y FROM report),
    lk AS (SELECT DISTINCT * FROM ({_refs('usc')} UNION ALL {_refs('plaw')} UNION ALL {_refs('stat')} UNION ALL {_title_keys('usc', C.USC)} UNION ALL {_title_keys('plaw', C.PLAW)} UNION ALL {_title_keys('stat', C.STAT)})),
    rk AS ({_cites('usc', C.USC)} UNION ALL {_cites('plaw', C.PLAW)} UNION ALL {_cites('stat', C.STAT)}),
    lt AS (SELECT package_id, unnest(x) AS k FROM l), rt AS (SELECT mandate_id, unnest(y) AS k FROM r),
    u AS (SELECT package_id, mandate_id, count(*) AS hits FROM lk JOIN rk USING (kind, k) GROUP BY 1, 2 UNION ALL SELECT package_id, mandate_id, 0 FROM lt JOIN rt USING (k) GROUP BY 1, 2 HAVING count(*) >= 2),
    c AS (SELECT package_id, mandate_id, CAST(max(hits) AS BIGINT) AS hits FROM u GROUP BY 1, 2),
    n AS (SELECT package_id, mandate_id, hits, len(x) AS ln, len(y) AS rn, len(list_intersect(x, y)) AS shared FROM c JOIN l USING (package_id) JOIN r USING (mandate_id)),
    m AS (SELECT package_id, mandate_id, round(2 * hits + shared / greatest(least(ln, rn), 1) + CASE WHEN ln + rn = 0 THEN 1.0 ELSE shared / (ln + rn - shared) END, {ROUND}) AS score, hits, shared FROM n),
    s AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY score DESC, mandate_id) AS rank FROM m) SELECT package_id, mandate_id, score, hits, shared, CAST(rank AS INT) AS rank FROM s WHERE rank <= 20""")
def q_link_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Twenty best mandates of each filing with a citation or two words in common: two for each citation, in the references
    or the title, plus Jaccard plus overlap coefficient of the words."""
    left = filings(spark, d).filter(every_20th(F.col("package_id"))).select("package_id", X.token_set(F.col("title")).alias("t"), C.stated_cites(F.col("title"), F.col("cite_refs")).alias("keys"))
    right = table(spark, d, "report").select("mandate_id", X.token_set(F.col("nature_of_report")).alias("t"), C.tagged_keys(C.parse_citations(F.col("authority"))).alias("keys"))
    return top_k_united(left, right, "package_id", "mandate_id", "t", "keys", 20, digits=ROUND)


ALL_CITE_PAIRS = CITE_PAIRS.replace(f" WHERE {EVERY}", "")
B1 = """CASE WHEN k >= 2 AND a THEN CASE WHEN t >= 0.15 THEN 'confident' ELSE 'candidate' END WHEN k >= 2 AND m THEN 'candidate' WHEN k >= 1 AND (a OR m) AND NOT law_only THEN 'candidate'
    WHEN law_only AND (a OR m) AND t >= 0.25 THEN 'candidate' WHEN k >= 1 AND NOT law_only AND t >= 0.15 THEN 'candidate' ELSE 'none' END"""


@query(f"""WITH {ALL_CITE_PAIRS}, x AS (SELECT p.package_id, p.mandate_id, (usc > 0)::INT + (plaw > 0)::INT + (stat > 0)::INT AS k, plaw > 0 AND usc = 0 AND stat = 0 AS law_only,
      coalesce(f.government_author = r.reporting_entity, false) AS a, coalesce(r.reporting_entity = {q(MULTI)}, false) AS m, {sql_tokens('f.title')} AS x, {sql_tokens('r.nature_of_report')} AS y
      FROM p JOIN f USING (package_id) JOIN report r USING (mandate_id)),
    s AS (SELECT *, round(CASE WHEN len(list_distinct(x || y)) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END, 3) AS t, max((a OR m)::INT) OVER (PARTITION BY package_id) AS any_fit FROM x),
    c AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY k DESC, t DESC, mandate_id) AS rank FROM s WHERE any_fit = 0 OR a OR m),
    v AS (SELECT package_id, mandate_id, rank, k, t, {B1} AS verdict FROM c WHERE rank <= 3),
    w AS (SELECT *, min(rank) OVER (PARTITION BY package_id) AS best, arg_min(verdict, rank) OVER (PARTITION BY package_id) AS first FROM v WHERE verdict <> 'none')
    SELECT package_id, mandate_id, CAST(rank AS INT) AS rank, CAST(k AS INT) AS kinds, t AS similarity, verdict FROM w WHERE rank = best OR (first = 'candidate' AND verdict = 'candidate')""")
def q_link_citations(spark: SparkSession, d: str) -> DataFrame:
    """Verdict on the three best mandates of every filing that share a citation, agencies that fit preferred. The first that isn't
    ruled out is the filing's; where it is a candidate only, the other candidates come too."""
    left, right = _cite_sides(spark, d, every=True)
    p = J.shared_citations(left, right, "package_id", "mandate_id", "keys")
    f = filings(spark, d).select("package_id", "government_author", X.token_set(F.col("title")).alias("x"))
    r = table(spark, d, "report").select("mandate_id", "reporting_entity", X.token_set(F.col("nature_of_report")).alias("y"))
    agency = F.coalesce(F.col("government_author") == F.col("reporting_entity"), F.lit(False))
    multi = F.coalesce(F.col("reporting_entity") == MULTI, F.lit(False))
    s = p.join(f, "package_id").join(r, "mandate_id").select("package_id", "mandate_id", "kinds", "law_only", agency.alias("a"), multi.alias("m"), F.round(X.jaccard(F.col("x"), F.col("y")), 3).alias("t"))
    from pyspark.sql.window import Window

    s = s.withColumn("any_fit", F.max((F.col("a") | F.col("m")).cast("int")).over(Window.partitionBy("package_id"))).filter("any_fit = 0 or a or m")
    top = J.top_k(s, ["package_id"], [F.desc("kinds"), F.desc("t"), F.col("mandate_id")], 3)
    v = R.stage_b1(F.col("kinds"), F.col("t"), F.col("a"), F.col("m"), F.col("law_only"))
    kept = top.select("package_id", "mandate_id", "rank", "kinds", F.col("t").alias("similarity"), v.alias("verdict")).filter("verdict <> 'none'")
    return J.best_then_candidates(kept, ["package_id"], "rank", "verdict")


@query(f"""WITH {FILINGS}, l AS (SELECT package_id, government_author AS e, {sql_tokens('title')} AS x FROM f WHERE {EVERY}), r AS (SELECT mandate_id, reporting_entity AS e, {sql_tokens('nature_of_report')} AS y FROM report),
    p AS (SELECT package_id, mandate_id, x, y FROM l JOIN r USING (e) WHERE e <> {q(MULTI)} UNION ALL SELECT package_id, mandate_id, x, y FROM l CROSS JOIN r WHERE r.e = {q(MULTI)}),
    s AS (SELECT package_id, mandate_id, round(CASE WHEN len(list_distinct(x || y)) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END, 3) AS t FROM p),
    b AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY t DESC, mandate_id) AS n, count(*) OVER (PARTITION BY package_id) AS pairs FROM s)
    SELECT package_id, mandate_id, t AS similarity, pairs, CASE WHEN t >= 0.5 THEN 'confident' WHEN t >= 0.25 THEN 'candidate' ELSE 'no_match' END AS verdict FROM b WHERE n = 1""")
def q_link_verdict_b2(spark: SparkSession, d: str) -> DataFrame:
    """Best mandate of each filing among those of its agency and those of several agencies."""
    left = filings(spark, d).filter(every_20th(F.col("package_id"))).select("package_id", F.col("government_author").alias("e"), X.token_set(F.col("title")).alias("t"))
    right = table(spark, d, "report").select("mandate_id", F.col("reporting_entity").alias("e"), X.token_set(F.col("nature_of_report")).alias("t"))
    best = best_within(left, right, "package_id", "mandate_id", "e", MULTI, "t")
    return best.select("package_id", "mandate_id", "similarity", "pairs", R.stage_b2(F.col("similarity")).alias("verdict"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(s_nationkey = c_nationkey, false) AS same FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
    r AS (SELECT *, max(same::INT) OVER (PARTITION BY l_orderkey) AS any_same, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey) AS rn FROM l)
    SELECT l_orderkey, l_linenumber, l_suppkey, same FROM r WHERE same OR (any_same = 0 AND rn = 1)""")
def q_prefer_subset_attach(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order whose supplier is of the customer's nation, else the first line."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey").join(c, "o_custkey")
    x = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(o, "l_orderkey").join(s, "l_suppkey")
    x = x.select("l_orderkey", "l_linenumber", "l_suppkey", F.coalesce(F.col("s_nationkey") == F.col("c_nationkey"), F.lit(False)).alias("same"))
    return J.prefer(x, ["l_orderkey"], F.col("same"), [F.col("l_linenumber"), F.col("l_suppkey")])


@query("SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING bool_and(coalesce(l_returnflag = 'N', false))")
def q_forall_anti(spark: SparkSession, d: str) -> DataFrame:
    """Orders of which every line has one flag."""
    return J.all_of(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", F.col("l_returnflag") == "N")


@query(f"""WITH r AS (SELECT mandate_id, translate(coalesce(authority, ''), {FOLD}) AS a FROM report),
    x AS (SELECT mandate_id, unnest(list_zip(regexp_extract_all(a, {q(C.USC_PATH)}, 1), regexp_extract_all(a, {q(C.USC_PATH)}, 2), regexp_extract_all(a, {q(C.USC_PATH)}, 3), regexp_extract_all(a, {q(C.USC_PATH)}, 4), regexp_extract_all(a, {q(C.USC_PATH)}, 5))) AS m FROM r),
    y AS (SELECT DISTINCT mandate_id, '/us/usc/t' || lower(m[1]) || CASE WHEN m[2] <> '' THEN 'a' ELSE '' END || '/s' || lower(m[3]) AS section_id, CASE WHEN m[5] <> '' THEN '' ELSE replace(replace(m[4], '(', '/'), ')', '') END AS path FROM x),
    c AS (SELECT mandate_id, section_id, section_id || path AS uslm_id FROM y), n AS (SELECT DISTINCT uslm_id AS id FROM documents WHERE uslm_id IS NOT NULL), l AS (SELECT lower(id) AS low, min(id) AS id FROM n GROUP BY 1)
    SELECT DISTINCT mandate_id, c.uslm_id, coalesce(e.id, l.id, s.id) AS resolved_id, CASE WHEN e.id IS NOT NULL THEN 'exact' WHEN l.id IS NOT NULL THEN 'folded' WHEN s.id IS NOT NULL THEN 'section' ELSE 'none' END AS resolved_at
    FROM c LEFT JOIN n e ON e.id = c.uslm_id LEFT JOIN l ON l.low = lower(c.uslm_id) LEFT JOIN n s ON s.id = c.section_id""")
def q_coalesce_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Every citation resolved to a document's node: exact, folded, or the section."""
    c = table(spark, d, "report").select("mandate_id", F.explode(C.parse_authority(F.col("authority"))).alias("x")).select("mandate_id", "x.section_id", "x.uslm_id").distinct()
    n = table(spark, d, "documents").select("uslm_id").filter("uslm_id is not null").distinct().withColumn("ord", F.col("uslm_id"))
    return J.resolve(c, n, "uslm_id", "section_id", "ord").select("mandate_id", "uslm_id", "resolved_id", "resolved_at").distinct()


@query(f"""WITH g AS (SELECT gold_id, regexp_extract(uslm_id, {q(C.SECTION_PATH)}, 1) AS s FROM mandate_gold), listed AS (SELECT DISTINCT regexp_extract(uslm_id, {q(C.SECTION_PATH)}, 1) AS s FROM documents WHERE doc_kind = 'provision'),
    noted AS (SELECT DISTINCT regexp_extract(uslm_id, {q(C.SECTION_PATH)}, 1) AS s FROM documents WHERE doc_kind = 'note')
    SELECT gold_id, CASE WHEN s = '' OR s IS NULL THEN 'novel' WHEN s IN (SELECT s FROM listed WHERE s <> '') THEN 'section_listed' WHEN s IN (SELECT s FROM noted WHERE s <> '') THEN 'note_listed' ELSE 'novel' END AS novelty FROM g""")
def q_semi_cascade_tier(spark: SparkSession, d: str) -> DataFrame:
    """First of several lists that an adjudicated section is on."""
    g = table(spark, d, "mandate_gold").select("gold_id", C.section_of(F.col("uslm_id")).alias("s"))
    docs = table(spark, d, "documents").select("doc_kind", C.section_of(F.col("uslm_id")).alias("s")).filter("s is not null")
    flags = docs.groupBy("s").agg(F.max((F.col("doc_kind") == "provision").cast("int")).alias("p"), F.max((F.col("doc_kind") == "note").cast("int")).alias("n"))
    return g.join(flags, "s", "left").select("gold_id", F.when(F.col("p") == 1, "section_listed").when(F.col("n") == 1, "note_listed").otherwise("novel").alias("novelty"))


@query(f"""WITH d AS (SELECT DISTINCT uslm_id FROM mandate_gold WHERE uslm_id IS NOT NULL),
    p AS (SELECT uslm_id, regexp_extract(uslm_id, {q(C.SECTION_PATH)}, 1) AS s, list_filter(string_split(substr(uslm_id, length(regexp_extract(uslm_id, {q(C.SECTION_PATH)}, 1)) + 2), '/'), lambda x: x <> '') AS r FROM d),
    e AS (SELECT uslm_id, s, r, unnest(range(0, len(r))) AS k FROM p WHERE s <> '' AND NOT regexp_matches(uslm_id, '/note/[0-9]+$')),
    a AS (SELECT uslm_id, k, CASE WHEN k = 0 THEN s ELSE s || '/' || array_to_string(r[1:k], '/') END AS a FROM e),
    h AS (SELECT a.uslm_id, arg_max(a.a, a.k) AS ancestor FROM a JOIN d ON d.uslm_id = a.a GROUP BY 1)
    SELECT d.uslm_id, h.ancestor FROM d LEFT JOIN h USING (uslm_id)""")
def q_nearest_ancestor(spark: SparkSession, d: str) -> DataFrame:
    """Nearest enclosing node that is itself adjudicated."""
    return nearest_ancestor(table(spark, d, "mandate_gold").select("uslm_id").filter("uslm_id is not null"))


def _sql_like(x: str, y: str) -> str:
    return f"({x} = '' OR {y} = '' OR starts_with({x}, {y}) OR starts_with({y}, {x}))"


def unit_sql(where: str) -> str:
    """CTEs that collapse adjudicated rows with a condition: ``u`` has id, o (owner), unit."""
    return f"""g AS (SELECT uslm_id, arg_max(struct_pack(e := trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce(gold.recipient, '')), '[^a-z ]', ' ', 'g'), ' (the|a|an) ', ' ', 'g'), ' +', ' ', 'g')), c := {sql_case("lower(trim(coalesce(text, '')))", R.FREQUENCIES, "CASE WHEN lower(trim(coalesce(text, ''))) IN ('', 'unknown', 'none') THEN 'unknown' ELSE 'other' END", whole=False)}, t := coalesce(text, '')), gold_id) AS r
      FROM mandate_gold WHERE {where} AND uslm_id IS NOT NULL GROUP BY 1),
    n AS (SELECT uslm_id AS id, r.e AS e, r.c AS c, r.t AS t, regexp_extract(uslm_id, {q(C.SECTION_PATH)}, 1) AS s FROM g),
    p AS (SELECT id, s, list_filter(string_split(substr(id, length(s) + 2), '/'), lambda x: x <> '') AS p FROM n WHERE s <> '' AND NOT regexp_matches(id, '/note/[0-9]+$')),
    up AS (SELECT id, k, CASE WHEN k = 0 THEN s ELSE s || '/' || array_to_string(p[1:k], '/') END AS a FROM (SELECT id, s, p, unnest(range(0, len(p))) AS k FROM p)),
    parent AS (SELECT id, arg_max(a, k) AS parent FROM up GROUP BY 1),
    near AS (SELECT up.id, arg_max(up.a, up.k) AS a FROM up JOIN n ON n.id = up.a GROUP BY 1),
    link AS (SELECT near.id, near.a FROM near JOIN n x ON x.id = near.id JOIN n y ON y.id = near.a WHERE x.c = y.c AND {_sql_like('x.e', 'y.e')}),
    chain AS (SELECT id, id AS o FROM n WHERE id NOT IN (SELECT id FROM link) UNION ALL SELECT link.id, chain.o FROM link JOIN chain ON chain.id = link.a),
    root AS (SELECT n.id, n.e, n.c, n.t, parent.parent AS p FROM n JOIN chain ON chain.id = n.id AND chain.o = n.id JOIN parent ON parent.id = n.id),
    head AS (SELECT p, c, e, min(id) AS id FROM root GROUP BY 1, 2, 3), nth AS (SELECT *, row_number() OVER (PARTITION BY p, c ORDER BY id) AS k FROM head),
    fold AS (SELECT p, c, CAST(1 AS BIGINT) AS k, [struct_pack(e := e, id := id)] AS l FROM nth WHERE k = 1
      UNION ALL SELECT f.p, f.c, f.k + 1, CASE WHEN len(list_filter(f.l, lambda y: {_sql_like('y.e', 'h.e')})) > 0 THEN f.l ELSE list_append(f.l, struct_pack(e := h.e, id := h.id)) END FROM fold f JOIN nth h ON h.p = f.p AND h.c = f.c AND h.k = f.k + 1),
    done AS (SELECT p, c, arg_max(l, k) AS l FROM fold GROUP BY 1, 2),
    joined AS (SELECT r.id, r.t, list_filter(d.l, lambda y: {_sql_like('y.e', 'r.e')})[1].id AS first FROM root r JOIN done d ON d.p = r.p AND d.c = r.c),
    same AS (SELECT first, count(*) AS n, min(t) AS lo, max(t) AS hi FROM joined GROUP BY 1),
    one AS (SELECT first FROM same WHERE n > 1 AND regexp_matches(substr(lo, 1, CAST(coalesce(list_min(list_filter(range(1, least(length(lo), length(hi)) + 1), lambda i: lo[i] <> hi[i])) - 1, least(length(lo), length(hi))) AS BIGINT)), {q(DUTY)})),
    u AS (SELECT chain.id, chain.o, coalesce((SELECT any_value(j.first) FROM joined j JOIN one USING (first) WHERE j.id = chain.o), chain.o) AS unit FROM chain)"""


@query(f"""WITH RECURSIVE {unit_sql('gold.is_mandate')}
    SELECT id AS uslm_id, unit AS unit_id, CASE WHEN unit = id THEN 'own' WHEN o <> id THEN 'ancestor' ELSE 'sibling' END AS rule FROM u""")
def q_unit_collapse(spark: SparkSession, d: str) -> DataFrame:
    """Adjudicated mandates collapsed into units per section: entity from the recipient, rhythm from the text. Of repeated ids
    the last ``gold_id`` counts."""
    g = table(spark, d, "mandate_gold").filter("gold.is_mandate")
    return collapse(g.select("gold_id", "uslm_id", X.entity_key(F.coalesce("gold.recipient", F.lit(""))).alias("entity"), R.frequency(F.col("text")).alias("cadence"), "text"), ("gold_id",))


@query(f"""WITH k AS (SELECT mandate_id, {sql_norm("coalesce(nature_of_report, '')")} || chr(31) || {sql_norm("coalesce(authority, '')")} AS k FROM report)
    SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS "rows", max(n) AS largest FROM (SELECT k, count(*) AS n FROM k GROUP BY 1 HAVING count(*) > 1)""")
def q_near_dup_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups of rows equal after normalizing."""
    e = F.lit("")
    k = F.concat_ws("\u001f", X.normalize_text(F.coalesce("nature_of_report", e)), X.normalize_text(F.coalesce("authority", e)))
    g = table(spark, d, "report").groupBy(k.alias("k")).agg(F.count("*").alias("n")).filter("n > 1")
    return g.agg(F.count("*").alias("groups"), F.sum("n").alias("rows"), F.max("n").alias("largest"))
