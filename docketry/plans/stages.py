"""Queries of the linkage stages that start from requirements, of resolution against documents, and of orders and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import rules as R
from ..functions import text as X
from ..operators import linkage as J
from ..operators import sampling as M
from ..operators.cited import cited_verdicts
from ..operators.search import top_k_overlap
from ..runtime import Scratch, table
from ..streaming import logs as L
from .attach import PACKAGE_REQUIREMENTS, package_requirements
from .catalogue import query
from .links import EVERY, FILINGS, MULTI, ROUND, TOKEN_PAIRS, _cites, every_20th, filings
from .logs import LAST, _hash, log
from .reports import count_if
from .texts import FOLD, q, sql_keys, sql_tokens

KINDS = ("usc", "plaw", "stat")
#: Requirements: title of the first filing under each, all that its filings cite, the agencies seen.
REQUIREMENTS = f"""{FILINGS}, {PACKAGE_REQUIREMENTS}, rn AS (SELECT requirement_number, arg_min(CASE WHEN trim(title) <> '' THEN title END, package_id) FILTER (trim(title) <> '') AS nature FROM pq JOIN f USING (package_id) GROUP BY 1),
    told AS ({" UNION ALL ".join(f"SELECT requirement_number, '{k}' AS kind, unnest({sql_keys('nature', p)}) AS k FROM rn" for k, p in zip(KINDS, (C.USC, C.PLAW, C.STAT)))}),
    refs AS (SELECT DISTINCT requirement_number, kind, k FROM ({" UNION ALL ".join(f"SELECT requirement_number, '{k}' AS kind, unnest(list_transform(list_filter(cite_refs.{k}, lambda x: x[1] IS NOT NULL AND x[2] IS NOT NULL), lambda x: x[1] || '/' || x[2])) AS k FROM pq JOIN f USING (package_id)" for k in KINDS)})),
    rk AS (SELECT * FROM told UNION ALL SELECT * FROM refs WHERE requirement_number NOT IN (SELECT requirement_number FROM told)),
    seen AS (SELECT DISTINCT requirement_number, government_author FROM pq WHERE government_author IS NOT NULL)"""
MANDATE_KEYS = " UNION ALL ".join(_cites(k, p) for k, p in zip(KINDS, (C.USC, C.PLAW, C.STAT)))
STAGE_A = f"""{REQUIREMENTS}, mk AS ({MANDATE_KEYS}), ap AS (SELECT requirement_number, mandate_id, count(DISTINCT kind) AS kinds FROM rk JOIN mk USING (kind, k) GROUP BY 1, 2),
    ax AS (SELECT ap.*, r.reporting_entity AS e, rn.nature, {sql_tokens('rn.nature')} AS x, {sql_tokens('r.nature_of_report')} AS y FROM ap JOIN rn USING (requirement_number) JOIN report r USING (mandate_id)),
    aj AS (SELECT *, CASE WHEN len(list_distinct(x || y)) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END AS j, coalesce(e = {q(MULTI)}, false) OR s.government_author IS NOT NULL AS a FROM ax LEFT JOIN seen s ON s.requirement_number = ax.requirement_number AND s.government_author = ax.e),
    av AS (SELECT requirement_number, mandate_id, kinds, round(j, 3) AS j, a, CASE WHEN trim(coalesce(nature, '')) = '' THEN CASE WHEN kinds >= 2 AND a THEN 0 WHEN a THEN 1 ELSE 2 END
      WHEN kinds >= 2 AND j >= 0.4 THEN 0 WHEN j >= 0.4 THEN CASE WHEN a THEN 0 ELSE 1 END WHEN j >= 0.2 THEN 1 ELSE 2 END AS v FROM aj)"""
VERDICTS = "CASE v WHEN 0 THEN 'confident' WHEN 1 THEN 'candidate' ELSE 'no_match' END"


def requirements(spark: SparkSession, d: str) -> DataFrame:
    """``requirement_number, nature, keys``: title of the first filing under it, and the citations of that title, else all references
    of its filings. A requirement's distinct citations are bounded by the law it rests on."""
    f = filings(spark, d).select("package_id", "title", "cite_refs", F.explode("requirement_numbers").alias("requirement_number")).filter("requirement_number is not null")
    nature = f.groupBy("requirement_number").agg(F.min_by("title", F.when(F.trim("title") != "", F.col("package_id"))).alias("nature"))
    refs = f.select("requirement_number", F.explode(C.flatten_references(F.col("cite_refs"))).alias("k")).distinct().groupBy("requirement_number").agg(F.collect_list("k").alias("refs"))
    told = C.tagged_keys(C.parse_citations(F.col("nature")))
    return nature.join(refs, "requirement_number", "left").select("requirement_number", "nature", F.when(F.size(told) > 0, told).otherwise(F.col("refs")).alias("keys"))


def verdicts_a(spark: SparkSession, d: str, best: bool = True) -> DataFrame:
    """The best mandate of every requirement that shares a citation with some, else all confident pairs: ``requirement_number, mandate_id,
    v, kinds, similarity, agency``. Pairs are scored where the mandates are read; there may be millions for a requirement."""
    req = requirements(spark, d).select("requirement_number", "nature", "keys", X.token_set(F.col("nature")).alias("tokens"))
    seen = package_requirements(spark, d).filter("government_author is not null").select("requirement_number", F.col("government_author").alias("entity"))
    m = table(spark, d, "report").select("mandate_id", F.col("reporting_entity").alias("entity"), X.token_set(F.col("nature_of_report")).alias("tokens"), C.tagged_keys(C.parse_citations(F.col("authority"))).alias("keys"))
    return cited_verdicts(req, m, seen, "requirement_number", "mandate_id", MULTI, best)


@query(f"""WITH {STAGE_A}, b AS (SELECT *, row_number() OVER (PARTITION BY requirement_number ORDER BY v, kinds DESC, j DESC, mandate_id) AS n FROM av)
    SELECT rn.requirement_number, CASE WHEN v < 2 THEN mandate_id END AS mandate_id, coalesce({VERDICTS}, 'no_match') AS verdict,
      CASE WHEN v IS NULL THEN 'no citation in common' ELSE CASE WHEN v = 2 THEN 'best rejected: ' ELSE '' END || kinds || ' kinds of citation; similarity ' || printf('%.3f', j) || CASE WHEN a THEN '; same agency' ELSE '' END END AS reason
    FROM rn LEFT JOIN (SELECT * FROM b WHERE n = 1) USING (requirement_number)""")
def q_link_verdict_a(spark: SparkSession, d: str) -> DataFrame:
    """Best mandate of every requirement, among those it shares a citation with, and why."""
    best = verdicts_a(spark, d).select("requirement_number", "mandate_id", "kinds", "similarity", "agency", "v")
    why = R.score_reason(F.col("kinds"), F.col("similarity"), F.col("agency"))
    why = F.when(F.col("v").isNull(), "no citation in common").otherwise(F.concat(F.when(F.col("v") == 2, "best rejected: ").otherwise(""), why))
    said = F.when(F.col("v") == 0, "confident").when(F.col("v") == 1, "candidate").otherwise("no_match")
    out = requirements(spark, d).select("requirement_number").join(best, "requirement_number", "left")
    return out.select("requirement_number", F.when(F.col("v") < 2, F.col("mandate_id")).alias("mandate_id"), said.alias("verdict"), why.alias("reason"))


ATTACHED = f"""{STAGE_A}, co AS (SELECT pq.package_id, pq.pos, pq.requirement_number, av.mandate_id, coalesce(pq.government_author = r.reporting_entity, false) AS fits, f.title, r.nature_of_report FROM pq JOIN av ON av.requirement_number = pq.requirement_number AND v = 0 JOIN report r USING (mandate_id) JOIN f ON f.package_id = pq.package_id),
    cw AS (SELECT *, max(fits::INT) OVER (PARTITION BY package_id, pos) AS any_fit, row_number() OVER (PARTITION BY package_id, pos ORDER BY mandate_id) AS n FROM co)"""


@query(f"""WITH {ATTACHED}, z AS (SELECT DISTINCT package_id, mandate_id, {sql_tokens('title')} AS x, {sql_tokens('nature_of_report')} AS y FROM cw WHERE fits OR (any_fit = 0 AND n = 1))
    SELECT package_id, mandate_id, CASE WHEN len(list_distinct(x || y)) = 0 THEN 1.0 ELSE len(list_intersect(x, y)) / len(list_distinct(x || y)) END < 0.1 AS to_validate FROM z""")
def q_attach_stage_a(spark: SparkSession, d: str) -> DataFrame:
    """Filings attached through each of their requirements to its confident mandates: those of the filing's agency, else the
    first; pairs whose titles have hardly a word in common are marked for validation."""
    r = table(spark, d, "report").select("mandate_id", "reporting_entity", X.token_set(F.col("nature_of_report")).alias("y"))
    f = filings(spark, d).select("package_id", X.token_set(F.col("title")).alias("x"))
    sure = Scratch(spark, "sure").put(verdicts_a(spark, d, best=False).select("requirement_number", "mandate_id").join(r.drop("y"), "mandate_id"), "pairs")
    own = sure.select("requirement_number", F.col("reporting_entity").alias("government_author"), "mandate_id").filter("government_author is not null")
    led = sure.groupBy("requirement_number").agg(F.min("mandate_id").alias("mandate_id"))
    p = package_requirements(spark, d).select("package_id", "requirement_number", "government_author")
    fits = own.select("requirement_number", "government_author").distinct().withColumn("fits", F.lit(True))
    p = p.join(led.withColumnRenamed("mandate_id", "first"), "requirement_number").join(fits, ["requirement_number", "government_author"], "left")
    other = p.filter("fits is null").select("package_id", F.col("first").alias("mandate_id"))
    pairs = p.filter("fits").join(own, ["requirement_number", "government_author"]).select("package_id", "mandate_id").unionByName(other).distinct()
    return pairs.join(f, "package_id").join(r, "mandate_id").select("package_id", "mandate_id", (X.jaccard(F.col("x"), F.col("y")) < 0.1).alias("to_validate"))


@query(f"""WITH {STAGE_A}, best AS (SELECT requirement_number, min(v) AS v FROM av GROUP BY 1), live AS (SELECT requirement_number FROM best WHERE v < 2)
    SELECT package_id FROM f WHERE package_id NOT IN (SELECT package_id FROM pq WHERE requirement_number IN (SELECT requirement_number FROM live))""")
def q_all_requirements_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Filings without requirement, or whose requirements all lead to no mandate."""
    live = verdicts_a(spark, d).filter("v < 2").select("requirement_number")
    led = package_requirements(spark, d).join(live, "requirement_number", "left_semi").select("package_id").distinct()
    return filings(spark, d).select("package_id").join(led, "package_id", "left_anti")


@query(f"""WITH e AS (SELECT reporting_entity AS agency, mandate_id, row_number() OVER (PARTITION BY reporting_entity ORDER BY mandate_id) AS place FROM report WHERE reporting_entity IS NOT NULL)
    SELECT agency, mandate_id, CAST(place AS BIGINT) AS place FROM e WHERE place <= 400 OR agency = {q(MULTI)}""")
def q_block_own_plus_global(spark: SparkSession, d: str) -> DataFrame:
    """The rows of every slice that filings are shown: the first 400 of each agency, and all of several agencies. A filing's
    slice is that of its agency and the common one, so slices are listed once and not per filing."""
    r = table(spark, d, "report").filter("reporting_entity is not null").select(F.col("reporting_entity").alias("agency"), "mandate_id")
    own = M.first_of(r.filter(F.col("agency") != MULTI), ["agency"], F.col("mandate_id"), 400, "place")
    w = M.numbered(r.filter(F.col("agency") == MULTI), F.col("mandate_id"), "place")
    return own.unionByName(w.select(*own.columns)).select("agency", "mandate_id", F.col("place").cast("long").alias("place"))


@query(f"""WITH {TOKEN_PAIRS}, b AS (SELECT package_id, max(round(shared / (ln + rn - shared), {ROUND})) AS best FROM p GROUP BY 1), e AS (SELECT DISTINCT reporting_entity AS e FROM report WHERE reporting_entity IS NOT NULL)
    SELECT f.package_id, CASE WHEN e.e IS NULL THEN 'agency_absent' WHEN len(coalesce(cite_refs.usc, [])) + len(coalesce(cite_refs.plaw, [])) + len(coalesce(cite_refs.stat, [])) > 0 AND coalesce(best, 0) < 0.2 THEN 'cited_but_unlike'
      WHEN best >= 0.3 THEN 'near_miss' WHEN best >= 0.15 THEN 'weak' ELSE 'none' END AS tag FROM f LEFT JOIN b USING (package_id) LEFT JOIN e ON e.e = f.government_author WHERE {EVERY}""")
def q_orphan_tag(spark: SparkSession, d: str) -> DataFrame:
    """Why a filing may have found no mandate: its agency is on no list, it cites but reads like none, or how near the nearest is."""
    asked = filings(spark, d).filter(every_20th(F.col("package_id"))).select("package_id", "government_author", "cite_refs", X.token_set(F.col("title")).alias("t"))
    rows = table(spark, d, "report").select("mandate_id", X.token_set(F.col("nature_of_report")).alias("t"))
    best = top_k_overlap(asked, rows, "package_id", "mandate_id", "t", 1, digits=ROUND).select("package_id", F.col("score").alias("best"))
    known = table(spark, d, "report").filter("reporting_entity is not null").select(F.col("reporting_entity").alias("government_author")).distinct().withColumn("on", F.lit(True))
    cites = sum((F.size(F.coalesce(F.col(f"cite_refs.{k}"), F.array().cast("array<array<string>>"))) for k in KINDS), F.lit(0))
    x = asked.join(best, "package_id", "left").join(known, "government_author", "left")
    return x.select("package_id", R.orphan_tag(F.coalesce("on", F.lit(False)), cites > 0, F.coalesce("best", F.lit(0.0))).alias("tag"))


SECTIONS = f"SELECT mandate_id, unnest(list_zip(regexp_extract_all(a, {q(C.USC_PATH)}, 1), regexp_extract_all(a, {q(C.USC_PATH)}, 2), regexp_extract_all(a, {q(C.USC_PATH)}, 3), regexp_extract_all(a, {q(C.USC_PATH)}, 4), regexp_extract_all(a, {q(C.USC_PATH)}, 5))) AS m FROM (SELECT mandate_id, translate(coalesce(authority, ''), {FOLD}) AS a FROM report)"
CITED = f"x AS ({SECTIONS}), y AS (SELECT DISTINCT mandate_id, '/us/usc/t' || lower(m[1]) || CASE WHEN m[2] <> '' THEN 'a' ELSE '' END || '/s' || lower(m[3]) AS section_id, CASE WHEN m[5] <> '' THEN '' ELSE replace(replace(m[4], '(', '/'), ')', '') END AS path, coalesce(m[5], '') <> '' AS is_note FROM x), c AS (SELECT mandate_id, section_id, section_id || path AS uslm_id, is_note FROM y)"


def cited(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "report").select("mandate_id", F.explode(C.parse_authority(F.col("authority"))).alias("x"))
    return c.select("mandate_id", "x.section_id", "x.uslm_id", "x.is_note").distinct()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Node ids that documents hold, each with its first non-empty text's document."""
    return table(spark, d, "documents").filter("uslm_id is not null and trim(coalesce(text, '')) <> ''").groupBy("uslm_id").agg(F.min("doc_id").alias("doc_id"))


def resolved(spark: SparkSession, d: str) -> DataFrame:
    """``mandate_id, uslm_id, is_note, grade, doc_id``: every citation of the Code with how well it was found. A note cited is looked for among
    the section's notes, never replaced by the section's own text."""
    n = nodes(spark, d)
    c = cited(spark, d)
    code = J.resolve(c.filter("not is_note"), n.withColumn("ord", F.col("uslm_id")), "uslm_id", "section_id", "ord")
    code = code.join(n.select(F.col("uslm_id").alias("resolved_id"), "doc_id"), "resolved_id", "left").select("mandate_id", "uslm_id", "is_note", F.col("resolved_at").alias("grade"), "doc_id")
    p = table(spark, d, "report").select("mandate_id", C.parse_citations(F.col("authority")).alias("p"))
    pair = lambda a: F.transform(a, lambda x: F.concat(x["a"], F.lit("-"), x["b"]))
    asked = c.filter("is_note").join(p, "mandate_id").select(F.concat_ws(" ", "mandate_id", "section_id").alias("cite_id"), "mandate_id", "section_id", "uslm_id", pair(F.col("p.plaw")).alias("laws"), pair(F.col("p.stat")).alias("stats"))
    t = table(spark, d, "documents").filter("doc_kind = 'note'").select("doc_id", C.section_of(F.col("uslm_id")).alias("section_id"), C.parse_citations(F.col("text")).alias("p")).filter("section_id is not null")
    graded = J.note_grades(asked, t.select("section_id", pair(F.col("p.plaw")).alias("laws"), pair(F.col("p.stat")).alias("stats")))
    first = t.groupBy("section_id").agg(F.min("doc_id").alias("doc_id"))
    notes = graded.join(first, "section_id", "left").select("mandate_id", "uslm_id", F.lit(True).alias("is_note"), "grade", "doc_id")
    return code.unionByName(notes)


RESOLVED = f"""{CITED}, n AS (SELECT uslm_id, min(doc_id) AS doc_id FROM documents WHERE uslm_id IS NOT NULL AND trim(coalesce(text, '')) <> '' GROUP BY 1), lo AS (SELECT lower(uslm_id) AS low, min(uslm_id) AS id FROM n GROUP BY 1),
    sn AS (SELECT regexp_extract(uslm_id, {q(C.SECTION_PATH)}, 1) AS s, doc_id, {sql_keys('text', C.PLAW)} AS l, {sql_keys('text', C.STAT)} AS t FROM documents WHERE doc_kind = 'note' AND uslm_id IS NOT NULL),
    s0 AS (SELECT s, min(doc_id) AS doc_id, count(*) AS n FROM sn WHERE s <> '' GROUP BY 1), rl AS (SELECT mandate_id, {sql_keys('authority', C.PLAW)} AS l, {sql_keys('authority', C.STAT)} AS t FROM report),
    law AS (SELECT DISTINCT s, unnest(l) AS k FROM sn), page AS (SELECT DISTINCT s, unnest(t) AS k FROM sn),
    code AS (SELECT mandate_id, c.uslm_id, is_note, CASE WHEN e.uslm_id IS NOT NULL THEN 'exact' WHEN lo.id IS NOT NULL THEN 'folded' WHEN s.uslm_id IS NOT NULL THEN 'section' ELSE 'none' END AS grade, coalesce(e.doc_id, f.doc_id, s.doc_id) AS doc_id
      FROM c LEFT JOIN n e ON e.uslm_id = c.uslm_id LEFT JOIN lo ON lo.low = lower(c.uslm_id) LEFT JOIN n f ON f.uslm_id = lo.id LEFT JOIN n s ON s.uslm_id = c.section_id WHERE NOT is_note),
    nl AS (SELECT DISTINCT mandate_id, section_id, k FROM (SELECT c.mandate_id, section_id, unnest(l) AS k FROM c JOIN rl USING (mandate_id) WHERE is_note)), ns AS (SELECT DISTINCT mandate_id, section_id, k FROM (SELECT c.mandate_id, section_id, unnest(t) AS k FROM c JOIN rl USING (mandate_id) WHERE is_note)),
    hl AS (SELECT DISTINCT mandate_id, section_id FROM nl JOIN law ON s = section_id AND law.k = nl.k), hs AS (SELECT DISTINCT mandate_id, section_id FROM ns JOIN page ON s = section_id AND page.k = ns.k),
    note AS (SELECT mandate_id, uslm_id, is_note, CASE WHEN s0.s IS NULL THEN 'note_absent' WHEN hl.section_id IS NOT NULL OR hs.section_id IS NOT NULL THEN 'note' ELSE 'note_unmatched' END AS grade, doc_id FROM c LEFT JOIN s0 ON s0.s = section_id LEFT JOIN hl USING (mandate_id, section_id) LEFT JOIN hs USING (mandate_id, section_id) WHERE is_note),
    rs AS (SELECT * FROM code UNION ALL SELECT * FROM note)"""


@query(f"WITH {RESOLVED} SELECT mandate_id, uslm_id, is_note, grade, doc_id FROM rs")
def q_resolve_mandates(spark: SparkSession, d: str) -> DataFrame:
    """Every citation of the Code resolved to a document: exact, folded, section or none; notes by the law or page they name."""
    return resolved(spark, d)


@query(f"""WITH {RESOLVED}, u AS (SELECT mandate_id FROM report WHERE mandate_id NOT IN (SELECT mandate_id FROM rs WHERE doc_id IS NOT NULL)),
    s AS (SELECT mandate_id, unnest(list_filter(string_split(regexp_replace(translate(coalesce(authority, ''), {FOLD}), {q(C.PLAW_SPAN)}, chr(30) || '\\0', 'g'), chr(30)), lambda s: regexp_extract(s, {q(C.PLAW)}, 1) <> '')) AS s FROM report JOIN u USING (mandate_id)),
    k AS (SELECT DISTINCT mandate_id, CAST(regexp_extract(s, {q(C.PLAW)}, 1) AS INT) AS congress, CAST(regexp_extract(s, {q(C.PLAW)}, 2) AS INT) AS number, nullif(regexp_extract(s, {q(C.SECTION_MARK)}, 1), '') AS section FROM s),
    dl AS (SELECT DISTINCT CAST(string_split(k, '/')[1] AS INT) AS congress, CAST(string_split(k, '/')[2] AS INT) AS number FROM (SELECT unnest({sql_keys('title', C.PLAW)}) AS k FROM submissions))
    SELECT k.mandate_id, k.congress, k.number, k.section, CASE WHEN k.congress < {C.FIRST_COLLECTED} THEN 'out_of_collection' WHEN dl.congress IS NULL THEN 'package_missing' WHEN k.section IS NULL THEN 'section_unspecified' ELSE 'section_not_found' END AS grade FROM k LEFT JOIN dl USING (congress, number)""")
def q_law_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Public laws of the mandates whose citations of the Code all lead nowhere, and how far each could be followed: the laws at
    hand are those that titles of filings name, none with its sections' text."""
    from ..operators.judges import law_resolution

    live = resolved(spark, d).filter("doc_id is not null").select("mandate_id").distinct()
    k = table(spark, d, "report").join(live, "mandate_id", "left_anti").select("mandate_id", F.explode(C.plaw_sections(F.col("authority"))).alias("x")).select("mandate_id", "x.congress", "x.number", "x.section")
    at = table(spark, d, "submissions").select(F.explode(C.parse_citations(F.col("title"))["plaw"]).alias("x")).select(F.col("x.a").cast("int").alias("congress"), F.col("x.b").cast("int").alias("number")).distinct().withColumn("has", F.lit(True))
    return k.join(at, ["congress", "number"], "left").select("mandate_id", "congress", "number", "section", law_resolution(F.col("congress"), F.col("section"), C.FIRST_COLLECTED, F.col("has"), F.lit(False)).alias("grade"))


@query(f"""WITH {RESOLVED}, t AS (SELECT rs.mandate_id, rs.doc_id, rs.uslm_id, rs.is_note, d.text FROM rs JOIN documents d USING (doc_id) WHERE trim(coalesce(d.text, '')) <> ''),
    a AS (SELECT mandate_id, 'code' AS source, arg_min(doc_id, uslm_id) AS doc_id FROM t WHERE NOT is_note GROUP BY 1 UNION ALL SELECT mandate_id, 'note', arg_min(doc_id, uslm_id) FROM t WHERE is_note GROUP BY 1)
    SELECT mandate_id, source, doc_id FROM a""")
def q_known_positives(spark: SparkSession, d: str) -> DataFrame:
    """First resolved document of each mandate from each of two sources, the Code and its notes."""
    r = resolved(spark, d).filter("doc_id is not null")
    return r.groupBy("mandate_id", F.when(F.col("is_note"), "note").otherwise("code").alias("source")).agg(F.min_by("doc_id", "uslm_id").alias("doc_id"))


@query(f"""WITH {RESOLVED}, t AS (SELECT mandate_id, string_agg(d.text, ' ' ORDER BY rs.uslm_id, rs.is_note) AS text FROM rs JOIN documents d USING (doc_id) GROUP BY 1)
    SELECT mandate_id, length(text) AS n_chars, md5(text) AS digest FROM t""")
def q_resolved_text(spark: SparkSession, d: str) -> DataFrame:
    """Length and digest of all text a mandate's citations resolve to, in order of node; a mandate has one text per citation."""
    r = resolved(spark, d).filter("doc_id is not null").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").filter("text is not null")
    parts = F.array_sort(F.collect_list(F.struct("uslm_id", "is_note", "text")))
    text = F.array_join(F.transform(parts, lambda x: x["text"]), " ")
    return r.groupBy("mandate_id").agg(text.alias("t")).select("mandate_id", F.length("t").alias("n_chars").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


@query(f"""WITH {CITED}, listed AS (SELECT DISTINCT section_id AS k FROM c), g AS (SELECT gold_id, nullif(regexp_extract(uslm_id, {q(C.SECTION_PATH)}, 1), '') AS s, {sql_keys('text', C.PLAW)} AS l, {sql_keys('text', C.STAT)} AS t FROM mandate_gold),
    ll AS (SELECT DISTINCT unnest({sql_keys('authority', C.PLAW)}) AS k FROM report), ls AS (SELECT DISTINCT unnest({sql_keys('authority', C.STAT)}) AS k FROM report),
    hl AS (SELECT DISTINCT gold_id FROM (SELECT gold_id, unnest(l) AS k FROM g) JOIN ll USING (k)), hs AS (SELECT DISTINCT gold_id FROM (SELECT gold_id, unnest(t) AS k FROM g) JOIN ls USING (k))
    SELECT gold_id, CASE WHEN s IS NULL THEN 'novel' WHEN s IN (SELECT k FROM listed) THEN 'listed_usc' WHEN gold_id IN (SELECT gold_id FROM hl) THEN 'listed_plaw' WHEN gold_id IN (SELECT gold_id FROM hs) THEN 'listed_stat' ELSE 'novel' END AS novelty FROM g""")
def q_novelty(spark: SparkSession, d: str) -> DataFrame:
    """Strongest evidence that an adjudicated provision is on the list already: its section, a law or a Statutes page that it names.
    A provision without a section counts as novel."""
    g = table(spark, d, "mandate_gold").select("gold_id", C.section_of(F.col("uslm_id")).alias("s"), C.parse_citations(F.col("text")).alias("p"))
    pair = lambda c: F.transform(c, lambda x: F.concat(x["a"], F.lit("/"), x["b"]))
    on = lambda c: F.when(F.col("s").isNotNull(), c)
    g = g.select("gold_id", F.array_compact(F.array("s")).alias("u"), on(pair(F.col("p.plaw"))).alias("l"), on(pair(F.col("p.stat"))).alias("t"))
    r = table(spark, d, "report").select(C.parse_citations(F.col("authority")).alias("p"))
    lists = [cited(spark, d).select(F.col("section_id").alias("k")), *[r.select(F.explode(pair(F.col(f"p.{k}"))).alias("k")) for k in ("plaw", "stat")]]
    return J.listed_tier(g, "gold_id", [("listed_usc", "u", lists[0]), ("listed_plaw", "l", lists[1]), ("listed_stat", "t", lists[2])], "novel", "novelty")


@query("SELECT lower(trim(coalesce(stratum, '?'))) AS stratum, count(*) FILTER (gold.is_mandate AND gold.recipient = 'congress') AS positive, count(*) FILTER (gold.is_mandate AND coalesce(gold.recipient, '') <> 'congress') AS other_recipient, count(*) AS n FROM mandate_gold GROUP BY 1")
def q_verdict_positive(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts that count: a duty, and Congress as its recipient."""
    g = table(spark, d, "mandate_gold").select(F.lower(F.trim(F.coalesce("stratum", F.lit("?")))).alias("stratum"), F.col("gold.is_mandate").alias("m"), F.coalesce("gold.recipient", F.lit("")).alias("r"))
    return g.groupBy("stratum").agg(count_if(F.col("m") & (F.col("r") == "congress")).alias("positive"), count_if(F.col("m") & (F.col("r") != "congress")).alias("other_recipient"), F.count("*").alias("n"))


TERMINAL = "('same', 'different', 'unclear', 'refused')"


@query(f"WITH {LAST}, e AS (SELECT DISTINCT candidate_id, judge FROM l WHERE verdict IN {TERMINAL}) SELECT DISTINCT candidate_id, judge FROM l ANTI JOIN e USING (candidate_id, judge)")
def q_work_terminal(spark: SparkSession, d: str) -> DataFrame:
    """Work to try again: no attempt of the judge on the candidate has succeeded or been refused; a refusal is final."""
    x = log(spark, d).select("candidate_id", "judge", "verdict", "log_seq")
    return L.never_ended(x, ["candidate_id", "judge"], F.col("verdict").isin("same", "different", "unclear", "refused"))


@query(f"""WITH {FILINGS}, s AS (SELECT package_id, CASE WHEN regexp_matches(date_issued, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') THEN TRY_CAST(date_issued AS DATE) END AS day FROM f WHERE {EVERY}) SELECT package_id, row_number() OVER (ORDER BY (day IS NOT NULL), day, package_id) AS place FROM s""")
def q_overdue_order(spark: SparkSession, d: str) -> DataFrame:
    """Filings by age: those without a date first, then the oldest; every twentieth, numbered without one task holding all."""
    from .reports import day

    f = filings(spark, d).filter(every_20th(F.col("package_id"))).select("package_id", day(F.col("date_issued")).alias("at"))
    key = F.struct(F.col("at").isNotNull().alias("a"), F.col("at").alias("b"), F.col("package_id").alias("c"))
    return M.numbered(f, key, "place").select("package_id", "place")


@query("""WITH r AS (SELECT DISTINCT r FROM (SELECT unnest(requirement_numbers) AS r FROM submissions) WHERE r IS NOT NULL) SELECT r AS requirement_number, row_number() OVER (ORDER BY TRY_CAST(r AS BIGINT) NULLS LAST, r) AS place FROM r""")
def q_numeric_order(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are numbers written as text, in order of the numbers; others behind."""
    r = table(spark, d, "submissions").select(F.explode("requirement_numbers").alias("requirement_number")).filter("requirement_number is not null").distinct()
    n = F.col("requirement_number").try_cast("long")
    return M.numbered(r, F.struct(n.isNull().alias("a"), n.alias("b"), F.col("requirement_number").alias("c")), "place").select("requirement_number", "place")


@query("""WITH s AS (SELECT government_author AS author, count(*) AS n FROM submissions WHERE government_author IS NOT NULL GROUP BY 1) SELECT author, n, row_number() OVER (ORDER BY n DESC, author) AS place FROM s QUALIFY place <= 25""")
def q_most_common(spark: SparkSession, d: str) -> DataFrame:
    """The 25 commonest authors."""
    s = table(spark, d, "submissions").filter("government_author is not null")
    return M.most_common(s, "government_author", 25).select(F.col("government_author").alias("author"), "n", "place")


@query(f"""WITH s AS (SELECT gold_id, lower(trim(stratum)) AS stratum, row_number() OVER (PARTITION BY lower(trim(stratum)) ORDER BY {_hash('gold_id')}, gold_id) AS rn FROM mandate_gold WHERE stratum IS NOT NULL), k AS (SELECT count(DISTINCT stratum) AS k FROM s)
    SELECT gold_id, stratum FROM s, k WHERE rn <= 200 // k""")
def q_sample_equal(spark: SparkSession, d: str) -> DataFrame:
    """Two hundred records allotted equally to the strata."""
    g = table(spark, d, "mandate_gold").filter("stratum is not null").select("gold_id", F.lower(F.trim("stratum")).alias("stratum"))
    return M.equal_allocation(g, ["stratum"], "gold_id", 200)


@query(f"""SELECT doc_id FROM documents WHERE doc_kind = 'provision' AND uslm_id IS NOT NULL AND uslm_id NOT IN (SELECT uslm_id FROM mandate_gold WHERE uslm_id IS NOT NULL) ORDER BY {_hash('doc_id')}, doc_id LIMIT 150""")
def q_sample_excluding(spark: SparkSession, d: str) -> DataFrame:
    """Uniform sample of provisions nobody has adjudicated."""
    p = table(spark, d, "documents").filter("doc_kind = 'provision' and uslm_id is not null").select("doc_id", "uslm_id")
    return M.excluding(p, table(spark, d, "mandate_gold").select("uslm_id"), "uslm_id", 150, by="doc_id").select("doc_id")


@query(f"""WITH g AS (SELECT gold_id, nullif(regexp_extract(uslm_id, {q(C.SECTION_PATH)}, 1), '') AS s FROM mandate_gold), r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY {_hash('gold_id')}, gold_id) AS rn, min({_hash('gold_id')}) OVER (PARTITION BY s) AS h, count(*) OVER (PARTITION BY s) AS n FROM g WHERE s IS NOT NULL),
    p AS (SELECT s, max(gold_id) FILTER (rn = 1) AS first_id, max(gold_id) FILTER (rn = 2) AS second_id, any_value(h) AS h FROM r WHERE n > 1 GROUP BY 1) SELECT s AS section, first_id, second_id FROM p ORDER BY h, s LIMIT 50""")
def q_sample_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Fifty sections, two adjudicated records of each."""
    g = table(spark, d, "mandate_gold").select("gold_id", C.section_of(F.col("uslm_id")).alias("section")).filter("section is not null")
    return M.paired(g, "section", "gold_id", 50)


@query(f"WITH {FILINGS}, {PACKAGE_REQUIREMENTS} SELECT p.package_id, p.mandate_id, f.title, f.date_issued FROM (SELECT DISTINCT package_id, mandate_id FROM candidates WHERE stage = 'B' AND package_id IS NOT NULL) p JOIN f USING (package_id)")
def q_package_details(spark: SparkSession, d: str) -> DataFrame:
    """Title and date of every package that stage B proposed."""
    c = table(spark, d, "candidates").filter("stage = 'B' and package_id is not null").select("package_id", "mandate_id").distinct()
    return c.join(filings(spark, d).select("package_id", "title", "date_issued"), "package_id")


def _candidates() -> str:
    from .catalogue import _SQL

    return _SQL["q_link_candidates"]


@query(f"""WITH {FILINGS}, c AS ({_candidates()}), o AS (SELECT c.package_id, list(c.mandate_id ORDER BY rank) AS ids, string_agg(c.mandate_id || ': ' || left(trim(regexp_replace(coalesce(r.nature_of_report, ''), '[ \\t\\n\\r]+', ' ', 'g')), 200), chr(10) ORDER BY rank) AS lines FROM c JOIN report r USING (mandate_id) GROUP BY 1),
    p AS (SELECT f.package_id, ids, 'Filing: ' || left(trim(coalesce(title, '')), 6000) || chr(10) || 'Candidates:' || chr(10) || lines AS prompt FROM f LEFT JOIN o USING (package_id) WHERE {EVERY}),
    n AS (SELECT *, CAST('0x' || left(md5(prompt), 8) AS BIGINT) % (len(ids) + 1) AS i FROM p)
    SELECT package_id, CASE WHEN ids IS NULL OR i = len(ids) THEN 'none' ELSE ids[i + 1] END AS picked, CASE WHEN ids IS NULL THEN 0 ELSE i END AS alternates FROM n""".replace("\\\\", "\\"))
def q_rescue_picks(spark: SparkSession, d: str) -> DataFrame:
    """A matcher's pick for each filing among its twenty best candidates; answers are held to the candidates, none without any."""
    from ..operators import judges
    from .links import q_link_candidates

    r = table(spark, d, "report").select("mandate_id", "nature_of_report")
    c = q_link_candidates(spark, d).join(r, "mandate_id").groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("mandate_id").alias("id"), F.col("nature_of_report").alias("text")))).alias("o"))  # at most twenty
    f = filings(spark, d).filter(every_20th(F.col("package_id"))).select("package_id", F.concat(F.lit("Filing: "), F.left(F.trim(F.coalesce("title", F.lit(""))), F.lit(6000))).alias("head")).join(c, "package_id", "left")
    asked = f.select("package_id", judges.with_options(F.col("head"), F.col("o")).alias("prompt"), F.transform("o", lambda x: x["id"]).alias("ids"))
    return judges.pick(asked, "prompt", "ids", "stub_pick", unknown="none").select("package_id", "picked", F.size("alternates").cast("long").alias("alternates"))
