"""Queries of the text, citation and rule functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import citations as C
from ..functions import rules as R
from ..functions import text as X
from ..operators import statutes as S
from ..operators.statutes import destination, html_text
from ..runtime import table
from .catalogue import query

YEAR = 2024
FOLD = f"'{C.DASHES}', '{'-' * len(C.DASHES)}'"


def q(s: str) -> str:
    """A Python string as an SQL literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_norm(x: str) -> str:
    return f"trim(regexp_replace(trim(regexp_replace(lower(strip_accents({x})), '[ \\t\\n\\r\\f]+', ' ', 'g')), '[.,;:!?]+$', ''))"


def sql_tokens(x: str) -> str:
    stop = ", ".join(map(q, X.STOPWORDS))
    return f"list_sort(list_distinct(list_filter(regexp_extract_all({sql_norm(f'coalesce({x}, {q('')})')}, '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({stop}))))"


def sql_keys(x: str, pattern: str) -> str:
    t = f"translate(coalesce({x}, ''), {FOLD})"
    return f"list_sort(list_distinct(list_transform(list_zip(regexp_extract_all({t}, {q(pattern)}, 1), regexp_extract_all({t}, {q(pattern)}, 2)), lambda p: p[1] || '/' || p[2])))"


def sql_case(text: str, rules: list[tuple[str, str]], otherwise: str, whole: bool = True) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, {q(R.bounded(p) if whole else p)}) THEN {q(k)}" for k, p in rules) + f" ELSE {otherwise} END"


SQUEEZED = "regexp_replace(lower(coalesce({}, '')), '[ \\t\\n\\r]+', ' ', 'g')"


@query(f"SELECT mandate_id, {sql_norm('nature_of_report')} AS nature FROM report")
def q_normalize_text(spark: SparkSession, d: str) -> DataFrame:
    """Normal form of every duty text."""
    return table(spark, d, "report").select("mandate_id", X.normalize_text(F.col("nature_of_report")).alias("nature"))


@query(f"SELECT mandate_id, len({sql_tokens('nature_of_report')}) AS n, array_to_string({sql_tokens('nature_of_report')}, ' ') AS tokens FROM report")
def q_token_set(spark: SparkSession, d: str) -> DataFrame:
    """Content words of every duty text."""
    t = X.token_set(F.col("nature_of_report"))
    return table(spark, d, "report").select("mandate_id", t.alias("t")).select("mandate_id", F.size("t").alias("n"), F.array_join("t", " ").alias("tokens"))


@query("SELECT entity_id, trim(regexp_replace(lower(regexp_replace(strip_accents(canonical_name), '&', ' and ', 'g')), '[^a-z0-9]+', ' ', 'g')) AS name_key FROM entity_list")
def q_key_normalize(spark: SparkSession, d: str) -> DataFrame:
    """Comparison key of every canonical name."""
    return table(spark, d, "entity_list").select("entity_id", X.basic_key(F.col("canonical_name")).alias("name_key"))


@query(r"""WITH s AS (SELECT package_id, fetched_at, trim(regexp_replace(government_author, '\s*\([^()]*\)\s*$', '')) AS a FROM submissions)
    SELECT package_id, trim(string_split_regex(a, '\s+[-–—]\s+')[1]) AS parent, count(*) AS n FROM s GROUP BY 1, 2""")
def q_parent_split(spark: SparkSession, d: str) -> DataFrame:
    """Parent part of every author, per package."""
    parent, _ = X.split_parent(F.col("government_author"))
    return table(spark, d, "submissions").groupBy("package_id", parent.alias("parent")).agg(F.count("*").alias("n"))


def sql_key(x: str) -> str:
    return f"trim(regexp_replace(lower(regexp_replace(strip_accents({x}), '&', ' and ', 'g')), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH n AS (SELECT {sql_key('canonical_name')} AS k, entity_id FROM entity_list UNION ALL SELECT {sql_key('acronym')}, entity_id FROM entity_list WHERE acronym IS NOT NULL), e AS (SELECT k, max(entity_id) AS entity_id FROM n WHERE k <> '' GROUP BY 1),
    v AS (SELECT mandate_id, {sql_key(r"trim(string_split_regex(trim(regexp_replace(reporting_entity, '\s*\([^()]*\)\s*$', '')), '\s+[-–—]\s+')[1])")} AS k FROM report),
    w AS (SELECT mandate_id, k, CASE WHEN k LIKE '% department' THEN 'department of ' || left(k, length(k) - 11) END AS k2 FROM v)
    SELECT mandate_id, coalesce(a.entity_id, b.entity_id) AS entity_id, w.k AS agency_key FROM w LEFT JOIN e a ON a.k = w.k LEFT JOIN e b ON b.k = w.k2""")
def q_alias_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Canonical agency of the parent part by key: a name or acronym on the list (the last entry on a clash), then the turned-round
    department form."""
    names = table(spark, d, "entity_list")
    e = names.select(X.basic_key(F.col("canonical_name")).alias("k"), "entity_id").unionByName(names.filter("acronym is not null").select(X.basic_key(F.col("acronym")).alias("k"), "entity_id"))
    e = F.broadcast(e.filter("k <> ''").groupBy("k").agg(F.max("entity_id").alias("entity_id")))  # the list doesn't grow
    parent, _ = X.split_parent(F.col("reporting_entity"))
    v = table(spark, d, "report").select("mandate_id", X.basic_key(parent).alias("k"))
    v = v.withColumn("k2", F.when(F.col("k").endswith(" department"), F.expr("'department of ' || left(k, length(k) - 11)")))
    out = v.join(e.withColumnRenamed("entity_id", "a"), "k", "left").join(e.select(F.col("entity_id").alias("b"), F.col("k").alias("k2")), "k2", "left")
    return out.select("mandate_id", F.coalesce("a", "b").alias("entity_id"), F.col("k").alias("agency_key"))


@query(f"SELECT mandate_id, array_to_string({sql_keys('authority', C.USC)}, ';') AS usc, array_to_string({sql_keys('authority', C.PLAW)}, ';') AS plaw, array_to_string({sql_keys('authority', C.STAT)}, ';') AS stat FROM report")
def q_cite_extract(spark: SparkSession, d: str) -> DataFrame:
    """Matching-grade citation keys of every mandate."""
    c = table(spark, d, "report").select("mandate_id", C.parse_citations(F.col("authority")).alias("c"))
    join = lambda k: F.array_join(F.array_sort(F.transform(F.col(f"c.{k}"), lambda p: F.concat(p["a"], F.lit("/"), p["b"]))), ";").alias(k)
    return c.select("mandate_id", join("usc"), join("plaw"), join("stat"))


def _fields(pattern: str, t: str) -> str:
    return ", ".join(f"regexp_extract_all({t}, {q(pattern)}, {g})" for g in range(1, 6))


@query(f"""WITH r AS (SELECT mandate_id, translate(coalesce(authority, ''), {FOLD}) AS a FROM report),
    x AS (SELECT mandate_id, unnest(list_zip({_fields(C.USC_PATH, 'a')})) AS m FROM r),
    y AS (SELECT mandate_id, m[1] AS title, m[2] <> '' AS is_appendix, m[3] AS section, m[4] AS subs, m[5] <> '' AS is_note FROM x),
    z AS (SELECT *, '/us/usc/t' || lower(title) || CASE WHEN is_appendix THEN 'a' ELSE '' END || '/s' || lower(section) AS section_id FROM y)
    SELECT DISTINCT mandate_id, section_id, CASE WHEN is_note THEN section_id ELSE section_id || replace(replace(subs, '(', '/'), ')', '') END AS uslm_id,
      title || ' U.S.C. ' || CASE WHEN is_appendix THEN 'App. ' ELSE '' END || section || subs || CASE WHEN is_note THEN ' note' ELSE '' END AS cite FROM z""")
def q_authority_parse(spark: SparkSession, d: str) -> DataFrame:
    """Addressing-grade citations of every mandate."""
    x = table(spark, d, "report").select("mandate_id", F.explode(C.parse_authority(F.col("authority"))).alias("x"))
    return x.select("mandate_id", "x.section_id", "x.uslm_id", "x.cite").distinct()


SPANS = f"list_filter(string_split(regexp_replace(translate(coalesce(authority, ''), {FOLD}), {q(C.PLAW_SPAN)}, chr(30) || '\\0', 'g'), chr(30)), lambda s: regexp_extract(s, {q(C.PLAW)}, 1) <> '')"


@query(f"""WITH s AS (SELECT mandate_id, unnest({SPANS}) AS s FROM report)
    SELECT DISTINCT mandate_id, CAST(regexp_extract(s, {q(C.PLAW)}, 1) AS INT) AS congress, CAST(regexp_extract(s, {q(C.PLAW)}, 2) AS INT) AS number, nullif(regexp_extract(s, {q(C.SECTION_MARK)}, 1), '') AS section,
      CASE WHEN CAST(regexp_extract(s, {q(C.PLAW)}, 1) AS INT) >= {C.FIRST_COLLECTED} THEN 'PLAW-' || regexp_extract(s, {q(C.PLAW)}, 1) || 'publ' || regexp_extract(s, {q(C.PLAW)}, 2) END AS package_id FROM s""")
def q_plaw_sections(spark: SparkSession, d: str) -> DataFrame:
    """Public laws with the first section named behind each, and their packages."""
    x = table(spark, d, "report").select("mandate_id", F.explode(C.plaw_sections(F.col("authority"))).alias("x")).select("mandate_id", "x.*")
    return x.withColumn("package_id", C.package_id(F.col("congress"), F.col("number")))


@query(f"""WITH s AS (SELECT mandate_id, unnest({SPANS}) AS s FROM report),
    t AS (SELECT mandate_id, regexp_extract(s, {q(C.PLAW)}, 1) AS c, regexp_extract(s, {q(C.PLAW)}, 2) AS n, unnest(regexp_extract_all(s, {q(C.SECTION_MARK)}, 1)) AS section FROM s)
    SELECT DISTINCT mandate_id, CAST(c AS INT) AS congress, CAST(n AS INT) AS number, section FROM t""")
def q_credit_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every section named behind each public law."""
    return table(spark, d, "report").select("mandate_id", F.explode(C.credit_keys(F.col("authority"))).alias("x")).select("mandate_id", "x.*")


@query(f"""WITH a AS (SELECT mandate_id, list_transform(list_zip(regexp_extract_all(translate(coalesce(authority, ''), {FOLD}), {q(C.PLAW)}, 1), regexp_extract_all(translate(coalesce(authority, ''), {FOLD}), {q(C.PLAW)}, 2)), lambda p: CAST(p[1] AS INT) * 100000 + CAST(p[2] AS INT)) AS k FROM report)
    SELECT mandate_id, list_max(k) // 100000 AS congress, list_max(k) % 100000 AS number, list_max(k) >= 117 * 100000 + 263 AS recent FROM a""")
def q_newest_law(spark: SparkSession, d: str) -> DataFrame:
    """Newest public law a mandate cites, and whether it is as new as a given one; null without laws."""
    n = table(spark, d, "report").select("mandate_id", C.newest_law(C.parse_citations(F.col("authority"))["plaw"]).alias("n"))
    return n.select("mandate_id", "n.congress", "n.number", (F.col("n") >= F.struct(F.lit(117).alias("congress"), F.lit(263).alias("number"))).alias("recent"))


@query("""SELECT package_id, kind, count(*) AS n FROM (
      SELECT DISTINCT package_id, kind, x[1] AS a, x[2] AS b FROM (
        SELECT package_id, 'usc' AS kind, unnest(cite_refs.usc) AS x FROM submissions UNION ALL
        SELECT package_id, 'plaw', unnest(cite_refs.plaw) FROM submissions UNION ALL SELECT package_id, 'stat', unnest(cite_refs.stat) FROM submissions)
      WHERE x[1] IS NOT NULL AND x[2] IS NOT NULL) GROUP BY 1, 2""")
def q_references_flat(spark: SparkSession, d: str) -> DataFrame:
    """Citation keys in the nested references of each package, by kind."""
    x = table(spark, d, "submissions").select("package_id", F.explode(C.flatten_references(F.col("cite_refs"))).alias("x"))
    return x.groupBy("package_id", "x.kind").agg(F.countDistinct("x").alias("n"))


@query(f"""SELECT gold_id, nullif(regexp_extract(uslm_id, {q(C.SECTION_PATH)}, 1), '') AS section FROM mandate_gold""")
def q_section_of(spark: SparkSession, d: str) -> DataFrame:
    """Section of every adjudicated node as its id is written."""
    return table(spark, d, "mandate_gold").select("gold_id", C.section_of(F.col("uslm_id")).alias("section"))


@query(f"""WITH s AS (SELECT gold_id, uslm_id, regexp_extract(uslm_id, {q(C.SECTION_PATH)}, 1) AS s FROM mandate_gold),
    p AS (SELECT gold_id, s, list_filter(string_split(substr(uslm_id, length(s) + 2), '/'), lambda x: x <> '') AS r FROM s WHERE s <> '' AND NOT regexp_matches(uslm_id, '/note/[0-9]+$')),
    e AS (SELECT gold_id, s, r, unnest(range(0, len(r))) AS k FROM p)
    SELECT gold_id, CASE WHEN k = 0 THEN s ELSE s || '/' || array_to_string(r[1:k], '/') END AS ancestor, CAST(len(r) - k AS INT) AS distance FROM e""")
def q_path_ancestors(spark: SparkSession, d: str) -> DataFrame:
    """Every enclosing node of every adjudicated node, with its distance."""
    x = table(spark, d, "mandate_gold").select("gold_id", F.posexplode(C.ancestors(F.col("uslm_id"))).alias("p", "ancestor"))
    return x.select("gold_id", "ancestor", (F.col("p") + 1).alias("distance"))


LAW_NODE, CODE_NODE = "^/us/usc/t([0-9A-Za-z_]+)/pl/([0-9]+)/([0-9]+)/s([^/]+)((/[^/]+)*)$", "^/us/usc/t([0-9A-Za-z_]+)/s([^/]+)((/[^/]+)*)$"


@query(f"""WITH d AS (SELECT DISTINCT uslm_id, translate(uslm_id, {FOLD}) AS u FROM documents WHERE uslm_id IS NOT NULL),
    x AS (SELECT *, regexp_extract(u, {q(LAW_NODE)}, ['t', 'c', 'n', 's', 'r']) AS l, regexp_extract(u, {q(CODE_NODE)}, ['t', 's', 'r']) AS k FROM d)
    SELECT uslm_id, CASE WHEN l.t <> '' THEN 'Pub. L. ' || l.c || '-' || l.n || ', § ' || l.s || regexp_replace(l.r, '/([^/]+)', '(\\1)', 'g') || ' (' || rtrim(l.t, 'a') || ' U.S.C. App.)'
      WHEN k.t <> '' THEN k.t || ' U.S.C. ' || k.s || CASE WHEN regexp_matches(k.r, '(^|/)note/[^/]+$') THEN ' note' ELSE regexp_replace(k.r, '/([^/]+)', '(\\1)', 'g') END ELSE uslm_id END AS citation,
      CASE WHEN regexp_matches(u, '^/us/usc/t[0-9]+/s[^/]') THEN 'https://uscode.house.gov/view.xhtml?req=granuleid:USC-prelim-title' || regexp_extract(u, '^/us/usc/t([0-9]+)/s([^/]+)', 1) || '-section' || regexp_extract(u, '^/us/usc/t([0-9]+)/s([^/]+)', 2) || '&num=0&edition=prelim' END AS url FROM x""")
def q_pretty_citation(spark: SparkSession, d: str) -> DataFrame:
    """Readable citation and web address of every node that documents name."""
    u = F.col("uslm_id")
    return table(spark, d, "documents").select("uslm_id").filter("uslm_id is not null").distinct().select("uslm_id", C.citation(u).alias("citation"), C.code_url(u).alias("url"))


@query("""WITH k AS (SELECT reporting_entity, regexp_replace(lower(coalesce(reporting_entity, '')), '[^a-z ]', ' ', 'g') AS s FROM report),
    a AS (SELECT reporting_entity, replace(' ' || regexp_replace(s, ' +', '  ', 'g') || ' ', ' of  the  united  states ', ' ') AS s FROM k)
    SELECT trim(regexp_replace(regexp_replace(s, ' (the|a|an) ', ' ', 'g'), ' +', ' ', 'g')) AS entity_key, count(*) AS n FROM a GROUP BY 1""")
def q_entity_key(spark: SparkSession, d: str) -> DataFrame:
    """Rows per loose actor key."""
    return table(spark, d, "report").groupBy(X.entity_key(F.col("reporting_entity")).alias("entity_key")).agg(F.count("*").alias("n"))


@query("""WITH g AS (SELECT when_expected, min(nature_of_report) AS lo, max(nature_of_report) AS hi, count(*) AS n FROM report WHERE nature_of_report IS NOT NULL GROUP BY 1)
    SELECT when_expected, n, substr(lo, 1, coalesce(list_min(list_filter(range(1, least(length(lo), length(hi)) + 1), lambda i: lo[i] <> hi[i])) - 1, least(length(lo), length(hi)))) AS prefix FROM g""")
def q_common_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Text that the duties of one "when expected" begin with in common."""
    g = table(spark, d, "report").filter("nature_of_report is not null").groupBy("when_expected").agg(F.min("nature_of_report").alias("lo"), F.max("nature_of_report").alias("hi"), F.count("*").alias("n"))
    return g.select("when_expected", "n", X.common_prefix(F.col("lo"), F.col("hi")).alias("prefix"))


@query("""WITH s AS (SELECT DISTINCT government_author, package_id, array_to_string(list_filter(string_split(regexp_replace(regexp_replace(lower(coalesce(title, '')), '(fiscal year|fy) ?[0-9]*|(19|20)[0-9][0-9]', ' ', 'g'), '[^a-z]+', ' ', 'g'), ' '), lambda w: w <> '')[1:8], ' ') AS stem FROM submissions)
    SELECT government_author, stem, count(*) AS n, min(package_id) AS first_id, max(package_id) AS last_id FROM s GROUP BY 1, 2""")
def q_stem_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Filings per author and edition-free title."""
    s = table(spark, d, "submissions").select("government_author", "package_id", X.stem(F.col("title")).alias("stem")).distinct()
    return s.groupBy("government_author", "stem").agg(F.count("*").alias("n"), F.min("package_id").alias("first_id"), F.max("package_id").alias("last_id"))


END = r"(?i)(?:through|until|ending(?:\s+on|\s+in)?|no\s+later\s+than\s+the\s+end\s+of)\s+(?:the\s+)?(?:end\s+of\s+)?(?:(?:fiscal|calendar)\s+year\s+|FY\s*)?(?:[A-Za-z]+\s+[0-9]{1,2},?\s+)?(19[0-9]{2}|20[0-9]{2})"


@query(f"""SELECT doc_id, list_max(list_transform(regexp_extract_all(coalesce(text, ''), {q(END)}, 1), lambda y: CAST(y AS INT))) AS end_year FROM documents""")
def q_end_year_max(spark: SparkSession, d: str) -> DataFrame:
    """Latest end bound stated by every document."""
    return table(spark, d, "documents").select("doc_id", C.terminal_year(F.col("text")).alias("end_year"))


@query("""SELECT mandate_id, list_max(list_transform(list_filter(string_split(regexp_replace(coalesce(when_expected, ''), '[^0-9A-Za-z]+', ' ', 'g'), ' '), lambda y: regexp_full_match(y, '20[0-9]{2}')), lambda y: CAST(y AS INT))) AS year FROM report""")
def q_deadline_year(spark: SparkSession, d: str) -> DataFrame:
    """Latest year in every "when expected"."""
    return table(spark, d, "report").select("mandate_id", C.deadline_year(F.col("when_expected")).alias("year"))


@query("""SELECT 'r-' || left(md5(concat_ws(chr(31), coalesce(reporting_entity, ''), coalesce(nature_of_report, ''), coalesce(authority, ''), coalesce(when_expected, ''))), 10) AS row_id, count(*) AS n FROM report GROUP BY 1""")
def q_row_id(spark: SparkSession, d: str) -> DataFrame:
    """Content ids and how many rows have each."""
    cols = [F.col(c) for c in ("reporting_entity", "nature_of_report", "authority", "when_expected")]
    return table(spark, d, "report").groupBy(X.row_id(*cols).alias("row_id")).agg(F.count("*").alias("n"))


@query("""SELECT bit_xor(CAST('0x' || left(md5(concat_ws(chr(31), mandate_id, coalesce(nature_of_report, ''))), 15) AS BIGINT)) AS fingerprint, count(*) AS n FROM report""")
def q_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    """Order-free fingerprint of the table."""
    return table(spark, d, "report").agg(X.fingerprint(F.col("mandate_id"), F.col("nature_of_report")).alias("fingerprint"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT mandate_id, trim(regexp_replace(regexp_replace(when_expected, '[.]{2,}', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g')) AS s FROM report)
    SELECT mandate_id, trim(regexp_replace(s, '(^|[^A-Za-z])[.]$', '\\1')) AS cell FROM s""".replace("\\\\", "\\"))
def q_clean_cell(spark: SparkSession, d: str) -> DataFrame:
    """Cells without dot leaders."""
    return table(spark, d, "report").select("mandate_id", X.clean_cell(F.col("when_expected")).alias("cell"))


@query("""SELECT event_id, CAST(json_extract(regexp_extract('Answer: ' || props || ' (end)', '(?s)\\{.*\\}', 0), '$.k') AS BIGINT) AS k FROM events""".replace("\\\\", "\\"))
def q_json_loose(spark: SparkSession, d: str) -> DataFrame:
    """A JSON object dug out of surrounding text."""
    text = F.concat(F.lit("Answer: "), F.col("props"), F.lit(" (end)"))
    return table(spark, d, "events").select("event_id", F.from_json(X.loose_json(text), "k bigint")["k"].alias("k"))


ONCE = f"regexp_matches(t, {q(R.bounded('(19|20)[0-9][0-9]'))}) AND NOT regexp_matches(t, {q(R.bounded('each|every|annual|then|thereafter'))})"


@query(f"""WITH r AS (SELECT mandate_id, lower(coalesce(when_expected, '')) AS t FROM report),
    c AS (SELECT mandate_id, CASE WHEN t = '' THEN 'other' ELSE {sql_case('t', R.CADENCES, f"CASE WHEN {ONCE} THEN 'one_time' ELSE 'other' END")} END AS cadence FROM r)
    SELECT mandate_id, cadence, CASE cadence {' '.join(f"WHEN '{k}' THEN {v}" for k, v in R.FRESHNESS.items())} END AS fresh_days FROM c""")
def q_cadence_class(spark: SparkSession, d: str) -> DataFrame:
    """Rhythm and freshness window of every mandate."""
    c = table(spark, d, "report").select("mandate_id", R.cadence(F.col("when_expected")).alias("cadence"))
    return c.withColumn("fresh_days", R.freshness_days(F.col("cadence")))


@query(f"""WITH r AS (SELECT when_expected, lower(trim(coalesce(when_expected, ''))) AS t FROM report)
    SELECT {sql_case('t', R.FREQUENCIES, "CASE WHEN t IN ('', 'unknown', 'none') THEN 'unknown' ELSE 'other' END", whole=False)} AS frequency, count(*) AS n FROM r GROUP BY 1""")
def q_frequency_class(spark: SparkSession, d: str) -> DataFrame:
    """Rows per folded frequency."""
    return table(spark, d, "report").groupBy(R.frequency(F.col("when_expected")).alias("frequency")).agg(F.count("*").alias("n"))


@query(f"""WITH x AS (SELECT doc_id, {SQUEEZED.format('text')} AS t, coalesce(doc_kind, '') = 'note' AS note, list_max(list_transform(regexp_extract_all(coalesce(text, ''), {q(END)}, 1), lambda y: CAST(y AS INT))) AS y FROM documents)
    SELECT doc_id, CASE WHEN coalesce(y < {YEAR}, false) THEN 'expired' WHEN note AND contains(t, 'repeal') THEN 'expired' WHEN regexp_matches(t, {q(R.bounded(R.DOUBTFUL))}) THEN 'review' ELSE 'current' END AS currency FROM x""")
def q_currency(spark: SparkSession, d: str) -> DataFrame:
    """Whether a document's duty still holds, as of a given year."""
    note = F.coalesce(F.col("doc_kind"), F.lit("")) == "note"
    return table(spark, d, "documents").select("doc_id", R.currency(F.col("text"), C.terminal_year(F.col("text")), YEAR, note).alias("currency"))


@query(f"""SELECT doc_id, regexp_matches({SQUEEZED.format('text')}, {q(R.bounded(R.RECIPIENTS))}) AS named, length(text) > 120 AND length(text) < 4000 AS sized FROM documents""")
def q_gate(spark: SparkSession, d: str) -> DataFrame:
    """Recipient gate and own-length bounds of every document."""
    return table(spark, d, "documents").select("doc_id", R.names_recipient(F.col("text")).alias("named"), R.length_between(F.col("text"), 120, 4000).alias("sized"))


def _first_at(pattern: str) -> str:
    """Where a pattern first matches in ``w``, 0 if nowhere."""
    return f"CASE WHEN regexp_matches(w, {q('(?is)' + pattern)}) THEN length(regexp_extract(w, {q('(?is)^(.*?)(?:' + pattern + ')')}, 1)) + 1 ELSE 0 END"


def _behind(verb: str) -> str:
    """Array of what stands behind each match: the text is marked behind the matches and cut at the marks."""
    cut = f"string_split(regexp_replace(t, {q('(?is)' + verb)}, '\\0' || chr(30), 'g'), chr(30))"
    return f"list_transform(range(2, len({cut}) + 1), lambda i: left(array_to_string(({cut})[i:], ''), {S.WINDOW}))"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), x AS (SELECT doc_id, unnest(list_concat({_behind(S.DELIVERY)}, {_behind(S.DIRECT)})) AS w FROM d),
    y AS (SELECT doc_id, regexp_matches(w, {q('(?is)' + S.CHAMBER)}) AS c, {_first_at(S.COMMITTEE)} AS a, {_first_at(S.CONGRESS)} AS b FROM x),
    z AS (SELECT doc_id, max(CASE WHEN c THEN 3 WHEN a > 0 AND (b = 0 OR a <= b) THEN 1 WHEN b > 0 THEN 2 ELSE 0 END) AS tier FROM y GROUP BY 1)
    SELECT doc_id, CASE tier WHEN 3 THEN 'chamber' WHEN 2 THEN 'congress' WHEN 1 THEN 'committee' ELSE 'unknown' END AS destination FROM d LEFT JOIN z USING (doc_id)""")
def q_destination(spark: SparkSession, d: str) -> DataFrame:
    """To whom each document's reports go."""
    return table(spark, d, "documents").select("doc_id", destination(F.col("text")).alias("destination"))


@query("""WITH h AS (SELECT doc_id, '<p>' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), chr(10), '</p><p>') || '</p>' AS h FROM documents),
    s AS (SELECT doc_id, regexp_replace(h, '(?s)<[^>]*>', ' ', 'g') AS s FROM h)
    SELECT doc_id, trim(regexp_replace(replace(replace(s, '&lt;', '<'), '&amp;', '&'), '[ \\t\\n\\r]+', ' ', 'g')) AS text FROM s""".replace("\\\\", "\\"))
def q_html_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts wrapped as HTML and read back."""
    t = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("\n"), F.lit("</p><p>"))
    return table(spark, d, "documents").select("doc_id", html_text(F.concat(F.lit("<p>"), t, F.lit("</p>"))).alias("text"))
