"""Round trips through the readers that the tables have no input for: pages of glyphs, XML and HTML of statutes, log streams and an
embedding model are made from the tables, read back, and held against SQL over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import pages as P
from ..operators import statutes as S
from ..operators.judges import embed
from ..runtime import Scratch, table
from ..streaming import logs as L
from .catalogue import query
from .logs import LOG

#: Nations of each region in order of name: what the made documents list.
LISTED = "n AS (SELECT r_regionkey, r_name, n_name, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_name, n_nationkey) AS k FROM nation JOIN region ON r_regionkey = n_regionkey)"


def _listed(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # five regions
    return n.select("r_regionkey", "r_name", "n_name", "n_nationkey", F.row_number().over(Window.partitionBy("r_regionkey").orderBy("n_name", "n_nationkey")).alias("k"))


def _glyphs(rows: DataFrame) -> DataFrame:
    """Glyphs of table cells (``doc_id, page, is_rotated, k, column, text, fontname``), every one stamped twice."""
    g = rows.select("*", F.posexplode(F.split("text", "")).alias("i", "glyph"), F.explode(F.array(F.lit(0.0), F.lit(0.4))).alias("shift")).filter("glyph <> ''")
    along, down = F.col("column") * 200.0 + F.col("i") * 6.0 + F.col("shift"), F.lit(120.0) + F.col("k") * 12.0 + F.col("shift")
    turned = F.col("is_rotated")
    return g.select("doc_id", "page", "is_rotated", F.col("glyph").alias("text"), F.when(turned, down).otherwise(along).alias("x0"), F.when(turned, 1000 - along).otherwise(down).alias("top"), "fontname")


@query(f"""WITH {LISTED} SELECT r_name AS doc_id, CAST(k AS BIGINT) AS place, r_name AS entity, n_name AS nature_of_report, n_nationkey + 1 || ' U.S.C. 7 (9 Stat. ' || k || ')' AS authority, 'Annually' AS when_expected FROM n""")
def q_page_table(spark: SparkSession, d: str) -> DataFrame:
    """Nations printed as tables, one page for each region, every second one turned, with rules, dot leaders and page numbers, and read back."""
    n = _listed(spark, d).select(F.col("r_name").alias("doc_id"), F.lit(1).alias("page"), (F.col("r_regionkey") % 2 == 1).alias("is_rotated"), "r_name", "n_name", "n_nationkey", "k")
    cite = F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit(" U.S.C. 7 (9 Stat. "), F.col("k").cast("string"), F.lit(")"))
    cell = lambda c, text, font="Plain": F.struct(F.lit(c).alias("column"), text.alias("text"), F.lit(font).alias("fontname"))
    cells = n.select("doc_id", "page", "is_rotated", "k", F.explode(F.array(cell(0, F.concat("n_name", F.lit("......"))), cell(1, cite), cell(2, F.lit("Annually")))).alias("c"))
    pages = n.select("doc_id", "page", "is_rotated").distinct()
    heads = pages.select("doc_id", "page", "is_rotated", F.lit(0).alias("k"), cell(0, F.col("doc_id"), "Bold").alias("c"))
    foot = pages.select("doc_id", "page", "is_rotated", F.lit(40).alias("k"), cell(1, F.lit("7")).alias("c"))
    chars = _glyphs(cells.unionByName(heads).unionByName(foot).select("doc_id", "page", "is_rotated", "k", "c.*"))
    turned = F.col("is_rotated")
    part = pages.select("*", F.explode(F.array(F.lit(190.0), F.lit(390.0))).alias("x"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("s"))
    at = F.lit(120.0) + F.col("s") * 20
    rules = part.select("doc_id", "page", "is_rotated", F.lit(900.0).alias("height"), F.when(turned, at).otherwise(F.col("x")).alias("x0"), F.when(turned, at + 15).otherwise(F.col("x")).alias("x1"), F.when(turned, 1000 - F.col("x")).otherwise(at).alias("top"), F.when(turned, 1000 - F.col("x")).otherwise(at + 15).alias("bottom"))
    edge = pages.select("*", F.explode(F.when(turned, F.array(F.lit(80.0), F.lit(100.0))).otherwise(F.array(F.lit(100.0)))).alias("y"))
    edges = edge.select("doc_id", "page", "is_rotated", F.lit(900.0).alias("height"), F.when(turned, F.col("y")).otherwise(0.0).alias("x0"), F.when(turned, F.col("y")).otherwise(600.0).alias("x1"), F.when(turned, 400.0).otherwise(F.col("y")).alias("top"), F.when(turned, 1000.0).otherwise(F.col("y")).alias("bottom"))
    out = P.table_rows(chars, rules.unionByName(edges))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord")).cast("long").alias("place")  # the rows of one page
    return out.select("doc_id", place, "entity", "nature_of_report", "authority", "when_expected")


def _statutes(spark: SparkSession, d: str) -> DataFrame:
    """One XML document for each region: a section, its nations as subsections, a credit and three notes of which one is operative."""
    node = F.concat(F.lit("/us/usc/t"), (F.col("r_regionkey") + 1).cast("string"), F.lit("/s1"))
    sub = F.concat(F.lit('<subsection identifier="'), node, F.lit("/"), F.col("k").cast("string"), F.lit('"><num>('), F.col("k").cast("string"), F.lit(")</num><content>submit a report on "), F.col("n_name"), F.lit(" to the <i>Con</i>gress</content></subsection>"))
    body = _listed(spark, d).withColumn("sub", sub).groupBy("r_regionkey", "r_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "sub"))), lambda s: s["sub"]), "").alias("subs"))
    note = lambda topic, role, text: F.concat(F.lit(f'<note topic="{topic}" role="{role}"><p>'), text, F.lit("</p></note>"))
    long = F.concat(F.lit("The head of "), F.col("r_name"), F.lit(" shall report on notes as well, every year."))
    notes = F.concat(F.lit("<notes>"), note("amendments", "", long), note("miscellaneous", "crossHeading", long), note("miscellaneous", "", long), F.lit("</notes>"))
    return body.select("r_name", F.concat(F.lit('<m xmlns="http://x"><section identifier="'), node, F.lit('"><num>1.</num><heading>'), F.col("r_name"), F.lit("</heading><chapeau>The head shall-</chapeau>"), F.col("subs"), F.lit("<sourceCredit>(Pub. L. 101-5)</sourceCredit>"), notes, F.lit("</section></m>")).alias("body"))


NODES = f"""{LISTED}, s AS (SELECT *, '/us/usc/t' || (r_regionkey + 1) || '/s1' AS sid, '(' || k || ') submit a report on ' || n_name || ' to the Congress' AS own FROM n),
    g AS (SELECT sid, r_name, '1. ' || r_name || ' The head shall- ' || string_agg(own, ' ' ORDER BY k) || ' (Pub. L. 101-5)' AS own FROM s GROUP BY 1, 2)"""
NOTE = "'The head of ' || r_name || ' shall report on notes as well, every year.'"


@query(f"""WITH {NODES} SELECT sid || '/' || k AS uslm_id, sid AS section_id, r_name AS section_heading, own AS text, CAST(0 AS INT) AS notes FROM s UNION ALL SELECT sid, sid, r_name, own, 1 FROM g""")
def q_xml_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of made statutes with their texts and operative notes."""
    return S.node_index(_statutes(spark, d)).select("uslm_id", "section_id", "section_heading", "text", F.size("statutory_notes").alias("notes"))


@query(f"""WITH {NODES} SELECT sid || '/' || k AS uslm_id, '1. ' || r_name || ' The head shall- ' || own AS text, 'provision' AS source FROM s UNION ALL SELECT sid || '/note/0', r_name || ' ' || {NOTE}, 'note' FROM g UNION ALL SELECT sid, own, 'provision' FROM g WHERE length(own) > 30 AND length(own) < 4000""")
def q_xml_provisions(spark: SparkSession, d: str) -> DataFrame:
    """Provisions of made statutes with the context of their section, and notes with synthetic ids."""
    return S.provision_stream(_statutes(spark, d), low=30)


@query("SELECT '/us/usc/t' || (r_regionkey + 1) || '/s1' AS section_id, '(Pub. L. 101-5)' AS credit FROM region")
def q_xml_credits(spark: SparkSession, d: str) -> DataFrame:
    """Source credits of made statutes."""
    return S.credit_index(_statutes(spark, d))


@query(f"""WITH {LISTED} SELECT r_name, 'uslm' AS kind, 'Sec. 2. ' || n_name || ' shall report.' AS text FROM n WHERE k = 2 UNION ALL SELECT r_name, 'htm', 'SEC. 2. ' || n_name || '. It shall report & tell.' FROM n WHERE k = 2""")
def q_law_sections(spark: SparkSession, d: str) -> DataFrame:
    """Second section of made public laws, from XML and from pages with a table of contents and side notes."""
    k = F.col("k").cast("string")
    join = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", c.alias("x")))), lambda s: s["x"]), "")
    section = F.concat(F.lit('<section><num value="'), k, F.lit('">Sec. '), k, F.lit(".</num><content>"), F.col("n_name"), F.lit(" shall report.</content></section>"))
    entry, text = F.concat(F.lit("\nSec. "), k, F.lit(". X."), F.lit("\n")), F.concat(F.lit("\nSEC. "), k, F.lit(". "), F.col("n_name"), F.lit(". It &lt;&lt;NOTE: Deadline.&gt;&gt; shall <b>report</b> &amp; tell.\n"))
    laws = _listed(spark, d).groupBy("r_name").agg(F.concat(F.lit("<law>"), join(section), F.lit("</law>")).alias("uslm"), F.concat(F.lit("<pre>"), join(entry), join(text), F.lit("</pre>")).alias("htm"))
    both = laws.select("r_name", F.explode(F.create_map(F.lit("uslm"), F.col("uslm"), F.lit("htm"), F.col("htm"))).alias("kind", "body"))
    return both.select("r_name", "kind", S.law_section(F.col("body"), F.lit("2"), F.col("kind")).alias("text"))


@query(f"WITH {LOG}, x AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, judge ORDER BY log_seq DESC) AS rn FROM l WHERE judge IS NOT NULL) SELECT candidate_id, judge, verdict, log_seq FROM x WHERE rn = 1")
def q_stream_log(spark: SparkSession, d: str) -> DataFrame:
    """The log written as JSON lines with a torn last line, streamed in micro-batches, appended once each, and reduced to the last
    record of each judge on each candidate."""
    from .logs import log

    at = Scratch(spark, "stream").root
    rows = log(spark, d).filter("judge is not null").select("candidate_id", "judge", "verdict", "log_seq")
    torn = spark.createDataFrame([('{"candidate_id":"x","judge":"y","ver',)], "value string")
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).repartition(4, "value").unionByName(torn).write.text(f"{at}/in")
    L.append_batches(L.stream_log(spark, f"{at}/in", rows.schema, files=2), f"{at}/out", f"{at}/checkpoint").awaitTermination()
    done = spark.read.schema(rows.schema).parquet(f"{at}/out").select(*rows.columns)
    return L.last_per_key(done, ["candidate_id", "judge"], ["log_seq"])


@query("SELECT doc_id, CAST(length(left(text, 512)) AS BIGINT) AS n, CAST(length(left(text, 512)) - length(replace(left(text, 512), 'e', '')) AS BIGINT) AS e FROM documents")
def q_embed(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of documents from a model that counts characters, called in batches over the first 512 characters, its window."""
    v = embed(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", lambda texts: [[float(len(t)), float(t.count("e"))] for t in texts])
    at = lambda i: F.get("vector", F.lit(i)).cast("long")
    return v.select("doc_id", at(0).alias("n"), at(1).alias("e"))

