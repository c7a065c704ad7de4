"""Queries of the log, window and sampling operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import candidate_id
from ..operators import glyphs as G
from ..operators import sampling as M
from ..runtime import table
from ..streaming import logs as L
from .catalogue import query

USABLE = ["same", "different", "unclear"]


def log(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").select("candidate_id", "mandate_id", "package_id", "stage", "requirement_number", F.lower(F.trim("judge")).alias("judge"), F.lower(F.trim("verdict")).alias("verdict"), "latency_ms", "judged_at", "log_seq")


LOG = "l AS (SELECT candidate_id, mandate_id, package_id, requirement_number, stage, lower(trim(judge)) AS judge, lower(trim(verdict)) AS verdict, latency_ms, judged_at, log_seq FROM candidates)"
LAST = f"{LOG}, x AS (SELECT *, row_number() OVER (PARTITION BY candidate_id, judge ORDER BY log_seq DESC) AS rn FROM l), t AS (SELECT * FROM x WHERE rn = 1)"


@query(f"WITH {LAST} SELECT candidate_id, judge, verdict, log_seq FROM t")
def q_last_wins_log(spark: SparkSession, d: str) -> DataFrame:
    """Latest record of each judge on each candidate."""
    return L.last_per_key(log(spark, d).select("candidate_id", "judge", "verdict", "log_seq"), ["candidate_id", "judge"], ["log_seq"])


@query(f"WITH {LAST}, d AS (SELECT candidate_id, judge FROM t WHERE verdict IN ('same', 'different', 'unclear')) SELECT DISTINCT candidate_id, judge FROM l ANTI JOIN d USING (candidate_id, judge)")
def q_done_anti(spark: SparkSession, d: str) -> DataFrame:
    """Work that remains: candidate and judge without a usable latest verdict."""
    x = log(spark, d).select("candidate_id", "judge", "verdict", "log_seq")
    return L.work_left(x.select("candidate_id", "judge").distinct(), x, ["candidate_id", "judge"], ["log_seq"], F.col("verdict").isin(USABLE))


@query(f"""WITH {LAST} SELECT candidate_id, count(*) FILTER (verdict IN ('same', 'different', 'unclear')) AS n,
    CASE WHEN count(*) FILTER (verdict IN ('same', 'different', 'unclear')) >= 2 AND count(DISTINCT verdict) FILTER (verdict IN ('same', 'different', 'unclear')) = 1 THEN min(verdict) FILTER (verdict IN ('same', 'different', 'unclear')) ELSE 'unclear' END AS verdict FROM t GROUP BY 1""")
def q_consensus(spark: SparkSession, d: str) -> DataFrame:
    """Unanimity of two or more judges, each counted once."""
    last = L.last_per_key(log(spark, d).select("candidate_id", "judge", "verdict", "log_seq"), ["candidate_id", "judge"], ["log_seq"])
    return L.majority(last, ["candidate_id"], "verdict", USABLE)


@query(f"""WITH {LAST}, u AS (SELECT candidate_id, judge, verdict FROM t WHERE verdict IN ('same', 'different'))
    SELECT a.judge AS judge_a, b.judge AS judge_b, count(*) AS both_judged, count(*) FILTER (a.verdict = b.verdict) AS agreed, round(count(*) FILTER (a.verdict = b.verdict) / count(*), 6) AS rate FROM u a JOIN u b ON a.candidate_id = b.candidate_id AND a.judge < b.judge GROUP BY 1, 2""")
def q_agreement(spark: SparkSession, d: str) -> DataFrame:
    """How often two judges agree; a candidate has at most one verdict per judge, so pairs are few."""
    u = L.last_per_key(log(spark, d).select("candidate_id", "judge", "verdict", "log_seq"), ["candidate_id", "judge"], ["log_seq"]).filter(F.col("verdict").isin("same", "different"))
    a = u.select("candidate_id", F.col("judge").alias("judge_a"), F.col("verdict").alias("va"))
    p = a.join(u.select("candidate_id", F.col("judge").alias("judge_b"), F.col("verdict").alias("vb")), "candidate_id").filter("judge_a < judge_b")
    same = F.sum((F.col("va") == F.col("vb")).cast("long"))
    return p.groupBy("judge_a", "judge_b").agg(F.count("*").alias("both_judged"), same.alias("agreed"), F.round(same / F.count("*"), 6).alias("rate"))


@query("""SELECT CASE stage WHEN 'A' THEN mandate_id || '|R' || coalesce(requirement_number, '') WHEN 'A_validation' THEN mandate_id || '|AV' || coalesce(package_id, '') ELSE mandate_id || '|P' || coalesce(package_id, '') END AS pair_id, count(*) AS n FROM candidates GROUP BY 1""")
def q_candidate_id(spark: SparkSession, d: str) -> DataFrame:
    """Log rows per stage-marked pair id."""
    x = log(spark, d)
    return x.groupBy(candidate_id(F.col("stage"), F.col("mandate_id"), F.col("requirement_number"), F.col("package_id")).alias("pair_id")).agg(F.count("*").alias("n"))


@query("""SELECT package_id, coalesce(arg_min(CASE WHEN trim(title) <> '' THEN title END, fetched_at) , NULL) AS title, arg_min(nullif(trim(branch), ''), fetched_at) AS branch, count(*) AS n FROM (SELECT * FROM submissions ORDER BY package_id) GROUP BY 1""")
def q_first_nonempty_merge(spark: SparkSession, d: str) -> DataFrame:
    """Repeated packages merged: first non-blank value of each field by fetch time."""
    s = table(spark, d, "submissions")
    first = lambda c: F.min_by(c, F.when(c.isNotNull(), F.col("fetched_at")))
    title, branch = F.when(F.trim("title") != "", F.col("title")), F.when(F.trim("branch") != "", F.trim("branch"))
    return s.groupBy("package_id").agg(first(title).alias("title"), first(branch).alias("branch"), F.count("*").alias("n"))


@query("""WITH f AS (SELECT l_orderkey, l_returnflag, min(l_linenumber) AS o FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY o, l_returnflag) AS flags FROM f GROUP BY 1""")
def q_ordered_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Distinct flags of an order in order of first appearance."""
    f = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.min("l_linenumber").alias("o"))
    return f.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "l_returnflag"))), lambda s: s["l_returnflag"]), ",").alias("flags"))


@query("""WITH x AS (SELECT package_id, unnest(requirement_numbers) AS r FROM submissions) SELECT r AS requirement_number, count(DISTINCT package_id) AS packages, string_agg(DISTINCT package_id, ',' ORDER BY package_id) AS ids FROM x WHERE r IS NOT NULL GROUP BY 1""")
def q_ref_union(spark: SparkSession, d: str) -> DataFrame:
    """Packages of every requirement, sorted."""
    x = table(spark, d, "submissions").select("package_id", F.explode("requirement_numbers").alias("requirement_number")).filter("requirement_number is not null").distinct()
    return x.groupBy("requirement_number").agg(F.count("*").alias("packages"), F.array_join(F.array_sort(F.collect_list("package_id")), ",").alias("ids"))


@query("""WITH x AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn, count(*) OVER (PARTITION BY text) AS n FROM documents) SELECT doc_id, n FROM x WHERE rn = 1""")
def q_dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    """First document of each exact text; only digests are shuffled."""
    g = table(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    return g.select("doc_id", "n")


@query("""WITH x AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 1800000000 THEN 1 ELSE 0 END AS s FROM events),
    y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM x) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, min(event_id) AS first_event FROM y GROUP BY 1, 2""")
def q_gap_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Sessions: a gap of over 30 minutes starts a new one."""
    e = table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    s = G.gap_clusters(e, ["user_id"], "us", 1_800_000_000, "event_id", "session")
    return s.groupBy("user_id", F.col("session").cast("long").alias("session")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM events""")
def q_carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """Last purchase up to each event of a user."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    return G.carry_forward(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_purchase").select("event_id", "last_purchase")


@query("""WITH x AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS s FROM events),
    y AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM x) SELECT event_id, count(*) OVER (PARTITION BY user_id, k) AS run_length FROM y""")
def q_run_islands(spark: SparkSession, d: str) -> DataFrame:
    """Length of the run of equal event types each event is in."""
    e = table(spark, d, "events").select("user_id", "event_id", "event_type", "ts")
    same = F.col("event_type") == F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return G.run_lengths(e.withColumn("same", same), ["user_id"], ["ts", "event_id"], F.col("same")).select("event_id", "run_length")


@query("""WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), y AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS pos FROM x) SELECT doc_id, arg_max(length(line), struct_pack(a := length(line), b := -pos)) AS longest, arg_max(pos, struct_pack(a := length(line), b := -pos)) AS pos FROM y GROUP BY 1""")
def q_longest_chunk(spark: SparkSession, d: str) -> DataFrame:
    """Longest line of every document, the first on a tie; stays inside the row."""
    lines = F.split("text", "\n")
    best = F.array_max(F.transform(lines, lambda x, i: F.struct(F.length(x).alias("n"), (-(i + 1)).alias("p"))))
    x = table(spark, d, "documents").filter("text is not null").select("doc_id", best.alias("b"))
    return x.select("doc_id", F.col("b.n").alias("longest"), (-F.col("b.p")).cast("long").alias("pos"))


def _hash(key: str, seed: int = 0) -> str:
    return f"md5(concat_ws(chr(31), CAST({key} AS VARCHAR), '{seed}'))"


@query(f"SELECT doc_id, source FROM documents ORDER BY {_hash('doc_id')}, doc_id LIMIT 100")
def q_sample_hash(spark: SparkSession, d: str) -> DataFrame:
    """A hundred documents by hash order."""
    return M.simple_sample(table(spark, d, "documents").select("doc_id", "source"), "doc_id", 100)


@query(f"SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {_hash('doc_id')}, doc_id) AS rn FROM documents) WHERE rn <= 5")
def q_sample_stratified(spark: SparkSession, d: str) -> DataFrame:
    """Five documents of every source."""
    return M.per_bucket(table(spark, d, "documents").select("doc_id", "source"), ["source"], "doc_id", 5)


@query(f"""WITH x AS (SELECT gold_id, row_number() OVER (PARTITION BY stratum, gold_congressional ORDER BY {_hash('gold_id')}, gold_id) AS rn, count(*) OVER (PARTITION BY stratum, gold_congressional) AS n FROM mandate_gold)
    SELECT gold_id, CASE WHEN rn <= round(n * 0.4) THEN 'train' WHEN rn <= round(n * 0.65) THEN 'validation' ELSE 'test' END AS split FROM x""")
def q_split(spark: SparkSession, d: str) -> DataFrame:
    """Stratified split in shares of 40, 25 and 35 percent."""
    g = table(spark, d, "mandate_gold").select("gold_id", "stratum", "gold_congressional")
    return M.stratified_split(g, ["stratum", "gold_congressional"], "gold_id", [("train", 0.4), ("validation", 0.25), ("test", 0.35)]).select("gold_id", "split")


@query(f"SELECT gold_id, CAST('0x' || left({_hash('gold_id')}, 8) AS BIGINT) % 100 < 20 AS held_out FROM mandate_gold")
def q_hold_out(spark: SparkSession, d: str) -> DataFrame:
    """Every fifth record or so held out by its hash."""
    return M.hold_out(table(spark, d, "mandate_gold").select("gold_id"), "gold_id", 20)
