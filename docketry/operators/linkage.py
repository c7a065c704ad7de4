"""Joins that link records without a common key: inverted indexes, blocking, top-k and argmax."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..runtime import fan_join, hot_keys


def _meet(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: str) -> DataFrame:
    """``left_id, right_id, _k`` for every key two rows have in common; keys that fill much of the right side are dealt to salts."""
    a = left.select(left_id, F.explode(F.array_distinct(keys)).alias("_k"))
    b = right.select(right_id, F.explode(F.array_distinct(keys)).alias("_k"))
    kind = b.schema["_k"].dataType
    # hot keys become literals, so keys of several parts are met by one string
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(f"_k.{p}").cast("string"), F.lit("\x1e")) for p in kind.names]) if isinstance(kind, T.StructType) else F.col("_k")
    b = b.select(right_id, text.alias("_j"))
    return fan_join(a.withColumn("_j", text), b, "_j", hot_keys(b, "_j")).drop("_j")


def shared_keys(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: str) -> DataFrame:
    """Pairs that share at least one element of the array ``keys``: ``left_id, right_id, shared``.

    Both sides are exploded and met on the key, so the plan is an equi-join with partial aggregation, never a product, and
    no task gets a hot key whole. Null and empty arrays meet nothing; repeated elements count once.
    """
    return _meet(left, right, left_id, right_id, keys).groupBy(left_id, right_id).agg(F.count("*").alias("shared"))


def shared_citations(left: DataFrame, right: DataFrame, left_id: str, right_id: str, keys: str) -> DataFrame:
    """As ``shared_keys`` for arrays of (kind, a, b): shared keys per kind, ``kinds`` with any, ``law_only``."""
    n = {k: F.sum((F.col("_k.kind") == k).cast("long")).alias(k) for k in ("usc", "plaw", "stat")}
    pairs = _meet(left, right, left_id, right_id, keys).groupBy(left_id, right_id).agg(*n.values())
    kinds = sum(((F.col(k) > 0).cast("int") for k in n), F.lit(0))
    return pairs.withColumn("kinds", kinds).withColumn("law_only", (F.col("plaw") > 0) & (F.col("usc") == 0) & (F.col("stat") == 0))


def token_scores(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str) -> DataFrame:
    """Pairs sharing a token: ``shared, left_n, right_n, jaccard, overlap`` (overlap coefficient)."""
    pairs = shared_keys(left, right, left_id, right_id, tokens)
    size_l, size_r = left.select(left_id, F.size(tokens).alias("left_n")), right.select(right_id, F.size(tokens).alias("right_n"))
    out = pairs.join(size_l, left_id).join(size_r, right_id)
    either = F.col("left_n") + F.col("right_n") - F.col("shared")
    return out.withColumn("jaccard", F.col("shared") / either).withColumn("overlap", F.col("shared") / F.greatest(F.least("left_n", "right_n"), F.lit(1)))


def top_k(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; ``order`` must end in a unique column, so ties are settled."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= k)


def best_one(df: DataFrame, group: list[str], by: Column, *carry: str) -> DataFrame:
    """The row of each group with the greatest ``by`` (a struct, last part unique), by aggregation rather than a sort."""
    kept = F.struct(*carry)
    return df.groupBy(*group).agg(F.max_by(kept, by).alias("_best")).select(*group, *[F.col(f"_best.{c}").alias(c) for c in carry])


def best_then_candidates(df: DataFrame, group: list[str], rank: str, verdict: str) -> DataFrame:
    """The row of least ``rank`` of each group; where its verdict is ``candidate``, the group's other candidates too. Groups are
    cut to a few rows before."""
    w = Window.partitionBy(*group)
    d = df.withColumn("_r", F.min(rank).over(w)).withColumn("_v", F.min_by(verdict, rank).over(w))
    return d.filter((F.col(rank) == F.col("_r")) | ((F.col("_v") == "candidate") & (F.col(verdict) == "candidate"))).drop("_r", "_v")


def prefer(df: DataFrame, group: list[str], flag: Column, order: list[Column]) -> DataFrame:
    """Rows of a group with ``flag``; where none has it, the first row by ``order``."""
    w = Window.partitionBy(*group)
    d = df.withColumn("_f", flag.cast("int")).withColumn("_any", F.max("_f").over(w)).withColumn("_rn", F.row_number().over(w.orderBy(*order)))
    return d.filter((F.col("_f") == 1) | ((F.coalesce(F.col("_any"), F.lit(0)) == 0) & (F.col("_rn") == 1))).drop("_f", "_any", "_rn")


def blocked(left: DataFrame, right: DataFrame, block: str, everywhere: Column, parts: int = 64) -> DataFrame:
    """Pairs of equal non-null ``block`` plus every left row with the right rows that belong everywhere.

    ``left`` is a stated query set. The right rows that belong everywhere are dealt to ``parts`` blocks, each of which
    meets the query set in a task of its own; an OR in the join condition would force a nested loop instead. A right
    row belongs to exactly one of the two parts, so no pair comes twice. Blocks that fill much of the right side are dealt
    to salts.
    """
    near = right.filter(~everywhere)
    own = fan_join(left, near, block, hot_keys(near, block), parts).drop(block)
    names = [c for c in right.columns if c != block]
    wide = right.filter(everywhere).drop(block).withColumn("_part", F.pmod(F.xxhash64(*names), F.lit(parts)).cast("int"))
    every = left.drop(block).withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return own.unionByName(every.join(wide, "_part").drop("_part"))


def all_of(items: DataFrame, key: str, ok: Column) -> DataFrame:
    """Keys of which every row satisfies ``ok`` (null counts as not)."""
    return items.groupBy(key).agg(F.min(F.coalesce(ok, F.lit(False)).cast("int")).alias("_all")).filter("_all = 1").select(key)


def resolve(cites: DataFrame, nodes: DataFrame, node_id: str, section_id: str, ordinal: str) -> DataFrame:
    """Exact node, else case-folded node (first in ``ordinal`` on a clash), else section: ``resolved_id, resolved_at``.

    ``nodes`` has ``node_id`` and the ordinal; ids met three times by equi-join, the first hit wins.
    """
    exact = nodes.select(F.col(node_id), F.col(node_id).alias("_exact")).distinct()
    folded = nodes.groupBy(F.lower(node_id).alias("_low")).agg(F.min_by(node_id, ordinal).alias("_folded"))
    section = nodes.select(F.col(node_id).alias(section_id), F.col(node_id).alias("_section")).distinct()
    out = cites.join(exact, node_id, "left").withColumn("_low", F.lower(node_id)).join(folded, "_low", "left").join(section, section_id, "left")
    found = F.coalesce("_exact", "_folded", "_section")
    at = F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_folded").isNotNull(), "folded").when(F.col("_section").isNotNull(), "section").otherwise("none")
    return out.withColumn("resolved_id", found).withColumn("resolved_at", at).drop("_exact", "_low", "_folded", "_section")


def note_grades(cites: DataFrame, notes: DataFrame) -> DataFrame:
    """How well a citation of a note finds the note meant: ``note``, ``note_unmatched`` or ``note_absent``, and by what.

    ``cites`` has ``cite_id, section_id, laws, stats`` (arrays of the keys that the citing text names), ``notes`` has
    ``section_id, laws, stats``, one row per note. A note of the section that names one of the laws is meant, else one that
    names one of the Statutes pages, else all the section's notes are kept and the grade says so. Adds ``grade``,
    ``selection`` (``law``, ``stat``, ``unmatched``, ``absent``) and ``notes`` (how many are meant; one that names two of the
    keys counts for each). Notes are counted per section and key first, so a section with very many costs one row per key.
    """

    def hits(kind: str) -> DataFrame:
        n = notes.select("section_id", F.explode(F.array_distinct(kind)).alias("_k")).groupBy("section_id", "_k").agg(F.count("*").alias("n"))
        c = cites.select("cite_id", "section_id", F.explode(F.array_distinct(kind)).alias("_k"))
        return c.join(n, ["section_id", "_k"]).groupBy("cite_id").agg(F.sum("n").alias(f"_{kind}"))

    size = notes.groupBy("section_id").agg(F.count("*").alias("_all"))
    d = cites.join(size, "section_id", "left").join(hits("laws"), "cite_id", "left").join(hits("stats"), "cite_id", "left")
    how = F.when(F.col("_all").isNull(), "absent").when(F.col("_laws") > 0, "law").when(F.col("_stats") > 0, "stat").otherwise("unmatched")
    d = d.withColumn("selection", how).withColumn("notes", F.coalesce("_laws", "_stats", "_all", F.lit(0)))
    grade = F.when(how == "absent", "note_absent").when(how == "unmatched", "note_unmatched").otherwise("note")
    return d.withColumn("grade", grade).drop("_all", "_laws", "_stats")


def listed_tier(rows: DataFrame, key: str, tiers: list[tuple[str, str, DataFrame]], otherwise: str, out: str = "tier") -> DataFrame:
    """``key, out``: the first of ``tiers`` (name, array column of ``rows``, table with the listed keys in ``k``) that lists one of the
    row's keys, else ``otherwise``. One semi-join per tier on exploded distinct keys; null and empty arrays are on no list."""
    found = None
    for i, (_, keys, listed) in enumerate(tiers):
        hit = rows.select(key, F.explode(F.array_distinct(keys)).alias("k")).join(listed.select("k").distinct(), "k", "left_semi").select(key, F.lit(i).alias("_t"))
        found = hit if found is None else found.unionByName(hit)
    best = found.groupBy(key).agg(F.min("_t").alias("_t"))
    name = F.lit(otherwise)
    for i, (label, _, _) in enumerate(tiers):
        name = F.when(F.col("_t") == i, label).otherwise(name)
    return rows.select(key).join(best, key, "left").select(key, name.alias(out))


def select_notes(notes: Column, laws: Column, stats: Column) -> Column:
    """Notes that contain a cited law, else those that contain a cited Statutes page, else all; and which it was.

    ``notes`` is an array of strings; dashes are folded before looking.
    """
    folded = F.transform(notes, lambda n: F.translate(n, "‐‑‒–—−", "------"))
    hits = lambda needles: F.filter(F.arrays_zip(notes.alias("n"), folded.alias("f")), lambda p: F.exists(needles, lambda x: p["f"].contains(x)))
    law, stat = F.transform(hits(laws), lambda p: p["n"]), F.transform(hits(stats), lambda p: p["n"])
    how = F.when(F.size(notes) == 0, "absent").when(F.size(law) > 0, "law").when(F.size(stat) > 0, "stat").otherwise("unmatched")
    return F.struct(F.when(F.size(law) > 0, law).when(F.size(stat) > 0, stat).otherwise(notes).alias("notes"), how.alias("selection"))
