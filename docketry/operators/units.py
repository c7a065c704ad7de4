"""Collapse of duplicate findings of one section into units, by joins on node ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.citations import ancestors, parent_of
from ..functions.text import common_prefix, same_entity
from ..runtime import Scratch

#: What shared text must say for siblings to be one duty.
DUTY = r"(?is)\b(?:shall|must|is required to|are required to)\b[^.;]{0,200}?\b(?:submit|transmit|report|provide|notify|furnish|deliver|prepare|make available)"


def states_duty(text: Column) -> Column:
    """True if a text says that somebody shall report: a modal, then a verb of delivery in the same clause."""
    return text.rlike(DUTY)


def nearest_ancestor(df: DataFrame, id_col: str = "uslm_id") -> DataFrame:
    """``id, ancestor``: the nearest enclosing node that is itself in the table, null if none. Equi-join on exploded paths."""
    up = df.select(id_col, F.posexplode(ancestors(F.col(id_col))).alias("_d", "_a"))
    present = df.select(F.col(id_col).alias("_a")).distinct()
    hit = up.join(present, "_a").groupBy(id_col).agg(F.min_by("_a", "_d").alias("ancestor"))
    return df.select(id_col).distinct().join(hit, id_col, "left")


def owners(found: DataFrame) -> DataFrame:
    """``uslm_id, owner`` for distinct nodes with ``entity`` and ``cadence``.

    A node is linked to its nearest ancestor in the table if both have one cadence and like entities; an ancestor in between
    that isn't alike stops it. The owner is the first ancestor upwards that isn't linked any further. All ancestors of
    a node lie on its own path, so one join finds the chain, however long.
    """
    a = found.select(F.col("uslm_id").alias("ancestor"), F.col("entity").alias("_e"), F.col("cadence").alias("_c"))
    near = nearest_ancestor(found.select("uslm_id")).filter("ancestor is not null")
    alike = F.col("cadence").eqNullSafe(F.col("_c")) & same_entity(F.col("entity"), F.col("_e"))
    linked = found.join(near, "uslm_id").join(a, "ancestor").filter(alike).select("uslm_id")
    tops = found.select("uslm_id").join(linked, "uslm_id", "left_anti").select(F.col("uslm_id").alias("_a"))
    up = found.select("uslm_id").join(linked, "uslm_id", "left_semi").select("uslm_id", F.posexplode(ancestors(F.col("uslm_id"))).alias("_d", "_a"))
    chain = up.join(tops, "_a").groupBy("uslm_id").agg(F.min_by("_a", "_d").alias("_o"))
    return found.select("uslm_id").join(chain, "uslm_id", "left").select("uslm_id", F.coalesce("_o", "uslm_id").alias("owner"))


def siblings(roots: DataFrame) -> DataFrame:
    """``uslm_id, first`` for nodes (``uslm_id, entity, cadence, text``) that are one duty with the first of their cluster.

    Children of one parent with one cadence form clusters in order of id: each joins the first cluster whose first member
    has a like entity, else opens one. Rows of equal entities go the same way, so only an entity's first row is put in
    order; the array folded holds the distinct entities under one parent. A cluster of two or more is one duty if
    the text all members begin with states it.
    """
    family = ["_p", "cadence"]
    r = roots.withColumn("_p", parent_of(F.col("uslm_id"))).filter("_p is not null").withColumn("cadence", F.coalesce("cadence", F.lit("")))
    heads = r.groupBy(*family, "entity").agg(F.min("uslm_id").alias("_id")).groupBy(*family).agg(F.array_sort(F.collect_list(F.struct("_id", "entity"))).alias("_h")).filter(F.size("_h") > 0)
    like = lambda x, y: same_entity(x["entity"], y["entity"])
    kind = "array<struct<_id:string,entity:string>>"
    firsts = F.aggregate("_h", F.array().cast(kind), lambda acc, x: F.when(F.exists(acc, lambda y: like(y, x)), acc).otherwise(F.array_append(acc, x)))
    put = heads.withColumn("_f", firsts).select(*family, "_f", F.explode("_h").alias("_x"))
    put = put.select(*family, F.col("_x.entity").alias("entity"), F.get(F.filter("_f", lambda y: like(y, F.col("_x"))), F.lit(0))["_id"].alias("first"))
    d = r.join(put, [*family, "entity"])
    text = F.coalesce("text", F.lit(""))
    clusters = d.groupBy(*family, "first").agg(F.min(text).alias("lo"), F.max(text).alias("hi"), F.count("*").alias("n"))
    one = clusters.filter("n > 1").filter(states_duty(common_prefix(F.col("lo"), F.col("hi")))).select("first")
    return d.join(one, "first", "left_semi").select("uslm_id", "first")


def collapse(findings: DataFrame, order: tuple[str, ...] = (), scratch: Scratch | None = None) -> DataFrame:
    """``uslm_id, unit_id, rule`` for findings (``uslm_id, entity, cadence, text``): nodes folded into their owners, then owners
    into the first of their siblings. ``rule`` is ``ancestor``, ``sibling`` (an owner folded) or ``own``.

    Of rows of one id the last by ``order`` counts, ties and no order by content, so the result doesn't depend on how rows
    arrive. Null entities, cadences and texts count as empty, null ids are dropped; ids without a section and notes stand
    alone. Everything is joins and aggregates, so a section of any size is fine.
    """
    last = F.max(F.struct(*order, "entity", "cadence", "text")).alias("_l")
    e = F.lit("")
    d = findings.filter(F.col("uslm_id").isNotNull()).groupBy("uslm_id").agg(last)
    scratch = scratch or Scratch(findings.sparkSession, "units")
    d = scratch.put(d.select("uslm_id", *[F.coalesce(F.col(f"_l.{c}"), e).alias(c) for c in ("entity", "cadence", "text")]), "nodes")
    up = scratch.put(owners(d.select("uslm_id", "entity", "cadence")), "owners")
    beside = siblings(d.join(up.filter("owner = uslm_id").select("uslm_id"), "uslm_id", "left_semi")).withColumnRenamed("uslm_id", "owner")
    out = up.join(beside, "owner", "left").withColumn("unit_id", F.coalesce("first", "owner"))
    rule = F.when(F.col("unit_id") == F.col("uslm_id"), "own").when(F.col("owner") != F.col("uslm_id"), "ancestor").otherwise("sibling")
    return out.select("uslm_id", "unit_id", rule.alias("rule"))
