"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import Scratch, spread

#: Fractional part of the golden ratio in units of 2**-32: slot i of a mix lies at the fraction i * GOLDEN mod 2**32.
GOLDEN = 2654435769
#: Broadcast bound: most (mix, source) pairs.
MOST_TARGETS = 100_000


@dataclass
class Mix:
    """``schedule``: texts in the order of the slots; ``usage``: mix, key, source, n_tokens, times_used, counted from the
    schedule; ``shares``: one row per target, summed from the usage."""

    usage: DataFrame
    shares: DataFrame
    schedule: DataFrame


def _order(seed: str, key: str) -> Column:
    return F.xxhash64(F.lit(seed), F.col(key))


def mix_sources(texts: DataFrame, key: str, source: str, size: str, targets: list[tuple[str, str, float, int]], scratch: Scratch, total: dict[str, int] | None = None, block: int = 8192) -> Mix:
    """Combine texts so that each source has its share of a mix's tokens.

    ``targets`` has (mix, source, weight, max repeats). Weights are relative among the sources of a mix that have
    tokens and may be used; the others are reported with share 0. The size of a mix is ``total[mix]`` tokens if given,
    else the largest at which no source exceeds its repeats; a source that would exceed them at a given total is held
    at its cap and its shortfall reported. Source s supplies ``quota`` tokens: whole passes over its texts, in an order
    shuffled anew per pass, and a last part of a pass; a text belongs to the quota if it starts within it, so a source
    misses its quota by less than one text.

    The schedule cuts each source's stream into blocks of ``block`` tokens and lays slots 0, 1, 2, ... at golden-ratio
    points; the source whose cumulative weight holds the point gets the slot, and its k-th slot takes its k-th block.
    So every prefix of the mix has shares close to the whole. Blocks of a source that got too few of the slots (a small
    weight, or others held at their caps) follow behind the last slot, spaced by the weights, so every block is placed
    once. Usage and shares are counted from the schedule. Both streams and slots are ranked by bucketed prefix
    sums: no source is collected into one task. Null sources belong to no mix, texts of no tokens are used 0 times,
    repeated keys count as texts of their own; a mix without usable source has size 0.
    """
    spark = scratch.spark
    if len(targets) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    named = sorted({s for _, s, _, _ in targets})
    base = scratch.put(texts.filter(F.col(source).isNotNull()).select(key, F.col(source).alias("source"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n_tokens")).filter(F.col("source").isin(named)), "texts")
    have = {r["source"]: (r["t"], r["n"]) for r in base.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}  # as many as targets
    rows, sizes = [], {}
    for mix in sorted({m for m, *_ in targets}):
        own = [(s, float(w), int(r)) for m, s, w, r in targets if m == mix]
        live = [(s, w, r) for s, w, r in own if w > 0 and r > 0 and have.get(s, (0, 0))[0] > 0]
        whole = sum(w for _, w, _ in live)
        size_of = min((have[s][0] * r * whole / w for s, w, r in live), default=0.0)
        if total and mix in total:
            size_of = float(total[mix])
        sizes[mix] = size_of
        for s, w, r in own:
            t, n = have.get(s, (0, 0))
            on = any(x[0] == s for x in live)
            quota = min(int(math.floor(size_of * w / whole + 1e-6)), t * r) if on else 0
            rows.append((mix, s, w, r, w / sum(x[1] for x in own), w / whole if on else 0.0, t, n, quota, quota // t if t else 0, quota % t if t else 0))
    plan = spark.createDataFrame(rows, "mix_name string, source string, weight double, max_repeats int, target_share double, live_share double, source_tokens long, source_texts long, quota long, full long, rest long")
    passes = max((r[9] for r in rows), default=0) + 1  # at most the largest max_repeats + 1
    schedule = scratch.put(_schedule(base, key, rows, sizes, passes, block, scratch), "schedule")
    b = F.broadcast(plan)  # no more rows than targets, checked above
    unused = base.join(b.select("mix_name", "source"), "source").select("mix_name", key, "source", "n_tokens", F.lit(0).cast("long").alias("times"))
    used = schedule.select("mix_name", key, "source", "n_tokens", F.lit(1).cast("long").alias("times"))
    usage = unused.unionByName(used).groupBy("mix_name", key, "source", "n_tokens").agg(F.sum("times").alias("times_used"))
    reached = usage.groupBy("mix_name", "source").agg(
        F.sum(F.col("n_tokens") * F.col("times_used")).alias("tokens"), F.sum((F.col("times_used") > 0).cast("long")).alias("texts_used"), F.max("times_used").alias("most_used")
    )
    shares = plan.join(reached, ["mix_name", "source"], "left").fillna(0, ["tokens", "texts_used", "most_used"])
    everything = F.sum("tokens").over(Window.partitionBy("mix_name"))
    shares = shares.select(
        "mix_name", F.col("source").alias("source_name"), "target_share", F.coalesce(F.try_divide(F.col("tokens"), everything), F.lit(0.0)).alias("actual_share"),
        "tokens", "quota", "source_texts", "texts_used", "most_used", "max_repeats",
    )
    return Mix(usage, shares, schedule)


def _schedule(base: DataFrame, key: str, rows: list[tuple], sizes: dict[str, float], passes: int, block: int, scratch: Scratch) -> DataFrame:
    """``mix_name, slot, source, block_no, place, <key>, n_tokens``: texts in the order in which the mix reads them."""
    spark = scratch.spark
    # stream of each source: pass p starts at p * source_tokens; a text is in the block in which it starts
    stream = None
    for p in range(passes):
        live = sorted({r[1] for r in rows if r[9] > p or (r[9] == p and r[10] > 0)})
        if not live:
            continue
        one = spread(base.filter(F.col("source").isin(live) & (F.col("n_tokens") > 0)), ["source"], _order(f"pass {p}", key), F.col(key), F.col("n_tokens"), rank="start", total="tokens_all")
        one = one.select(key, "source", "n_tokens", (F.col("start") + F.lit(p) * F.col("tokens_all")).alias("start"))
        stream = one if stream is None else stream.unionByName(one)
    slots = None
    edges, span = [], {}
    for mix in sizes:
        own = [r for r in rows if r[0] == mix and r[8] > 0]
        n = sum(-(-r[8] // block) for r in own)
        upto = 0
        span[mix] = n + n // 8 + 64 * len(own)
        for r in own:
            width = round(2**32 * r[5] / sum(x[5] for x in own))
            edges.append((mix, r[1], upto, upto + width if r is not own[-1] else 2**32, -(-r[8] // block), r[8]))
            upto += width
        if n:
            # golden-ratio points stray from their share by a few log n slots, so the last blocks may lie beyond n; the surplus is dropped
            s = spark.range(0, span[mix]).select(F.lit(mix).alias("mix_name"), F.col("id").alias("slot"))
            slots = s if slots is None else slots.unionByName(s)
    columns = f"mix_name string, slot long, source string, block_no long, place long, {key} {base.schema[key].dataType.simpleString()}, n_tokens long"
    if slots is None or stream is None:
        return spark.createDataFrame([], columns)
    bounds = F.broadcast(spark.createDataFrame(edges, "mix_name string, source string, low long, high long, blocks long, quota long"))
    point = F.pmod(F.pmod(F.col("slot") + 1, F.lit(1 << 31)) * F.lit(GOLDEN), F.lit(1 << 32))
    placed = slots.withColumn("point", point).join(bounds, "mix_name").filter("point >= low and point < high").select("mix_name", "source", "slot", "blocks", "quota")
    # slots are ranked per source in chunks: chunk counts give offsets
    chunk = 1 << 16
    placed = scratch.put(placed.withColumn("chunk", F.floor(F.col("slot") / chunk).cast("long")), "slots")
    counts = placed.groupBy("mix_name", "source", "chunk").agg(F.count("*").alias("n"))
    w = Window.partitionBy("mix_name", "source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, 0)
    offsets = counts.select("mix_name", "source", "chunk", (F.sum("n").over(w) - F.col("n")).alias("before"))
    inner = Window.partitionBy("mix_name", "source", "chunk").orderBy("slot")
    ranked = placed.join(offsets, ["mix_name", "source", "chunk"]).withColumn("block_no", F.col("before") + F.row_number().over(inner) - 1)
    ranked = ranked.filter(F.col("block_no") < F.col("blocks")).select("mix_name", "source", "slot", "block_no", "quota")
    # blocks without a slot: the k-th left of a source lies (k + 1/2) / weight behind the last slot, in units of the greatest weight left
    got = {(r["mix_name"], r["source"]): r["n"] for r in counts.groupBy("mix_name", "source").agg(F.sum("n").alias("n")).collect()}  # as many as targets
    lacking, late = {}, []
    for m, src, _, _, need, quota in edges:
        if got.get((m, src), 0) < need:
            lacking.setdefault(m, []).append((src, got.get((m, src), 0), need, quota))
    live_share = {(r[0], r[1]): r[5] for r in rows}
    for m, own in lacking.items():
        top = max(live_share[m, src] for src, *_ in own)
        late += [(m, src, have, need, quota, top / live_share[m, src], i, len(own), span[m]) for i, (src, have, need, quota) in enumerate(own)]
    if late:
        rest = spark.createDataFrame(late, "mix_name string, source string, have long, need long, quota long, step double, i long, among long, span long")
        rest = rest.withColumn("from", F.explode(F.sequence("have", F.col("need") - 1, F.lit(chunk).cast("long"))))
        rest = rest.withColumn("block_no", F.explode(F.sequence("from", F.least(F.col("from") + chunk, F.col("need")) - 1)))
        slot = F.col("span") + F.floor((F.col("block_no") - F.col("have") + 0.5) * F.col("step")).cast("long") * F.col("among") + F.col("i")
        ranked = ranked.unionByName(rest.select("mix_name", "source", slot.alias("slot"), "block_no", "quota"))
    blocks = stream.withColumn("block_no", F.floor(F.col("start") / block).cast("long"))
    out = ranked.join(blocks, ["source", "block_no"]).filter("start < quota")
    return out.select("mix_name", "slot", "source", "block_no", (F.col("start") - F.col("block_no") * block).alias("place"), key, "n_tokens")
