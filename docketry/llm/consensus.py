"""Consensus of annotators' labels by message passing on the item-annotator graph."""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch, hot_keys, skew_join

#: Pseudo-counts behind every reliability: (right, wrong) before any label is seen.
PRIOR = (2.0, 1.0)
#: Annotators with more than this share of the votes are tested for copying; there are fewer than 1 / HEAVY of them.
HEAVY = 1 / 64
#: Up to this many distinct (annotator, label) pairs their rates go through the driver; their number is checked before, more meet by joins.
LOOKUP = 1024
#: Two annotators count as dependent when their covariance exceeds what those with the others explain by a factor, by
#: this much, and by this many standard errors.
EXCESS = (1.15, 0.015, 4.0)


@dataclass
class Consensus:
    """``items``: item, label, score, votes, agreement; ``annotators``: annotator, class, reliability figures."""

    items: DataFrame
    annotators: DataFrame
    rounds: int


def verdict_class(c: Column) -> Column:
    """``same``, ``different`` or ``unclear`` of a loosely spelt verdict; null when it is none of them.

    Case, quotes, punctuation and surrounding words such as "mandate" are ignored; a negated "same" is different.
    """
    s = F.trim(F.regexp_replace(F.lower(c), "[^a-z]+", " "))
    return (
        F.when(s.rlike(r"^(not (the )?same|diff(erent|ers?|s)?|dissimilar)( |$)"), "different")
        .when(s.rlike(r"^(the )?same( |$)"), "same")
        .when(s.rlike(r"^(un(clear|sure|certain)|ambiguous)( |$)"), "unclear")
    )


def latest_votes(log: DataFrame, item: list[str], annotator: str, label: str, order: list[str]) -> DataFrame:
    """One row per item and annotator: the usable ``label`` of the highest ``order``. Null labels and items don't count.

    Partial aggregation comes before the shuffle, so repeated attempts of one annotator stay cheap. Ties in all of
    ``order`` go to the label that sorts last.
    """
    live = log.filter(F.col(label).isNotNull() & F.col(annotator).isNotNull())
    for c in item:
        live = live.filter(F.col(c).isNotNull())
    return live.groupBy(*item, annotator).agg(F.max_by(label, F.struct(*order, label)).alias(label))


def message_passing(votes: DataFrame, item: list[str], annotator: str, label: str, classes: list[str], scratch: Scratch, rounds: int = 60, tolerance: float = 2e-3, joint: bool = True) -> Consensus:
    """Label per item, by messages between items and annotators, one class against the rest.

    For each class, an edge says +1 (this class) or -1 (another). An item's message to an annotator is the belief that
    the class holds, from the prior and what all *other* annotators say. The annotator weighs it with its own label
    and answers with the log-likelihood ratio of that label, its two rates (how often it says + when the class holds
    and when it doesn't) being learnt from all its *other* items. A round is one aggregation per annotator and one per
    item; leaving the receiver out is a subtraction. It ends when no belief moves by more than ``tolerance``, or after
    ``rounds``. The class of highest belief wins, ties go to the first of ``classes``.

    With ``joint``, heavy annotators whose votes agree by more than their reliabilities explain send one joint message per
    item, with the combination of their votes as its label, so that copies don't outvote the rest. It asks that who votes
    on an item doesn't depend on what others said there: where more annotators are called in because the first ones
    disagreed, agreement varies with who is present, which looks like copying and isn't. Then leave it off.

    Items with the same votes have the same messages; they are counted once, with a weight, so the work per round
    follows the number of distinct vote combinations. ``votes`` has one row per item and annotator; labels outside
    ``classes`` (abstentions) make no edge but count in ``votes``. Items whose every vote abstains get a null label.
    An empty table gives empty results.
    """
    edges = scratch.put(votes.filter(F.col(label).isin(classes)).select(*item, F.col(annotator).alias("_a"), F.col(label).alias("_l")), "edges")
    # with two classes the second is the mirror image of the first, so one pass serves both
    beliefs, skills, turns = None, None, 0
    for c in classes[:1] if len(classes) == 2 else classes:
        b, s, n = _one_class(edges, item, c, scratch, rounds, tolerance, joint)
        b = b.select(*item, F.lit(c).alias("class"), "belief")
        if len(classes) == 2:
            b = b.unionByName(b.select(*item, F.lit(classes[1]).alias("class"), (1 - F.col("belief")).alias("belief")))
        beliefs = b if beliefs is None else beliefs.unionByName(b)
        s = s.withColumn("class", F.lit(c))
        skills = s if skills is None else skills.unionByName(s)
        turns = max(turns, n)
    order = F.struct("belief", (-F.array_position(F.array(*map(F.lit, classes)), F.col("class"))).alias("o"))
    best = beliefs.groupBy(*item).agg(F.max_by("class", order).alias("label"), F.max("belief").alias("score"))
    n = [F.col(f"n_{i}") for i in range(len(classes))]
    tally = votes.groupBy(*item).agg(F.count("*").alias("votes"), *[F.sum((F.col(label) == c).cast("int")).alias(f"n_{i}") for i, c in enumerate(classes)])
    cast, pairs = sum(n, F.lit(0)), sum((x * (x - 1) for x in n), F.lit(0))
    tally = tally.select(*item, "votes", cast.alias("usable"), F.array_max(F.array(*n)).alias("largest"), F.when(cast > 1, pairs / (cast * (cast - 1))).alias("agreement"))
    return Consensus(tally.join(best, item, "left").select(*item, "label", "score", "votes", "usable", "largest", "agreement"), skills, turns)


def dependent_blocks(combos: DataFrame, heavy: list[str]) -> list[list[str]]:
    """Groups of ``heavy`` annotators (at most 1 / HEAVY) that agree by more than their reliabilities explain.

    ``combos`` has distinct vote combinations (``v``: array of annotator and sign) with their number ``n``. Were votes
    independent given the truth, covariances would be products of one number per annotator, so for any two others c, d
    the ratio cov(a, b) cov(c, d) / (cov(a, c) cov(b, d)) would be 1. Its median over all c, d tells how much a and b
    agree beyond that; others that copy spoil only a minority of the ratios.
    """
    if len(heavy) < 4:
        return []
    kept = combos.select(F.filter("v", lambda x: x["a"].isin(heavy)).alias("v"), "n").filter(F.size("v") > 1).groupBy("v").agg(F.sum("n").alias("n"))
    x = kept.select("n", "v", F.explode("v").alias("x")).select("n", "x", F.explode("v").alias("y")).filter("x.a < y.a")
    s = lambda c: F.col(f"{c}.s").cast("double")
    rows = x.groupBy(F.col("x.a").alias("a"), F.col("y.a").alias("b")).agg(
        F.sum("n").alias("n"), F.sum(s("x") * F.col("n")).alias("x"), F.sum(s("y") * F.col("n")).alias("y"), F.sum(s("x") * s("y") * F.col("n")).alias("xy")
    ).collect()
    cov, err = {}, {}
    for r in rows:
        n, x, y = r["n"], r["x"] / r["n"], r["y"] / r["n"]
        cov[r["a"], r["b"]] = cov[r["b"], r["a"]] = r["xy"] / n - x * y
        err[r["a"], r["b"]] = math.sqrt(max(x * (1 - x) * y * (1 - y), 1e-4) / n)
    factor, much, errors = EXCESS
    group = {a: {a} for a in heavy}
    sure = {p for p, x in cov.items() if abs(x) > 3 * err[min(p), max(p)]}
    while True:  # the clearest pair joins, then the ratios are taken again without it
        clear = []
        for a, b in sorted(err):
            if b in group[a] or (a, b) not in sure:
                continue
            rest = [h for h in heavy if h not in group[a] and h not in group[b]]
            found = []
            for c, d in itertools.permutations(rest, 2):
                if c not in group[d] and {(c, d), (a, c), (b, d)} <= sure:
                    usual = abs(cov[a, c] * cov[b, d] / cov[c, d])
                    part = sum((err[min(p), max(p)] / cov[p]) ** 2 for p in ((a, c), (b, d), (c, d)))
                    found.append((abs(cov[a, b]) / usual, (abs(cov[a, b]) - usual) / math.sqrt(err[a, b] ** 2 + usual**2 * part)))
            if found:
                ratio, sigmas = (sorted(x)[len(found) // 2] for x in zip(*found))
                excess = abs(cov[a, b]) * (1 - 1 / ratio)
                if ratio > factor and excess > much and sigmas > errors:
                    clear.append((excess, a, b))
        if not clear:
            break
        _, a, b = max(clear)
        group[a] |= group[b]
        for x in group[a]:
            group[x] = group[a]
    return [sorted(g) for g in {id(g): g for g in group.values()}.values() if len(g) > 1]


def _llr(b1: Column, b0: Column, t1: Column, t0: Column, belief: Column) -> Column:
    """What a unit answers to an item: log-likelihood ratio of its label, learnt from all other items. The sums include pseudo-counts."""
    p1, p0 = (b1 - belief) / (t1 - belief), (b0 - (1 - belief)) / (t0 - (1 - belief))
    tiny = F.lit(1e-9)
    return F.log(F.greatest(p1, tiny) / F.greatest(p0, tiny))


def _sigmoid(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), log_odds))))


def _one_class(edges: DataFrame, item: list[str], cls: str, scratch: Scratch, rounds: int, tolerance: float, joint: bool) -> tuple[DataFrame, DataFrame, int]:
    """Belief per item that ``cls`` holds, rates per annotator, and the rounds it took."""
    spark = scratch.spark
    signed = edges.select(*item, F.col("_a").alias("a"), (F.col("_l") == cls).alias("s"))
    # items with the same votes get the same fingerprint, made by partial aggregation: no item's votes are collected
    h = F.xxhash64("a", "s")
    mark = F.concat_ws(":", F.bit_xor(h), F.sum(F.shiftright(F.xxhash64(h, F.lit(1)), 24)), F.count("*")).alias("_p")
    items = scratch.put(signed.groupBy(*item).agg(mark), "items")
    shown = items.groupBy("_p").agg(F.count("*").alias("n"), F.min(F.struct(*item)).alias("_i")).select("_p", "n", *[F.col(f"_i.{c}").alias(c) for c in item])
    flat = scratch.put(signed.join(shown, item).select("_p", "n", "a", "s"), "flat")
    blocks: list[list[str]] = []
    if joint:
        total = flat.agg(F.sum("n")).first()[0] or 0
        heavy = sorted(r["a"] for r in flat.groupBy("a").agg(F.sum("n").alias("n")).filter(F.col("n") > total * HEAVY).collect())
        near = flat.filter(F.col("a").isin(heavy)).groupBy("_p", "n").agg(F.collect_list(F.struct("a", "s")).alias("v"))  # < 1 / HEAVY votes each
        blocks = dependent_blocks(near, heavy) if heavy else []
    # units: an annotator, or those of a block that voted; labels: a sign, or the block's combination of signs
    unit = F.lit(None).cast("int")
    for i, b in enumerate(blocks):
        unit = F.when(F.col("a").isin(b), F.lit(i)).otherwise(unit)
    named_votes = flat.select("_p", "n", unit.alias("block"), "a", F.when(F.col("s"), "+").otherwise("-").alias("k"))
    state = named_votes.filter("block is null").select("_p", "n", F.concat(F.lit("a:"), "a").alias("u"), "k")
    if blocks:
        both = named_votes.filter("block is not null").groupBy("_p", "n", "block").agg(F.array_sort(F.collect_list(F.struct("a", "k"))).alias("m"))
        state = state.unionByName(both.select("_p", "n", F.concat(F.lit("b:"), F.array_join("m.a", "\x1f")).alias("u"), F.array_join("m.k", "").alias("k")))
    state = scratch.put(state, "units")
    votes = flat.groupBy("_p", "n").agg(F.sum(F.col("s").cast("double")).alias("p"), F.count("*").alias("c"))
    share = votes.agg(F.sum(F.col("p") * F.col("n")) / F.sum(F.col("c") * F.col("n"))).first()[0] or 0.5
    start = scratch.put(votes.select("_p", ((F.col("p") + share) / (F.col("c") + 1)).alias("belief")), "belief")
    labels = [(r["u"], r["k"]) for r in state.select("u", "k").distinct().limit(LOOKUP + 1).collect()]
    run = _rounds_few if len(labels) <= LOOKUP else _rounds_many
    belief, turn = run(spark, state, start, sorted(labels), scratch, rounds, tolerance)
    right, wrong = PRIOR
    one, s = F.col("belief"), F.col("s").cast("double")
    rates = flat.join(belief, "_p").groupBy(F.col("a").alias("annotator")).agg(
        F.sum("n").alias("items"),
        ((F.sum(one * s * F.col("n")) + right) / (F.sum(one * F.col("n")) + right + wrong)).alias("sensitivity"),
        ((F.sum((1 - one) * (1 - s) * F.col("n")) + right) / (F.sum((1 - one) * F.col("n")) + right + wrong)).alias("specificity"),
    )
    named = {a: ",".join(b) for b in blocks for a in b}
    label = F.create_map(*[F.lit(x) for kv in named.items() for x in kv])[F.col("annotator")] if named else F.lit(None).cast("string")
    return skew_join(items, belief, "_p"), rates.withColumn("depends_on", label), turn


def _expected(alone: Column, plus: Column, usual: Column) -> tuple[Column, Column]:
    """Rates of a label before any is seen: an annotator is right more often than not; a combination of votes says nothing."""
    right, wrong = (x / sum(PRIOR) for x in PRIOR)
    return F.when(alone & plus, right).when(alone, wrong).otherwise(usual), F.when(alone & plus, wrong).when(alone, right).otherwise(usual)


def _rounds_few(spark: SparkSession, state: DataFrame, start: DataFrame, labels: list[tuple[str, str]], scratch: Scratch, rounds: int, tolerance: float) -> tuple[DataFrame, int]:
    """Rounds for at most ``LOOKUP`` labels: their sums go through the driver, and a round is one pass over the vote combinations
    without a shuffle of them."""
    at = spark.createDataFrame([(u, k, i) for i, (u, k) in enumerate(labels)], "u string, k string, i int")
    packed = state.join(F.broadcast(at), ["u", "k"]).groupBy("_p", "n").agg(F.collect_list("i").alias("ks"))  # each label once at most
    now, turn, weight = scratch.put(packed.join(start, "_p"), "state"), 0, sum(PRIOR)
    b, n = F.col("belief"), F.col("n")
    totals = now.agg((F.sum(b * n) + 1) / (F.sum(n) + 2)).first()
    prior = totals[0] or 0.5
    while turn < rounds and labels:
        turn += 1
        seen = now.select("n", "belief", F.explode("ks").alias("i")).groupBy("i").agg(F.sum(b * n).alias("b1"), F.sum((1 - b) * n).alias("b0"))
        got = {r["i"]: (r["b1"], r["b0"]) for r in seen.collect()}  # <= LOOKUP rows
        of_unit: dict[str, list[float]] = {}
        for i, (u, _) in enumerate(labels):
            t = of_unit.setdefault(u, [0.0, 0.0])
            t[0], t[1] = t[0] + got[i][0], t[1] + got[i][1]
        rows = []
        for i, (u, k) in enumerate(labels):
            (b1, b0), (t1, t0) = got[i], of_unit[u]
            e1, e0 = ((x if k == "+" else y) / weight for x, y in (PRIOR, PRIOR[::-1])) if u.startswith("a:") else ((b1 + b0) / (t1 + t0),) * 2
            rows.append((b1 + weight * e1, b0 + weight * e0, t1 + weight, t0 + weight))
        sums = spark.createDataFrame([tuple(list(c) for c in zip(*rows))], "b1 array<double>, b0 array<double>, t1 array<double>, t0 array<double>")
        answer = F.aggregate("ks", F.lit(math.log(prior / (1 - prior))), lambda acc, i: acc + _llr(*[F.get(F.col(c), i) for c in ("b1", "b0", "t1", "t0")], b))
        seen = Observation()
        after = now.crossJoin(F.broadcast(sums)).select("_p", "n", "ks", _sigmoid(answer).alias("belief"), b.alias("before"))
        after = after.observe(seen, F.max(F.abs(b - F.col("before"))).alias("moved"), ((F.sum(b * n) + 1) / (F.sum(n) + 2)).alias("prior"))
        before, now = now, scratch.put(after, "state")
        scratch.drop(before)
        moved, prior = seen.get["moved"] or 0.0, seen.get["prior"] or 0.5
        if moved < tolerance:
            break
    return now.select("_p", "belief"), turn


def _rounds_many(spark: SparkSession, state: DataFrame, start: DataFrame, labels: list, scratch: Scratch, rounds: int, tolerance: float) -> tuple[DataFrame, int]:
    """Rounds for any number of labels: messages meet by joins, labels that fill much of the table apart."""
    state = scratch.put(state.withColumn("uk", F.concat_ws("\x1e", "u", "k")), "units")
    hot, belief, turn, weight = hot_keys(state, "uk"), start, 0, F.lit(sum(PRIOR))
    n_of = state.select("_p", "n").distinct()
    b, n = F.col("belief"), F.col("n")
    prior = start.join(n_of, "_p").agg((F.sum(b * n) + 1) / (F.sum(n) + 2)).first()[0] or 0.5
    while turn < rounds:
        turn += 1
        seen = state.join(belief.select("_p", "belief"), "_p")
        sums = seen.groupBy("u", "k", "uk").agg(F.sum(b * n).alias("b1"), F.sum((1 - b) * n).alias("b0"))
        of_unit = sums.groupBy("u").agg(F.sum("b1").alias("t1"), F.sum("b0").alias("t0"))
        e1, e0 = _expected(F.col("u").startswith("a:"), F.col("k") == "+", (F.col("b1") + F.col("b0")) / (F.col("t1") + F.col("t0")))
        rates = sums.join(of_unit, "u").select("uk", (F.col("b1") + weight * e1).alias("b1"), (F.col("b0") + weight * e0).alias("b0"), (F.col("t1") + weight).alias("t1"), (F.col("t0") + weight).alias("t0"))
        e = skew_join(seen, rates, "uk", "inner", hot)
        answers = e.select("_p", "n", "belief", _llr(*[F.col(c) for c in ("b1", "b0", "t1", "t0")], b).alias("y"))
        met = Observation()
        after = answers.groupBy("_p", "n").agg(_sigmoid(F.lit(math.log(prior / (1 - prior))) + F.sum("y")).alias("belief"), F.first("belief").alias("before"))
        after = after.observe(met, F.max(F.abs(b - F.col("before"))).alias("moved"), ((F.sum(b * n) + 1) / (F.sum(n) + 2)).alias("prior"))
        before, belief = belief, scratch.put(after, "belief")
        scratch.drop(before)
        moved, prior = met.get["moved"] or 0.0, met.get["prior"] or 0.5
        if moved < tolerance:
            break
    return belief.select("_p", "belief"), turn
