"""Filling fixed-capacity containers with whole texts, by hierarchical multi-length packing over size histograms."""

from __future__ import annotations

from bisect import bisect_left, insort
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch, spread

#: Sum of capacities up to which the size histogram (one row per size) is collected.
MOST_SIZES = 1 << 18


@dataclass
class Group:
    """Containers ``first`` .. ``first + count - 1`` of one tier, filled alike: (source tier, size, first rank, items per container)."""

    tier: int
    first: int
    count: int
    load: int
    items: int
    contents: list[tuple[int, int, int, int]] = field(default_factory=list)

    def split(self, k: int) -> Group:
        """Keep the first ``k`` containers; return the rest."""
        rest = Group(self.tier, self.first + k, self.count - k, self.load, self.items, [(t, s, r + k * q, q) for t, s, r, q in self.contents])
        self.count = k
        return rest


def plan(histograms: list[dict[int, int]], capacities: list[int], joiners: list[int]) -> list[Group]:
    """Groups of identically filled containers for tiers given from the longest window to the shortest.

    Tier by tier: its own items go best-fit decreasing into its windows; what stays open is then filled with items
    routed to shorter tiers, largest first, without opening new windows for them. Every step handles all items of one
    size that meet containers of one room, so the work follows the number of sizes, not of items, and there are at
    most about three groups per size. A joiner lies between two texts of a container; it costs nothing before the
    first. Items are known by tier, size and rank among that tier's items of the size.
    """
    left = [dict(h) for h in histograms]
    used = [dict.fromkeys(h, 0) for h in histograms]
    groups: list[Group] = []
    for tier, (capacity, joiner) in enumerate(zip(capacities, joiners)):
        rooms: list[int] = []
        open_: dict[int, list[Group]] = {}
        first = 0

        def put(g: Group, capacity: int = capacity, joiner: int = joiner) -> None:
            room = capacity - g.load - joiner if g.items else capacity
            if room < 0:
                groups.append(g)
                return
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append(g)

        for source in range(tier, len(left)):
            for size in sorted(left[source], reverse=True):
                n = left[source][size]
                while n:
                    at = bisect_left(rooms, size)
                    if at < len(rooms):
                        room = rooms[at]
                        g = open_[room].pop()
                        if not open_[room]:
                            del open_[room]
                            rooms.pop(at)
                        if g.count > n:
                            put(g.split(n))
                        fit = 1
                        if g.count * 2 <= n:  # several of this size per container
                            fit = min(1 + (room - size) // max(size + joiner, 1), n // g.count) if size + joiner else n // g.count
                    elif source == tier:
                        fit = min(1 + (capacity - size) // max(size + joiner, 1) if size + joiner else n, n)
                        g = Group(tier, first, n // fit, 0, 0)
                        first += g.count
                    else:
                        break
                    g.contents.append((source, size, used[source][size], fit))
                    g.load += fit * size + (fit - (0 if g.items else 1)) * joiner
                    g.items += fit
                    used[source][size] += fit * g.count
                    n -= fit * g.count
                    put(g)
                left[source][size] = n
        groups += [g for gs in open_.values() for g in gs]
        for source in range(tier, len(left)):
            left[source] = {s: n for s, n in left[source].items() if n}
    return groups


def step_ranks(groups: list[Group]) -> list[tuple[Group, int]]:
    """Groups from the fullest, with the rank of their first container, for dealing containers to balanced steps."""
    out, rank = [], 0
    for g in sorted(groups, key=lambda g: (-g.load, g.first)):
        out.append((g, rank))
        rank += g.count
    return out


def pack(texts: DataFrame, key: str, size: str, limits: list[tuple[str, int, int]], scratch: Scratch, together: bool, per_step: int = 64) -> DataFrame:
    """Container of every text or piece.

    ``limits`` has (name, capacity, joiner). A text goes to the tier of the shortest limit that holds it; tiers are packed from the longest,
    and what their windows leave open is filled from shorter tiers. With ``together`` there is one packing, each tier having windows
    of its own limit. Without, every limit packs all texts on its own into windows of its capacity, its tiers being itself
    and the limits below it. A text larger than the (longest) capacity is
    cut into full pieces and a remainder; no other text is cut. Texts of size 0 are placed too and take a joiner.

    Only the histogram of sizes (at most the sum of the capacities plus one row per limit, checked) and the plan, a
    few groups per size, pass through the driver; items find their place by size and rank, the rank being taken
    without collecting a size in one task, so one text repeated in a third of all rows is no burden.

    Columns: ``pack_name, <key>, piece_no, n_tokens, tier, container_id, container_items, unused, step_group``.
    ``step_group`` numbers batches of about ``per_step`` containers of one tier, dealt from the fullest to and fro so
    that their loads are nearly equal. Null sizes count as 0; repeated keys are packed as separate items.
    """
    spark = scratch.spark
    if sum(c for _, c, _ in limits) > MOST_SIZES:
        raise ValueError("capacities too large for one size histogram")
    limits = sorted(limits, key=lambda x: (-x[1], x[0]))
    # per packing its tiers: name, window, joiner, and the largest size routed to it
    jobs = [("all", [(n, c, j, c) for n, c, j in limits])] if together else [(n, [(n, c, j, r) for m, r, _ in limits if r < c or m == n]) for n, c, j in limits]
    n = F.coalesce(F.col(size), F.lit(0)).cast("long")
    parts = []
    for name, tiers in jobs:
        most = tiers[0][1]
        whole = texts.select(F.lit(name).alias("pack_name"), F.col(key), n.alias("_n"), F.floor(F.greatest(n - 1, F.lit(0)) / most).cast("int").alias("_last"))
        parts.append(whole.select("pack_name", key, F.explode(F.sequence(F.lit(0), F.col("_last"))).alias("piece_no"), "_n").withColumn("n_tokens", F.least(F.col("_n") - F.col("piece_no") * F.lit(most), F.lit(most))).drop("_n"))
    pieces = parts[0]
    for p in parts[1:]:
        pieces = pieces.unionByName(p)
    tier_of = F.lit(0)
    for name, tiers in jobs:
        for i, (_, _, _, routed) in enumerate(tiers):
            tier_of = F.when((F.col("pack_name") == name) & (F.col("n_tokens") <= routed), i).otherwise(tier_of)
    pieces = scratch.put(pieces.withColumn("_t", tier_of), "pieces")
    counts = {(r["pack_name"], r["_t"], r["n_tokens"]): r["n"] for r in pieces.groupBy("pack_name", "_t", "n_tokens").agg(F.count("*").alias("n")).collect()}
    rows = []
    for name, tiers in jobs:
        hist = [{s: c for (p, t, s), c in counts.items() if p == name and t == i} for i in range(len(tiers))]
        groups = plan(hist, [c for _, c, _, _ in tiers], [j for _, _, j, _ in tiers])
        for tier, capacity in {t[0]: t[1] for t in tiers}.items():
            mine = [i for i, t in enumerate(tiers) if t[0] == tier]
            some = [g for g in groups if g.tier in mine]
            before = {i: sum(g.count for g in some if g.tier < i) for i in mine}  # windows of one limit are numbered on from tier to tier
            ranked = step_ranks(some)
            steps = max(1, -(-sum(g.count for g in some) // per_step))
            for g, rank in ranked:
                for source, s, r, q in g.contents:
                    rows.append((name, source, s, r, r + q * g.count, q, tier, before[g.tier] + g.first, g.items, capacity - g.load, rank, steps))
    where = spark.createDataFrame(rows, "pack_name string, _t int, n_tokens long, _from long, _to long, _q long, tier string, _first long, container_items long, unused long, _rank long, _steps long")
    ranked = spread(pieces, ["pack_name", "_t", "n_tokens"], F.xxhash64(key, "piece_no"), F.col(key))
    # the plan's rows follow the number of sizes, checked above, so they can be broadcast
    placed = ranked.drop("group_total").join(F.broadcast(where), ["pack_name", "_t", "n_tokens"]).filter((F.col("rank") >= F.col("_from")) & (F.col("rank") < F.col("_to")))
    shift = F.floor((F.col("rank") - F.col("_from")) / F.col("_q")).cast("long")
    at = F.col("_rank") + shift
    lap, col = F.floor(at / F.col("_steps")).cast("long"), F.pmod(at, F.col("_steps"))
    step = F.when(F.pmod(lap, F.lit(2)) == 0, col).otherwise(F.col("_steps") - 1 - col)
    return placed.select("pack_name", key, "piece_no", "n_tokens", "tier", (F.col("_first") + shift).alias("container_id"), "container_items", "unused", step.alias("step_group"))
