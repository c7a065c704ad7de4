"""Splits that keep related records together, from an incremental, persisted component table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.citations import section_address
from ..runtime import Scratch, skew_join, spread
from .components import components

#: Components above this share of all records are placed one by one; there are fewer than 1 / LARGE_SHARE of them.
LARGE_SHARE = 1 / 2000
TOP_PROFILES = 256
QUARANTINE = "quarantine"
#: Keys of the counts of records without keys; keys of records begin with a number.
KEYLESS = "none:"
KEYS = "key string, component string, n long, split string, status string"


@dataclass
class Splits:
    """``records``: the batch's rows with ``component``, ``component_n`` (its records so far), ``split`` and ``status``; ``state``: the table to persist."""

    records: DataFrame
    state: DataFrame


def _profile(balance: list[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.regexp_replace(F.lower(F.trim(F.col(c).cast("string"))), "[^a-z0-9]+", "_"), F.lit("?")) for c in balance]) if balance else F.lit("")


def assign_splits(records: DataFrame, id_col: str, keys: list[str], targets: dict[str, float], scratch: Scratch, state: DataFrame | None = None, balance: list[str] | None = None) -> Splits:
    """Give every record of a batch a split so that records sharing any key value share it.

    ``state`` (``key, component, n, split, status``) is what earlier batches left; ``n`` counts a key's records.
    Rules: a component known from ``state`` keeps its split, and new records join it. A batch that links components
    of one split merges them. A batch that links components of different splits is a conflicting merge: all of it gets
    status ``quarantined`` and split ``quarantine`` and stays out of every split from then on. New components fill
    the deficits of the targets; those larger than ``LARGE_SHARE`` of the records (so a bounded number) are placed
    one by one where most is missing, the others by their position among components of the same ``balance`` profile.
    Null and empty key values link nothing; a record without keys is a component of its own; of these only counts per split persist.
    Records sharing only a key that holds a third of all rows are fine: keys are pre-aggregated, and the lookup
    treats hot keys apart. Repeated ids get the split of each row's own keys; rows without id and keys form one
    component. Columns named like those added here are replaced. Empty input gives empty output.
    """
    balance = balance or []
    total_weight = sum(targets.values())
    shares = {k: v / total_weight for k, v in targets.items()}
    tagged = [F.when(F.coalesce(F.trim(F.col(k)), F.lit("")) != "", F.concat(F.lit(f"{i}:"), F.trim(F.col(k)))) for i, k in enumerate(keys)]
    # the batch's columns travel as one struct, so none can clash with those made here
    carried = [c for c in records.columns if c not in ("component", "component_n", "split", "status")]
    batch = scratch.put(
        records.select(
            F.struct(*[F.col(f"`{c}`") for c in carried]).alias("_row"), F.array_sort(F.array_distinct(F.array_compact(F.array(*tagged)))).alias("_keys"),
            F.concat(F.lit("r:"), F.col(id_col).cast("string")).alias("_own"), _profile(balance).alias("_profile"),
        ).withColumn("_key", F.coalesce(F.get("_keys", F.lit(0)), "_own", F.lit("r:"))),
        "batch",
    )
    state = scratch.spark.createDataFrame([], KEYS) if state is None else state
    # keys of the batch and links between the keys of one record, both pre-aggregated
    counts = batch.groupBy("_key", "_profile").agg(F.count("*").alias("n"))
    lone = batch.filter(F.size("_keys") > 1).select(F.explode("_keys").alias("_key")).distinct()
    links = batch.filter(F.size("_keys") > 1).select(F.col("_key").alias("a"), F.explode(F.slice("_keys", 2, 1 << 30)).alias("b")).distinct()
    known = state.select("key", F.col("component").alias("old"))
    lift = lambda d, c: d.join(known.withColumnRenamed("key", c), c, "left").withColumn(c, F.coalesce("old", c)).drop("old")
    merged = scratch.put(components(lift(lift(links, "a"), "b"), scratch), "merged")
    keyed = counts.select(F.col("_key").alias("key"), "_profile", "n").unionByName(lone.select(F.col("_key").alias("key"), F.lit(None).cast("string").alias("_profile"), F.lit(0).cast("long").alias("n")))
    fresh = (
        keyed.join(known, "key", "left").withColumn("node", F.coalesce("old", "key"))
        .join(merged, "node", "left").withColumn("component", F.coalesce("root", "node"))
        .select("key", "component", "_profile", "n")
    )
    fresh = scratch.put(fresh, "fresh")
    # what the persisted components say: one split is kept, two conflict
    moved = state.withColumnRenamed("component", "node").join(merged, "node", "left").withColumn("component", F.coalesce("root", "node"))
    kept = scratch.put(
        moved.groupBy("component").agg(F.collect_set("split").alias("splits"), F.sum("n").alias("had"))
        .select("component", F.when(F.size("splits") == 1, F.get("splits", F.lit(0))).otherwise(F.lit(QUARANTINE)).alias("split"), "had"),
        "kept",
    )
    size = fresh.groupBy("component").agg(F.sum("n").alias("n"), F.coalesce(F.max_by("_profile", F.struct("n", "_profile")), F.lit("")).alias("profile"))
    new = scratch.put(size.join(kept.select("component"), "component", "left_anti"), "new")
    placed = scratch.put(_fill(new, fresh, kept, size, shares, scratch), "placed")
    where = scratch.put(kept.select("component", "split").unionByName(placed), "where")
    status = F.when(F.col("split") == QUARANTINE, "quarantined").otherwise("assigned").alias("status")
    sizes = fresh.select("component", "n").unionByName(moved.select("component", "n")).groupBy("component").agg(F.sum("n").alias("component_n"))
    key_table = scratch.put(fresh.select("key", "component").distinct().join(where, "component").join(sizes, "component"), "keys")
    out = skew_join(batch.withColumnRenamed("_key", "key"), key_table, "key").select("_row.*", "component", "component_n", "split", status)
    old_keys = moved.select("key", "component", F.col("n").alias("had"))
    new_keys = fresh.filter(~F.col("key").startswith("r:")).groupBy("key", "component").agg(F.sum("n").alias("got"))
    after = old_keys.join(new_keys, ["key", "component"], "full").join(where, "component").select("key", "component", (F.coalesce("had", F.lit(0)) + F.coalesce("got", F.lit(0))).alias("n"), "split", status)
    # records without keys are kept as one count per split, under a name that no key has, so later deficits know of them
    lone_n = fresh.filter(F.col("key").startswith("r:")).join(where, "component").groupBy("split").agg(F.sum("n").alias("n"))
    lone = lone_n.select(F.concat(F.lit(KEYLESS), "split").alias("key"), F.concat(F.lit(KEYLESS), "split").alias("component"), "n", "split", F.lit("assigned").alias("status"))
    after = after.unionByName(lone).groupBy("key", "component", "split", "status").agg(F.sum("n").alias("n")).select("key", "component", "n", "split", "status")
    return Splits(out, scratch.put(after, "state"))


class Store:
    """The component table on disk: one version per batch under ``path``, named by place and batch, written aside and renamed.

    A batch that was committed before is worked out again from the version before it, so a replay gives every record the split it had
    and changes nothing; the table stays where it is for later jobs. Batches are one after another: a single job writes at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[str]:
        """Committed versions in order."""
        at = self._hadoop.Path(self.path)
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(n for n in names if n.startswith("v"))

    def load(self, before: str | None = None) -> DataFrame | None:
        """The newest table, or the one before the version of batch ``before``; None if there is none."""
        known = self.versions()
        at = next((i for i, v in enumerate(known) if v.split("-", 1)[1] == before), len(known))
        return self.spark.read.schema(KEYS).parquet(f"{self.path}/{known[at - 1]}") if at else None

    def commit(self, state: DataFrame, batch: str) -> bool:
        """Write the table of a new batch; False, and nothing done, if the batch is known."""
        known = self.versions()
        if any(v.split("-", 1)[1] == batch for v in known):
            return False
        aside = f"{self.path}/_{batch}"
        state.select(*[c.strip().split()[0] for c in KEYS.split(",")]).write.mode("overwrite").parquet(aside)
        self._fs.rename(self._hadoop.Path(aside), self._hadoop.Path(f"{self.path}/v{len(known) + 1:08d}-{batch}"))
        return True

    def assign(self, batch: str, records: DataFrame, id_col: str, keys: list[str], targets: dict[str, float], scratch: Scratch, balance: list[str] | None = None) -> DataFrame:
        """``assign_splits`` of a named batch against the table, which then holds it; the batch's records."""
        out = assign_splits(records, id_col, keys, targets, scratch, state=self.load(before=batch), balance=balance)
        self.commit(out.state, batch)
        return out.records


def _fill(new: DataFrame, fresh: DataFrame, kept: DataFrame, size: DataFrame, shares: dict[str, float], scratch: Scratch) -> DataFrame:
    """``component``, ``split`` for new components, so that the totals come as near to the shares as they can."""
    spark = scratch.spark
    added = kept.join(size, "component", "left").groupBy("split").agg(F.sum(F.col("had") + F.coalesce("n", F.lit(0))).alias("n"))
    have = {r["split"]: r["n"] for r in added.collect() if r["split"] in shares}  # as many rows as splits
    coming = new.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    total = coming + sum(have.values())
    left = {k: total * v - have.get(k, 0) for k, v in shares.items()}
    large = new.filter(F.col("n") > max(1, total * LARGE_SHARE))  # < 1 / LARGE_SHARE components
    # profiles of these components: the most frequent ones by name, the rest together, so both counts are bounded
    top = [r[0] for r in fresh.groupBy("_profile").agg(F.sum("n").alias("n")).filter("_profile is not null").orderBy(F.desc("n"), "_profile").limit(TOP_PROFILES).collect()]
    cell = F.when(F.col("_profile").isin(top), F.col("_profile")).otherwise(F.lit(""))
    totals = {r[0]: r[1] for r in fresh.groupBy(cell.alias("c")).agg(F.sum("n").alias("n")).collect()}
    vectors: dict[str, dict[str, int]] = {}
    for r in fresh.join(F.broadcast(large.select("component")), "component", "left_semi").groupBy("component", cell.alias("c")).agg(F.sum("n").alias("n")).collect():
        if r["n"]:
            vectors.setdefault(r["component"], {})[r["c"]] = r["n"]
    rows, have_cell = [], {(k, c): 0.0 for k in shares for c in totals}
    for comp, v in sorted(vectors.items(), key=lambda x: (-sum(x[1].values()), x[0])):
        n = sum(v.values())

        def cost(k: str, n: int = n, v: dict = v) -> float:
            # growth of the squared distance from the goal, as a part of the goal: of the whole and of each profile
            whole = n * (n - 2 * left[k]) / max(shares[k] * total, 1.0)
            return 4 * whole + sum(x * (2 * (have_cell[k, c] - shares[k] * totals[c]) + x) / max(shares[k] * totals[c], 1.0) for c, x in v.items())

        k = min(shares, key=lambda k: (cost(k), k))
        rows.append((comp, k))
        left[k] -= n
        for c, x in v.items():
            have_cell[k, c] += x
    big = spark.createDataFrame(rows, "component string, split string")
    gaps = {k: max(v, 0.0) for k, v in left.items()}
    whole = sum(gaps.values())
    if not whole:
        gaps, whole = dict(shares), sum(shares.values())
    small = new.filter(F.col("n") <= max(1, total * LARGE_SHARE))
    ranked = spread(small, ["profile"], F.xxhash64("component"), F.col("component"), F.col("n"))
    at = (F.col("rank") + F.col("n") / 2) / F.greatest(F.col("group_total"), F.lit(1))
    choice, upto = None, 0.0
    for k, v in gaps.items():
        upto += v / whole
        choice = F.when(at < upto, k) if choice is None else choice.when(at < upto, k)
    last = max(gaps, key=lambda k: gaps[k])
    return big.unionByName(ranked.select("component", choice.otherwise(F.lit(last)).alias("split")))


def section_records(gold: DataFrame) -> DataFrame:
    """``mandate_gold`` with ``section_id``; ids that address no section give null."""
    return gold.select("gold_id", section_address(F.col("uslm_id")).alias("section_id"), "stratum", "gold_congressional")
