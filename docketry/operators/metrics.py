"""Agreement, precision and retrieval measures, and vector similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import Scratch


def confusion(df: DataFrame, truth: Column, guess: Column, by: list[str]) -> DataFrame:
    """``tp, fp, fn, tn, recall, precision, f2, accuracy`` per group; rows with a null side are left out; ratios without
    a denominator are null."""
    d = df.filter(truth.isNotNull() & guess.isNotNull())
    c = lambda cond: F.sum(cond.cast("long"))
    out = d.groupBy(*by).agg(c(truth & guess).alias("tp"), c(~truth & guess).alias("fp"), c(truth & ~guess).alias("fn"), c(~truth & ~guess).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return out.select(
        *by, "tp", "fp", "fn", "tn", F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(tp, tp + fp).alias("precision"),
        F.try_divide(5 * tp, 5 * tp + 4 * fn + fp).alias("f2"), F.try_divide(tp + tn, tp + fp + fn + tn).alias("accuracy"),
    )


def weighted_rate(samples: DataFrame, stratum: str, hit: Column, sizes: DataFrame, size: str, renormalize: bool = False) -> DataFrame:
    """Stratum-weighted rate and half width of its 95 % interval. Strata without sample add nothing; ``renormalize``
    spreads their weight over the others."""
    s = samples.groupBy(stratum).agg(F.count(hit).alias("n"), F.avg(hit.cast("double")).alias("p"))
    d = sizes.join(s, stratum, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    used = F.col("n") > 0
    base = F.sum(F.when(used, F.col(size)) if renormalize else F.col(size)).over(Window.partitionBy(F.lit(1)))  # one row per stratum
    d = d.withColumn("w", F.col(size) / base).filter(used)
    return d.agg(F.sum(F.col("w") * F.col("p")).alias("rate"), (1.96 * F.sqrt(F.sum(F.col("w") * F.col("w") * F.col("p") * (1 - F.col("p")) / F.col("n")))).alias("half_width"))


def recall_at(ranked: DataFrame, relevant: Column, order: list[Column], ks: list[int]) -> DataFrame:
    """``k, recall``: part of all relevant rows among the first k. Only the first max(ks) rows are ever sorted together."""
    top = ranked.withColumn("_r", relevant.cast("long")).orderBy(*order).limit(max(ks))
    w = Window.partitionBy(F.lit(1)).orderBy(*order)  # at most max(ks) rows
    numbered = top.withColumn("_rank", F.row_number().over(w))
    total = ranked.agg(F.sum(relevant.cast("long")).alias("_all"))
    hits = numbered.agg(*[F.sum(F.when(F.col("_rank") <= k, F.col("_r"))).alias(f"h{k}") for k in ks])
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("h")) for k in ks]))
    return hits.select(rows.alias("x")).crossJoin(F.broadcast(total)).select("x.k", F.try_divide(F.col("x.h"), F.col("_all")).alias("recall"))  # one total


def max_cosine(vectors: DataFrame, key: str, vector: str, reference: DataFrame, block: int = 4096, most: int = 200_000) -> DataFrame:
    """``key, cosine``: greatest cosine to any reference vector, the reference being a stated set met in blocks.

    At most some ``most`` reference vectors are broadcast at a time; a larger set is dealt to as many blocks as it needs, each block's
    result is written before the next is sent, and the greatest of all counts. Norms are clipped at 1e-12; null, empty and
    other-sized vectors give null. ``key`` is unique.
    """
    spark = vectors.sparkSession
    live = reference.filter(F.col(vector).isNotNull()).select(vector)
    blocks = max(1, math.ceil(live.count() / most))
    scratch, out = Scratch(spark, "cosine"), None
    for i in range(blocks):
        some = live if blocks == 1 else live.filter(F.pmod(F.xxhash64(vector), F.lit(blocks)) == i)
        got = some.toPandas()[vector].tolist()  # about ``most`` vectors
        m = np.array(got, np.float64).reshape(len(got), -1) if got else np.zeros((0, 0))
        sent = spark.sparkContext.broadcast(m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12))
        best = _greatest(vectors, key, vector, sent, block)
        if blocks > 1:
            best = scratch.put(best, "block")
            sent.unpersist()
        out = best if out is None else out.unionByName(best)
    return out if blocks == 1 else out.groupBy(key).agg(F.max("cosine").alias("cosine"))


def _greatest(vectors: DataFrame, key: str, vector: str, sent, block: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ref = sent.value
        for pdf in batches:
            best = np.full(len(pdf), np.nan)
            ok = np.array([v is not None and len(ref) > 0 and len(v) == ref.shape[1] for v in pdf[vector]], bool)
            at = np.flatnonzero(ok)
            for a in range(0, len(at), block):
                rows = at[a : a + block]
                x = np.stack(pdf[vector].iloc[rows].to_numpy()).astype(np.float64)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                top = np.full(len(rows), -np.inf)
                for b in range(0, len(ref), block):
                    top = np.maximum(top, (x @ ref[b : b + block].T).max(axis=1))
                best[rows] = top
            yield pd.DataFrame({key: pdf[key], "cosine": pd.Series(best).astype(object).where(~np.isnan(best), None)})

    kind = vectors.schema[key].dataType.simpleString()
    return vectors.select(key, vector).mapInPandas(run, f"{key} {kind}, cosine double")
