"""Connected components by hooking and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch


def components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``root`` (smallest node of its component) for every node of ``edges``.

    Each round, every node hooks to the neighbour of lowest priority if that is below its own (priorities are hashed
    anew per round, so long paths shrink by a constant factor), pointers jump until they reach roots, and the edges
    are contracted to roots. Edges only shrink; a node with very many neighbours is reduced by partial aggregation
    before any shuffle. Null ends, loops and repeated edges are ignored; without edges the result is empty.
    """
    kind = edges.schema[a].dataType
    work = scratch.put(edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).distinct(), "edges")
    nodes = scratch.put(work.select(F.col("x").alias("node")).union(work.select("y")).distinct().withColumn("root", F.col("node")), "nodes")
    turn = 0
    while not work.isEmpty():
        turn += 1
        rank = lambda c, seed=turn: F.struct(F.xxhash64(F.col(c), F.lit(seed)).alias("p"), F.col(c).alias("n"))
        both = work.select(F.col("x").alias("node"), rank("y").alias("other")).union(work.select("y", rank("x")))
        best = both.groupBy("node").agg(F.min("other").alias("best"))
        hooks = scratch.put(best.select("node", F.when(F.col("best") < rank("node"), F.col("best.n")).otherwise(F.col("node")).alias("up")), "hooks")
        while True:  # pointer jumping
            up = hooks.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            jumped = scratch.put(hooks.join(up, "up").select("node", F.col("upper").alias("up"), (F.col("upper") != F.col("up")).alias("moved")), "hooks")
            moving = not jumped.filter("moved").isEmpty()
            scratch.drop(hooks)
            hooks = jumped
            if not moving:
                break
        to = hooks.select(F.col("node").alias("root"), F.col("up").alias("upper"))
        old = nodes
        nodes = scratch.put(nodes.join(to, "root", "left").select("node", F.coalesce("upper", "root").alias("root")), "nodes")
        scratch.drop(old)
        x, y = hooks.select(F.col("node").alias("x"), F.col("up").alias("rx")), hooks.select(F.col("node").alias("y"), F.col("up").alias("ry"))
        old = work
        work = scratch.put(work.join(x, "x").join(y, "y").filter("rx != ry").select(F.least("rx", "ry").alias("x"), F.greatest("rx", "ry").alias("y")).distinct(), "edges")
        scratch.drop(old)
    least = nodes.groupBy("root").agg(F.min("node").alias("least"))
    return nodes.join(least, "root").select(F.col("node").cast(kind), F.col("least").cast(kind).alias("root"))
