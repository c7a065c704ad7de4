"""Top-k search by token overlap: a stated query set met in blocks with every row of a table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import jaccard, overlap_coefficient
from ..runtime import Scratch
from .linkage import shared_keys, top_k

#: Queries per block: what is broadcast at a time.
BLOCK = 20_000
#: Cells of the overlap matrix held at a time, and candidates kept before they are cut to the best.
CELLS, HELD = 1 << 20, 1 << 19


def _csr(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    off = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]


def _best(q: np.ndarray, score: np.ndarray, rid: np.ndarray, extra: np.ndarray, k: int) -> tuple:
    """The k best entries of every query: highest score, then smallest id."""
    order = np.lexsort((rid, -score, q))
    q, score, rid, extra = q[order], score[order], rid[order], extra[order]
    start = np.concatenate([[0], np.flatnonzero(q[1:] != q[:-1]) + 1]) if len(q) else np.zeros(0, np.int64)
    place = np.arange(len(q)) - np.repeat(start, np.diff(np.concatenate([start, [len(q)]])))
    keep = place < k
    return q[keep], score[keep], rid[keep], extra[keep]


def top_k_overlap(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, tokens: str, k: int, score: str = "jaccard", least: int = 1, digits: int = 6) -> DataFrame:
    """``query_id, row_id, score, shared, rank``: the ``k`` best rows of every query.

    ``score`` is ``jaccard`` or ``sum`` (Jaccard plus overlap coefficient), rounded to ``digits``; ties go to the smaller
    id. Only rows sharing ``least`` tokens or more count; null and empty token arrays meet nothing.

    Queries are taken ``BLOCK`` at a time as an inverted index that is broadcast. Each task counts shared tokens of its
    rows with all queries of the block in numpy and keeps the best ``k`` per query, so what is shuffled is k rows per
    query and task, not the pairs that share a token. Tokens are compared as 64-bit hashes. ``row_id`` is a string.
    """
    spark = rows.sparkSession
    hashed = F.transform(F.array_distinct(tokens), lambda t: F.xxhash64(t)).alias("_t")
    asked = queries.select(F.col(query_id).alias("_q"), hashed).filter(F.size("_t") > 0)
    table = rows.select(F.col(row_id).alias("_r"), hashed).filter(F.size("_t") > 0)
    out = None
    blocks = max(1, -(-asked.count() // BLOCK))
    scratch = Scratch(spark, "search")
    for b in range(blocks):
        some = asked.filter(F.pmod(F.xxhash64("_q", F.lit(11)), F.lit(blocks)) == b).toArrow()  # about BLOCK queries
        if not some.num_rows and out is not None:
            continue
        flat, off = _csr(some.column("_t").combine_chunks()) if some.num_rows else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        owner, order = np.repeat(np.arange(some.num_rows), np.diff(off)), np.argsort(flat, kind="stable")
        words, first = np.unique(flat[order], return_index=True)
        sent = spark.sparkContext.broadcast((words, np.append(first, len(flat)), owner[order].astype(np.int32), np.diff(off), some.column("_q").to_pylist()))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words, first, owner, q_size, names = sent.value
            n_q = len(q_size)
            held, floor, waiting = [], np.full(n_q, -np.inf), 0
            step = max(1, CELLS // max(n_q, 1))
            for whole in batches:
                for lo in range(0, len(whole), step) if n_q else ():
                    b = whole.slice(lo, step)
                    flat, off = _csr(b.column(1))
                    size = np.diff(off)
                    row = np.repeat(np.arange(len(b)), size)
                    at = np.minimum(np.searchsorted(words, flat), len(words) - 1)
                    known = words[at] == flat
                    at, row = at[known], row[known]
                    many = first[at + 1] - first[at]
                    post = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[at], many)
                    shared = np.bincount(np.repeat(row, many) * n_q + owner[post], minlength=len(b) * n_q)
                    hit = np.flatnonzero(shared >= max(least, 1))
                    i, q, n = hit // n_q, hit % n_q, shared[hit]
                    value = n / (size[i] + q_size[q] - n)
                    if score == "sum":
                        value = value + n / np.maximum(np.minimum(size[i], q_size[q]), 1)
                    value = np.round(value, digits)
                    ok = value >= floor[q]
                    held.append((q[ok], value[ok], np.array(b.column(0).to_pylist(), dtype=str)[i[ok]], n[ok]))
                    waiting += int(ok.sum())
                    if waiting > HELD:
                        held = [_best(*(np.concatenate(x) for x in zip(*held)), k)]
                        waiting = len(held[0][0])
                        q, value = held[0][:2]
                        full = np.bincount(q, minlength=n_q) >= k
                        lowest = np.full(n_q, np.inf)
                        np.minimum.at(lowest, q, value)
                        floor = np.where(full, lowest, -np.inf)
            if held:
                q, value, rid, n = _best(*(np.concatenate(x) for x in zip(*held)), k)
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in q.tolist()], pa.string()), pa.array(value), pa.array(rid.tolist(), pa.string()), pa.array(n.astype(np.int64))], ["q", "score", "r", "shared"])

        got = top_k(table.mapInArrow(run, "q string, score double, r string, shared long"), ["q"], [F.desc("score"), F.col("r")], k)
        if blocks > 1:  # a block's queries leave memory before the next ones are sent
            got = scratch.put(got, "block")
            sent.unpersist()
        out = got if out is None else out.unionByName(got)
    return out.select(F.col("q").alias(query_id), F.col("r").alias(row_id), "score", "shared", "rank")


def top_k_united(queries: DataFrame, rows: DataFrame, query_id: str, row_id: str, tokens: str, keys: str, k: int, least: int = 2, weight: float = 2.0, digits: int = 6) -> DataFrame:
    """``query_id, row_id, score, hits, shared, rank``: the ``k`` best rows of every query by shared ``keys`` and tokens.

    A row counts if it shares a key or ``least`` tokens; ``score`` is ``weight`` per shared key plus Jaccard plus overlap
    coefficient of the token sets (two empty sets have Jaccard 1). Ties go to the smaller id; ids are unique.

    Pairs that share a key are met by an equi-join and scored whole. The others come from ``top_k_overlap``: a pair without
    a key that isn't among its ``k`` best has ``k`` rows above it, and keys only raise those, so none is lost. A pair found
    both ways keeps the score with its keys.
    """
    x, y = queries.select(query_id, F.col(tokens).alias("_x")), rows.select(row_id, F.col(tokens).alias("_y"))
    none = F.array().cast("array<string>")
    d = shared_keys(queries, rows, query_id, row_id, keys).withColumnRenamed("shared", "hits").join(x, query_id).join(y, row_id)
    d = d.withColumn("_x", F.coalesce("_x", none)).withColumn("_y", F.coalesce("_y", none)).withColumn("shared", F.size(F.array_intersect("_x", "_y")).cast("long"))
    value = weight * F.col("hits") + jaccard(F.col("_x"), F.col("_y")) + overlap_coefficient(F.col("shared"), F.size("_x"), F.size("_y"))
    by_key = d.select(query_id, row_id, F.round(value, digits).alias("score"), "hits", "shared")
    by_word = top_k_overlap(queries, rows, query_id, row_id, tokens, k, score="sum", least=least, digits=digits)
    by_word = by_word.select(query_id, row_id, "score", F.lit(0).cast("long").alias("hits"), "shared")
    best = by_key.unionByName(by_word).groupBy(query_id, row_id).agg(F.max(F.struct("score", "hits", "shared")).alias("_b")).select(query_id, row_id, "_b.*")
    return top_k(best, [query_id], [F.desc("score"), F.col(row_id)], k)
