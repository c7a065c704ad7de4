"""Near-duplicate records: size-banded tiles with bitmap signatures, then exact intersection of sorted arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import HOT_SHARE, Scratch, fan_join, skew_join
from .components import components

#: Most words whose frequency is broadcast. A word is listed when it holds more than 1 / LISTED of all word
#: occurrences, so there are fewer than LISTED of them whatever the input; the others count as equally rare.
LISTED = 100_000
#: Records that share a word held by more than HOT_WORD classes must share a second one to meet.
HOT_WORD = 8192
#: A larger tile is cut into blocks of this many entries, which meet pairwise in tasks of their own.
TILE = 20_000
#: 64-bit parts of a word bitmap.
MAPS = 2
#: Pairs looked at in one numpy step.
STEP = 1 << 20


def word_set(*columns: Column) -> Column:
    """Distinct words (longest runs of a-z and digits, lower case) of all columns taken together, as sorted 64-bit
    hashes. Null counts as empty; no words give an empty array."""
    words = F.regexp_extract_all(F.lower(F.concat_ws(" ", *columns)), F.lit("[a-z0-9]+"), F.lit(0))
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def copy_classes(records: DataFrame, key: str, words: Column, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Records with equal word sets form a class. Returns ``class_id, words, n`` and ``class_id, <key>``.

    ``class_id`` is a number valid for this run. Empty word sets have no similarity and are left out.
    """
    digest = F.concat(F.hex(F.xxhash64("words")), F.hex(F.xxhash64(F.lit(1), "words")))  # 128 bits
    # words are filtered once they are written: a filter in the same step would make Spark find all words twice
    sets = scratch.put(records.select(key, words.alias("words")).withColumn("digest", digest), "sets").filter(F.size("words") > 0)
    classes = scratch.put(sets.groupBy("digest").agg(F.first("words").alias("words"), F.count("*").alias("n")).withColumn("class_id", F.monotonically_increasing_id()), "classes")
    hot = [r[0] for r in _hot(classes, "digest")]
    members = scratch.put(skew_join(sets.select(key, "digest"), classes.select("digest", "class_id"), "digest", "inner", hot).select("class_id", key), "members")
    return classes.select("class_id", "words", "n"), members


def _hot(classes: DataFrame, column: str) -> list:
    """Classes with more than ``HOT_SHARE`` of the records: at most 1 / HOT_SHARE."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    return classes.filter(F.col("n") > max(1, total * HOT_SHARE)).select(column).collect()


def _pairs_in_tiles(tile: np.ndarray, size: np.ndarray, left: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of one tile, i left, with size i <= size j <= size i / t; rows sorted by tile, size."""
    n = len(tile)
    tile_end = np.concatenate([np.flatnonzero(tile[1:] != tile[:-1]) + 1, [n]])
    end = tile_end[np.searchsorted(tile_end, np.arange(n), side="right")]
    wide = int(size.max()) + 2
    start = np.concatenate([[0], tile_end[:-1]])[np.searchsorted(tile_end, np.arange(n), side="right")]
    code = np.searchsorted(tile_end, np.arange(n), side="right").astype(np.int64) * (4 * wide) + size
    most = np.floor(size / t + 1e-9).astype(np.int64)
    upto = np.minimum(np.searchsorted(code, code - size + np.minimum(most, 4 * wide - 1), side="right"), end)
    first = np.searchsorted(code, code, side="left")
    first = np.maximum(first, start)  # equal sizes meet in both orders of rows; the caller's roles keep one
    rows = np.flatnonzero(left)
    count = (upto - first)[rows]
    rows, count = rows[count > 0], count[count > 0]
    done = np.concatenate([[0], np.cumsum(count)])
    a = 0
    while a < len(rows):
        b = max(a + 1, int(np.searchsorted(done, done[a] + STEP, side="right")) - 1)
        c = count[a:b]
        i = np.repeat(rows[a:b], c)
        j = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c) + np.repeat(first[rows[a:b]], c)
        yield i, j
        a = b


def candidates(classes: DataFrame, t: float, scratch: Scratch) -> DataFrame:
    """Pairs ``a < b`` of classes whose Jaccard similarity may reach ``t``; none that reaches it is missing.

    A pair at ``t`` shares one of the rarest words of both (prefix filter), and two of them when prefixes are one word
    longer. Each rare word is a tile; words of more than ``HOT_WORD`` classes are refined to tiles of two words. Tiles
    over ``TILE`` entries are cut into blocks that meet pairwise. Within a tile, rows are ordered by size, only sizes
    within the factor ``t`` meet, and word bitmaps of ``MAPS`` times 64 bits bound the overlap from above:
    overlap <= (size a + size b - differing bits) / 2.
    """
    spark = scratch.spark
    bits = [f"m{i}" for i in range(MAPS)]
    occurrences = classes.agg(F.sum(F.size("words"))).first()[0] or 0
    counts = classes.select(F.explode("words").alias("w")).groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") > max(1, occurrences / LISTED))
    listed = counts.toArrow()  # fewer than LISTED rows
    w, n = listed.column("w").to_numpy(), listed.column("n").to_numpy()
    by = np.argsort(w)
    known = spark.sparkContext.broadcast((w[by].astype(np.int64), n[by].astype(np.int64)))

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ws, ns = known.value
        for b in batches:
            ids, col = b.column(0).to_numpy(), b.column(1)
            flat, off = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy().astype(np.int64)
            size = np.diff(off)
            flat = flat[off[0] : off[-1]]
            off = off - off[0]
            row = np.repeat(np.arange(len(ids)), size)
            if len(ws):
                at = np.minimum(np.searchsorted(ws, flat), len(ws) - 1)
                df = np.where(ws[at] == flat, ns[at], 0)
            else:
                df = np.zeros(len(flat), np.int64)
            # bitmaps: one of 64 * MAPS bits per word
            bit = ((flat.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(64 * MAPS)
            maps = []
            for part in range(MAPS):
                on = np.where((bit >> np.uint64(6)) == part, np.uint64(1) << (bit & np.uint64(63)), np.uint64(0))
                maps.append(np.bitwise_or.reduceat(on, off[:-1]) if len(on) else np.zeros(0, np.uint64))
            order = np.lexsort((flat, df, row))
            words, df, pos = flat[order], df[order], np.arange(len(flat)) - off[:-1][row]
            s = size[row]
            probe = s - np.ceil(t * s - 1e-9).astype(np.int64) + 1
            index = s - np.ceil(2 * t / (1 + t) * s - 1e-9).astype(np.int64) + 1
            inside = pos < probe
            hot = inside & (df > HOT_WORD)
            cold = inside & (~hot | (np.ceil(t * s - 1e-9) < 2))  # sets so small that one common word may do
            out_row, out_tile, out_index, out_big = [row[cold]], [words[cold]], [(pos < index)[cold]], [df[cold] > TILE]
            # two-word tiles: a hot word and any later word of the prefix that is one longer
            h = np.flatnonzero(hot)
            more = (probe - pos)[h]
            more = np.minimum(more, (s - 1 - pos)[h])
            first = np.repeat(h, more)
            second = first + 1 + np.arange(len(first)) - np.repeat(np.cumsum(more) - more, more)
            mixed = (words[first].view(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) ^ words[second].view(np.uint64)) * np.uint64(0x94D049BB133111EB)
            out_row.append(row[first])
            out_tile.append(mixed.view(np.int64))
            out_index.append((pos < index)[first])
            out_big.append(np.minimum(df[first], df[second]) > TILE)
            r, tl, ix = np.concatenate(out_row), np.concatenate(out_tile), np.concatenate(out_index)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tl), pa.array(size[r].astype(np.int32)), pa.array(ids[r]), pa.array(ix), pa.array(np.concatenate(out_big)), *[pa.array(m[r].view(np.int64)) for m in maps]],
                ["tile", "size", "id", "idx", "big", *bits],
            )

    schema = "tile long, size int, id long, idx boolean, big boolean, " + ", ".join(f"{m} long" for m in bits)
    entries = scratch.put(classes.select("class_id", "words").mapInArrow(enter, schema), "entries")
    # a tile may only be large if all its words are held by more than TILE classes, so few entries are counted
    maybe = entries.filter("big")
    large = scratch.put(maybe.groupBy("tile").agg(F.count("*").alias("n")).filter(F.col("n") > TILE).select("tile", F.ceil(F.col("n") / TILE).cast("int").alias("parts")), "large")
    e = maybe.join(large, "tile", "left")
    # a block pair (p, q), p <= q, is a tile of its own: entries of block p go to (p, *) and (*, p)
    part = F.pmod(F.xxhash64("id", F.lit(5)), F.col("parts")).cast("int")
    whole = [F.lit(True).alias("l"), F.lit(True).alias("r"), *bits]
    small = entries.filter("not big").select("tile", "size", "id", "idx", *whole).unionByName(e.filter("parts is null").select("tile", "size", "id", "idx", *whole))
    cut = e.filter("parts is not null").withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.select(F.xxhash64("tile", F.least("part", "other"), F.greatest("part", "other")).alias("tile"), "size", "id", "idx", (F.col("part") <= F.col("other")).alias("l"), (F.col("part") >= F.col("other")).alias("r"), *bits)
    tiled = small.unionByName(cut)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def work(tab: pa.Table) -> Iterator[pa.RecordBatch]:
            col = {c: tab.column(c).to_numpy() for c in ("tile", "size", "id", "idx", "l", "r", *bits)}
            size, ids = col["size"].astype(np.int64), col["id"]
            maps = [col[m].view(np.uint64) for m in bits]
            lft, rgt = col["l"].astype(bool), col["r"].astype(bool)
            idx = col["idx"].astype(bool)
            one_block = lft & rgt
            total = np.arange(2 * int(size.max()) + 1)
            room = (total - 2 * np.ceil(t / (1 + t) * total - 1e-9)).astype(np.int16)  # bits that may differ, by the sum of sizes
            for i, j in _pairs_in_tiles(col["tile"], size, idx, t):
                left_bits = room[size[i] + size[j]]
                for m in maps:  # nearly all pairs fail here, so the rest is looked at for few
                    left_bits = left_bits - np.bitwise_count(m[i] ^ m[j])
                    ok = left_bits >= 0
                    i, j, left_bits = i[ok], j[ok], left_bits[ok]
                # equal sizes: the smaller id is the indexed side; block pairs: the two sides differ unless the block is one
                ok = ((size[i] < size[j]) | (ids[i] < ids[j])) & (one_block[i] | one_block[j] | (lft[i] != lft[j]))
                a, b = ids[i[ok]], ids[j[ok]]
                if len(a):
                    pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        for b in batches:
            held.append(pa.Table.from_batches([b]))
            rows += len(b)
            if rows >= 200_000:  # whole tiles only: the last one may go on in the next batch
                tab = pa.concat_tables(held)
                tile = tab.column("tile").to_numpy()
                cut = int(np.searchsorted(tile, tile[-1], side="left"))
                if cut:
                    yield from work(tab.slice(0, cut))
                held, rows = [tab.slice(cut)], len(tile) - cut
        if rows:
            yield from work(pa.concat_tables(held))

    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(entries.count() / 1_000_000))
    found = tiled.repartition(n, "tile").sortWithinPartitions("tile", "size").mapInArrow(meet, "a long, b long")
    out = scratch.put(found.distinct(), "candidates")
    scratch.drop(entries)
    return out


def similar_classes(classes: DataFrame, t: float, scratch: Scratch) -> DataFrame:
    """``a, b, similarity`` of class pairs with a Jaccard similarity of at least ``t``: candidates, checked exactly."""
    found = candidates(classes, t, scratch)
    a = classes.select(F.col("class_id").alias("a"), F.col("words").alias("wa"))
    b = classes.select(F.col("class_id").alias("b"), F.col("words").alias("wb"))
    both = found.join(a, "a").join(b, "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            n = len(x)
            if not n:
                continue
            sides = []
            for c in (2, 3):
                col = x.column(c)
                off = col.offsets.to_numpy().astype(np.int64)
                size = np.diff(off)
                flat = col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
                sides.append((np.repeat(np.arange(n), size), flat, size))
            # sorted arrays of both sides merged by pair: a word next to its equal is in both
            row = np.concatenate([sides[0][0], sides[1][0]])
            word = np.concatenate([sides[0][1], sides[1][1]])
            order = np.lexsort((word, row))
            row, word = row[order], word[order]
            twin = (row[1:] == row[:-1]) & (word[1:] == word[:-1])
            shared = np.bincount(row[1:][twin], minlength=n)
            sim = shared / (sides[0][2] + sides[1][2] - shared)
            ok = sim >= t - 1e-12
            yield pa.RecordBatch.from_arrays([x.column(0).filter(pa.array(ok)), x.column(1).filter(pa.array(ok)), pa.array(sim[ok])], ["a", "b", "similarity"])

    return scratch.put(both.select("a", "b", "wa", "wb").mapInArrow(exact, "a long, b long, similarity double"), "similar")


def near_duplicate_pairs(records: DataFrame, key: str, words: Column, t: float, scratch: Scratch) -> DataFrame:
    """``<key>_a < <key>_b`` for every pair of records with similarity at least ``t``, copies included."""
    classes, members = copy_classes(records, key, words, scratch)
    links = similar_classes(classes, t, scratch)
    hot = [r[0] for r in _hot(classes, "class_id")]
    x, y = members.select(F.col("class_id").alias("a"), F.col(key).alias("_x")), members.select(F.col("class_id").alias("b"), F.col(key).alias("_y"))
    several = classes.filter("n > 1").select("class_id")
    copies = scratch.put(skew_join(members, several, "class_id", "left_semi", hot), "copies")
    left, right = copies.select("class_id", F.col(key).alias("_x")), copies.select("class_id", F.col(key).alias("_y"))
    within = fan_join(left, right, "class_id", hot).filter("_x < _y").select("_x", "_y")
    across = fan_join(fan_join(links.select("a", "b"), x, "a", hot), y, "b", hot).select(F.least("_x", "_y").alias("_x"), F.greatest("_x", "_y").alias("_y"))
    return within.union(across).select(F.col("_x").alias(f"{key}_a"), F.col("_y").alias(f"{key}_b"))


def near_duplicate_groups(records: DataFrame, key: str, words: Column, t: float, scratch: Scratch) -> DataFrame:
    """One row per record with words: ``<key>, class_id`` (smallest key among its copies), ``copies``, ``links``
    (other classes it is similar to) and ``group_id`` (smallest key of the records connected with it)."""
    classes, members = copy_classes(records, key, words, scratch)
    links = similar_classes(classes, t, scratch)
    degree = links.select(F.col("a").alias("class_id")).unionAll(links.select("b")).groupBy("class_id").agg(F.count("*").alias("links"))
    roots = components(links, scratch).withColumnRenamed("node", "class_id")
    least = members.groupBy("class_id").agg(F.min(key).alias("rep"))
    of = classes.select("class_id", "n").join(least, "class_id").join(degree, "class_id", "left").join(roots, "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    of = scratch.put(of, "of")
    group = of.groupBy("root").agg(F.min("rep").alias("group_id"))
    of = of.join(group, "root").select("class_id", F.col("rep"), F.col("n").alias("copies"), F.coalesce("links", F.lit(0)).alias("links"), "group_id")
    return skew_join(members, of, "class_id", "inner", [r[0] for r in _hot(classes, "class_id")]).select(key, F.col("rep").alias("class_id"), "copies", "links", "group_id")
