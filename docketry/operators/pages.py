"""Tables on pages of positioned glyphs, upright or turned: layout from ruled lines, lines of text, cells, logical rows.

Turned pages are read along falling ``top``, upright ones along ``x0``; ``along`` and ``down`` are the two axes as read, so
everything behind ``oriented`` is the same for both. Pages are independent and bounded by their paper; a document is by its pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_cell
from .glyphs import ROW_GAP, dedupe_glyphs, gap_clusters, merge_rows, run_lengths

#: A ruled line is at most this thick, a rule of the header box at least this long, a column rule has so many segments.
THIN, LONG, SEGMENTS = 1.0, 100.0, 3
#: How near copies of a stamped glyph lie, turned and upright.
TOLERANCE = (1.0, 1.5)
KEYS = ["doc_id", "page"]


def oriented(d: DataFrame) -> DataFrame:
    """Glyphs (``doc_id, page, is_rotated, text, x0, top, fontname``) with ``along`` and ``down``."""
    return d.withColumn("along", F.when(F.col("is_rotated"), -F.col("top")).otherwise(F.col("x0"))).withColumn("down", F.when(F.col("is_rotated"), F.col("x0")).otherwise(F.col("top")))


def layout(lines: DataFrame) -> DataFrame:
    """``doc_id, page, left, right, cutoff`` from ruled lines (``doc_id, page, is_rotated, height, x0, x1, top, bottom``).

    Column rules lie at the two places along the reading direction with most segments, ``SEGMENTS`` at least; ``cutoff`` is
    where the header ends: the second rule of the header box on turned pages, the lowest long rule of the upper half on
    upright ones. Pages without both take those of the last page of the document that has them, else of the first (``carried``).
    """
    turned = F.col("is_rotated")
    flat, steep = F.abs(F.col("top") - F.col("bottom")) < THIN, F.abs(F.col("x0") - F.col("x1")) < THIN
    box = turned & steep & (F.abs(F.col("top") - F.col("bottom")) > LONG)
    edge = lines.filter(box).select(*KEYS, F.round("x0").alias("x")).distinct()
    edge = edge.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy("x"))).groupBy(*KEYS).agg(F.min("x").alias("_from"), F.max(F.when(F.col("_r") == 2, F.col("x"))).alias("_box")).filter("_box is not null")
    head = lines.filter(~turned & flat & (F.col("x1") - F.col("x0") > LONG) & (F.col("top") < F.col("height") / 2)).groupBy(*KEYS).agg(F.max("top").alias("_head"))
    at = F.when(turned & flat & (F.col("x0") >= F.coalesce("_from", F.lit(80.0))), -F.round("top", 1)).when(~turned & steep, F.round("x0", 1))
    rules = lines.join(edge, KEYS, "left").select(*KEYS, at.alias("at")).filter("at is not null").groupBy(*KEYS, "at").agg(F.count("*").alias("n")).filter(F.col("n") >= SEGMENTS)
    two = rules.withColumn("_r", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("n"), "at"))).filter("_r <= 2")
    two = two.groupBy(*KEYS).agg(F.min("at").alias("left"), F.max("at").alias("right"), F.count("*").alias("_n")).filter("_n = 2").drop("_n")
    d = lines.select(*KEYS, "is_rotated").distinct().join(two, KEYS, "left").join(edge.drop("_from"), KEYS, "left").join(head, KEYS, "left")
    own = d.select(*KEYS, "is_rotated", F.when(turned | F.col("_head").isNotNull(), F.col("left")).alias("left"), F.when(turned | F.col("_head").isNotNull(), F.col("right")).alias("right"), F.when(turned, F.col("_box")).otherwise(F.col("_head") + 1).alias("cutoff"))
    return carried(own)


def carried(own: DataFrame) -> DataFrame:
    """Layouts of all pages: their own, else those of the last page of the same document and direction that has some, else the first's."""
    by = Window.partitionBy("doc_id", "is_rotated").orderBy("page")
    back, whole = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(whole)).alias(c)
    return own.select(*KEYS, *map(fill, ("left", "right", "cutoff")))


def without_leaders(chars: DataFrame, least: int = 5, step: float = 5.0) -> DataFrame:
    """Glyphs without runs of ``least`` dots or more, less than ``step`` apart along one line."""
    d = chars.withColumn("_line", F.round("down"))
    dots, group = d.filter("text = '.'"), [*KEYS, "_line"]
    near = F.col("along") - F.lag("along").over(Window.partitionBy(*group).orderBy("along")) < step
    short = run_lengths(dots.withColumn("_near", near), group, ["along"], F.col("_near")).filter(F.col("run_length") < least).drop("run_length", "_near")
    return d.filter("text <> '.'").unionByName(short).drop("_line")


def without_page_number(chars: DataFrame) -> DataFrame:
    """Glyphs without those within 5 of the page's last line if together they are a number of up to three digits."""
    last = F.max("down").over(Window.partitionBy(*KEYS))
    d = chars.withColumn("_foot", F.col("down") > last - 5)
    text = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("along", "text"))), lambda s: s["text"]), ""))
    number = d.filter("_foot").groupBy(*KEYS).agg(text.alias("_t")).filter(F.col("_t").rlike("^[0-9]{1,3}$")).select(*KEYS, F.lit(True).alias("_num"))
    return d.join(number, KEYS, "left").filter(~(F.col("_foot") & F.coalesce("_num", F.lit(False)))).drop("_foot", "_num")


def unstamped(chars: DataFrame) -> DataFrame:
    """Glyphs stamped once: copies of the same text within the tolerance of the page's direction are left out."""

    def run(pdf):
        return dedupe_glyphs(pdf, TOLERANCE[0] if bool(pdf["is_rotated"].iloc[0]) else TOLERANCE[1])

    return chars.groupBy(*KEYS).applyInPandas(run, chars.schema)


def text_lines(chars: DataFrame, layouts: DataFrame) -> DataFrame:
    """``doc_id, page, ord, type, text, nature, authority, when_expected``: lines of the data area in reading order. A line in bold
    that keeps to the first column is an ``entity_header``, every other a ``data_line`` with its three cells."""
    d = oriented(chars).join(layouts, KEYS).filter(F.col("down") > F.col("cutoff"))
    d = without_page_number(unstamped(without_leaders(d)))
    d = gap_clusters(d, KEYS, "down", ROW_GAP, "along", "line")
    column = F.when(F.col("along") < F.col("left"), 0).when(F.col("along") < F.col("right"), 1).otherwise(2)
    d = d.withColumn("_c", column)
    cell = lambda keep: clean_cell(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("along", "text")))), lambda s: s["text"]), ""))
    g = d.groupBy(*KEYS, "line").agg(
        F.min("down").alias("down"), F.max(F.col("fontname").contains("Bold")).alias("_bold"), F.max("_c").alias("_last"),
        cell(F.lit(True)).alias("text"), *[cell(F.col("_c") == i).alias(n) for i, n in enumerate(("nature", "authority", "when_expected"))],
    )
    header = F.coalesce("_bold", F.lit(False)) & (F.col("_last") == 0)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "down")).cast("long").alias("ord")
    return g.select(*KEYS, order, F.when(header, "entity_header").otherwise("data_line").alias("type"), "text", *[F.when(~header, F.col(n)).otherwise("").alias(n) for n in ("nature", "authority", "when_expected")])


def table_rows(chars: DataFrame, lines: DataFrame) -> DataFrame:
    """Logical rows of all documents from their glyphs and ruled lines."""
    return merge_rows(text_lines(chars, layout(lines)))


def glyph_layers(chars: DataFrame, layouts: DataFrame) -> DataFrame:
    """Every glyph with what became of it, for review: ``header``, ``kept`` or ``dropped`` (leader, page number or second stamp)."""
    d = oriented(chars).join(layouts, KEYS)
    kept = without_page_number(unstamped(without_leaders(d.filter(F.col("down") > F.col("cutoff"))))).select(*KEYS, "x0", "top", "text").distinct().withColumn("_k", F.lit(True))
    layer = F.when(F.col("down") <= F.col("cutoff"), "header").when(F.col("_k"), "kept").otherwise("dropped")
    return d.join(kept, [*KEYS, "x0", "top", "text"], "left").select(*KEYS, "x0", "top", "text", layer.alias("layer"))

