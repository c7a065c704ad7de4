"""Tables from positioned glyphs: rows, dot leaders, columns, and logical rows over page breaks."""

from __future__ import annotations

import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vertical distance beyond which a glyph starts a new visual row.
ROW_GAP = 2.0


def gap_clusters(df: DataFrame, group: list[str], at: str, gap: float, tie: str, out: str = "cluster") -> DataFrame:
    """Add the number of the cluster: a new one starts where ``at`` exceeds the *previous* value by more than ``gap``."""
    w = Window.partitionBy(*group).orderBy(at, tie)
    d = df.withColumn("_new", F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(0)))
    return d.withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def run_lengths(df: DataFrame, group: list[str], order: list[str], same: Column, out: str = "run_length") -> DataFrame:
    """Length of the unbroken run each row is in; ``same`` says whether a row goes on from the one before."""
    w = Window.partitionBy(*group).orderBy(*order)
    d = df.withColumn("_k", F.sum((~F.coalesce(same, F.lit(False))).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return d.withColumn(out, F.count("*").over(Window.partitionBy(*group, "_k"))).drop("_k")


def drop_leaders(chars: DataFrame, least: int = 5, step: float = 5.0) -> DataFrame:
    """Glyphs (``page, row, x0, text``) without runs of ``least`` or more dots less than ``step`` apart."""
    dots = chars.filter("text = '.'")
    w = Window.partitionBy("page", "row").orderBy("x0")
    near = F.col("x0") - F.lag("x0").over(w) < step
    runs = run_lengths(dots, ["page", "row"], ["x0"], near).filter(F.col("run_length") < least).drop("run_length")
    return chars.filter("text <> '.'").unionByName(runs)


def carry_layout(pages: DataFrame, layouts: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Bounds for every page: its own, else those of the last page that had some, else the first there are."""
    d = pages.join(layouts, "page", "left")
    back = Window.partitionBy(doc).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(doc).orderBy("page").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    fill = lambda c: F.coalesce(F.last(c, ignorenulls=True).over(back), F.first(c, ignorenulls=True).over(whole)).alias(c)
    return d.select(doc, "page", fill("left"), fill("right"))


def dedupe_glyphs(pdf: pd.DataFrame, tol: float = 1.0) -> pd.DataFrame:
    """One page without glyphs stamped twice: the same text within ``tol`` in both axes of one already kept, from
    left to right. Kept glyphs lie in cells somewhat wider than ``tol``, so those within it are in the cell or next to it,
    however many there are. Glyphs without a place are kept."""
    kept: dict[tuple[str, int, int], list[tuple[float, float]]] = {}
    keep = []
    cell = tol * 1.01 or 1.0
    for r in pdf.sort_values(["x0", "top", "text"]).itertuples():
        if pd.isna(r.x0) or pd.isna(r.top):
            keep.append(r.Index)
            continue
        i, j = math.floor(r.x0 / cell), math.floor(r.top / cell)
        near = (p for a in (i - 1, i, i + 1) for b in (j - 1, j, j + 1) for p in kept.get((r.text, a, b), ()))
        if not any(abs(r.x0 - x) <= tol and abs(r.top - y) <= tol for x, y in near):
            kept.setdefault((r.text, i, j), []).append((r.x0, r.top))
            keep.append(r.Index)
    return pdf.loc[keep]


def dedupe(chars: DataFrame, tol: float = 1.0) -> DataFrame:
    """``dedupe_glyphs`` page by page; a page is bounded by its paper."""
    return chars.groupBy("page").applyInPandas(lambda pdf: dedupe_glyphs(pdf, tol), chars.schema)


_CITE = re.compile(r"^\W*(?:\d+\s*U\.?\s*S\.?\s*C|Pub|P\.\s*L|\(?\d+\s*Stat|Executive Order|Added\s+by\s+Pub|Aug\.\s+\d)", re.I)
MERGED = "doc_id string, ord long, page int, entity string, nature_of_report string, authority string, when_expected string"


def merge_document(pdf: pd.DataFrame) -> pd.DataFrame:
    """Logical rows of one document (``doc_id, page, ord, type, text, nature, authority, when_expected``).

    Headers name the entity until the next one, headers in a row are one name, and a header ends the row before it. A
    line starts a new row if no row is open, or if it has a nature, no authority of the open row is cut off (the last fragment
    ends in a bracket, or there is none yet), its own authority begins as citations do, and its nature begins with a
    digit or its first letter is no small one; else it goes on with the open row.
    """
    out, entity, header, row = [], "", False, None
    for r in pdf.sort_values("ord").itertuples():
        if r.type == "entity_header":
            entity = f"{entity} {r.text}".strip() if header else (r.text or "").strip()
            header = True
            if row:
                out.append(row)
                row = None
            continue
        header = False
        nature, authority, when = ((x or "").strip() for x in (r.nature, r.authority, r.when_expected))
        whole = row is not None and (not row["_last"] or row["_last"].endswith(")"))
        sign, letter = (next((c for c in nature if f(c)), "") for f in (str.isalnum, str.isalpha))
        fresh = row is None or (whole and bool(nature) and bool(_CITE.match(authority)) and (sign.isdigit() or not letter.islower()))
        if fresh:
            if row:
                out.append(row)
            row = {"doc_id": r.doc_id, "ord": r.ord, "page": r.page, "entity": entity, "n": [], "a": [], "w": [], "_last": ""}
        for part, key in ((nature, "n"), (authority, "a"), (when, "w")):
            if part:
                row[key].append(part)
        row["_last"] = authority or row["_last"]
    if row:
        out.append(row)
    return pd.DataFrame(
        [(r["doc_id"], r["ord"], r["page"], r["entity"], " ".join(r["n"]), " ".join(r["a"]), " ".join(r["w"])) for r in out],
        columns=["doc_id", "ord", "page", "entity", "nature_of_report", "authority", "when_expected"],
    )


def merge_rows(lines: DataFrame) -> DataFrame:
    """``merge_document`` for every document; the fold reads what it has built, so it is no window, but documents are
    independent and bounded by their pages."""
    return lines.groupBy("doc_id").applyInPandas(merge_document, MERGED)


def carry_forward(df: DataFrame, group: list[str], order: list[str], value: Column, out: str) -> DataFrame:
    """Last non-null ``value`` up to each row."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def data_pages(chars: DataFrame, title: str) -> DataFrame:
    """``page, is_rotated``: pages that hold table rows. A page counts when most of its glyphs are rotated and its text,
    read in order of ``top`` and ``x0``, names the title; upright pages when their first line names it."""
    p = chars.groupBy("page").agg(
        (F.sum((~F.col("upright")).cast("long")) / F.count("*")).alias("part"),
        F.lower(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.round("top", 0).alias("t"), "x0", "text"))), lambda s: s["text"]), ""), "[^A-Za-z]", "")).alias("said"),
    )
    wanted = F.lit(re.sub(r"[^a-z]", "", title.lower()))
    return p.filter(((F.col("part") > 0.5) & F.col("said").contains(wanted)) | ((F.col("part") <= 0.5) & F.col("said").startswith(wanted))).select("page", (F.col("part") > 0.5).alias("is_rotated"))


def header_box(chars: DataFrame, header: str) -> DataFrame:
    """``page, x_from, x_to, bottom``: where the words of a column header stand; rows start below ``bottom``."""
    want = [w.lower() for w in header.split()]
    hits = chars.filter(F.lower("text").isin(want))
    return hits.groupBy("page").agg(F.min("x0").alias("x_from"), F.max("x1").alias("x_to"), F.max("top").alias("bottom"), F.countDistinct(F.lower("text")).alias("_n")).filter(F.col("_n") == len(set(want))).drop("_n")
