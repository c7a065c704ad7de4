"""What to land from listing pages: links, the newest release, and tables of pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how release points are named in links, Congress and law.
RELEASE = r"@([0-9]+)-([0-9]+)"


def html_links(page: Column) -> Column:
    """Targets of all links of an HTML page in order, entities of ``&`` decoded; null and unlinked pages give none."""
    found = F.regexp_extract_all(F.coalesce(page, F.lit("")), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)"""), F.lit(1))
    return F.transform(found, lambda x: F.replace(F.regexp_replace(x, "^[\"']|[\"']$", ""), F.lit("&amp;"), F.lit("&")))


def newest_release(links: Column, pattern: str = RELEASE) -> Column:
    """The greatest (congress, law) named in an array of links, compared as numbers; null if none names one."""
    hits = F.filter(links, lambda x: x.rlike(pattern))
    return F.array_max(F.transform(hits, lambda x: F.struct(F.regexp_extract(x, pattern, 1).cast("int").alias("congress"), F.regexp_extract(x, pattern, 2).cast("int").alias("law"))))
