"""Column functions for text, names and keys. Built-in expressions only, so they stay inside generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no content in titles and duty texts.
STOPWORDS = (
    "a an and as at be by for from in is it of on or that the to with regarding "
    "report reports submitted submitting congress congressional house senate fiscal year years annual annually biennial biennially "
    "department departments office offices agency agencies program programs section sections title titles part parts chapter chapters "
    "act acts public law laws pub stat pursuant concerning"
).split()

#: Accented Latin letters and their plain letters, by rule: one base letter a-z plus combining marks.
_ACCENTED = [(c, b) for c, b in ((chr(x), unicodedata.normalize("NFKD", chr(x))) for x in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))) if b[0].isascii() and b[0].isalpha() and all(unicodedata.combining(m) for m in b[1:]) and b != c]


def strip_diacritics(c: Column) -> Column:
    """Latin letters without accents; letters that don't decompose (ø, ß) stay."""
    plain = F.translate(c, "".join(a for a, _ in _ACCENTED), "".join(b[0] for _, b in _ACCENTED))
    return F.regexp_replace(plain, "[\u0300-\u036f]", "")


def normalize_text(c: Column) -> Column:
    """No accents, lower case, no final punctuation, single spaces. Null stays null."""
    s = F.trim(F.regexp_replace(F.lower(strip_diacritics(c)), "[ \t\n\r\f]+", " "))
    return F.trim(F.regexp_replace(s, "[.,;:!?]+$", ""))


def basic_key(c: Column) -> Column:
    """Comparison key: no accents, ``&`` as "and", lower case, everything but letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(strip_diacritics(c), "&", " and ")), "[^a-z0-9]+", " "))


def split_parent(c: Column) -> tuple[Column, Column]:
    """Parent and sub-unit of "Parent - Unit (ACR)": a final bracket is dropped, the first spaced hyphen splits."""
    s = F.trim(F.regexp_replace(c, "\\s*\\([^()]*\\)\\s*$", ""))
    parts = F.split(s, "\\s+[-\u2013\u2014]\\s+", 2)
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.coalesce(F.get(parts, F.lit(1)), F.lit("")))


def words(c: Column) -> Column:
    """All runs of a-z and digits of the normalized text, in order."""
    return F.regexp_extract_all(normalize_text(c), F.lit("[a-z0-9]+"), F.lit(0))


def token_set(c: Column) -> Column:
    """Distinct content words longer than one character, sorted. Null gives an empty set."""
    found = F.filter(words(F.coalesce(c, F.lit(""))), lambda w: F.length(w) > 1)
    return F.array_sort(F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in STOPWORDS])))


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    """Shared part of two sets; two empty sets give ``both_empty``, one empty set 0."""
    shared, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(both_empty)).otherwise(shared / either)


def overlap_coefficient(shared: Column, a: Column, b: Column) -> Column:
    """Shared count over the smaller size, which counts as 1 when 0."""
    return shared / F.greatest(F.least(a, b), F.lit(1))


def stem(c: Column, n: int = 8) -> Column:
    """Title without years and fiscal-year marks, letters only, first ``n`` words: the same for all editions."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "(fiscal year|fy) ?[0-9]*|(19|20)[0-9][0-9]", " ")
    return F.array_join(F.slice(F.filter(F.split(F.regexp_replace(s, "[^a-z]+", " "), " "), lambda w: w != ""), 1, n), " ")


def clean_cell(c: Column) -> Column:
    """Cell text without dot leaders, blanks squeezed, and without a lone final dot that follows no letter."""
    s = F.trim(F.regexp_replace(F.regexp_replace(c, "[.]{2,}", " "), "[ \t\n\r]+", " "))
    return F.trim(F.regexp_replace(s, "(^|[^A-Za-z])[.]$", "$1"))


def row_id(*columns: Column) -> Column:
    """Content id: ``r-`` and ten hex digits of the MD5 of the columns joined by a unit separator, null as empty."""
    joined = F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.concat(F.lit("r-"), F.substring(F.md5(joined), 1, 10))


def fingerprint(*columns: Column) -> Column:
    """Aggregate: order-free hash of a relation, 60 bits of each row's MD5 combined by exclusive or."""
    joined = F.concat_ws("\u001f", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
    return F.bit_xor(F.conv(F.substring(F.md5(joined), 1, 15), 16, 10).cast("long"))


def loose_json(c: Column) -> Column:
    """The outermost ``{...}`` of a text, without code fences; empty if there is none."""
    return F.regexp_extract(F.coalesce(c, F.lit("")), "(?s)\\{.*\\}", 0)


def candidate_id(stage: Column, mandate: Column, requirement: Column, package: Column) -> Column:
    """Pair id whose mark tells the stage, so ids of different stages never meet."""
    r, p = F.coalesce(requirement, F.lit("")), F.coalesce(package, F.lit(""))
    return F.when(stage == "A", F.concat(mandate, F.lit("|R"), r)).when(stage == "A_validation", F.concat(mandate, F.lit("|AV"), p)).otherwise(F.concat(mandate, F.lit("|P"), p))


def common_prefix(low: Column, high: Column) -> Column:
    """Longest common prefix of a group, from its least and greatest string (code point order)."""
    n = F.least(F.length(low), F.length(high))
    same = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (i > n) | (F.substring(low, i, F.lit(1)) != F.substring(high, i, F.lit(1))))
    first = F.get(same, F.lit(0))
    return F.when(n == 0, "").otherwise(F.substring(low, F.lit(1), F.coalesce(first - 1, n)))


def entity_key(c: Column) -> Column:
    """Loose actor key: letters only, no articles, no "of the United States"."""
    s = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z ]", " ")
    s = F.regexp_replace(F.concat(F.lit(" "), F.regexp_replace(s, " +", "  "), F.lit(" ")), " of  the  united  states ", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(s, " (the|a|an) ", " "), " +", " "))


def same_entity(a: Column, b: Column) -> Column:
    """True if either key is empty or one starts with the other. Not transitive."""
    return (a == "") | (b == "") | a.startswith(b) | b.startswith(a)


def descending(c: Column) -> Column:
    """A key that sorts the other way round, for strings in a struct that is maximised: code points complemented, an end mark added."""
    return F.concat(F.translate(F.hex(F.encode(F.coalesce(c, F.lit("")), "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G"))


def replace_once(c: Column, old: str, new: str) -> Column:
    """``c`` with the one occurrence of ``old`` replaced; null where it occurs never or more than once, so no variant is made by mistake."""
    times = (F.length(c) - F.length(F.replace(c, F.lit(old), F.lit("")))) / F.lit(len(old))
    return F.when(times == 1, F.replace(c, F.lit(old), F.lit(new)))


def agency_names(organization: Column, display: Column, author: Column) -> Column:
    """The three names a catalogue gives an agency, ``full, display, author``: the first of an array, else empty."""
    first = F.get(organization, F.lit(0))
    return F.struct(*[F.coalesce(F.trim(x), F.lit("")).alias(n) for x, n in ((first, "full"), (display, "display"), (author, "author"))])


def agency_keys(*names: Column) -> Column:
    """All comparison keys of a filing's agency: of every name whole, of its parent and of its sub-unit; distinct, none empty."""
    keys = [k for n in names for k in (basic_key(n), *map(basic_key, split_parent(n)))]
    return F.array_distinct(F.filter(F.array(*keys), lambda k: k.isNotNull() & (k != "")))
