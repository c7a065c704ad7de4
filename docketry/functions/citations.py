"""Column functions that read legal citations. Built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Dash characters that stand for a hyphen in section numbers.
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\ufe63\uff0d"
#: Blanks other than the plain space, folded before parsing.
BLANKS = "\u00a0\u2007\u202f\u2009\u3000\t\r\n"


def fold_dashes(c: Column) -> Column:
    """Every dash of ``DASHES`` as an ASCII hyphen; null stays null."""
    return F.translate(c, DASHES, "-" * len(DASHES))


def section_address(uslm_id: Column) -> Column:
    """``/us/usc/t<title>/s<section>`` of an id or citation, lower case, ASCII hyphens, no leading zeros.

    Understands path ids with any subdivision, note or fragment behind the section, and citations such as
    ``42 U.S.C. § 300zz-7(e)(4) note`` or with ``App.`` for an appendix title. Anything else gives null.
    """
    s = F.regexp_replace(F.lower(fold_dashes(F.translate(uslm_id, BLANKS, " " * len(BLANKS)))), r"[\u200b-\u200f\u2060\ufeff\u00ad]", "")
    s = F.trim(F.regexp_replace(F.regexp_replace(s, " +", " "), "/+", "/"))
    section = r"([0-9]+[a-z]*(?:-[0-9a-z]+)*)(?![0-9a-z])"
    path = rf"^/?us/usc/t0*([0-9]+[a-z]*)/s0*{section}"
    cite = rf"^(?:title )?0*([0-9]+[a-z]*) ?u\.? ?s\.? ?c\.? ?(?:code)?(app)?\.?,? ?(?:§+|sec\.?|section)? ?0*{section}"
    by_path = F.when(F.regexp_extract(s, path, 2) != "", F.concat(F.lit("/us/usc/t"), F.regexp_extract(s, path, 1), F.lit("/s"), F.regexp_extract(s, path, 2)))
    app = F.when(F.regexp_extract(s, cite, 2) == "app", "a").otherwise("")
    by_cite = F.when(F.regexp_extract(s, cite, 3) != "", F.concat(F.lit("/us/usc/t"), F.regexp_extract(s, cite, 1), app, F.lit("/s"), F.regexp_extract(s, cite, 3)))
    return F.coalesce(by_path, by_cite)


#: Citation formats. Group 1 and 2 are the two halves of a key.
USC = r"(?i)(?:^|[^0-9a-z])([0-9]+)\s*U\.?\s*S\.?\s*C\.?\s*(?:§+\s*)?([0-9]+[A-Za-z]*(?:-[0-9]+)?)"
PLAW = r"(?i)(?:^|[^a-z])P(?:ub(?:lic)?)?[.\s]*L(?:aw)?[.\s]*([0-9]+)\s*-\s*([0-9]+)"
STAT = r"(?i)(?:^|[^0-9])([0-9]+)\s*Stat\.?\s*([0-9]+)"
#: Addressing grade: title, appendix mark, section, subsection path, note mark.
USC_PATH = r"(?i)(?:^|[^0-9a-z])([0-9]+[A-Za-z]?)\s*U\.?\s*S\.?\s*C\.?\s*(App\.\s*)?(?:§+\s*)?([0-9]+[A-Za-z]*(?:-[0-9]+[A-Za-z]*)?)((?:\([a-zA-Z0-9]{1,4}\))*)(\s+note)?"
PLAW_SPAN = r"(?i)(?:^|[^a-z])P(?:ub(?:lic)?)?[.\s]*L(?:aw)?[.\s]*[0-9]+\s*-\s*[0-9]+"
SECTION_MARK = r"(?i)(?:Sec\.|§+)\s*([0-9]+[A-Za-z]?)"
SECTION_PATH = r"(/us/usc/t[0-9A-Za-z]+(?:/pl/[0-9]+/[0-9]+)?/s[^/]+)"
#: First Congress whose laws are in the public-law collection.
FIRST_COLLECTED = 104


def _keys(text: Column, pattern: str) -> Column:
    a, b = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (1, 2))
    return F.array_distinct(F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b"))))


def parse_citations(text: Column) -> Column:
    """Matching grade: distinct ``usc`` (title, section), ``plaw`` (congress, number), ``stat`` (volume, page) keys, as
    strings, without subsection paths. Null text gives empty arrays."""
    t = fold_dashes(F.coalesce(text, F.lit("")))
    return F.struct(_keys(t, USC).alias("usc"), _keys(t, PLAW).alias("plaw"), _keys(t, STAT).alias("stat"))


def citation_overlap(a: Column, b: Column) -> Column:
    """Shared keys per kind of two ``parse_citations`` results."""
    return F.struct(*[F.size(F.array_intersect(a[k], b[k])).alias(k) for k in ("usc", "plaw", "stat")])


def parse_authority(text: Column) -> Column:
    """Addressing grade, in order, first of equals kept: title, section, subs (path as written), note, appendix,
    ``uslm_id`` (subsection case kept, notes without path), ``section_id`` and ``cite``."""
    t = fold_dashes(F.coalesce(text, F.lit("")))
    parts = [F.regexp_extract_all(t, F.lit(USC_PATH), F.lit(g)) for g in range(1, 6)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("title", "app", "section", "subs", "note"))])

    def build(x: Column) -> Column:
        app, note = x["app"] != "", x["note"] != ""
        head = F.concat(F.lit("/us/usc/t"), F.lower(x["title"]), F.when(app, "a").otherwise(""), F.lit("/s"), F.lower(x["section"]))
        path = F.regexp_replace(F.regexp_replace(x["subs"], r"\(", "/"), r"\)", "")
        shown = F.concat(x["title"], F.lit(" U.S.C. "), F.when(app, "App. ").otherwise(""), x["section"], x["subs"], F.when(note, " note").otherwise(""))
        return F.struct(
            x["title"].alias("title"), x["section"].alias("section"), x["subs"].alias("subs"), note.alias("is_note"), app.alias("is_appendix"),
            F.when(note, head).otherwise(F.concat(head, path)).alias("uslm_id"), head.alias("section_id"), shown.alias("cite"),
        )

    return F.array_distinct(F.transform(zipped, build))


def authority(text: Column) -> Column:
    """All that a text cites as distinct (kind, cite) in order within each kind: sections of the Code with path, note and appendix
    mark, public laws, Statutes pages. Null text cites nothing."""
    c = parse_citations(text)
    said = lambda kind, items, cite: F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), cite(x).alias("cite")))
    return F.array_distinct(F.concat(
        said("usc", parse_authority(text), lambda x: x["cite"]), said("plaw", c["plaw"], lambda x: F.concat(F.lit("Pub. L. "), x["a"], F.lit("-"), x["b"])),
        said("stat", c["stat"], lambda x: F.concat(x["a"], F.lit(" Stat. "), x["b"])),
    ))


def law_spans(text: Column) -> Column:
    """The text cut at each public law: one piece per law, up to the next one."""
    t = fold_dashes(F.coalesce(text, F.lit("")))
    marked = F.regexp_replace(t, PLAW_SPAN, "\u001e$0")
    return F.filter(F.split(marked, "\u001e"), lambda s: F.regexp_extract(s, PLAW, 1) != "")


def plaw_sections(text: Column) -> Column:
    """Each public law with the first section named before the next law (null if none), in order, distinct."""

    def build(s: Column) -> Column:
        sec = F.regexp_extract(s, SECTION_MARK, 1)
        return F.struct(F.regexp_extract(s, PLAW, 1).cast("int").alias("congress"), F.regexp_extract(s, PLAW, 2).cast("int").alias("number"), F.when(sec != "", sec).alias("section"))

    return F.array_distinct(F.transform(law_spans(text), build))


def credit_keys(text: Column) -> Column:
    """Every section named behind each public law, as (congress, number, section), distinct."""

    def build(s: Column) -> Column:
        c, n = F.regexp_extract(s, PLAW, 1).cast("int"), F.regexp_extract(s, PLAW, 2).cast("int")
        return F.transform(F.regexp_extract_all(s, F.lit(SECTION_MARK), F.lit(1)), lambda x: F.struct(c.alias("congress"), n.alias("number"), x.alias("section")))

    return F.array_distinct(F.flatten(F.transform(law_spans(text), build)))


def credit_pages(text: Column) -> Column:
    """Every Statutes page a source credit names, as distinct (volume, page) numbers."""
    return F.transform(parse_citations(text)["stat"], lambda x: F.struct(x["a"].cast("int").alias("volume"), x["b"].cast("int").alias("page")))


def tagged_keys(citations: Column) -> Column:
    """``parse_citations`` as one array of (kind, a, b)."""
    return F.concat(*[F.transform(citations[k], lambda x: F.struct(F.lit(k).alias("kind"), x["a"].alias("a"), x["b"].alias("b"))) for k in ("usc", "plaw", "stat")])


def stated_cites(title: Column, refs: Column) -> Column:
    """All that a filing cites, in its references or its title, as distinct (kind, a, b)."""
    return F.array_union(flatten_references(refs), tagged_keys(parse_citations(title)))


def package_id(congress: Column, number: Column) -> Column:
    """Name of a public law's package; null before the collection begins."""
    return F.when(congress >= FIRST_COLLECTED, F.concat(F.lit("PLAW-"), congress, F.lit("publ"), number))


def section_of(uslm_id: Column) -> Column:
    """Enclosing section of a node id, null if it has none."""
    s = F.regexp_extract(uslm_id, SECTION_PATH, 1)
    return F.when(s != "", s)


def ancestors(uslm_id: Column) -> Column:
    """Enclosing nodes from the parent up to the section; empty for sections, notes and other ids."""
    section = section_of(uslm_id)
    rest = F.filter(F.split(F.substring(uslm_id, F.length(section) + 2, F.lit(1 << 30)), "/"), lambda x: x != "")
    depth = F.size(rest)
    up = F.transform(F.sequence(depth - 1, F.lit(0), F.lit(-1)), lambda k: F.concat_ws("/", section, F.when(k > 0, F.array_join(F.slice(rest, F.lit(1), k), "/"))))
    none = F.array().cast("array<string>")
    return F.when(section.isNull() | uslm_id.rlike("/note/[0-9]+$") | (depth < 1), none).otherwise(F.coalesce(up, none))


def parent_of(uslm_id: Column) -> Column:
    """The enclosing node; null for sections, notes and ids without a section."""
    return F.get(ancestors(uslm_id), F.lit(0))


def citation(uslm_id: Column) -> Column:
    """Readable citation of a node id, dashes folded: ``42 U.S.C. 300gg-111(a)(2)``, ``10 U.S.C. 2687 note``, and for a law printed
    in an appendix ``Pub. L. 95-452, § 8(b) (5 U.S.C. App.)``. Other ids come back as they are; null stays null."""
    u = fold_dashes(uslm_id)
    law, node = r"^/us/usc/t([0-9A-Za-z_]+)/pl/([0-9]+)/([0-9]+)/s([^/]+)((?:/[^/]+)*)$", r"^/us/usc/t([0-9A-Za-z_]+)/s([^/]+)((?:/[^/]+)*)$"
    part = lambda pattern, g: F.regexp_extract(u, pattern, g)
    path = lambda c: F.regexp_replace(c, "/([^/]+)", "($1)")
    enacted = F.concat(F.lit("Pub. L. "), part(law, 2), F.lit("-"), part(law, 3), F.lit(", § "), part(law, 4), path(part(law, 5)), F.lit(" ("), F.regexp_replace(part(law, 1), "a+$", ""), F.lit(" U.S.C. App.)"))
    coded = F.concat(part(node, 1), F.lit(" U.S.C. "), part(node, 2), F.when(part(node, 3).rlike("(^|/)note/[^/]+$"), " note").otherwise(path(part(node, 3))))
    return F.when(u.rlike(law), enacted).when(u.rlike(node), coded).otherwise(uslm_id)


#: Fixed value: address of a section in the public code browser.
CODE_URL = "https://uscode.house.gov/view.xhtml?req=granuleid:USC-prelim-title{}-section{}&num=0&edition=prelim"


def code_url(uslm_id: Column) -> Column:
    """Web address of a node's section; null for appendix titles and ids without a section."""
    u, pattern = fold_dashes(uslm_id), r"^/us/usc/t([0-9]+)/s([^/]+)"
    before, between, after = CODE_URL.split("{}")
    return F.when(u.rlike(pattern), F.concat(F.lit(before), F.regexp_extract(u, pattern, 1), F.lit(between), F.regexp_extract(u, pattern, 2), F.lit(after)))


def newest_law(laws: Column) -> Column:
    """Largest (congress, number) of an array of ``a``, ``b`` string pairs; null if there is none."""
    return F.array_max(F.transform(laws, lambda x: F.struct(x["a"].try_cast("int").alias("congress"), x["b"].try_cast("int").alias("number"))))


def flatten_references(refs: Column) -> Column:
    """``cite_refs`` (arrays of string arrays per kind) as distinct (kind, a, b) keys; null gives none."""

    def of(kind: str) -> Column:
        pairs = F.transform(F.filter(F.coalesce(refs[kind], F.array().cast("array<array<string>>")), lambda x: x.isNotNull()), lambda x: F.struct(F.lit(kind).alias("kind"), F.get(x, F.lit(0)).alias("a"), F.get(x, F.lit(1)).alias("b")))
        return F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull())

    return F.array_distinct(F.concat(of("usc"), of("plaw"), of("stat")))


def end_years(text: Column) -> Column:
    """Years that a text states as an end bound ("through fiscal year 2023", "until December 31, 2015")."""
    lead = r"(?i)(?:through|until|ending(?:\s+on|\s+in)?|no\s+later\s+than\s+the\s+end\s+of)\s+"
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(lead + r"(?:the\s+)?(?:end\s+of\s+)?(?:(?:fiscal|calendar)\s+year\s+|FY\s*)?(?:[A-Za-z]+\s+[0-9]{1,2},?\s+)?(19[0-9]{2}|20[0-9]{2})(?![0-9])"), F.lit(1)), lambda y: y.cast("int"))


def terminal_year(text: Column) -> Column:
    """Latest end bound of a text, null if none."""
    return F.array_max(end_years(text))


def deadline_year(text: Column) -> Column:
    """Latest year from 2000 to 2099 that stands alone in a text, null if none."""
    return F.array_max(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?:^|[^0-9A-Za-z])(20[0-9]{2})(?=$|[^0-9A-Za-z])"), F.lit(1)), lambda y: y.cast("int")))
