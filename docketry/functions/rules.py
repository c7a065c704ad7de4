"""Ordered rule classifiers over text and scores. Thresholds and years are parameters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that name a reporting rhythm, most specific first.
CADENCES = [
    ("biennial", "biennial|biennially|every (other|2|two) years?|every 2nd year"),
    ("triennial", "triennial|triennially|every (3|three) years?"),
    ("semiannual", "semi[ -]?annual(ly)?|twice (a|each) (fiscal )?year|every (six|6) months|each (six|6)[ -]month period|after the end of each (six|6)[ -]?month period"),
    ("quarterly", "quarterly|every quarter|each (fiscal )?quarter|every (three|3) months"),
    ("monthly", "monthly|every month|each month"),
    ("annual", "annual|annually|(each|every) (fiscal )?year|yearly|once a year|after the end of (the |each )?(fiscal )?year|first monday in february|on or before january 15|fiscal year thereafter"),
    ("on_demand", "immediately|as soon as|without delay|promptly"),
    ("event_driven", "if (any|specified|requested|necessary)|upon (a |the |any |request)|when (the |a |any |specified )|in the event|whenever|as needed|on demand|from time to time"),
]
#: Days within which a filing of each rhythm counts as fresh.
FRESHNESS = {"monthly": 60, "quarterly": 120, "semiannual": 240, "annual": 500, "biennial": 850, "triennial": 1200, "on_demand": 365}
#: Folding of free frequency labels, in order.
FREQUENCIES = [
    ("weekly", "weekly"), ("monthly", "monthly|every month"), ("quarterly", "quarter"), ("semiannual", "semi-?annual|every (6|six) months|every 180 days|twice (a|each) year"),
    ("biennial", "bienni|every (2|two) years"), ("annual", "annual|each year|every year|yearly"),
    ("multi-year", "trienni|quadrenni|every [a-z0-9]+ years|five-year|every [a-z0-9]+ congress|(^|[^0-9a-z])[0-9]+ years($|[^0-9a-z])"),
    ("periodic", "periodic|regular|recurring"), ("event-driven", "event|session"), ("one-time", "one[- ]time"),
]
#: Bodies of Congress that may receive a report.
RECIPIENTS = "congress|congressional|senate|house of representatives|committees? (on|of)|speaker of the house|president pro tempore|comptroller general|clerk of the house|secretary of the senate"
#: Language that leaves open whether a duty still holds.
DOUBTFUL = r"interim ([a-z0-9]+ ){0,3}(panel|committee|commission|board|authority|council|corporation)|shall (cease|terminate|expire)|terminat(es|ion) (on|of (this|the))|no longer (be )?(required|in effect|applicable)|sunset|repealed effective"


def bounded(phrases: str) -> str:
    """A pattern for lower-case text that finds the phrases as whole words, alike in every regex dialect."""
    return f"(^|[^a-z0-9])({phrases})($|[^a-z0-9])"


def first_match(text: Column, rules: Iterable[tuple[str, str]], otherwise: Column, whole_words: bool = True) -> Column:
    """Label of the first rule whose pattern the lower-case text matches."""
    out = None
    for label, pattern in rules:
        hit = text.rlike(bounded(pattern) if whole_words else pattern)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return otherwise if out is None else out.otherwise(otherwise)


def cadence(when_expected: Column) -> Column:
    """Rhythm of a "when expected" text; ``one_time`` if it names a year and no recurrence, else ``other``."""
    t = F.lower(F.coalesce(when_expected, F.lit("")))
    once = t.rlike(bounded("(19|20)[0-9][0-9]")) & ~t.rlike(bounded("each|every|annual|then|thereafter"))
    return F.when(t == "", "other").otherwise(first_match(t, CADENCES, F.when(once, "one_time").otherwise("other")))


def freshness_days(label: Column) -> Column:
    """Days of ``FRESHNESS``, null where being overdue has no meaning."""
    out = None
    for k, v in FRESHNESS.items():
        out = F.when(label == k, v) if out is None else out.when(label == k, v)
    return out


def frequency(label: Column) -> Column:
    """Rhythm class of a free frequency label; empty, unknown and none give ``unknown``."""
    t = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return first_match(t, FREQUENCIES, F.when(t.isin("", "unknown", "none"), "unknown").otherwise("other"), whole_words=False)


def names_recipient(text: Column) -> Column:
    """True if a body of Congress is named."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \t\n\r]+", " ").rlike(bounded(RECIPIENTS))


def length_between(text: Column, low: int, high: int) -> Column:
    return (F.length(text) > low) & (F.length(text) < high)


def currency(text: Column, end_year: Column, year: int, is_note: Column) -> Column:
    """``expired`` (end bound before ``year``, or a note of a repeal), ``review`` (termination language), ``current``."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[ \t\n\r]+", " ")
    return F.when(F.coalesce(end_year < year, F.lit(False)), "expired").when(is_note & t.contains("repeal"), "expired").when(t.rlike(bounded(DOUBTFUL)), "review").otherwise("current")


def stage_a(kinds: Column, similarity: Column, agency: Column, empty_nature: Column) -> Column:
    """Verdict on a requirement and a mandate from citation kinds in common, unrounded similarity and agency match."""
    bare = F.when((kinds >= 2) & agency, "confident").when((kinds >= 1) & agency, "candidate").otherwise("reject")
    full = (
        F.when((kinds >= 2) & (similarity >= 0.4), "confident")
        .when((kinds >= 1) & (similarity >= 0.4), F.when(agency, "confident").otherwise("candidate"))
        .when((kinds >= 1) & (similarity >= 0.2), "candidate").when((kinds == 0) & (similarity >= 0.7), "candidate").otherwise("reject")
    )
    return F.when(empty_nature, bare).otherwise(full)


def stage_b1(kinds: Column, similarity: Column, agency: Column, multi: Column, law_only: Column) -> Column:
    """Verdict on a filing and a mandate that share a citation; ``similarity`` is rounded to three places before."""
    return (
        F.when((kinds >= 2) & agency, F.when(similarity >= 0.15, "confident").otherwise("candidate"))
        .when((kinds >= 2) & multi, "candidate").when((kinds >= 1) & (agency | multi) & ~law_only, "candidate")
        .when(law_only & (agency | multi) & (similarity >= 0.25), "candidate").when((kinds >= 1) & ~law_only & (similarity >= 0.15), "candidate").otherwise("none")
    )


def stage_b2(similarity: Column) -> Column:
    """Verdict by title similarity within an agency, null similarity meaning no row of the agency."""
    return F.when(similarity >= 0.5, "confident").when(similarity >= 0.25, "candidate").otherwise("no_match")


def score_reason(kinds: Column, similarity: Column, agency: Column) -> Column:
    """Readable reason of a score."""
    return F.concat_ws("; ", F.when(kinds > 0, F.concat(kinds.cast("string"), F.lit(" kinds of citation"))), F.concat(F.lit("similarity "), F.format_number(similarity, 3)), F.when(agency, "same agency"))


def orphan_tag(agency_known: Column, cites: Column, best: Column) -> Column:
    """Why a filing found no mandate, from whether its agency is listed, whether it cites, and the best similarity."""
    return F.when(~agency_known, "agency_absent").when(cites & (best < 0.2), "cited_but_unlike").when(best >= 0.3, "near_miss").when(best >= 0.15, "weak").otherwise("none")


def window_reason(label: Column, year: Column, first: int, last: int) -> Column:
    """Why a duty of rhythm ``label`` falls in the years ``first`` to ``last`` or not: ``recurring``, ``on_demand``, ``one_time_in``, which do, or
    ``one_time_future``, ``one_time_out``, ``event_driven``, ``other``. A single duty without a year is out."""
    once = F.when(year.between(first, last), "one_time_in").when(year > last, "one_time_future").otherwise("one_time_out")
    return F.when(label.isin("on_demand", "event_driven", "other"), label).when(label == "one_time", once).otherwise("recurring")
