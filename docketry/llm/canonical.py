"""Freely typed values mapped to a canonical list: an automaton over names and aliases, then token-set similarity."""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import HOT_SHARE, Scratch, skew_join

#: Words that carry no meaning of their own in a name.
FILLERS = frozenset("the of for and a an to in on".split())
#: Words after which a name stands by itself: "Secretary of the <name>".
CONNECTIVES = frozenset("of within at under in from".split())
#: Short forms of the country's name, which may stand before any name.
COUNTRY = {"us": ("united", "states"), "usa": ("united", "states")}
#: Broadcast bound: a longer list is refused.
MOST_ENTRIES = 200_000
#: Two word sets are one name when at least this part of all their words pairs off.
COVER = 0.8
#: Similarity of a word to one it shortens: by its beginning or keeping the last letter, by any letters in order, with one letter wrong.
SHORT = (0.95, 0.85, 0.75)
_BREAK = re.compile(r"\s+[-–—‒―]+\s+|\s*[:/|;\[\](){}]\s*|\s*,(?=\s|$)|\s+[–—]|[–—]\s+")
_ZERO = re.compile(r"(?<=[^\W\d_])0|0(?=[^\W\d_])")


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+|\||&", text.replace("'", ""))


class Canon:
    """The compiled list: one per Python worker."""

    def __init__(self, entries: list[tuple], threshold: float):
        self.threshold = threshold
        self.tokens: dict = {}  # id -> content words in order
        self.holders: dict[str, set] = defaultdict(set)  # content word -> ids
        patterns: dict[str, set] = defaultdict(set)  # words between blanks -> ids
        initials: dict[str, set] = defaultdict(set)
        listed: dict[str, set] = defaultdict(set)
        for id_, name, aliases in entries:
            if not name or not name.strip():
                continue
            words = self.read(name)
            self.tokens[id_] = content = [w for w in words if w not in FILLERS and w != "|"]
            for w in content:
                self.holders[w].add(id_)
            for form in (words, content):
                patterns[" ".join(form)].add(id_)
                for k in range(1, len(form)):  # turned round at a comma
                    patterns[" ".join([*form[k:], "|", *form[:k]])].add(id_)
            for skip in (FILLERS, {"the"}, set()):
                code = "".join(w[0] for w in words if w not in skip and w != "|")
                if len(code) > 1:
                    initials[code].add(id_)
            for a in aliases:
                if a and a.strip():
                    if " " in a.strip():
                        patterns[" ".join(self.read(a))].add(id_)
                    else:
                        listed[re.sub(r"[^a-z0-9]", "", self.fold(a))].add(id_)
        # acronyms: the listed one wins, else initials that no other entry shares
        self.codes = {c: next(iter(x)) for c, x in initials.items() if len(x) == 1} | {c: next(iter(x)) for c, x in listed.items() if len(x) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, ids in patterns.items():
            if p:
                self.automaton.add_word(f" {p} ", (p.count(" ") + 1, len(p) + 2, frozenset(ids)))
        if patterns:
            self.automaton.make_automaton()
        self.near = defaultdict(set)  # deletions of up to two letters -> content words
        self.by_letter: dict[str, list[str]] = defaultdict(list)
        for w in self.holders:
            self.by_letter[w[0]].append(w)
            for d in self._deletions(w, 2 if len(w) > 4 else 1):
                self.near[d].add(w)
        self.longest = max(map(len, self.holders), default=0)
        self.cache: dict[str, list] = {}

    @staticmethod
    def fold(text: str) -> str:
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if not unicodedata.combining(c)).replace("’", "'").replace("_", " ").casefold()
        return re.sub(r"\s+", " ", _ZERO.sub("o", text)).strip()

    def read(self, text: str) -> list[str]:
        """Words of a text with ``|`` where it is broken; letters standing singly are joined, ``&`` is "and"."""
        text = _BREAK.sub(" | ", re.sub(r"\s*(?:\d+/|\*+)\s*$", "", self.fold(text)))
        text = re.sub(r"(?<![a-z0-9'])(?:[a-z]\.?[ ]){1,}[a-z]\.?(?![a-z0-9'])|(?<![a-z0-9'])(?:[a-z]\.){2,}", lambda m: re.sub(r"[ .]", "", m.group()), text)
        return ["and" if w == "&" else w for w in _words(text)]

    @staticmethod
    def _deletions(w: str, depth: int) -> set[str]:
        found, level = {w}, {w}
        for _ in range(depth):
            level = {x[:i] + x[i + 1 :] for x in level for i in range(len(x))}
            found |= level
        return found

    @staticmethod
    def distance(a: str, b: str, most: int) -> int:
        """Edits with swaps of neighbours (optimal string alignment); ``most`` + 1 if more."""
        if abs(len(a) - len(b)) > most:
            return most + 1
        prev2, prev = None, list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                v = min(prev[j] + 1, row[-1] + 1, prev[j - 1] + (x != y))
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    v = min(v, prev2[j - 2] + 1)
                row.append(v)
            prev2, prev = prev, row
        return min(prev[-1], most + 1)

    @staticmethod
    def shortens(w: str, v: str) -> float:
        """Similarity of ``w`` to the longer ``v`` whose beginning or whose letters in order it is; 0 if it isn't."""
        if len(w) < 2 or len(w) >= len(v) or w[0] != v[0]:
            return 0.0
        if v.startswith(w):
            return SHORT[0] if len(w) > 2 else SHORT[1]
        letters = iter(v)
        if not all(c in letters for c in w):
            return 0.0
        return SHORT[0] if w[-1] == v[-1] else SHORT[1] if len(w) > 2 else 0.0

    def alike(self, w: str) -> list[tuple[str, float]]:
        """Content words that ``w`` may be a misspelling or a short form of, with a similarity up to 1."""
        got = self.cache.get(w)
        if got is None:
            if w in self.holders:
                got = [(w, 1.0)]
            else:
                best = {v: s for v in self.by_letter.get(w[0], ()) if (s := self.shortens(w, v))}
                maybe = set()
                if len(w) <= self.longest + 3:
                    for d in self._deletions(w, 2 if len(w) > 3 else 1):
                        maybe |= self.near.get(d, set())
                for v in maybe:
                    far = self.distance(w, v, 3)
                    same = w[0] == v[0]
                    if far <= 1 or (far == 2 and len(v) > 4 and (len(w) > 4 or same)) or (far == 3 and len(v) > 5 and len(w) > 4 and same):
                        best[v] = max(best.get(v, 0.0), 1 - far / (2 + max(len(w), len(v))))
                if not best and len(w) > 4:  # a short form with a letter too much or wrong
                    for x in self._deletions(w, 1):
                        best.update({v: SHORT[2] for v in self.by_letter.get(x[0], ()) if self.shortens(x, v) == SHORT[0]})
                got = sorted(best.items())
            if len(self.cache) < 500_000:
                self.cache[w] = got
        return got

    @staticmethod
    def _idle(words: list[str]) -> bool:
        return all(w in FILLERS or w in COUNTRY or w in ("united", "states") or not w.isalpha() for w in words)

    def mention(self, words: list[str]) -> object | None:
        """The entry a value mentions: of all names found anywhere in it the longest that don't overlap, then the first that stands
        by itself: nothing but fillers behind it up to the next break, and before it too, or a connective ("of the")."""
        if not self.tokens:
            return None
        text = f" {' '.join(words)} "
        spans = []
        for end, (n, size, ids) in self.automaton.iter(text):
            first = text.count(" ", 0, end - size + 1)  # words before the mention
            spans.append((first, first + n, ids))
        taken: list[tuple] = []
        for a, b, ids in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
            if all(b <= x or a >= y for x, y, _ in taken):
                taken.append((a, b, ids))
        for a, b, ids in sorted(taken):
            left = words[:a][::-1]
            left = left[: left.index("|")] if "|" in left else left
            right = words[b:]
            right = right[: right.index("|")] if "|" in right else right
            lead = next((w for w in left if w not in ("the", "a", "an")), "")
            if len(ids) == 1 and self._idle(right) and (self._idle(left) or lead in CONNECTIVES):
                return next(iter(ids))
        return None

    def similar(self, words: list[str]) -> tuple[float, object] | None:
        """Best entry by token-set similarity, words matched one to one; None below the thresholds or on a tie."""
        words = [x for w in words for x in COUNTRY.get(w, (w,)) if x not in FILLERS and x != "|" and (x.isalpha() or len(x) > 2)]
        if not words:
            return None
        options = [self.alike(w) for w in words]
        hits: dict[object, float] = defaultdict(float)
        for o in options:
            for id_ in {i for v, _ in o for i in self.holders[v]}:
                hits[id_] += 1
        best: list[tuple[float, object]] = []
        for id_, h in hits.items():
            content = self.tokens[id_]
            # "United States" may be put before any name
            spare = [] if "united" in content else [w for w in words if w in ("united", "states")]
            n = len(words) - len(spare)
            if h < COVER * (n + len(content) - h):
                continue
            left, used, score = list(content), set(), 0.0
            for much, i, v in sorted(((s, i, v) for i, o in enumerate(options) for v, s in o if v in left), key=lambda x: (len(options[x[1]]), -x[0], x[1], x[2])):
                if i not in used and v in left:
                    left.remove(v)
                    used.add(i)
                    score += much
            matched = len(used)
            if matched >= COVER * (n + len(content) - matched) and matched:
                cover = matched / (n + len(content) - matched)
                best.append((score / matched * cover, score / matched, id_))
        best.sort(key=lambda x: (-x[0], str(x[2])))
        if not best or best[0][1] < self.threshold or (len(best) > 1 and best[0][0] - best[1][0] < 1e-9):
            return None
        return best[0][0], best[0][2]

    def find(self, value: str) -> tuple[object | None, str]:
        """Entry meant by a value and how it was found: ``exact`` (a mention), ``code``, ``similar`` or ``none``."""
        words = self.read(value)
        parts: list[list[str]] = [[]]
        for w in words:
            parts.append([]) if w == "|" else parts[-1].append(w)
        parts = [p for p in parts if p]
        codes = [self.codes.get(p[0]) if len(p) == 1 and 2 <= len(p[0]) <= 10 else None for p in parts]
        if len(parts) == 1 and codes[0] is not None:
            return codes[0], "code"
        if (hit := self.mention(words)) is not None:
            return hit, "exact"
        tails = [p[i + 2 :] for p in parts for i in range(1, len(p) - 2) if p[i] in CONNECTIVES and p[i + 1] == "the"]
        pairs = [x + y for x, y in zip(parts, parts[1:])] if len(parts) > 2 else []
        for form in [words, *(parts if len(parts) > 1 else []), *pairs, *tails]:
            if (got := self.similar(form)) is not None:
                return got[1], "similar"
        hit = next((c for c in codes if c is not None), None)
        return (hit, "code") if hit is not None else (None, "none")


_compiled: dict[int, Canon] = {}


def map_values(df: DataFrame, value: str, entries: DataFrame, entry_id: str, name: str, aliases: Iterable[str], out: str = "entry_id", threshold: float = 0.72, scratch: Scratch | None = None) -> DataFrame:
    """Add ``out`` (the entry meant, null if none) and ``how`` (``exact`` for a mention, ``code``, ``similar``, ``none``) to every row.

    An automaton over names, aliases and names turned round finds every mention in a value; the longest that don't overlap
    win, and one stands if nothing but fillers is beside it up to the next break, or a connective before it. A word that
    isn't part of the name and follows without a break ("Solar Commission Mirror") makes another name, so no entry. What is left goes
    to token-set similarity: words pair off one to one, misspelt or shortened, ``COVER`` of all words must, at a mean word
    similarity of ``threshold``. Short forms are recognised from the list's own words. An ambiguous value gets none.

    Distinct values are counted and mapped once, in as many tasks as there are shuffle partitions, and joined back, hot
    values apart, so a value that fills a third of the rows costs one lookup. ``entries`` must have at most
    ``MOST_ENTRIES`` rows, which is checked; it is broadcast. Null, empty and blank values get null and ``none``. Columns
    ``out`` and ``how`` of the input are replaced. An empty table or list gives no matches.
    """
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    spark = df.sparkSession
    scratch = scratch or Scratch(spark, "canonical")
    got = entries.select(entry_id, name, *aliases).limit(MOST_ENTRIES + 1).toArrow().to_pylist()
    if len(got) > MOST_ENTRIES:
        raise ValueError(f"more than {MOST_ENTRIES} canonical entries")
    listed = sorted(((r[entry_id], r[name], tuple(r[a] for a in aliases)) for r in got), key=lambda r: str(r[0]))
    sent = spark.sparkContext.broadcast(listed)
    kind = entries.schema[entry_id].dataType
    ids, stamp = to_arrow_type(kind), hash((tuple(listed), threshold))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if stamp not in _compiled:
            _compiled.clear()
            _compiled[stamp] = Canon(sent.value, threshold)
        canon = _compiled[stamp]
        for b in batches:
            results = [canon.find(v) if v.strip() else (None, "none") for v in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r[0] for r in results], ids), pa.array([r[1] for r in results], pa.string())], ["_v", "_n", out, "how"])

    schema = StructType([StructField("_v", StringType()), StructField("_n", LongType()), StructField(out, kind), StructField("how", StringType())])
    base = df.withColumn("_v", F.col(value)).drop(out, "how")
    counted = base.filter(F.col("_v").isNotNull()).groupBy("_v").agg(F.count("*").alias("_n"))
    # a stated number of partitions: adaptive execution would put the few bytes of all values into one task
    mapped = scratch.put(counted.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(find, schema), "mapped")
    total = mapped.agg(F.sum("_n")).first()[0] or 0
    hot = [r[0] for r in mapped.filter(F.col("_n") > max(1, total * HOT_SHARE)).select("_v").collect()]  # < 1 / HOT_SHARE
    return skew_join(base, mapped.drop("_n"), "_v", hot=hot).drop("_v").withColumn("how", F.coalesce("how", F.lit("none")))
