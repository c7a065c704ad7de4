"""Several values packed in one field: EM segmentation over the whole column, Viterbi lattices per field.

A field is cut into tokens and gaps. Quoted spans and balanced brackets with blanks inside are single tokens. A value
is known by its shape: words stay, anything with a digit is ``#``, single capitals and Roman numerals are ``@``, a
quoted span is ``"``. Hard delimiters always end a value; commas, slashes, "and", line breaks and blanks may or may
not. Expectation-maximisation over all fields learns how often each shape is a value and how often each kind of gap
ends one; the most probable path through the lattice gives the split.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Scratch

#: Most shapes in the broadcast model: those with more than 1 / SHAPES of all expected values, so never more.
SHAPES = 20_000
#: Log-probability of an unlearnt value, besides one less for each token.
RARE = -25.0
#: Most rounds of EM, and what counts as settled.
ROUNDS, SETTLED = 20, 0.002
#: Longest piece of text whose class is kept for the next time it is met.
SHORT = 64
HARD = ";；|•·¦"
SOFT = ",，、/&"
_QUOTED = r"\"(?:[^\"]|\"\")*\"|“[^”]*”|„[^“”]*[“”]|«[^»]*»"
_BRACKET = r"\((?:[^()]|\([^()]*\))*\)"
_GAP = rf"(?:[\s{HARD}{SOFT}]+(?:(?:and|or)(?=[\s\"“(])[\s{HARD}{SOFT}]*)?)"
_NUMBERED = re.compile(r"\D*\d.*", re.S)
_ROMAN = re.compile(r"(?:[IVXLC]+|[A-Za-z])[.)]?")
_TOKEN = re.compile(rf"(?P<quote>{_QUOTED})|(?P<bracket>{_BRACKET})|(?P<gap>{_GAP})|(?P<text>[^\s{HARD}{SOFT}\"“„«(]+|.)", re.S)


@dataclass
class Field:
    """Tokens (start, end, shape) and, between neighbours, gap classes."""

    tokens: list[tuple[int, int, str]]
    gaps: list[str]


def _gap_class(text: str) -> str:
    return _short_gap(text) if len(text) <= SHORT else _short_gap.__wrapped__(text)


@lru_cache(1 << 14)
def _short_gap(text: str) -> str:
    marks = "".join(sorted({"," if c in ",，、" else ";" if c in ";；" else c for c in text if c in HARD + SOFT}))
    word = "+" if re.search(r"\b(?:and|or)\b", text) else ""
    if marks or word:
        return marks + word
    return "nl" if re.search(r"[\n\t\r]", text) else "sp" if text else "none"


def _shape(token: str, kind: str) -> str:
    if kind == "quote":
        return '"'
    if kind == "bracket":
        inner = _GAPS.sub(" ", token)
        return " ".join("#" if re.search(r"\d", w) else w.casefold() for w in inner.split())
    return _word(token) if len(token) <= SHORT else _word.__wrapped__(token)


@lru_cache(1 << 16)
def _word(token: str) -> str:
    if _NUMBERED.fullmatch(token):
        return "#"
    return "@" if _ROMAN.fullmatch(token) else token.casefold()


_GAPS = re.compile(r"\s+")


def read_field(text: str) -> Field:
    """Tokens and gaps of one field; leading and trailing gaps are dropped."""
    tokens, gaps, start, gap_from = [], [], None, 0

    def close(end: int) -> None:
        nonlocal start
        if start is not None:
            add(start, end, "text")
            start = None

    def add(a: int, b: int, kind: str) -> None:
        nonlocal gap_from
        if tokens:
            gaps.append(_gap_class(text[gap_from:a]))
        tokens.append((a, b, _shape(text[a:b], kind)))
        gap_from = b

    for m in _TOKEN.finditer(text):
        kind, a, b = m.lastgroup, m.start(), m.end()
        if kind == "gap":
            close(a)
        elif kind == "quote" and start is None or kind == "bracket" and re.search(r"\s", m.group()):
            close(a)
            add(a, b, kind)
        elif start is None:
            start = a
    close(len(text))
    return Field(tokens, gaps)


def chunks(field: Field) -> Iterator[tuple[int, list[str], list[str]]]:
    """Runs between hard delimiters: index of the first token, shapes, gaps."""
    a = 0
    for i in range(len(field.tokens)):
        if i == len(field.gaps) or any(c in HARD for c in field.gaps[i]):
            yield a, [t[2] for t in field.tokens[a : i + 1]], field.gaps[a:i]
            a = i + 1


def usual(gap: str) -> float:
    """How often a class of gap ends a value before anything is learnt."""
    return 0.02 if gap in ("sp", "none") else 0.5


class Model:
    """Log-probabilities of shapes and of gap classes ending a value."""

    def __init__(self, shapes: dict[str, float], gaps: dict[str, float]):
        total = sum(shapes.values()) or 1.0
        self.value = {s: math.log(n / total) for s, n in shapes.items() if n > 0}
        self.gaps = gaps
        self._sorted: list[str] = []

    def cut(self, gap: str, after: str) -> tuple[float, float]:
        """Log-probability that a gap before the token ``after`` ends a value, and that it doesn't."""
        p = self.gaps.get(f"{gap}\x1d{after}", self.gaps.get(gap, usual(gap)))
        p = min(max(p, 1e-4), 1 - 1e-4)
        return math.log(p), math.log(1 - p)

    def of(self, shape: str, tokens: int) -> float:
        """Log-probability of a value; unlearnt ones are rarer the longer they are."""
        return self.value.get(shape, RARE - tokens)

    def learnt(self, shapes: list[str], gaps: list[str]) -> Iterator[tuple[int, int, str]]:
        """All values of a learnt shape (first token, end token, shape), as far as learnt shapes go."""
        if len(self._sorted) != len(self.value):
            self._sorted = sorted(self.value)
        for i in range(len(shapes)):
            shape = shapes[i]
            for j in range(i + 1, len(shapes) + 1):
                if shape in self.value:
                    yield i, j, shape
                at = bisect_right(self._sorted, shape)  # a longer learnt shape that begins like this comes next
                if j == len(shapes) or at == len(self._sorted) or not self._sorted[at].startswith(shape):
                    break
                shape += _joint(gaps[j - 1]) + shapes[j]

    def lattice(self, shapes: list[str], gaps: list[str]) -> tuple[list, list[float], list[float]]:
        """Every run of tokens may be a value, of whatever length: the learnt ones (first token, end token, shape,
        log-probability with inner gaps and the gap that ends it), and for the unlearnt from i to j the two parts of
        theirs, ``start[i] + end[j]``, so that they needn't be listed."""
        n = len(shapes)
        cuts = [self.cut(g, s) for g, s in zip(gaps, shapes[1:])]
        whole = [0.0]
        for c in cuts:
            whole.append(whole[-1] + c[1])
        last = [c[0] for c in cuts] + [0.0]
        arcs = [(i, j, s, self.value[s] + whole[j - 1] - whole[i] + last[j - 1]) for i, j, s in self.learnt(shapes, gaps)]
        return arcs, [RARE + i - whole[i] for i in range(n)], [0.0] + [whole[j - 1] + last[j - 1] - j for j in range(1, n + 1)]

    def arcs(self, shapes: list[str], gaps: list[str]) -> list[tuple[int, int, str, float]]:
        """The whole lattice as a list."""
        arcs, start, end = self.lattice(shapes, gaps)
        of = {(i, j): (s, p) for i, j, s, p in arcs}
        spans = [(i, j) for i in range(len(shapes)) for j in range(i + 1, len(shapes) + 1)]
        return [(i, j, *(of.get((i, j)) or (_together(shapes[i:j], gaps[i : j - 1]), start[i] + end[j]))) for i, j in spans]

    def best(self, shapes: list[str], gaps: list[str]) -> list[int]:
        """End token of each value on the most probable path (Viterbi); on a tie, the longer value."""
        n = len(shapes)
        arcs, start, end = self.lattice(shapes, gaps)
        into: dict[int, list[tuple[int, float]]] = defaultdict(list)
        for i, j, _, p in arcs:
            into[j].append((i, p))
        score, back, top, first = [0.0] + [-math.inf] * n, [0] * (n + 1), -math.inf, 0
        for j in range(1, n + 1):
            if score[j - 1] + start[j - 1] > top + 1e-12:
                top, first = score[j - 1] + start[j - 1], j - 1
            for i, p in sorted([(first, top + end[j]), *((i, score[i] + p) for i, p in into[j])]):
                if p > score[j] + 1e-12:
                    score[j], back[j] = p, i
        ends = []
        while n:
            ends.append(n)
            n = back[n]
        return ends[::-1]

    def expect(self, shapes: list[str], gaps: list[str], weight: float, values: dict, cuts: dict) -> None:
        """Add a chunk's expected values and gap decisions (forward-backward)."""
        n = len(shapes)
        arcs, start, end = self.lattice(shapes, gaps)
        into: dict[int, list] = defaultdict(list)
        out: dict[int, list] = defaultdict(list)
        for i, j, _, p in arcs:
            into[j].append((i, p))
            out[i].append((j, p))

        def plus(a: float, b: float) -> float:
            hi, lo = (a, b) if a > b else (b, a)
            return hi if lo == -math.inf else hi + math.log1p(math.exp(lo - hi))

        fwd, bwd = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        run = -math.inf
        for j in range(1, n + 1):
            run = plus(run, fwd[j - 1] + start[j - 1])
            fwd[j] = run + end[j]
            for i, p in into[j]:
                fwd[j] = plus(fwd[j], fwd[i] + p)
        run = -math.inf
        for i in range(n - 1, -1, -1):
            run = plus(run, end[i + 1] + bwd[i + 1])
            bwd[i] = run + start[i]
            for j, p in out[i]:
                bwd[i] = plus(bwd[i], bwd[j] + p)
        ended = [0.0] * n
        known = set()
        for i, j, s, p in arcs:
            known.add((i, j))
            e = math.exp(min(0.0, fwd[i] + p + bwd[j] - fwd[n]))
            if e > 1e-6:
                values[s] += weight * e
                ended[j - 1] += e
        least, most = math.log(1e-6) + fwd[n], [-math.inf] * (n + 1)
        for j in range(n, 0, -1):
            most[j - 1] = max(most[j], end[j] + bwd[j])
        for i in range(n):
            a = fwd[i] + start[i]
            if a + most[i] <= least:
                continue
            for j in range(i + 1, n + 1):
                if a + most[j - 1] <= least:
                    break
                if a + end[j] + bwd[j] > least and (i, j) not in known:
                    e = math.exp(min(0.0, a + end[j] + bwd[j] - fwd[n]))
                    values[_together(shapes[i:j], gaps[i : j - 1])] += weight * e
                    ended[j - 1] += e
        for g, s, e in zip(gaps, shapes[1:], ended):
            cuts[f"{g}\x1d{s}", True] += weight * e
            cuts[f"{g}\x1d{s}", False] += weight * (1 - e)


def _joint(gap: str) -> str:
    return " " if gap in ("nl", "sp", "none") else f"{gap} "


def _together(shapes: list[str], gaps: list[str]) -> str:
    """Shape of a value of several tokens."""
    return shapes[0] + "".join(_joint(g) + s for g, s in zip(gaps, shapes[1:]))


def _encode(shapes: list[str], gaps: list[str]) -> str:
    return "\x1e".join(["\x1f".join(shapes), "\x1f".join(gaps)])


def _decode(code: str) -> tuple[list[str], list[str]]:
    a, b = code.split("\x1e")
    shapes = a.split("\x1f")
    return shapes, b.split("\x1f") if len(shapes) > 1 else []


def tokenized(df: DataFrame, keys: list[str], column: str, scratch: Scratch) -> DataFrame:
    """``keys, _field, _codes, _spans`` of all fields that aren't blank: per chunk its shapes and gaps as one string, and where all
    tokens start and end. Written, so learning and splitting read the tokens once made."""
    base = df.select(*keys, F.col(column).alias("_field")).filter(F.length(F.trim(F.col("_field"))) > 0)
    schema = T.StructType([*base.schema.fields, T.StructField("_codes", T.ArrayType(T.StringType())), T.StructField("_spans", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, spans = [], []
            for text in b.column(len(keys)).to_pylist():
                field = read_field(text)
                codes.append([_encode(shapes, gaps) for _, shapes, gaps in chunks(field)])
                spans.append([x for t in field.tokens for x in t[:2]])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(codes, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32()))], [*b.schema.names, "_codes", "_spans"])

    return scratch.put(base.mapInArrow(run, schema), "fields")


def learn(df: DataFrame, column: str, scratch: Scratch) -> Model:
    """EM over the whole column, see ``learn_chunks``."""
    return learn_chunks(tokenized(df, [], column, scratch), scratch)


def learn_chunks(fields: DataFrame, scratch: Scratch) -> Model:
    """EM over the whole column. Fields are reduced to distinct chunks with counts first; each round then runs over
    those, and only shapes above 1 / SHAPES of all values come back. It ends when no class of gaps ends values more or less
    often by ``SETTLED`` and no shape comes or goes, or after ``ROUNDS``."""
    spark = fields.sparkSession
    counts = fields.select(F.explode("_codes").alias("chunk")).groupBy("chunk").agg(F.count("*").alias("n"))
    # few bytes but much work: as many files as tasks, or every round would run in one
    seen = scratch.put(counts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))), "chunks")
    model: Model | None = None
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(None if model is None else (model.value, model.gaps))

        def step(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = None
            if sent.value is not None:
                m = Model({}, sent.value[1])
                m.value = sent.value[0]
            for b in batches:
                values: dict[str, float] = defaultdict(float)
                cuts: dict[tuple, float] = defaultdict(float)
                for code, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    shapes, gaps = _decode(code)
                    if m is None:  # at first every chunk is one value
                        values[_together(shapes, gaps)] += n
                    else:
                        m.expect(shapes, gaps, n, values, cuts)
                rows = [("v" + k, v) for k, v in values.items()] + [(("y" if on else "n") + g, v) for (g, on), v in cuts.items()]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], ["k", "e"])

        counts = scratch.put(seen.mapInArrow(step, "k string, e double").groupBy("k").agg(F.sum("e").alias("e")), "counts")
        total = counts.filter(F.col("k").startswith("v")).agg(F.sum("e")).first()[0] or 1.0
        # fewer than SHAPES shapes pass, and as many gap contexts; those of a single gap class also count together.
        # A shape of several tokens must be seen a few times, else chance meetings of two values pass for one.
        long = F.col("k").rlike(r"[ (]")
        enough = F.col("k").startswith("v") & (F.col("e") > total / SHAPES) & (F.col("e") > F.when(long, 2.5).otherwise(0.5))
        gap = ~F.col("k").startswith("v")
        every = counts.filter(gap).agg(F.sum("e")).first()[0] or 1.0
        kept = counts.filter(enough | (gap & (F.col("e") > every / SHAPES))).collect()
        classes = counts.filter(gap).groupBy(F.substring_index("k", "\x1d", 1).alias("k")).agg(F.sum("e").alias("e")).collect()
        ends: dict[str, float] = {}
        yes, no = ({r["k"][1:]: r["e"] for r in [*classes, *kept] if r["k"][0] == c} for c in "yn")
        for g in sorted({*yes, *no}, key=lambda g: "\x1d" in g):
            cls = g.split("\x1d")[0]
            ends[g] = (yes.get(g, 0.0) + 4 * ends.get(cls, usual(cls))) / (yes.get(g, 0.0) + no.get(g, 0.0) + 4)
        before, model = model, Model({r["k"][1:]: r["e"] for r in kept if r["k"][0] == "v"}, ends)
        scratch.drop(counts)
        if before is not None and before.value.keys() == model.value.keys() and all(abs(p - before.gaps.get(g, -1.0)) < SETTLED for g, p in ends.items() if "\x1d" not in g):
            break
    scratch.drop(seen)
    return model


def as_written(text: str) -> str:
    """A value without quotes around the whole, doubled quotes inside made single, blanks squeezed."""
    text = text.strip()
    if text[:1] == '"' and re.fullmatch(r'"(?:[^"]|"")*"', text):
        text = text[1:-1].replace('""', '"')
    elif len(text) > 1 and (text[0], text[-1]) in (("“", "”"), ("„", "“"), ("„", "”"), ("«", "»")):
        text = text[1:-1]
    return _GAPS.sub(" ", text).strip()


def _cut(text: str, codes: list[str], spans: list[int], model: Model, cache: dict) -> list[str]:
    """Values of a field from its chunks and the starts and ends of its tokens."""
    out, at = [], 0
    for code in codes:
        ends = cache.get(code)
        if ends is None:
            shapes, gaps = _decode(code)
            ends = [1] if len(shapes) == 1 else model.best(shapes, gaps)
            if len(cache) < 200_000:
                cache[code] = ends
        a = 0
        for e in ends:
            out.append(as_written(text[spans[2 * (at + a)] : spans[2 * (at + e) - 1]]))
            a = e
        at += a
    return [x for x in out if x]


def split_field(text: str, model: Model, cache: dict) -> list[str]:
    """Values of one field in order."""
    field = read_field(text)
    return _cut(text, [_encode(s, g) for _, s, g in chunks(field)], [x for t in field.tokens for x in t[:2]], model, cache)


def split_values(df: DataFrame, keys: list[str], column: str, scratch: Scratch, position: str = "item_no", value: str = "value", model: Model | None = None) -> DataFrame:
    """``keys``, ``position`` (from 1) and ``value``: one row per value packed in ``column``, repeats counted again.

    Null, empty and blank fields give no row. A field without delimiter is one value. An unclosed quote or bracket is
    plain text. Without ``model`` one is learnt from the whole column.
    """
    fields = tokenized(df, keys, column, scratch)
    model = model or learn_chunks(fields, scratch)
    sent = df.sparkSession.sparkContext.broadcast((model.value, model.gaps))
    schema = df.select(*keys).schema.add(position, "integer").add(value, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model({}, sent.value[1])
        m.value = sent.value[0]
        cache: dict = {}
        for b in batches:
            rows, places, values = [], [], []
            for i, (text, codes, spans) in enumerate(zip(*(b.column(len(keys) + k).to_pylist() for k in range(3)))):
                found = _cut(text, codes, spans, m, cache)
                rows += [i] * len(found)
                places += range(1, len(found) + 1)
                values += found
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(j).take(at) for j in range(len(keys))), pa.array(places, pa.int32()), pa.array(values, pa.string())], [*keys, position, value])

    return fields.mapInArrow(run, schema)
