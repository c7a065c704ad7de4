"""One consistent form for texts that look the same but hold different characters.

Arrow string buffers are turned into numpy code-point arrays; lookup tables replace every code point by its
expansion (removing invisible ones), marks are put into canonical order and composed again, all on whole batches.
No string method is called per row.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import HOT_SHARE, fan_join, skew_join

#: Characters that leave no trace on the page, beside the tag characters and variation selectors.
INVISIBLE = "\u00AD\u034F\u061C\u115F\u1160\u17B4\u17B5\u180B\u180C\u180D\u180E\u200B\u200C\u200D\u200E\u200F\u202A\u202B\u202C\u202D\u202E\u2060\u2061\u2062\u2063\u2064\u2065\u2066\u2067\u2068\u2069\u206A\u206B\u206C\u206D\u206E\u206F\u3164\uFEFF\uFFA0"
#: Blanks of other widths.
BLANKS = "\u00A0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200A\u202F\u205F\u3000"
#: Letters and signs that are drawn as the character before them, pair by pair.
LOOKALIKES = {
    "A": "\u0391\u0410\u13AA", "B": "\u0392\u0412\u13F4", "C": "\u0421\u03F9\u13DF", "D": "\u13A0",
    "E": "\u0395\u0415\u13AC", "F": "\u03DC", "G": "\u050C", "H": "\u0397\u041D\u13BB", "I": "\u0399\u0406\u04C0",
    "J": "\u0408\u037F", "K": "\u039A\u041A\u13E6", "L": "\u13DE", "M": "\u039C\u041C\u13B7\u03FA", "N": "\u039D",
    "O": "\u039F\u041E\u0555", "P": "\u03A1\u0420\u13E2", "Q": "\u051A", "S": "\u0405\u054F",
    "T": "\u03A4\u0422\u13A2", "U": "\u054D", "V": "\u0474", "W": "\u051C", "X": "\u03A7\u0425",
    "Y": "\u03A5\u04AE\u0423", "Z": "\u0396\u13C3", "a": "\u0430", "c": "\u0441\u03F2", "d": "\u0501", "e": "\u0435",
    "g": "\u0261", "h": "\u04BB", "i": "\u0456", "j": "\u0458\u03F3", "o": "\u043E\u03BF\u0585", "p": "\u0440\u03C1",
    "q": "\u051B", "s": "\u0455", "u": "\u03C5\u057D", "v": "\u03BD\u0475", "w": "\u051D", "x": "\u0445",
    "y": "\u0443\u04AF", "-": "\u2010\u2011",
}
#: Compatibility forms are folded in these blocks only: ligatures, digraphs and Roman numerals. Superscripts,
#: fractions, circled and styled letters look different and stay.
FOLDED_BLOCKS = ((0xFB00, 0xFB06), (0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F))
SIZE = 0x110000
BLOCK = 1 << 20


def _expansion(cp: int, same: dict[str, str]) -> str:
    c = chr(cp)
    if c in same:
        return same[c]
    d = unicodedata.decomposition(c)
    if not d and not 0xAC00 <= cp <= 0xD7A3:
        return c
    if d.startswith("<"):
        tag, _, rest = d.partition("> ")
        if tag not in ("<wide", "<narrow", "<noBreak") and not any(a <= cp <= b for a, b in FOLDED_BLOCKS):
            return c
        parts = [chr(int(x, 16)) for x in rest.split()]
    else:
        parts = list(unicodedata.normalize("NFD", c))
        if parts == [c]:
            return c
    return "".join(_expansion(ord(x), same) for x in parts)


class Tables:
    """length and start of each code point's expansion in ``out``; combining classes; composed pairs."""

    def __init__(self) -> None:
        same = {x: "" for x in INVISIBLE} | {x: " " for x in BLANKS}
        same |= {chr(x): "" for a, b in ((0xFE00, 0xFE0F), (0xE0000, 0xE007F), (0xE0100, 0xE01EF)) for x in range(a, b + 1)}
        same |= {x: to for to, froms in LOOKALIKES.items() for x in froms}
        self.length = np.ones(SIZE, np.uint8)
        self.start = np.arange(SIZE, dtype=np.int32)
        extra: list[int] = []
        ccc: dict[int, int] = {}
        pairs: dict[int, int] = {}
        for cp in range(SIZE):
            if 0x4E00 <= cp <= 0x9FFF or 0xD800 <= cp <= 0xDFFF or 0x30000 <= cp <= 0xDFFFF or cp >= 0xF0000:
                continue
            c = chr(cp)
            if (k := unicodedata.combining(c)) > 0:
                ccc[cp] = k
            d = unicodedata.decomposition(c)
            if d and not d.startswith("<") and " " in d and unicodedata.normalize("NFC", c) == c:
                a, b = (int(x, 16) for x in d.split())
                pairs[(a << 21) | b] = cp
            if (e := _expansion(cp, same)) != c:
                self.length[cp] = len(e)
                self.start[cp] = SIZE + len(extra)
                extra += map(ord, e)
        self.out = np.concatenate([np.arange(SIZE, dtype=np.uint32), np.array(extra, np.uint32)])
        self.ccc = np.zeros(SIZE, np.uint8)
        self.ccc[list(ccc)] = list(ccc.values())
        keys = np.array(sorted(pairs), np.int64)
        self.pair_keys, self.pair_to = keys, np.array([pairs[k] for k in keys.tolist()], np.uint32)
        self.changed = self.length != 1
        self.changed |= self.start != np.arange(SIZE)


_tables: list[Tables] = []


def tables() -> Tables:
    """Built once per process."""
    if not _tables:
        _tables.append(Tables())
    return _tables[0]


def canonical_points(cps: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all rows and each row's first index (with the end as last entry) → the same, in canonical form."""
    t = tables()
    if not len(cps):
        return cps, starts
    n = t.length[cps].astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(n)])
    starts = ends[starts]
    if t.changed[cps].any():
        at = np.repeat(t.start[cps].astype(np.int64) - ends[:-1], n) + np.arange(ends[-1])
        cps = t.out[at]
    if not len(cps):
        return cps, starts
    ccc = t.ccc[cps]
    if not ccc.any():
        return cps, starts
    head = np.zeros(len(cps) + 1, bool)
    head[starts] = True
    # canonical order: within each run of marks, stable by combining class
    wrong = (ccc[1:] > 0) & (ccc[:-1] > ccc[1:]) & ~head[1:-1]
    if wrong.any():
        run = np.cumsum((ccc == 0) | head[:-1])
        order = np.lexsort((ccc, run))
        cps, ccc = cps[order], ccc[order]
    # composition: the first mark of a run that makes a letter with its base joins it, if no mark of its own class
    # stands between; again until no pair is left
    row = np.cumsum(head[:-1])
    while len(t.pair_keys):
        base = np.maximum.accumulate(np.where(ccc == 0, np.arange(len(cps)), -1))
        marks = np.flatnonzero(ccc[1:] > 0) + 1
        marks = marks[(base[marks] >= 0) & ((ccc[marks - 1] == 0) | (ccc[marks - 1] < ccc[marks]))]
        marks = marks[row[marks] == row[base[marks]]]
        keys = (cps[base[marks]].astype(np.int64) << 21) | cps[marks].astype(np.int64)
        hit = np.minimum(np.searchsorted(t.pair_keys, keys), len(t.pair_keys) - 1)
        ok = np.flatnonzero(t.pair_keys[hit] == keys)
        if not len(ok):
            break
        ok = ok[np.unique(base[marks[ok]], return_index=True)[1]]
        cps = cps.copy()
        cps[base[marks[ok]]] = t.pair_to[hit[ok]]
        keep = np.ones(len(cps), bool)
        keep[marks[ok]] = False
        moved = np.concatenate([[0], np.cumsum(keep)])
        starts = moved[starts]
        cps, ccc, row = cps[keep], ccc[keep], row[keep]
    return cps, starts


def canonical_array(texts: pa.Array) -> pa.Array:
    """Canonical form of an Arrow string array; nulls stay null, empty stays empty.

    Rows are taken in blocks of about ``BLOCK`` bytes, so memory follows the longest text, not the batch.
    """
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff((offsets - offsets[0]) // BLOCK)), [len(texts)]]))
    return pa.concat_arrays([_block(texts.slice(a, b - a)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())])


def _block(texts: pa.Array) -> pa.Array:
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    cps = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    lead = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    cps, starts = canonical_points(cps, lead[offsets - offsets[0]])
    width = 1 + (cps > 0x7F).astype(np.int64) + (cps > 0x7FF) + (cps > 0xFFFF)
    at = np.concatenate([[0], np.cumsum(width)])[starts]
    body = cps.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    valid = None if not texts.null_count else pa.array(texts.is_valid()).buffers()[1]
    return pa.Array.from_buffers(pa.large_string(), len(texts), [valid, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(body)])


def canonicalize(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """Add ``out``: one form for all texts that look like ``text``.

    Full-width forms, ligatures, combining sequences, blanks of any width, invisible characters and look-alike
    letters of other scripts are unified; wording, case, accents, digits, punctuation and line breaks stay. Null gives
    null; empty, or only invisible characters, gives empty. Other columns pass through; an existing ``out`` is replaced.
    """
    df = df.drop(out) if out in df.columns and out != text else df
    names = df.columns
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.StringType())]) if out != text else df.schema
    i = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns, form = b.columns, canonical_array(b.column(i)).cast(pa.string())
            if out == text:
                columns[i] = form
                yield pa.RecordBatch.from_arrays(columns, names)
            else:
                yield pa.RecordBatch.from_arrays([*columns, form], [*names, out])

    return df.mapInArrow(run, schema)


def alike_forms(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, form, variant``: digests of the canonical form and of the exact text. Null texts are left out.

    Texts travel as 128-bit digests only, so no shuffle moves whole texts.
    """
    d = canonicalize(df.filter(F.col(text).isNotNull()).select(F.col(key), F.col(text).alias("_t")), "_t", "_c")
    return d.select(key, F.md5("_c").alias("form"), F.md5("_t").alias("variant"))


def alike_pairs(df: DataFrame, scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pairs of keys (smaller first) whose texts look the same and differ in some character.

    Works on groups of exact copies first: only groups with two or more variants survive, pairs are formed between
    variants and expanded to members last, so equal copies are never compared with each other.
    """
    forms = scratch.put(alike_forms(df, key, text), "forms")
    variants = scratch.put(forms.groupBy("form", "variant").agg(F.count("*").alias("n")), "variants")
    total = variants.agg(F.sum("n")).first()[0] or 0
    sizes = variants.groupBy("form").agg(F.count("*").alias("v"), F.sum("n").alias("n"))
    hot = lambda d, c: [r[0] for r in d.filter(F.col("n") > max(1, total * HOT_SHARE)).select(c).collect()]  # noqa: E731  at most 1 / HOT_SHARE
    many = sizes.filter("v > 1").select("form")
    kept = scratch.put(skew_join(forms, many, "form", "left_semi", hot(sizes, "form")), "kept")
    some = variants.join(many, "form", "left_semi")
    a, b = some.select("form", F.col("variant").alias("va")), some.select("form", F.col("variant").alias("vb"))
    kinds = variants.count()
    wide = [r["form"] for r in sizes.filter(F.col("v") > max(1, kinds * HOT_SHARE)).select("form").collect()]  # forms with very many variants
    pairs = fan_join(a, b, "form", wide).filter("va < vb").select("va", "vb")
    x = kept.select(F.col("variant").alias("va"), F.col(key).alias("_x"))
    y = kept.select(F.col("variant").alias("vb"), F.col(key).alias("_y"))
    often = hot(variants, "variant")
    both = fan_join(fan_join(pairs, x, "va", often), y, "vb", often)
    return both.select(F.least("_x", "_y").alias(f"{key}_a"), F.greatest("_x", "_y").alias(f"{key}_b"))


def alike_groups(df: DataFrame, scratch, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per text: ``key, group_id`` (smallest key that looks the same), ``members`` (texts that look the same, itself included)
    and ``variants`` (different character sequences among them). Null texts are left out; no pairs are formed."""
    forms = scratch.put(alike_forms(df, key, text), "forms")
    variants = forms.groupBy("form", "variant").agg(F.count("*").alias("n"), F.min(key).alias("k"))
    groups = scratch.put(variants.groupBy("form").agg(F.min("k").alias("group_id"), F.sum("n").alias("members"), F.count("*").alias("variants")), "groups")
    total = groups.agg(F.sum("members")).first()[0] or 0
    hot = [r["form"] for r in groups.filter(F.col("members") > max(1, total * HOT_SHARE)).select("form").collect()]
    return skew_join(forms.select(key, "form"), groups, "form", "inner", hot).select(key, "group_id", "members", "variants")
