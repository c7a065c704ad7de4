"""Text sizes in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

#: Place of the vocabulary files; the driver's box has them here. Any other folder can be given.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's authors cut text before merging bytes.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Longer texts are encoded in parts, cut before a blank that follows a non-blank, where the pattern never joins.
PART = 1 << 16
_encoders: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The encoder of a ``.tiktoken`` rank file, one per process."""
    if path not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line)}
        _encoders[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def parts(text: str) -> list[str]:
    """``text`` in parts of about ``PART`` characters whose token counts add up to that of the whole."""
    if len(text) <= PART:
        return [text]
    out, at = [], 0
    for m in re.finditer(r"(?<=\S) (?=\S)", text):
        if m.start() - at >= PART:
            out.append(text[at : m.start()])
            at = m.start()
    return [*out, text[at:]]


def with_token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", path: str = VOCABULARY) -> DataFrame:
    """Replace ``text`` by its size in tokens. Null and empty texts have size 0. An input column ``out`` is replaced."""
    df = df.drop(out) if out != text else df
    names = [c for c in df.columns if c != text]
    schema = df.select(*names).schema.add(out, "long")
    i = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            sizes = []
            for lo in range(0, len(b), 512):
                some = b.column(i).slice(lo, 512).to_pylist()
                sizes += [sum(len(enc.encode_ordinary(p)) for p in parts(t)) if t else 0 for t in some]
            yield pa.RecordBatch.from_arrays([*(b.column(j) for j in range(len(b.columns)) if j != i), pa.array(sizes, pa.int64())], [*names, out])

    return df.mapInArrow(run, schema)
