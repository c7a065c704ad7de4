"""Outside functions as pluggable operators: judges, prompts, embeddings, and the guards around them."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Judge = Callable[[str], dict | None]
#: Judges by name. A judge takes a prompt and returns {"verdict", "reasoning"}, None for no answer; it may raise.
REGISTRY: dict[str, Judge] = {}
VERDICT = "verdict string, reasoning string, error string, latency_ms long"


def stub(prompt: str) -> dict:
    """A judge for tests: the verdict follows from the prompt's MD5."""
    n = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16) % 3
    return {"verdict": ("same", "different", "unclear")[n], "reasoning": "stub"}


REGISTRY["stub"] = stub


def stub_pick(prompt: str) -> dict:
    """A matcher for tests: which of the options listed behind "Candidates:" it picks, or none, follows from the prompt's MD5."""
    ids = [line.split(": ", 1)[0] for line in prompt.partition("\nCandidates:\n")[2].split("\n") if line]
    n = int(hashlib.md5(prompt.encode()).hexdigest()[:8], 16) % (len(ids) + 1)
    return {"picked": ids[n] if n < len(ids) else "none", "alternates": ids[:n], "reasoning": "stub"}


REGISTRY["stub_pick"] = stub_pick


def ask(judge: Judge, prompt: str, tries: int = 3, pause: float = 0.0) -> tuple:
    """One verdict with retries; a failure leaves the verdict null, which means "try again", never "no"."""
    began, error = time.monotonic(), None
    for attempt in range(tries):
        try:
            out = judge(prompt)
            if out is not None and out.get("verdict") is not None:
                return out["verdict"], out.get("reasoning"), None, int((time.monotonic() - began) * 1000)
            error = "no verdict"
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:500]
        if attempt + 1 < tries and pause:
            time.sleep(pause * 2**attempt)
    return None, None, error, int((time.monotonic() - began) * 1000)


def judge(df: DataFrame, prompt: str, name: str | Judge, workers: int = 8, tries: int = 3) -> DataFrame:
    """Every row with ``VERDICT`` columns; calls of a batch overlap in threads. Null prompts get a null verdict."""
    f = REGISTRY[name] if isinstance(name, str) else name
    added = [c.split()[0] for c in VERDICT.split(", ")]
    base = df.drop(*added)
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in base.schema), VERDICT])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                got = list(pool.map(lambda p: ask(f, p, tries) if p is not None else (None, None, "no prompt", 0), pdf[prompt]))
                yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(got, columns=added)], axis=1)

    return base.mapInPandas(run, schema)


def prompt(*parts: tuple[str, Column], most: int = 6000) -> Column:
    """Labelled lines, empty ones left out, each cut at ``most`` characters."""
    return F.array_join(F.array_compact(F.array(*[F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.left(F.trim(c), F.lit(most)))) for label, c in parts])), "\n")


def with_options(head: Column, options: Column, most: int = 200) -> Column:
    """A prompt that lists ``options`` (array of ``id, text``) behind ``head``, one a line, blanks squeezed, texts cut at ``most``
    characters; null options are none."""
    flat = lambda t: F.left(F.trim(F.regexp_replace(F.coalesce(t, F.lit("")), "[ \t\n\r]+", " ")), F.lit(most))
    lines = F.transform(options, lambda o: F.concat(o["id"], F.lit(": "), flat(o["text"])))
    return F.concat(head, F.lit("\nCandidates:\n"), F.coalesce(F.array_join(lines, "\n"), F.lit("")))


PICK = "picked string, alternates array<string>, reasoning string, error string"


def pick(df: DataFrame, prompt: str, options: str, name: str | Judge, unknown: str = "error", workers: int = 8, tries: int = 3) -> DataFrame:
    """Every row with ``PICK`` columns: which of its ``options`` (array of ids) a judge picks.

    A judge returns {"picked", "alternates", "reasoning"}; ``picked`` is an id or "none". Alternates that aren't among the options are
    dropped, as is the pick. A pick that isn't among them is, by ``unknown``, an ``error`` (picked null: the row is tried again by a later
    run) or quietly ``none``. Rows with null or empty options are "none" without a call; null prompts are an error.
    """
    if unknown not in ("error", "none"):
        raise ValueError(f"unknown={unknown!r}")
    f = REGISTRY[name] if isinstance(name, str) else name
    added = [c.split()[0] for c in PICK.split(", ")]
    base = df.drop(*added)
    schema = ", ".join([*(f"`{x.name}` {x.dataType.simpleString()}" for x in base.schema), PICK])

    def one(text: str | None, ids) -> tuple:
        known = list(ids) if ids is not None else []
        if not known:
            return "none", [], "no options", None
        if text is None:
            return None, [], None, "no prompt"
        error = None
        for _ in range(tries):
            try:
                out = f(text) or {}
                got = out.get("picked")
                if got in known or got == "none":
                    return got, [a for a in out.get("alternates") or [] if a in known and a != got], out.get("reasoning"), None
                if got is not None and unknown == "none":
                    return "none", [], out.get("reasoning"), None
                error = "no pick" if got is None else f"unknown id {got}"
            except Exception as e:
                error = f"{type(e).__name__}: {e}"[:500]
        return None, [], None, error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(workers) as pool:
            for pdf in batches:
                got = list(pool.map(one, pdf[prompt], pdf[options]))
                yield pd.concat([pdf.reset_index(drop=True), pd.DataFrame(got, columns=added)], axis=1)

    return base.mapInPandas(run, schema)


def checked(judge: Judge, schema: dict[str, tuple[str, ...] | type], label: str) -> Judge:
    """A judge whose answers are held to ``schema``: every field must be there, one of the allowed values or of the type; ``label`` is the
    field taken as verdict. Other answers raise, so they are asked for again and never taken for a "no"."""

    def f(text: str) -> dict | None:
        out = judge(text)
        if out is None:
            return None
        for field, wanted in schema.items():
            ok = out.get(field) in wanted if isinstance(wanted, tuple) else isinstance(out.get(field), wanted)
            if not ok:
                raise ValueError(f"field {field}: {out.get(field)!r}")
        return {**out, "verdict": out[label]}

    return f


class Endpoints:
    """Models by name with the characters of text each can read; ``judge(name)`` cuts prompts to that, keeping their beginning."""

    def __init__(self) -> None:
        self.table: dict[str, tuple[Judge, int]] = {}

    def add(self, name: str, call: Judge, budget: int, probe: str | None = None) -> None:
        """``probe`` is asked once, so that a dead endpoint is found before a pass and not row by row."""
        if probe is not None and call(probe) is None:
            raise ConnectionError(f"{name} doesn't answer")
        self.table[name] = (call, budget)

    def judge(self, name: str) -> Judge:
        call, budget = self.table[name]
        return lambda text: call(text[:budget])


def guard_unparsed(df: DataFrame, verdict: str, most: float = 0.02) -> DataFrame:
    """The rows unchanged, or an error when more than ``most`` of them have no verdict. An empty table passes."""
    n, bad = df.agg(F.count("*"), F.count_if(F.col(verdict).isNull())).first()
    if n and bad / n > most:
        raise ValueError(f"{bad} of {n} rows have no verdict")
    return df


def embed(df: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], batch: int = 128, most: int = 512) -> DataFrame:
    """``key, vector``: texts cut at ``most`` characters (the model's window), sent in batches that are halved when the
    model refuses one; a text it refuses alone gets null. Null texts get null."""
    kind = df.schema[key].dataType.simpleString()

    def call(texts: list[str]) -> list:
        try:
            return list(model(texts))
        except Exception:
            if len(texts) == 1:
                return [None]
            half = len(texts) // 2
            return call(texts[:half]) + call(texts[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list = [None] * len(pdf)
            live = [(i, t[:most]) for i, t in enumerate(pdf[text]) if t is not None]
            for a in range(0, len(live), batch):
                some = live[a : a + batch]
                for (i, _), v in zip(some, call([t for _, t in some])):
                    out[i] = v
            yield pd.DataFrame({key: pdf[key], "vector": out})

    return df.select(key, text).mapInPandas(run, f"{key} {kind}, vector array<float>")


def law_resolution(congress: Column, section: Column, first_collected: int, has_package: Column, found: Column) -> Column:
    """How far a public-law citation could be resolved."""
    return (
        F.when(congress < first_collected, "out_of_collection").when(~F.coalesce(has_package, F.lit(False)), "package_missing")
        .when(section.isNull(), "section_unspecified").when(F.coalesce(found, F.lit(False)), "section").otherwise("section_not_found")
    )
