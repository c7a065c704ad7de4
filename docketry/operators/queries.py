"""Queries of the core's general training-data operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import Scratch, table
from .multivalue import split_values


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every citation or quoted title packed in ``authority``, with its place in the field."""
    return split_values(table(spark, d, "report").select("mandate_id", "authority"), ["mandate_id"], "authority", Scratch(spark, "p3"), value="cite")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": p3_found}
