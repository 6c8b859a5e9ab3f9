"""Constraints on rows, and rules from several sources: what breaks them comes out as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def violations(df: DataFrame, keys: list[str], broken: dict[str, Column]) -> DataFrame:
    """(keys, code) for each condition that holds; an unknown one does not."""
    codes = F.array_compact(F.array(*[F.when(condition, F.lit(code)) for code, condition in broken.items()]))
    return df.select(*keys, F.explode(codes).alias("code"))


def merged_rules(rules: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rules of all sources by key: the value they agree on, or null and conflict. Unknown values do not count."""
    x = rules.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    conflict = F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))
    return x.select(*keys, F.when(~conflict, F.col("lo")).alias(value), conflict.alias("conflict"))


def contradicts(first: Column, second: Column, override: Column, known: tuple[str, ...] = ("eligible", "ineligible")) -> Column:
    """Two known states that differ, and nothing that overrides them."""
    return F.coalesce(first.isin(*known) & second.isin(*known) & (first != second) & override.isNull(), F.lit(False))


def squeezed(text: Column) -> Column:
    """Text in lower case with runs of white space as one blank."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def quoted(source: Column, quote: Column) -> Column:
    """Whether the source holds the quote, white space and case apart."""
    return F.coalesce(F.contains(squeezed(source), squeezed(quote)), F.lit(False))
