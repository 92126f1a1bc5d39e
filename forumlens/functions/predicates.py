"""Predicates over columns. Each says what it does with nulls."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def same_text(a: Column, b: Column) -> Column:
    """Equal without case and outer spaces; null if either is null."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def not_soft_removed(removed: str, votes: str, least: int) -> Column:
    """Not removed, or removed with at least `least` votes. Null `removed` is not removed, null votes are none."""
    return (F.coalesce(removed, F.lit(0)) == 0) | ((F.col(removed) == 1) & (F.coalesce(votes, F.lit(0)) >= least))


def unless_flagged(flag: Column, verdict: Column, approved: Sequence[str]) -> Column:
    """Not flagged, or flagged with an approved verdict. A null flag is not flagged."""
    flagged = F.coalesce(flag, F.lit(False))
    return ~flagged | (flagged & verdict.isin(*approved))


def not_blank(column: str) -> Column:
    """Neither null nor the empty string."""
    return F.coalesce(column, F.lit("")) != ""


def contains_any(column: Column, words: Sequence[str]) -> Column:
    """One pattern for all words, so the text is searched once; null if the column is."""
    return column.rlike("|".join(map(re.escape, words)))


def starts_with_any(column: Column, prefixes: Sequence[str]) -> Column:
    return column.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")")
