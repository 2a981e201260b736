"""Metadata filters and access control: predicates that are evaluated before any scoring, in every strategy."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class MetadataFilter:
    """All fields must match, any value of a field will do; values are compared as strings.

    access_tags: the row needs one of them (rows without tags are denied); freshness_after: ISO dates compared as
    strings, rows without a date pass. deny_all is what a user without entitlements gets.
    """

    equals: dict[str, list[str]] = field(default_factory=dict)
    access_tags: list[str] = field(default_factory=list)
    freshness_after: str | None = None
    deny_all: bool = False

    def predicate(self, rows: DataFrame) -> Column:
        if self.deny_all:
            return F.lit(False)
        out = F.lit(True)
        for name, wanted in self.equals.items():
            if name not in rows.columns:
                out = out & F.lit("None" in wanted)
            elif isinstance(rows.schema[name].dataType, T.ArrayType):
                out = out & overlap(F.col(name).cast("array<string>"), F.array(*map(F.lit, wanted)))
            else:
                out = out & F.coalesce(F.col(name).cast("string"), F.lit("None")).isin(list(wanted))
        if self.access_tags:
            out = out & overlap(F.col("access_tags"), F.array(*map(F.lit, self.access_tags)))
        if self.freshness_after:
            out = out & F.coalesce(F.col("freshness_date") >= self.freshness_after, F.lit(True))
        return out

    def apply(self, rows: DataFrame) -> DataFrame:
        return rows.where(self.predicate(rows))


def overlap(a: Column, b: Column) -> Column:
    """Whether two arrays share a value; nulls in or instead of arrays share nothing."""
    tidy = lambda x: F.filter(F.coalesce(x, F.array().cast("array<string>")), lambda v: v.isNotNull())
    return F.size(F.array_intersect(tidy(a), tidy(b))) > 0


def build_filter(equals: dict[str, list[str]], suggested_tags: list[str], entitlements: list[str], freshness_after: str | None = None) -> MetadataFilter:
    """Suggested tags within the user's entitlements, all entitlements if none is; no entitlements, no rows."""
    tags = [t for t in suggested_tags if t in entitlements] or list(entitlements)
    return MetadataFilter(equals, tags, freshness_after, deny_all=not entitlements)


def relaxed(entitlements: list[str]) -> MetadataFilter:
    """The fallback of a starved query: entitlements only."""
    return MetadataFilter({}, list(entitlements), None, deny_all=not entitlements)


def effective_tags(suggested: Column, entitlements: Column) -> Column:
    """build_filter's tags for a column of users."""
    shared = F.array_intersect(suggested, entitlements)
    return F.when(F.size(shared) > 0, shared).otherwise(entitlements)
