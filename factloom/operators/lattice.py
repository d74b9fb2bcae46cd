"""Aggregations of a type lattice, and censuses.

A type is an array of canonical member names; ``untyped`` absorbs everything.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN, NIL = "untyped", "nil"


def normal(members: Column) -> Column:
    """Sorted, distinct, and absorbed by the unknown type."""
    return F.when(F.array_contains(members, UNKNOWN), F.array(F.lit(UNKNOWN))).otherwise(F.array_sort(F.array_distinct(members)))


def type_join(members: Column) -> Column:
    """Aggregate: the union of a group's types (a column of arrays); the unknown type absorbs."""
    return F.when(F.coalesce(F.bool_or(F.array_contains(members, UNKNOWN)), F.lit(False)), F.array(F.lit(UNKNOWN))).otherwise(F.array_sort(F.array_distinct(F.flatten(F.collect_set(members)))))


def atoms_join(atom: Column) -> Column:
    """Aggregate over single names: one name per key and task is kept, so groups of any size stay small."""
    return F.when(F.coalesce(F.bool_or(atom == UNKNOWN), F.lit(False)), F.array(F.lit(UNKNOWN))).otherwise(F.array_sort(F.collect_set(atom)))


def all_equal_or_unknown(atom: Column) -> Column:
    """Aggregate: the one type all writes agree on, else unknown."""
    return F.when(F.min(atom) == F.max(atom), F.min(atom)).otherwise(UNKNOWN)


def strip(members: Column, member: Column) -> Column:
    """The type without one member: null where it is no union, has an unknown part, or lacks the member."""
    rest = F.array_remove(members, member)
    ok = (F.size(members) > 1) & ~F.array_contains(members, UNKNOWN) & F.array_contains(members, member) & (F.size(rest) > 0)
    return F.when(ok, rest)


def strip_nil(members: Column) -> Column:
    """The type without nil; nil alone is unknown."""
    rest = F.array_remove(members, NIL)
    return F.when(F.size(rest) == 0, F.array(F.lit(UNKNOWN))).otherwise(rest)


def erase(name: Column) -> Column:
    """``Array[T]`` and ``Hash[K, V]`` without their elements."""
    return F.regexp_replace(name, r"^(Array|Hash)\[.*\]$", "$1")


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))


def poisoned(values: Column, bad: Column) -> Column:
    """Aggregate: the sorted values of a group, or null where any row is bad."""
    return F.when(~F.coalesce(F.bool_or(bad), F.lit(False)), F.array_sort(F.collect_set(values)))


def census(rows: DataFrame, levels: list[str]) -> DataFrame:
    """Counts of nested buckets with all subtotals."""
    grouped = rows.rollup(*levels).agg(F.count("*").alias("n"), *(F.grouping(c).cast("long").alias(f"all_{c}") for c in levels))
    return grouped


def top(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The k commonest keys, ties by key; the limit is the report's own."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)
