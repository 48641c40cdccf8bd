"""Nested nodes: arrays of structs read as tests, lists and single values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_where(nodes: Column, test: Callable[[Column], Column]) -> Column:
    """Whether an element passes; false for a null array, null tests do not pass."""
    return F.coalesce(F.exists(nodes, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def pick(nodes: Column, test: Callable[[Column], Column], of: Callable[[Column], Column]) -> Column:
    """What `of` gives for the elements that pass; an empty array for a null one."""
    return F.transform(F.filter(F.coalesce(nodes, F.array()), lambda x: F.coalesce(test(x), F.lit(False))), of)


def last_known(nodes: Column, of: Callable[[Column], Column]) -> Column:
    """The last value that is not null; null if there is none."""
    return F.try_element_at(F.filter(F.transform(nodes, of), lambda v: v.isNotNull()), F.lit(-1))


def with_one(items: Column, one: Column) -> Column:
    """An array and, unless it is null, one more element; repeats stay."""
    return F.concat(F.coalesce(items, F.array().cast("array<string>")), F.array_compact(F.array(one)))


def best_key(scores: Column) -> Column:
    """The key of a map's largest value; ties go to the smaller key, an empty map has none."""
    ordered = F.array_sort(F.transform(F.map_entries(scores), lambda e: F.struct((-e["value"]).alias("less"), e["key"].alias("key"))))
    return F.try_element_at(ordered, F.lit(1))["key"]
