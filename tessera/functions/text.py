"""Text and JSON functions on columns: lenient numbers, lists, flags, feature names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient_int(c: Column, fallback: int | None = None) -> Column:
    """A whole number from decimal, hexadecimal (0x) or octal (0) text; fractions lose their fraction; else the fallback."""
    t = F.lower(F.trim(c))
    negative = F.when(t.startswith("-"), -1).otherwise(1)
    plain = F.regexp_replace(t, "^[+-]", "")
    hexa = F.conv(F.substring(plain, 3, 32), 16, 10).try_cast("bigint")
    octal = F.conv(plain, 8, 10).try_cast("bigint")
    value = (
        F.when(plain.rlike("^0x[0-9a-f]{1,15}$"), negative * hexa)
        .when(plain.rlike("^0[0-7]{1,20}$"), negative * octal)
        .when(plain.rlike("^[0-9]+$"), t.try_cast("bigint"))
        .when(plain.rlike(r"^([0-9]+\.[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?$"), t.try_cast("double").try_cast("bigint"))
    )
    return F.coalesce(value, F.lit(fallback).cast("bigint"))


def json_int(json: str, path: str, default: int = -1) -> Column:
    return F.coalesce(F.get_json_object(json, path).try_cast("bigint"), F.lit(default).cast("bigint"))


def csv_items(c: Column) -> Column:
    """Trimmed items between commas without the empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def top_n_list(c: Column) -> Column:
    """Distinct positive numbers of a list in rising order."""
    numbers = F.transform(csv_items(c), lambda x: x.try_cast("bigint"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda x: x > 0)))


def flag(c: Column) -> Column:
    return F.lower(F.trim(c)).isin("1", "true", "t", "yes", "y", "on")


def feature_name(c: Column) -> tuple[Column, Column]:
    """key[index] as (key, index); without brackets (key, null)."""
    index = F.regexp_extract(c, r"^.+\[(\d+)\]$", 1)
    return F.when(index != "", F.regexp_extract(c, r"^(.+)\[\d+\]$", 1)).otherwise(c), F.when(index != "", index.try_cast("bigint"))


def by_name(values: Column, index: Column) -> Column:
    """An element as a number; 0 if it is missing."""
    return F.coalesce(F.get(values, index.cast("int")).cast("double"), F.lit(0.0))


def by_schema(values: Column, width: int) -> Column:
    """The whole array if it has the declared width, else zeros."""
    return F.when(F.size(values) == width, F.transform(values, lambda x: F.coalesce(x.cast("double"), F.lit(0.0)))).otherwise(F.array_repeat(F.lit(0.0), width))
