"""Numeric and time expressions shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_even(c: Column, digits: int) -> Column:
    """Round to digits by the exact binary value, ties to even.

    ``bround`` rounds the shortest decimal text instead, so it takes 4.35 (a
    little less than that in binary) for a tie. Here the product with the power
    of ten is split into its rounded value and the exact remainder.
    """
    p = float(10 ** digits)

    def nearest(x: Column) -> Column:
        wide = x * 134217729.0
        head = wide - (wide - x)
        product = x * p
        rest = (head * p - product) + (x - head) * p
        low = F.floor(product)
        part = product - low
        up = (part > 0.5) | ((part == 0.5) & ((rest > 0) | ((rest == 0) & (low % 2 != 0))))
        return (low + F.when(up, 1).otherwise(0)) / p

    # One-element array: the value is computed once and the generated code stays small.
    return F.transform(F.array(c.cast("double")), nearest)[0]


def mean(c: Column) -> Column:
    """Average summed as decimals, so it does not depend on the order in which tasks finish."""
    return F.avg(c.cast("decimal(30,12)"))


def percent(part: Column, whole: Column, digits: int | None = 1) -> Column:
    """part/whole*100, half-even rounded; 0 when the whole is 0 or null."""
    share = F.when(whole > 0, part / whole * 100).otherwise(F.lit(0.0))
    return share if digits is None else half_even(share, digits)


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, null unless both are known."""
    return F.timestamp_diff("MICROSECOND", start, end) / 1000.0


def since_days(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(days=F.lit(days))


def iso_time(text: str) -> Column:
    """An ISO-8601 filter value; a malformed one is an error when the plan runs."""
    return F.to_timestamp_ntz(F.lit(text))


def clamp_confidence(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def tally(groups: Column, name: str, n: str = "n") -> Column:
    """Map of one field of an array of group rows to its summed counts, in key order.

    Reports group once by all their fields, gather the few group rows, and take every
    breakdown from them, so the table itself is read once.
    """
    names = F.array_sort(F.array_distinct(F.transform(groups, lambda g: g[name])))
    return F.map_from_entries(F.transform(names, lambda k: F.struct(k, F.aggregate(
        F.filter(groups, lambda g: g[name] == k), F.lit(0).cast("long"), lambda acc, g: acc + g[n]))))


def counts_map(name: Column, n: Column) -> Column:
    """Aggregate of already grouped (name, n) rows to a map in key order."""
    return F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, n))))


def is_live(created_at: Column, ttl: Column, now: Column) -> Column:
    """An entry without a positive ttl never expires; otherwise age <= ttl seconds."""
    age = F.timestamp_diff("MICROSECOND", created_at, now) / 1e6
    return ttl.isNull() | (ttl <= 0) | (age <= ttl)


def bit_set(bitmap: Column, place: Column) -> Column:
    """Whether a bitmap of ``bitmap_construct_agg`` has the bit at a place from 0."""
    byte = F.conv(F.hex(F.substr(bitmap, (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.pmod(F.floor(byte / F.pow(F.lit(2.0), place % 8)), F.lit(2)) == 1
