"""Scalar and aggregate functions whose usual SQLite meaning differs from Spark's, as column expressions."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_TIME, DATE, TIME = "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "HH:mm:ss"
RFC3339, RFC3339_MILLIS = "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def like(text: Column, pattern: Column | str, escape: str | None = None) -> Column:
    """LIKE that does not tell upper from lower case."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    return F.ilike(text, pattern) if escape is None else F.ilike(text, pattern, F.lit(escape))


def glob(text: Column, pattern: str) -> Column:
    """GLOB: * and ? stand for any characters, [...] for one of a set ([^...] for one outside it); case counts."""
    out, at = "", 0
    while at < len(pattern):
        c = pattern[at]
        close = pattern.find("]", at + 2 + (pattern[at + 1 : at + 2] == "^")) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif close > 0:
            inside = pattern[at + 1 : close]
            negated, inside = inside.startswith("^"), inside.removeprefix("^")
            out += "[" + ("^" if negated else "") + re.sub(r"([\\\[\]&^~])", r"\\\1", inside) + "]"
            at = close
        else:
            out += re.escape(c)
        at += 1
    return text.rlike(f"(?s)\\A{out}\\z")


def parse_time(text: Column) -> Column:
    """A time of day as seconds; text in another format is an error."""
    ok = text.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d$")
    seconds = F.substring(text, 1, 2).cast("int") * 3600 + F.substring(text, 4, 2).cast("int") * 60 + F.substring(text, 7, 2).cast("int")
    return F.when(text.isNotNull(), F.when(ok, seconds).otherwise(F.raise_error(F.concat(F.lit("invalid time: "), text)).cast("int")))


def time_text(seconds: Column) -> Column:
    """Seconds of a day as HH:mm:ss."""
    return F.date_format(F.timestamp_seconds(seconds), TIME)


def int_div(a: Column, b: Column) -> Column:
    """Integer quotient, cut towards zero; null for a zero divisor."""
    return F.when(b != 0, F.call_function("div", a, b))


def divide(a: Column, b: Column) -> Column:
    """Quotient; null for a zero divisor."""
    return F.try_divide(a, b)


def count_big(x: Column | None = None) -> Column:
    """COUNT_BIG: a count under another name, never null."""
    return F.count(F.lit(1) if x is None else x)


def total(x: Column) -> Column:
    """Sum as a double; 0.0 of nothing."""
    return F.coalesce(F.sum(x.cast("double")), F.lit(0.0))


def real_sum(x: Column) -> Column:
    """Sum as a double; null of nothing."""
    return F.sum(x.cast("double"))


def group_concat(x: Column, separator: str = ",", order: Column | None = None) -> Column:
    """Non-null values joined; in the given order, else in that of the values."""
    text = x.cast("string")
    pairs = F.sort_array(F.collect_list(F.when(text.isNotNull(), F.struct((order if order is not None else text).alias("o"), text.alias("t")))))
    return F.when(F.size(pairs) > 0, F.array_join(F.transform(pairs, lambda p: p["t"]), separator))


def json_group_array(x: Column, order: Column | None = None) -> Column:
    """Non-null values as a JSON array in text, in order."""
    pairs = F.sort_array(F.collect_list(F.when(x.isNotNull(), F.struct((order if order is not None else x).alias("o"), x.alias("v")))))
    return F.to_json(F.transform(pairs, lambda p: p["v"]))


def json_group_object(key: Column, value: Column) -> Column:
    """Keys with their values as a JSON object in text, in the order of keys; the last of equal keys wins."""
    entries = F.sort_array(F.collect_list(F.when(key.isNotNull(), F.struct(key.cast("string").alias("key"), value.alias("value")))))
    unique = F.filter(entries, lambda e, i: F.coalesce(e["key"] != F.get(entries, i + 1)["key"], F.lit(True)))
    return F.to_json(F.map_from_entries(unique), {"ignoreNullFields": "false"})


def json_object(**fields: Column) -> Column:
    """A JSON object in text that keeps nulls."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]), {"ignoreNullFields": "false"})


def json_each(text: Column, kind: str) -> Column:
    """One row per element of a JSON array in text."""
    return F.explode(F.from_json(text, f"array<{kind}>"))


def byte_length(x: Column) -> Column:
    return F.octet_length(x)


def hex_lower(x: Column) -> Column:
    return F.lower(F.hex(x))


def rfc3339(ts: Column, millis: bool = False) -> Column:
    """A timestamp as UTC text."""
    return F.date_format(ts, RFC3339_MILLIS if millis else RFC3339)


def utc_now(millis: bool = False) -> Column:
    return rfc3339(F.current_timestamp(), millis)


def to_bool(x: Column) -> Column:
    """Stored 0 is false, any other number is true, null stays null."""
    return x != 0


def from_bool(x: Column) -> Column:
    return x.cast("int")


def parse_date_time(text: Column) -> Column:
    """Strict: text in another format is an error."""
    return F.to_timestamp_ntz(text, F.lit(DATE_TIME))


def parse_date(text: Column) -> Column:
    return F.to_date(text, DATE)


def parse_instant(text: Column) -> Column:
    return F.to_timestamp(text, "yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX")


def enum_by_value(x: Column, values: dict[Any, str], strict: bool = True) -> Column:
    """Name of an enumerated value; null stays null, an unknown value is an error (or null if not strict)."""
    pairs = [part for value, name in values.items() for part in (F.lit(value), F.lit(name))]
    found = F.try_element_at(F.create_map(*pairs), x)
    if not strict:
        return found
    complaint = F.raise_error(F.concat(F.lit("unknown enum value: "), x.cast("string"))).cast("string")
    return F.when(x.isNull(), F.lit(None).cast("string")).when(found.isNotNull(), found).otherwise(complaint)


def random_key() -> Column:
    """Sixteen random bytes."""
    return F.unhex(F.replace(F.uuid(), F.lit("-"), F.lit("")))
