"""Encodings of values in change records: numbers and bytes as canonical text, canonical JSON and its hash."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_UUID = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
_INT64 = r"^(0|-?[1-9][0-9]*)$"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _or_fail(ok: Column, value: Column, message: str, kind: str) -> Column:
    return F.when(ok, value).otherwise(F.raise_error(F.lit(message)).cast(kind))


def int64_text(text: Column) -> Column:
    """Canonical signed 64-bit text as a long; any other spelling, or a value out of range, is an error."""
    value = text.try_cast("bigint")
    return F.when(text.isNotNull(), _or_fail(text.rlike(_INT64) & value.isNotNull(), value, "invalid canonical signed-64 text", "bigint"))


def bool_text(x: Column) -> Column:
    return F.when(x, "1").when(~x, "0")


def uuid_text(raw: Column) -> Column:
    """Sixteen bytes as canonical UUID text."""
    h = F.lower(F.hex(raw))
    parts = [F.substring(h, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.when(raw.isNotNull(), _or_fail(F.octet_length(raw) == 16, F.concat_ws("-", *parts), "a UUID has 16 bytes", "string"))


def wire_uuid(text: Column) -> Column:
    """Canonical UUID text as bytes; any other spelling is an error."""
    return F.when(text.isNotNull(), _or_fail(text.rlike(_UUID), F.unhex(F.replace(text, F.lit("-"), F.lit(""))), "invalid canonical UUID text", "binary"))


def wire_blob(text: Column) -> Column:
    """Canonical Base64 as bytes; any other spelling is an error."""
    raw = F.try_to_binary(text, F.lit("base64"))
    return F.when(text.isNotNull(), _or_fail(F.coalesce(F.base64(raw) == text, F.lit(False)), raw, "invalid canonical Base64 text", "binary"))


def local_blob(text: Column) -> Column:
    """Bytes from hexadecimal, canonical Base64 or UUID text, tried in this order."""
    clean = F.regexp_replace(F.trim(text), r"^\\[xX]", "")
    as_hex = F.when(clean.rlike(r"^([0-9A-Fa-f]{2})*$"), F.unhex(clean))
    raw = F.try_to_binary(text, F.lit("base64"))
    as_base64 = F.when(F.base64(raw) == text, raw)
    as_uuid = F.when(F.lower(text).rlike(_UUID), F.unhex(F.replace(text, F.lit("-"), F.lit(""))))
    found = F.coalesce(as_hex, as_base64, as_uuid)
    return F.when(text.isNotNull(), _or_fail(found.isNotNull(), found, "bytes must be hexadecimal, Base64 or UUID text", "binary"))


def local_uuid(text: Column) -> Column:
    """Sixteen bytes from UUID text in any case, canonical Base64 or hexadecimal, tried in this order."""
    as_uuid = F.when(F.lower(text).rlike(_UUID), F.unhex(F.replace(text, F.lit("-"), F.lit(""))))
    raw = F.try_to_binary(text, F.lit("base64"))
    as_base64 = F.when(F.base64(raw) == text, raw)
    as_hex = F.when(F.trim(text).rlike(r"^([0-9A-Fa-f]{2})*$"), F.unhex(F.trim(text)))
    found = F.coalesce(as_uuid, as_base64, as_hex)
    return F.when(text.isNotNull(), _or_fail(F.coalesce(F.octet_length(found) == 16, F.lit(False)), found, "a UUID is UUID, Base64 or hexadecimal text of 16 bytes", "binary"))


def number_text(x: float) -> str:
    """Shortest decimal text of a finite binary64 number, as ECMAScript writes it."""
    if not math.isfinite(x):
        raise ValueError("a canonical number is finite")
    if x == 0:
        return "0"
    sign, spelled = ("-" if x < 0 else ""), repr(abs(x))
    mantissa, _, exponent = spelled.partition("e")
    whole, _, fraction = mantissa.partition(".")
    fraction = "" if fraction == "0" else fraction
    digits = (whole + fraction).lstrip("0")
    point = len(whole) + int(exponent or 0) - (len(whole + fraction) - len(digits))
    digits = digits.rstrip("0")
    if 0 < point <= 21:
        body = digits[:point].ljust(point, "0") + ("." + digits[point:] if len(digits) > point else "")
    elif -6 < point <= 0:
        body = "0." + "0" * -point + digits
    else:
        body = digits[0] + ("." + digits[1:] if len(digits) > 1 else "") + "e" + ("+" if point > 0 else "-") + str(abs(point - 1))
    return sign + body


def canonical_json(value: object) -> str:
    """RFC 8785: members sorted by UTF-16 units, short escapes, ECMAScript numbers."""
    if isinstance(value, dict):
        members = sorted(value.items(), key=lambda m: m[0].encode("utf-16-be"))
        return "{" + ",".join(f"{canonical_json(k)}:{canonical_json(v)}" for k, v in members) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, str):
        value.encode("utf-8")  # an unpaired surrogate is an error
        return json.dumps(value, ensure_ascii=False)
    if value is None or isinstance(value, bool):
        return json.dumps(value)
    return number_text(float(value))


def _canonical(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else canonical_json(json.loads(t)))


def _number(values: pd.Series) -> pd.Series:
    return values.map(lambda x: None if pd.isna(x) else number_text(x))


def canonical(text: Column) -> Column:
    """Canonical form of JSON text."""
    return F.pandas_udf(_canonical, "string")(text)


def real_text(x: Column) -> Column:
    """Canonical text of a double."""
    return F.pandas_udf(_number, "string")(x)


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def rows_hash(row_json: Column, ordinal: Column) -> Column:
    """Hash of a bundle: SHA-256 of the JSON array of its canonical rows in order (an aggregate)."""
    rows = F.sort_array(F.collect_list(F.struct(ordinal.alias("o"), row_json.alias("r"))))
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(rows, lambda x: x["r"]), ","), F.lit("]")), 256)
