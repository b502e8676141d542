"""Change rows as JSON text from outside, read strictly: a text that is not exactly one row is told apart, not guessed at.

Spark's own reader takes the last of two members of one name, lets unknown ones pass and rounds numbers.  So a batch of
texts is checked first (``problem``), and only those without a problem are parsed, by Spark.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Members of a row and their kinds: all must be there and no others.
ROW = {"schema": "string", "table": "string", "key": "strings", "row_version": "long", "payload": "object"}
#: Objects and arrays inside each other, the row's own included.
MAX_DEPTH = 128

_SPARK = {"string": "string", "long": "bigint", "boolean": "boolean", "strings": "map<string,string>", "object": "string"}


class _Wrong(ValueError):
    pass


def _members(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise _Wrong("duplicate member")
    return found


def _no_number(name: str) -> None:
    raise _Wrong("syntax")


def _depth(value: Any) -> int:
    deepest, waiting = 0, [(value, 1)]
    while waiting:
        x, at = waiting.pop()
        if isinstance(x, (dict, list)):
            deepest = max(deepest, at)
            waiting += [(y, at + 1) for y in (x.values() if isinstance(x, dict) else x)]
    return deepest


def _is(value: Any, kind: str) -> bool:
    if kind == "long":
        return isinstance(value, int) and not isinstance(value, bool) and -(2**63) <= value < 2**63
    if kind == "strings":
        return isinstance(value, dict) and all(isinstance(v, str) for v in value.values())
    return isinstance(value, {"string": str, "boolean": bool, "object": dict}[kind])


def problem_of(text: str, members: dict[str, str]) -> str | None:
    """What keeps a text from being an object of these members, or None."""
    try:
        value = json.loads(text, object_pairs_hook=_members, parse_constant=_no_number)
        if "\\u" in text:
            json.dumps(value, ensure_ascii=False).encode()
    except RecursionError:
        return "too deep"
    except _Wrong as e:
        return str(e)
    except UnicodeEncodeError:
        return "unpaired surrogate"
    except ValueError:
        return "syntax"
    if _depth(value) > MAX_DEPTH:
        return "too deep"
    if not isinstance(value, dict):
        return "syntax"
    if value.keys() - members.keys():
        return "unknown member"
    if members.keys() - value.keys():
        return "missing member"
    wrong = [m for m, kind in members.items() if not _is(value[m], kind)]
    return f"{wrong[0]} is no {members[wrong[0]]}" if wrong else None


def problem(text: Column, members: dict[str, str] = ROW) -> Column:
    """The problem of a text as a column: null if there is none; a null text is one."""

    def each(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: "missing" if t is None else problem_of(t, members))

    return F.pandas_udf(each, "string")(text)


def decode(df: DataFrame, text_col: str = "text", members: dict[str, str] = ROW) -> DataFrame:
    """The rows with ``problem`` and, where it is null, ``row``; an object inside stays JSON text."""
    schema = ", ".join(f"{m} {_SPARK[kind]}" for m, kind in members.items())
    checked = df.withColumn("problem", problem(F.col(text_col), members))
    return checked.withColumn("row", F.when(F.col("problem").isNull(), F.from_json(text_col, schema, {"mode": "FAILFAST"})))


def decoded(df: DataFrame, text_col: str = "text", members: dict[str, str] = ROW) -> DataFrame:
    """The rows' members as columns; any problem is an error when the result is read."""
    found = decode(df, text_col, members)
    complaint = F.raise_error(F.concat(F.lit("a change row cannot be read: "), F.col("problem")))
    ready = found.withColumn("row", F.when(F.col("problem").isNotNull(), complaint.cast(found.schema["row"].dataType)).otherwise(F.col("row")))
    return ready.select(*[c for c in df.columns if c != text_col], "row.*")
