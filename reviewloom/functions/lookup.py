"""Constant-table lookups that stay inside a projection (no join, no shuffle)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Mapping
from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MAX_PARTS = 1 << 16


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` computed once per row, however often the body uses it.

    A helper column would do as well until a filter on the result is pushed below it: Spark then copies the
    helper's expression to every place that reads it.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _quoted(value: object) -> str:
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, (list, tuple)):
        return f"array({', '.join(_quoted(v) for v in value)})"
    return f"{value}D" if isinstance(value, float) else str(value)


@lru_cache(maxsize=64)
def _literals(words: tuple[str, ...], application: str) -> tuple[Column, ...]:
    # Making a literal is a round trip to the JVM, so each list is made once per application.
    return tuple(F.lit(w) for w in words)


def one_of(word: Column, words: Iterable[str]) -> Column:
    """Whether `word` is one of `words`: a hash probe. Null for null."""
    return word.isin(*_literals(tuple(words), SparkSession.active().sparkContext.applicationId))


def lookup(word: Column, mapping: Mapping[str, object], value_type: str, default: Column | None = None) -> Column:
    """``mapping[word]``, or `default` (null) when absent.

    Most words of a text are in none of the tables, so a hash probe of the keys comes first. Spark scans the
    keys of a map one by one, hence the table is dealt into parts of about one entry by checksum. The parts are
    one constant of the plan, written as SQL because that takes a single call to the JVM. The table travels with the
    plan, so one that does not fit the driver belongs in a DataFrame and the join form of the operator (`*_with_table`).
    """
    count = max(1, min(len(mapping), MAX_PARTS))
    parts: list[list[str]] = [[] for _ in range(count)]
    for key, value in mapping.items():
        parts[zlib.crc32(key.encode()) % count] += [_quoted(key), _quoted(value)]
    maps = ", ".join(f"CAST(map({', '.join(part)}) AS MAP<STRING, {value_type}>)" for part in parts)
    part = F.get(F.expr(f"array({maps})"), (F.crc32(word) % count).cast("int"))
    found = F.when(one_of(word, mapping), F.element_at(part, word))
    return found if default is None else F.coalesce(found, default)


def text_array(values: Iterable[str]) -> Column:
    """A constant array of strings."""
    return F.expr(f"CAST(array({', '.join(_quoted(v) for v in values)}) AS ARRAY<STRING>)")
