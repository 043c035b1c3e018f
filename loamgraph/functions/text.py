"""Typed reading of text values, as expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a whole number and as a decimal number after trimming.
INT_PATTERN = r"^[+-]?[0-9]+\z"
FLOAT_PATTERN = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"

#: The same for DuckDB's regular expressions, which are given the whole value.
SQL_SPACE = r"[\s\x0b\x{85}\p{Z}]"
SQL_INT = r"[+-]?[0-9]+"
SQL_FLOAT = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")


def filled(c: Column) -> Column:
    """Whether there is anything but Unicode white space; null for null."""
    return c.rlike(r"(?U)\S")


def to_int(c: Column) -> Column:
    """BIGINT, or null if the trimmed text is no whole number of 64 bits."""
    s = strip(c)
    # Most texts have nothing to trim and need one look.
    return F.when(c.rlike(INT_PATTERN), c.try_cast("bigint")).when(s.rlike(INT_PATTERN), s.try_cast("bigint"))


def to_float(c: Column) -> Column:
    """DOUBLE, or null if the trimmed text is no decimal number.  Too large a number becomes an infinity."""
    s = strip(c)
    return F.when(s.rlike(FLOAT_PATTERN), s.try_cast("double"))


def sql_strip(x: str) -> str:
    """DuckDB text of ``strip``."""
    return f"regexp_replace({x}, '^{SQL_SPACE}+|{SQL_SPACE}+$', '', 'g')"


def sql_is_int(x: str) -> str:
    """DuckDB text: the value of ``x`` is a whole number of 64 bits."""
    s = sql_strip(x)
    return f"(regexp_full_match({s}, '{SQL_INT}') AND try_cast({s} AS BIGINT) IS NOT NULL)"


def sql_is_float(x: str) -> str:
    """DuckDB text: the value of ``x`` is a decimal number."""
    return f"regexp_full_match({sql_strip(x)}, '{SQL_FLOAT}')"
