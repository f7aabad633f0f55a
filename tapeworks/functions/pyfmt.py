"""Render values the way the reference's text outputs show them (STR-9, JSON-3):
Python float repr of rounded numbers, ``json.dumps(sort_keys=True)`` spacing and
Python list/str repr, built from column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(c: Column, digits: int) -> Column:
    """``f"{x:.{digits}f}"`` (NULL -> 'nan')."""
    x = c.cast("double")
    return F.when(x.isNull(), F.lit("nan")).otherwise(F.format_string(f"%.{digits}f", x))


def py_float(c: Column, digits: int = 4) -> Column:
    """repr(round(x, digits)): shortest decimal, at least one fractional digit; NULL -> 'NaN'."""
    x = c.cast("double")
    s = F.format_string(f"%.{digits}f", x)
    s = F.regexp_replace(F.regexp_replace(s, "0+$", ""), r"\.$", ".0")
    return F.when(x.isNull(), F.lit("NaN")).otherwise(s)


def json_str(c: Column) -> Column:
    """A JSON string literal (quotes and escapes) of ``c``."""
    return F.regexp_replace(F.regexp_replace(F.to_json(F.array(c)), r"^\[", ""), r"\]$", "")


def json_bool(c: Column) -> Column:
    return F.when(c, F.lit("true")).otherwise(F.lit("false"))


def json_str_list(arr: Column) -> Column:
    """``["a", "b"]`` with Python's ", " separator."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, lambda x: json_str(x)), ", "), F.lit("]"))


def json_object(fields: Sequence[tuple[str, Column]]) -> Column:
    """``json.dumps(obj, sort_keys=True)``: fields are rendered values, sorted by key here."""
    parts = []
    for i, (k, v) in enumerate(sorted(fields, key=lambda kv: kv[0])):
        parts += [F.lit(("" if i == 0 else ", ") + f'"{k}": '), v]
    return F.concat(F.lit("{"), *parts, F.lit("}"))


def py_str(c: Column) -> Column:
    """Python ``repr(str)`` for ordinary text: single quotes unless the text has a
    single quote and no double quote; backslash, newline, CR and tab escaped."""
    esc = F.regexp_replace(c, r"\\", r"\\\\")
    esc = F.regexp_replace(F.regexp_replace(F.regexp_replace(esc, "\n", r"\\n"), "\r", r"\\r"), "\t", r"\\t")
    dq = F.contains(c, F.lit("'")) & ~F.contains(c, F.lit('"'))
    return F.when(dq, F.concat(F.lit('"'), esc, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.regexp_replace(esc, "'", r"\\'"), F.lit("'"))
    )


def py_str_list(arr: Column) -> Column:
    """Python repr of a list of str: ``['a', 'b']``."""
    return F.concat(F.lit("["), F.array_join(F.transform(arr, py_str), ", "), F.lit("]"))
