"""String expressions (STR-*): stripping, keys, truncation; key words are in ``matcher``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters Python's str.strip() removes (fixed values), as a regex class that
# Java and RE2 read the same way.
WS_CLASS = r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_WS = f"^{WS_CLASS}+|{WS_CLASS}+$"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace (NULL -> '').

    Only texts that begin or end with whitespace are searched."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    return F.when(ends.rlike(WS_CLASS), F.regexp_replace(text, _WS, "")).otherwise(text)


def truncate(c: Column, n: int) -> Column:
    """STR-6: first ``n`` characters."""
    return F.substring(c, 1, n)


def dedupe_key(cols: Sequence[Column]) -> Column:
    """STR-8: sha1 of the fields joined with '|' (NULL -> '')."""
    return F.sha1(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))


def url_host(url: Column) -> Column:
    """STR-7: network location of a URL (like ``urlparse(..).netloc``)."""
    return F.coalesce(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit(""))


def mentions_ticker(text: Column, ticker: Column) -> Column:
    """STR-10: ticker substring in the upper-cased text."""
    return F.contains(F.upper(text), ticker)
