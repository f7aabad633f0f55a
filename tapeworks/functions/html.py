"""HTML helpers (STR-3, STR-4).

Tags, whitespace and entities are handled by column expressions; no text goes
through a Python worker. Entities follow ``html.unescape``: the names come from
the standard library's table, which a literal holds in buckets.
"""

from __future__ import annotations

import zlib
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS_CLASS

# Patterns (fixed values): tag, paragraph and meta-description extraction.
TAG_RE = r"<[^>]+>"
PARAGRAPH_RE = r"(?is)<p[^>]*>(.*?)</p>"
META_DESCRIPTION_RE = (
    r"(?i)<meta[^>]+(?:name|property)=[\"'](?:description|og:description)[\"'][^>]+content=[\"']([^\"']+)[\"']"
)
MIN_PARAGRAPH_CHARS = 40
MAX_PARAGRAPHS = 12


# Character references (fixed values): what follows ``&``, and the names that need no ``;``, longest first.
REFERENCE_RE = r"^(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
BARE_NAME_RE = f"^({'|'.join(sorted((k for k in html5 if not k.endswith(';')), key=len, reverse=True))})"
NAME_RE = "^[A-Za-z0-9]+;$"
MAX_CODE_POINT = 0x10FFFF
#: What the references 128 to 159 stand for: Windows-1252, or the control itself.
C1_REFERENCES = "".join(bytes([x]).decode("cp1252", "ignore") or chr(x) for x in range(0x80, 0xA0))
NAME_BUCKETS = 1024
_BEGIN, _IS, _NEXT = "\x01", "\x02", "\x03"


def _name_table() -> str:
    """All names and their texts, dealt by the CRC of the name, so that a lookup searches one short bucket."""
    buckets = [_BEGIN] * NAME_BUCKETS
    for name, text in html5.items():
        buckets[zlib.crc32(name.encode()) % NAME_BUCKETS] += name + _IS + text + _BEGIN
    return _NEXT.join(buckets)


NAME_TABLE = _name_table()


def _named(name: Column) -> Column:
    """The text of an entity name, NULL if there is none of that name."""
    bucket = F.get(F.split(F.lit(NAME_TABLE), _NEXT), F.pmod(F.crc32(name.cast("binary")), F.lit(NAME_BUCKETS)).cast("int"))
    key = F.concat(F.lit(_BEGIN), name, F.lit(_IS))
    return F.when(F.contains(bucket, key), F.split_part(F.split_part(bucket, key, F.lit(2)), F.lit(_BEGIN), F.lit(1)))


def _code_point(n: Column) -> Column:
    """The text of a numeric reference: U+FFFD where there is no such character, '' for the ones not allowed."""
    bad = n.between(0xD800, 0xDFFF) | (n > MAX_CODE_POINT) | (n == 0)
    dropped = n.between(1, 8) | (n == 11) | n.between(14, 31) | (n == 127) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when(bad, F.lit("\ufffd"))
        .when(n.between(0x80, 0x9F), F.substring(F.lit(C1_REFERENCES), n - 0x7F, F.lit(1)))
        .when(dropped, F.lit(""))
        .when(n == 0xFEFF, F.lit("\ufeff"))  # the decoder takes it for a byte order mark
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    )


def _reference(ref: Column) -> Column:
    """The text of a reference without its ``&``; NULL if it stands for itself."""
    digits, hexes = F.regexp_extract(ref, "^#0*([0-9]+)", 1), F.regexp_extract(ref, "^#[xX]0*([0-9a-fA-F]+)", 1)
    decimal = F.when(F.length(digits) <= 7, digits.try_cast("int")).otherwise(MAX_CODE_POINT + 1)
    from_hex = F.when(F.length(hexes) <= 6, F.conv(hexes, 16, 10).try_cast("int")).otherwise(MAX_CODE_POINT + 1)
    bare = F.regexp_extract(ref, BARE_NAME_RE, 1)
    return (
        F.when(ref.rlike("^#[0-9]"), _code_point(decimal))
        .when(F.startswith(ref, F.lit("#")), _code_point(from_hex))
        .otherwise(F.coalesce(F.when(ref.rlike(NAME_RE), _named(ref)), F.when(bare != "", F.concat(_named(bare), F.substring(ref, F.length(bare) + 1, F.length(ref))))))
    )


def unescape_entities(c: Column) -> Column:
    """``html.unescape`` as an expression: the text is parted at ``&``, and each part's reference is replaced."""
    parts = F.transform(F.split(c, "&"), lambda p, i: F.struct(i.alias("i"), p.alias("part"), F.when(i > 0, F.regexp_extract(p, REFERENCE_RE, 0)).otherwise("").alias("ref")))
    done = F.transform(
        parts,
        lambda p: F.when(p["ref"] == "", F.concat(F.when(p["i"] > 0, "&").otherwise(""), p["part"])).otherwise(
            F.concat(F.coalesce(_reference(p["ref"]), F.concat(F.lit("&"), p["ref"])), F.substring(p["part"], F.length(p["ref"]) + 1, F.length(p["part"])))
        ),
    )
    return F.array_join(done, "")


def strip_html(c: Column) -> Column:
    """STR-3: tags -> space, entities unescaped, whitespace collapsed, trimmed."""
    no_tags = F.regexp_replace(F.coalesce(c, F.lit("")), TAG_RE, " ")
    text = unescape_entities(no_tags)
    collapsed = F.regexp_replace(text, f"{WS_CLASS}+", " ")
    return F.regexp_replace(collapsed, r"^ | $", "")


def article_body(html: Column, min_chars: int = MIN_PARAGRAPH_CHARS, max_paragraphs: int = MAX_PARAGRAPHS) -> Column:
    """STR-4: the first ``max_paragraphs`` stripped ``<p>`` blocks of ``min_chars`` or more joined by newline;
    else the stripped meta description; else ''.

    Paragraphs are unescaped together: tag-stripped blocks are
    joined with U+0001 (no entity can span it) and split back afterwards.
    """
    src = F.coalesce(html, F.lit(""))
    paras = F.regexp_extract_all(src, F.lit(PARAGRAPH_RE), 1)
    notag = F.transform(paras, lambda p: F.regexp_replace(p, TAG_RE, " "))
    back = F.split(unescape_entities(F.array_join(notag, "\u0001")), "\u0001")
    clean = F.transform(back, lambda p: F.regexp_replace(F.regexp_replace(p, f"{WS_CLASS}+", " "), r"^ | $", ""))
    kept = F.filter(clean, lambda p: F.length(p) >= min_chars)
    meta = F.regexp_extract(src, META_DESCRIPTION_RE, 1)
    return (
        F.when(F.size(kept) > 0, F.array_join(F.slice(kept, 1, max_paragraphs), "\n"))
        .when(meta != "", strip_html(meta))
        .otherwise(F.lit(""))
    )
