"""Personal data in texts (operator 11), DataFrame functions only.

Per kind, a regular expression proposes spans from left to right without
overlap, a validator (part ranges, digit counts, Luhn, mod-97, number ranges)
confirms them, and words near a span raise or lower its score. E-mail
addresses, IP addresses, card numbers and international phone numbers count as
soon as they are confirmed; IBANs, national phone numbers and social security
numbers are added when their score reaches ``Rules.least`` and they touch none
of the first four.

The places of matches are running sums of the lengths of what ``split`` leaves
between them. Sums are taken in blocks of ``BLOCK`` matches, so a text with
many matches costs n times ``BLOCK``, not n squared. Patterns are written so
that a match is found in time linear in the text: quantifiers never give back
what no later part could take, and an address starts where its run of
characters does.

Defined results: a null or empty text has no spans; whole texts of any length
are read; of spans with one start, the kind listed first comes first; repeated
rows are judged each on its own; an empty table gives an empty result; columns
of the input are neither read nor returned but for id and text (``redacted``
keeps them all), whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, text_of

BLOCK = 1000
BEFORE, AFTER = 40, 20

#: Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27,
    "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31,
    "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}

#: Words of the context, looked for in lower case with no letter on either side.
PHONE_WORDS = ["phone", "tel", "telephone", "call", "fax", "mobile", "cell", "telefon", "anruf", "téléphone", "teléfono", "móvil"]
BANK_WORDS = ["iban", "bank", "account", "konto", "kontonummer", "compte", "cuenta", "bic", "swift"]
CARD_WORDS = ["card", "credit", "visa", "mastercard", "amex", "karte", "carte", "tarjeta"]
SSN_WORDS = ["ssn", "social security", "social-security"]
MAIL_WORDS = ["mail", "e-mail", "email", "contact", "correo", "courriel"]
NET_WORDS = ["ip", "host", "server", "address", "client", "login"]
NOT_NET_WORDS = ["version", "release", "build", "section", "chapter"]
NOT_PHONE_WORDS = ["order", "invoice", "isbn", "serial", "item", "part"]


@dataclass(frozen=True)
class Rules:
    #: Added kinds stay from this score on, of 100.
    least: int = 60


@dataclass(frozen=True)
class Kind:
    name: str
    #: A cheap test of texts that may hold a match; the pattern as searched; the same as a plain pattern for other engines.
    guard: Callable[[Column], Column]
    pattern: str
    plain: str
    confirmed: Callable[[Column], Column]
    score: int
    raising: list[str]
    lowering: list[str]
    base: bool = True
    #: Whether neither neighbour may be a letter or digit.
    edges: bool = False


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass the Luhn check."""

    def weighed(c: Column, i: Column) -> Column:
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), weighed), F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN without blanks leaves 1, its first four characters moved to the end and letters read as 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 1000), F.substring(iban, 1, 4))
    step = lambda a, c: F.when(c.between("0", "9"), (a * 10 + c.try_cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _iban_confirmed(value: Column) -> Column:
    lengths = F.create_map(*[F.lit(x) for pair in IBAN_LENGTHS.items() for x in pair])
    return let(F.replace(value, F.lit(" "), F.lit("")), lambda x: (F.length(x) == F.try_element_at(lengths, F.substring(x, 1, 2))) & mod97(x))


def _small_parts(value: Column) -> Column:
    return F.forall(F.split(value, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(value, r"\."), lambda p: F.right(p, F.lit(3)).cast("int") <= 255)


def _luhn_card(value: Column) -> Column:
    return let(digits_of(value), lambda d: F.length(d).between(14, 19) & luhn(d))


def _ssn(value: Column) -> Column:
    area = F.substring(value, 1, 3)
    return ~area.isin("000", "666") & (area < "900") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000")


MAIL_CHARS = "A-Za-z0-9._%+-"
KINDS = [
    Kind(
        "email", lambda t: F.contains(t, F.lit("@")), rf"(?:(?<![{MAIL_CHARS}])|\G)[{MAIL_CHARS}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        rf"[{MAIL_CHARS}]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: F.lit(True), 80, MAIL_WORDS, [],
    ),
    Kind("ip", lambda t: t.rlike(r"[0-9]\.[0-9]"), r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", _small_parts, 60, NET_WORDS, NOT_NET_WORDS),
    Kind("card", lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", _luhn_card, 70, CARD_WORDS, NOT_PHONE_WORDS),
    Kind("phone", lambda t: F.contains(t, F.lit("+")), r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: F.length(digits_of(v)).between(10, 15), 70, PHONE_WORDS, NOT_PHONE_WORDS),
    Kind(
        "iban", lambda t: t.rlike(r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
        _iban_confirmed, 70, BANK_WORDS, [], base=False, edges=True,
    ),
    Kind(
        "phone_national", lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"), r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
        r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}", lambda v: F.lit(True), 40, PHONE_WORDS, NOT_PHONE_WORDS, base=False, edges=True,
    ),
    Kind(
        "ssn", lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"), r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", _ssn, 40, SSN_WORDS, NOT_PHONE_WORDS,
        base=False, edges=True,
    ),
]
RAISE, LOWER = 25, 25
BASE_KINDS = [k.name for k in KINDS if k.base]
SPAN = "struct<start:bigint,kind_no:int,end:bigint,kind:string,value:string,score:int>"


def _context(words: list[str]) -> str:
    return rf"(?:^|[^\p{{L}}])(?:{'|'.join(words)})(?:[^\p{{L}}]|$)"


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """``[0, v0, v0 + v1, ...]`` under an associative ``add`` with zero 0, one more than the values, by blocks."""
    zero = F.lit(0).cast("long")

    def within(x: Column) -> Column:
        return F.aggregate(x, F.array(zero), lambda a, v: F.concat(a, F.array(add(F.element_at(a, -1), v))))

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(x) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, BLOCK))

    def joined(parts: Column) -> Column:
        def offset(before: Column) -> Column:
            own = F.transform(parts, lambda p, b: F.transform(F.slice(within(p), 1, F.size(p)), lambda v: add(F.get(before, b), v)))
            return F.concat(F.flatten(own), F.slice(before, -1, 1))

        return let(within(F.transform(parts, lambda p: F.aggregate(p, zero, add))), offset)

    return F.when(F.size(values) < BLOCK, within(values)).otherwise(let(blocks(values), joined))


def _span(no: int, kind: Kind, hit: Column, before: Column, after: Column, end: Column) -> Column:
    """The span of a match between two gaps, null if it is not confirmed."""
    near = F.lower(F.concat(F.right(before, F.lit(BEFORE)), F.lit(" # "), F.left(after, F.lit(AFTER))))
    score = F.lit(kind.score) + F.when(near.rlike(_context(kind.raising)), RAISE).otherwise(0)
    if kind.lowering:
        score = score - F.when(near.rlike(_context(kind.lowering)), LOWER).otherwise(0)
    stands = kind.confirmed(hit)
    if kind.edges:
        stands = stands & ~F.right(before, F.lit(1)).rlike(r"[\p{L}0-9+]") & ~F.left(after, F.lit(1)).rlike(r"[\p{L}0-9]")
    fields = {"start": end - F.length(hit), "kind_no": F.lit(no), "end": end, "kind": F.lit(kind.name), "value": hit, "score": F.least(score, F.lit(100))}
    return F.when(stands, F.struct(*[v.alias(k) for k, v in fields.items()]))


def _spans_of(no: int, kind: Kind) -> Column:
    """The confirmed spans of one kind, in order, from the columns that ``with_spans`` lays out."""
    hits, gaps, ends = f"_hits_{no}", f"_gaps_{no}", f"_ends_{no}"
    spans = F.transform(hits, lambda h, i: _span(no, kind, h, F.get(gaps, i), F.get(gaps, i + 1), F.get(ends, i + 1)))
    return F.coalesce(F.when(F.col(gaps).isNotNull(), F.filter(spans, lambda s: s.isNotNull())), F.array().cast(f"array<{SPAN}>"))


def with_spans(docs: DataFrame, keep: list[Column], text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The columns ``keep`` and ``_base`` and ``_spans``: confirmed spans of the first four kinds, and all spans.

    Every step is a column of its own that the next one reads more than once,
    so the optimizer keeps it and it is computed once.
    """
    text, kinds = F.col("_pii_text"), list(enumerate(KINDS))
    proposed = docs.select(*keep, text_of(text_col).alias("_pii_text"))
    own = proposed.columns[:-1]
    proposed = proposed.select("*", *[F.when(k.guard(text), F.regexp_extract_all(text, F.lit(k.pattern), F.lit(0))).alias(f"_hits_{no}") for no, k in kinds])
    proposed = proposed.select("*", *[F.when(F.size(f"_hits_{no}") > 0, F.split(text, k.pattern, -1)).alias(f"_gaps_{no}") for no, k in kinds])
    length = lambda no: F.transform(f"_hits_{no}", lambda h, i: F.length(F.get(f"_gaps_{no}", i)).cast("long") + F.length(h))
    proposed = proposed.select("*", *[F.when(F.col(f"_gaps_{no}").isNotNull(), length(no)).alias(f"_steps_{no}") for no, _ in kinds])
    proposed = proposed.select("*", *[running(F.col(f"_steps_{no}"), lambda a, x: a + x).alias(f"_ends_{no}") for no, _ in kinds])
    proposed = proposed.select(*own, *[_spans_of(no, k).alias(f"_pii_{k.name}") for no, k in kinds])
    base = proposed.select(
        *own, F.sort_array(F.concat(*[f"_pii_{k}" for k in BASE_KINDS])).alias("_base"),
        F.concat(*[f"_pii_{k.name}" for k in KINDS if not k.base]).alias("_more"),
    )
    clear = lambda s: ~F.exists("_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter("_more", lambda s: (s["score"] >= rules.least) & clear(s))
    return base.select(*own, "_base", F.when(F.size("_more") > 0, F.sort_array(F.concat("_base", added))).otherwise(F.col("_base")).alias("_spans"))


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per span: id, kind, start, end (code points, end exclusive), value, score (0 to 100)."""
    s = with_spans(docs, [F.col(id_col).alias("_id")], text_col, rules).select(F.col("_id").alias(id_col), F.explode("_spans").alias("_s"))
    return s.select(id_col, *[F.col("_s")[c].alias(c) for c in ("kind", "start", "end", "value", "score")])


def redacted(docs: DataFrame, text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """All columns of the input; in the text each run of touching spans is replaced by ``[kind]`` of its first one.

    A text is read once for each of its spans.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]).alias("_row")

    def replaced(text: Column, spans: Column) -> Column:
        def built(covered: Column) -> Column:
            shown = lambda start, end: F.substring(text, start.cast("int") + 1, (end - start).cast("int"))
            runs = F.transform(spans, lambda s, i: F.when(s["start"] >= F.get(covered, i), F.concat(shown(F.get(covered, i), s["start"]), F.lit("["), s["kind"], F.lit("]"))))
            return F.concat(F.array_join(runs, ""), shown(F.element_at(covered, -1), F.length(text)))

        return let(running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x)), built)

    out = with_spans(docs, [row], text_col, rules)
    text = F.when(F.size("_spans") > 0, replaced(F.col("_row")[text_col], F.col("_spans"))).otherwise(F.col("_row")[text_col])
    return out.select(*[(text if c == text_col else F.col("_row")[c]).alias(c) for c in docs.columns])


def _digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: Rules = Rules()) -> DataFrame:
    """One row per document: id, confirmed spans of the first four kinds by number and digest, all spans, the highest score."""
    out = with_spans(docs, [F.col(id_col).alias("_id")], text_col, rules)
    count = lambda kind: F.size(F.filter("_base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        F.col("_id").alias(id_col), *[count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_digest(F.col("_base")), 256).alias("base_sha256"), _digest(F.col("_spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("_spans", lambda s: s["score"])), F.lit(0)).alias("max_score"),
    )


def _oracle() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    digits = "regexp_replace(h, '[^0-9]', '', 'g')"
    bare = "replace(h, ' ', '')"
    confirm = {
        "email": "true",
        "ip": "len(list_filter(string_split(h, '.'), lambda p: length(ltrim(p, '0')) <= 3 and cast(right(p, 3) as int) <= 255)) = 4",
        "card": f"length({digits}) between 14 and 19 and list_sum(list_transform(range(1, length({digits}) + 1), lambda i: case when (length({digits}) - i) % 2 = 0 then cast({digits}[i] as int) when cast({digits}[i] as int) > 4 then 2 * cast({digits}[i] as int) - 9 else 2 * cast({digits}[i] as int) end)) % 10 = 0",
        "phone": f"length({digits}) between 10 and 15",
        "iban": f"length({bare}) = case left(h, 2) {' '.join(f"when '{c}' then {n}" for c, n in IBAN_LENGTHS.items())} end and list_reduce(list_prepend(0, list_transform(string_split(substr({bare}, 5) || left({bare}, 4), ''), lambda c: case when c between '0' and '9' then cast(c as int) else ascii(c) - 55 end)), lambda a, v: (case when v < 10 then a * 10 + v else a * 100 + v end) % 97) = 1",
        "phone_national": "true",
        "ssn": "left(h, 3) not in ('000', '666') and left(h, 3) < '900' and substr(h, 5, 2) <> '00' and substr(h, 8, 4) <> '0000'",
    }
    parts = []
    for no, k in enumerate(KINDS):
        near = f"lower(right(gap, {BEFORE}) || ' # ' || left(next_gap, {AFTER}))"
        score = f"{k.score} + case when regexp_matches({near}, {quoted(_context(k.raising))}) then {RAISE} else 0 end"
        if k.lowering:
            score += f" - case when regexp_matches({near}, {quoted(_context(k.lowering))}) then {LOWER} else 0 end"
        edges = r" and not regexp_matches(right(gap, 1), '[\p{L}0-9+]') and not regexp_matches(left(next_gap, 1), '[\p{L}0-9]')" if k.edges else ""
        parts.append(f"""
  select doc_id, {no} as kind_no, '{k.name}' as kind, upto - length(h) as start, upto as stop, least({score}, 100) as score
  from (
    select *, sum(length(gap) + length(h)) over (partition by doc_id order by i) as upto from (
      select doc_id, i, hits[i] as h, gaps[i] as gap, gaps[i + 1] as next_gap from (
        select doc_id, hits, gaps, unnest(range(1, len(hits) + 1)) as i from (
          select doc_id, regexp_extract_all(t, {quoted(k.plain)}) as hits, string_split_regex(t, {quoted(k.plain)}) as gaps from d where regexp_matches(t, {quoted(k.plain)}))))
  ) where {confirm[k.name]}{edges}""")
    base = ", ".join(f"'{k}'" for k in BASE_KINDS)
    return f"""
with d as (
  select doc_id, coalesce(text, '') as t from documents
), s as ({" union all ".join(parts)}
), b as (
  select * from s where kind in ({base})
), e as (
  select * from b union all
  select * from s where kind not in ({base}) and score >= {Rules().least}
    and not exists (select 1 from b where b.doc_id = s.doc_id and b.start < s.stop and s.start < b.stop)
), nb as (
  select doc_id, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE_KINDS)},
    string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, kind_no) as joined from b group by doc_id
), ne as (
  select doc_id, string_agg(kind || ':' || cast(start as bigint) || ':' || cast(stop as bigint), ',' order by start, kind_no) as joined, max(score) as max_score from e group by doc_id
)
select d.doc_id, {", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in BASE_KINDS)}, sha256(coalesce(nb.joined, '')) as base_sha256,
  coalesce(ne.joined, '') as spans, cast(coalesce(max_score, 0) as int) as max_score
from d left join nb on d.doc_id = nb.doc_id left join ne on d.doc_id = ne.doc_id
"""


ORACLE = _oracle()
