"""Raw feed payloads -> article rows (SRC-7..10, DT-1, DT-2, STR-5, STR-7).

Input is a landing table of raw payloads, one row per fetch:
``(payload_id, ticker, payload, fetched_at)``. Fetching itself is out of
scope; parsing is JVM-side (``from_xml``, VARIANT paths, regex), exploding each
payload's items with their position so per-payload caps keep the vendor's
order. Every parser returns the same columns:
``payload_id, ticker, position, title, body, source, url, published_ts``
(``published_ts`` NULL when the time could not be parsed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import strip_html
from ..functions.text import py_strip, url_host

# Payload shapes (fixed values): list keys tried in order, then wrapper keys.
SEARCH_LIST_KEYS = ["results", "items", "data", "articles", "news", "news_results", "organic", "organic_results"]
SEARCH_WRAPPER_KEYS = ["result", "parsed", "response", "body"]
SEARCH_BODY_KEYS = ["description", "snippet", "summary", "body", "content"]
RSS_SCHEMA = (
    "channel struct<item: array<struct<title: string, link: string, description: string, "
    "source: string, pubDate: string>>>"
)
RELATIVE_RE = r"(?i)(\d+)\s+(minute|minutes|min|mins|hour|hours|hr|hrs|day|days|week|weeks)\s+ago"
ITEMS = "array<variant>"
#: Levels of envelopes that are opened; deeper ones become error rows, never silence.
UNWRAP_DEPTH = 8


def iso_utc(ts: Column) -> Column:
    """Timestamp -> ``YYYY-MM-DDTHH:MM:SS+00:00`` (UTC, whole seconds)."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def parse_rfc822(v: Column) -> Column:
    """RFC-822 date (``Fri, 26 Jun 2026 15:52:03 GMT`` / ``+0200``); the weekday is
    dropped before parsing (Spark cannot parse ``EEE``)."""
    body = F.regexp_replace(F.trim(v), r"^[A-Za-z]{3},\s*", "")
    # two-digit years mean 1969 to 2068; missing seconds are zero
    body = F.regexp_replace(body, r"^(\d{1,2}\s+[A-Za-z]{3})\s+([0-5]\d|6[0-8])\s", "$1 20$2 ")
    body = F.regexp_replace(body, r"^(\d{1,2}\s+[A-Za-z]{3})\s+(69|[7-9]\d)\s", "$1 19$2 ")
    body = F.regexp_replace(body, r"\s(\d{1,2}:\d{2})\s", " $1:00 ")
    return F.coalesce(
        F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm:ss z")),
        F.try_to_timestamp(body, F.lit("d MMM yyyy HH:mm:ss Z")),
    )


def parse_iso(v: Column) -> Column:
    """ISO-8601 with ``Z`` or an offset; naive values are UTC (session zone)."""
    return F.trim(v).try_cast("timestamp")


def parse_relative(v: Column, as_of: Column) -> Column:
    """``N minutes/hours/days/weeks ago`` and ``yesterday`` relative to ``as_of``."""
    n = F.regexp_extract(v, RELATIVE_RE, 1).try_cast("int")
    unit = F.lower(F.regexp_extract(v, RELATIVE_RE, 2))
    secs = (
        F.when(unit.startswith("min"), n * 60)
        .when(unit.startswith("h"), n * 3600)
        .when(unit.startswith("day"), n * 86400)
        .when(unit.startswith("week"), n * 604800)
    )
    rel = F.when(n.isNotNull(), F.timestamp_add("SECOND", -secs, as_of))
    return F.coalesce(rel, F.when(F.lower(F.trim(v)) == "yesterday", F.timestamp_add("DAY", F.lit(-1), as_of)))


def coerce_published(v: Column, as_of: Column) -> Column:
    """DT-1: RFC-822, else ISO, else relative, else NULL; truncated to seconds."""
    ts = F.coalesce(parse_rfc822(v), parse_iso(v), parse_relative(v, as_of))
    return F.when(F.coalesce(F.trim(v), F.lit("")) != "", F.date_trunc("second", ts))


# ----------------------------------------------------------------- SRC-7 RSS
def parse_rss(raw: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """SRC-7: RSS items. ``pages`` (url, html) supplies fetched article pages;
    their extracted body (STR-4) replaces the description when non-empty."""
    items = raw.select(
        "payload_id", "ticker", F.posexplode(F.from_xml("payload", RSS_SCHEMA)["channel"]["item"]).alias("position", "it")
    )
    link = py_strip(F.col("it.link"))
    out = items.select(
        "payload_id", "ticker", "position",
        py_strip(F.col("it.title")).alias("title"),
        link.alias("url"),
        strip_html(F.col("it.description")).alias("description"),
        py_strip(F.coalesce(F.nullif(F.col("it.source"), F.lit("")), F.nullif(url_host(link), F.lit("")),
                            F.lit("google_news"))).alias("source"),
        F.date_trunc("second", parse_rfc822(F.col("it.pubDate"))).alias("published_ts"),
    )
    if pages is not None:
        from ..functions.html import article_body

        bodies = pages.select(F.col("url").alias("_u"), article_body(F.col("html")).alias("_page_body"))
        out = out.join(bodies, out.url == bodies._u, "left").drop("_u")
        body = F.when(F.coalesce(F.col("_page_body"), F.lit("")) != "", F.col("_page_body")).otherwise(F.col("description"))
    else:
        body = F.col("description")
    return out.select("payload_id", "ticker", "position", "title", body.alias("body"), "source", "url", "published_ts")


# ---------------------------------------------------------- SRC-8/9 search API
def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _is_array(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("ARRAY")


def _unwrap(v: Column) -> Column:
    """A wrapper value: objects and lists as they are, strings that hold one parsed, others NULL
    (``v`` is read once: an object's JSON text parses back to itself)."""
    parsed = F.try_parse_json(F.try_variant_get(v, "$", "string"))
    return F.when(_is_object(parsed) | _is_array(parsed), parsed)


def _objects(arr: Column) -> Column:
    return F.filter(arr, lambda x: _is_object(x))


def _keyed(v: Column) -> Column:
    return F.coalesce(*[F.try_variant_get(v, f"$.{k}", ITEMS) for k in SEARCH_LIST_KEYS])


def _own_items(v: Column) -> Column:
    """The items that a node holds itself: a list, or an object's first list key."""
    return F.coalesce(_objects(F.try_variant_get(v, "$", ITEMS)), _objects(_keyed(v)))


def _children(node: Column) -> Column:
    """The wrappers within a node, in the order of the wrapper keys; a node is (path, v)."""
    kids = [
        F.struct(F.concat(node["path"], F.lit(str(i))).alias("path"), _unwrap(F.try_variant_get(node["v"], f"$.{k}", "variant")).alias("v"))
        for i, k in enumerate(SEARCH_WRAPPER_KEYS)
    ]
    return F.filter(F.array(*kids), lambda n: n["v"].isNotNull())


def with_search_items(df: DataFrame, payload: Column, out: str = "items", depth: int = UNWRAP_DEPTH) -> DataFrame:
    """SRC-8: add ``out`` = the item list of a search envelope (array<variant>,
    empty if none) and ``<out>_error`` (NULL, or why nothing can be read).

    A list payload is the list; an object takes the first of the list keys
    holding a list, else the first wrapper (objects, lists, or strings holding
    either) whose content yields items, depth first. Each level of wrappers
    is one array column of (path, value), so the plan grows by one column a
    level; the smallest path among the nodes with items is the depth-first
    one. A payload with wrappers below ``depth`` and no items is an error.
    """
    df = df.withColumn("_root", F.try_parse_json(payload))
    df = df.withColumn("_level0", F.filter(F.array(F.struct(F.lit("").alias("path"), F.col("_root").alias("v"))), lambda n: n["v"].isNotNull()))
    levels = ["_level0"]
    for level in range(depth):
        df = df.withColumn(f"_level{level + 1}", F.flatten(F.transform(levels[-1], _children)))
        levels.append(f"_level{level + 1}")
    held = F.transform(F.flatten(F.array(*levels)), lambda n: F.struct(n["path"].alias("path"), _own_items(n["v"]).alias("items")))
    df = df.withColumn("_held", F.filter(held, lambda n: F.size(n["items"]) > 0))
    first = F.array_min(F.transform("_held", lambda n: n["path"]))
    df = df.withColumn("_first", first)
    found = F.try_element_at(F.filter("_held", lambda n: n["path"] == F.col("_first")), F.lit(1))["items"]
    deeper = F.size(F.flatten(F.transform(levels[-1], _children))) > 0
    error = F.when(F.col("_root").isNull(), F.lit("payload is not JSON")).when(
        F.col("_first").isNull() & deeper, F.lit(f"envelopes nested deeper than {depth}")
    )
    df = df.withColumn(out, F.coalesce(found, F.array().cast(ITEMS))).withColumn(f"{out}_error", error)
    return df.drop("_root", "_held", "_first", *levels)


def search_errors(raw: DataFrame) -> DataFrame:
    """(payload_id, ticker, error) of search payloads that cannot be read."""
    out = with_search_items(raw.select("payload_id", "ticker", "payload"), F.col("payload"), "_items")
    return out.filter(F.col("_items_error").isNotNull()).select("payload_id", "ticker", F.col("_items_error").alias("error"))


def rss_errors(raw: DataFrame) -> DataFrame:
    """(payload_id, ticker, error) of RSS payloads that are no XML."""
    checked = F.from_xml("payload", f"{RSS_SCHEMA}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    bad = raw.select("payload_id", "ticker", checked.alias("x")).filter(F.col("x").isNull() | F.col("x._corrupt").isNotNull())
    return bad.select("payload_id", "ticker", F.lit("payload is not XML").alias("error"))


def _vstr(item: Column, key: str) -> Column:
    return F.try_variant_get(item, f"$.{key}", "string")


def _first_truthy(*cols: Column) -> Column:
    """Python ``a or b or ''`` over strings: the first non-empty value."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def search_body(cols: dict[str, Column]) -> Column:
    """STR-5: the first of description/snippet/summary/body/content that holds
    anything once stripped by STR-3 (entities of blanks alone are nothing);
    else the title/headline."""
    stripped = [F.nullif(strip_html(cols[k]), F.lit("")) for k in SEARCH_BODY_KEYS]
    return F.coalesce(*stripped, py_strip(_first_truthy(cols["title"], cols["headline"])))


ITEM_KEYS = ["title", "headline", "url", "link", "source", "domain", "published_at", "date", "published",
             *SEARCH_BODY_KEYS]


def parse_search(raw: DataFrame, as_of: Column) -> DataFrame:
    """SRC-8/9: search-API payloads -> article rows; items without title or link are dropped.

    The per-item values leave the VARIANT in one generated struct, which keeps
    later filters from being pushed into its wide expressions."""
    items = with_search_items(raw.select("payload_id", "ticker", "payload"), F.col("payload"), "_items")
    items = items.select("payload_id", "ticker", F.posexplode("_items").alias("position", "it"))
    values = F.struct(*[_vstr(F.col("it"), k).alias(f"_{k}") for k in ITEM_KEYS])
    flat = items.select("payload_id", "ticker", "position", F.inline(F.array(values)))
    c = {k: F.col(f"_{k}") for k in ITEM_KEYS}
    link = py_strip(_first_truthy(c["url"], c["link"]))
    src = py_strip(_first_truthy(c["source"], c["domain"], url_host(link), F.lit("brightdata")))
    pub = coerce_published(_first_truthy(c["published_at"], c["date"], c["published"]), as_of)
    rows = F.struct(
        py_strip(_first_truthy(c["title"], c["headline"])).alias("title"),
        search_body(c).alias("body"), src.alias("source"), link.alias("url"), pub.alias("published_ts"),
    )
    out = flat.select("payload_id", "ticker", "position", rows.alias("r")).select("payload_id", "ticker", "position", F.inline(F.array("r")))
    return out.filter((F.col("title") != "") & (F.col("url") != ""))


# ------------------------------------------------------- SRC-10 second vendor
def parse_results(raw: DataFrame, body_chars: int = 4000) -> DataFrame:
    """SRC-10/DT-2: ``{"results": [...]}`` payloads; time from published_date |
    published_at | date (ISO only), else the fetch time."""
    v = F.try_parse_json("payload")
    arr = F.coalesce(_objects(F.try_variant_get(v, "$.results", ITEMS)), F.array().cast(ITEMS))
    items = raw.select("payload_id", "ticker", "fetched_at", F.posexplode(arr).alias("position", "it"))
    it = F.col("it")
    url = py_strip(_first_truthy(_vstr(it, "url")))
    title = py_strip(_first_truthy(_vstr(it, "title")))
    body = py_strip(_first_truthy(_vstr(it, "raw_content"), _vstr(it, "content"), _vstr(it, "title")))
    src = py_strip(_first_truthy(_vstr(it, "source"), _vstr(it, "domain")))
    host = F.when(F.contains(url, F.lit("://")), F.split(url, "/").getItem(2)).otherwise(F.lit("tavily"))
    pub = F.coalesce(*[parse_iso(F.nullif(F.trim(_vstr(it, k)), F.lit(""))) for k in ("published_date", "published_at", "date")],
                     F.col("fetched_at"))
    return items.select(
        "payload_id", "ticker", "position", title.alias("title"), F.substring(body, 1, body_chars).alias("body"),
        F.when(src != "", src).otherwise(host).alias("source"), url.alias("url"),
        F.date_trunc("second", pub).alias("published_ts"),
    )
