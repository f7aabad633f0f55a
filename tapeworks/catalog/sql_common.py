"""DuckDB text of the adapter views (FIXTURES.md part B), shared by oracles."""

OHLCV_CTE = """
ohlcv as (
  select upper(p_brand) as ticker, cast(l_shipdate as date) as date,
         first(l_extendedprice order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as open,
         max(l_extendedprice) as high, min(l_extendedprice) as low,
         last(l_extendedprice order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) as close,
         sum(l_quantity) as volume
  from lineitem join part on l_partkey = p_partkey
  group by 1, 2
)"""

NEWS_CTE = """
news as (
  select 'BRAND#' || cast(doc_id % 25 + 1 as varchar) as ticker,
         timestamp '1995-01-02 00:00:00' + to_days(cast((doc_id * 7919) % 2400 as integer))
           + to_seconds(cast((doc_id * 104729) % 86400 as integer)) as published_at,
         substring(text, 1, 80) as title, text as body, source,
         'https://' || source || '.example.com/' || cast(doc_id as varchar) as url,
         doc_id
  from documents
)"""


def guarded(agg: str, x: str, n: int, w: str = "w") -> str:
    frame = f"(partition by ticker order by date rows between {n - 1} preceding and current row)"
    return f"case when count({x}) over {frame} = {n} then {agg}({x}) over {frame} end"


def rel(num: str, den: str) -> str:
    return f"({num} / nullif({den}, 0) - 1)"


def features_sql(roles=("BRAND#1", "BRAND#2")) -> str:
    """DuckDB text of DS-1 over the ``ohlcv`` CTE (as a CTE named ``features``)."""
    q, s = roles
    rets = ",\n    ".join(f"{rel('close', f'lag(close, {n}) over w')} as ret_{n}d" for n in (1, 3, 5, 10, 20, 60))
    mas = ",\n    ".join(f"{guarded('avg', 'close', n)} as ma{n}" for n in (10, 20, 50, 200))
    fut = ",\n    ".join(f"lead(close, {h}) over w as future_close_{h}d" for h in (1, 5, 10, 20))
    vols = ",\n    ".join(f"{guarded('stddev_samp', 'ret_1d', n)} as volatility_{n}d" for n in (5, 20, 60))
    cvm = ",\n    ".join(f"{rel('close', f'ma{n}')} as close_vs_ma{n}" for n in (10, 20, 50, 200))
    fr = ",\n    ".join(f"{rel(f'future_close_{h}d', 'close')} as future_ret_{h}d" for h in (1, 5, 10, 20))
    return f"""
f1 as (
  select ticker, date, open, high, low, close, volume,
    {rets},
    {guarded('avg', 'volume', 20)} as volume_ma20,
    {guarded('stddev_samp', 'volume', 20)} as volume_std20,
    {mas},
    (high - low) / nullif(close, 0) as high_low_range,
    {rel('close', 'open')} as close_open_return,
    {guarded('max', 'high', 20)} as rolling_high_20,
    {guarded('min', 'low', 20)} as rolling_low_20,
    {fut}
  from ohlcv window w as (partition by ticker order by date)
),
f2 as (select *, {vols} from f1),
f3 as (
  select *,
    coalesce((volume - volume_ma20) / nullif(volume_std20, 0), 0.0) as volume_z20,
    coalesce(volume / nullif(volume_ma20, 0), 0.0) as volume_ratio_20,
    {cvm},
    {rel('close', 'rolling_high_20')} as close_vs_20d_high,
    {rel('close', 'rolling_low_20')} as close_vs_20d_low,
    coalesce(cast(abs(ret_1d) > 2.5::double * volatility_20d as integer), 0) as rapid_move,
    {fr}
  from f2
),
f4 as (
  select *,
    case when future_ret_5d is null then null
         when future_ret_5d <= -0.05::double then 0.0
         when future_ret_5d <= -0.01::double then 1.0
         when future_ret_5d <= 0.01::double then 2.0
         when future_ret_5d <= 0.05::double then 3.0 else 4.0 end::double as future_ret_5d_bucket
  from f3
),
bench_rows as (
  select ticker, date,
    {rel('close', 'lag(close, 1) over w')} as ret_1d,
    {rel('close', 'lag(close, 5) over w')} as ret_5d,
    {rel('close', 'lag(close, 20) over w')} as ret_20d
  from ohlcv where ticker in ('{q}', '{s}') window w as (partition by ticker order by date)
),
bench as (
  select date,
    max(case when ticker = '{q}' then ret_1d end) as qqq_ret_1d,
    max(case when ticker = '{q}' then ret_5d end) as qqq_ret_5d,
    max(case when ticker = '{q}' then ret_20d end) as qqq_ret_20d,
    max(case when ticker = '{s}' then ret_1d end) as spy_ret_1d,
    max(case when ticker = '{s}' then ret_5d end) as spy_ret_5d,
    max(case when ticker = '{s}' then ret_20d end) as spy_ret_20d
  from bench_rows group by date
),
features as (
  select f4.*, bench.qqq_ret_1d, bench.qqq_ret_5d, bench.qqq_ret_20d,
         bench.spy_ret_1d, bench.spy_ret_5d, bench.spy_ret_20d,
         f4.ret_5d - bench.qqq_ret_5d as stock_minus_qqq_ret_5d,
         f4.ret_5d - bench.spy_ret_5d as stock_minus_spy_ret_5d
  from f4 left join bench on f4.date = bench.date
)"""


def present_sql(sql: str, keep: list[str], digits: int = 6) -> str:
    """Round every column except ``keep`` (non-double columns) to ``digits``."""
    names = ", ".join(f"'{c}'" for c in keep)
    return (
        f"select round(columns(lambda c: c not in ({names})), {digits}), "
        f"columns(lambda c: c in ({names})) from ({sql}) as _q"
    )


def strip_sql(x: str) -> str:
    """Python ``str.strip()`` in DuckDB (same character class as the Spark side)."""
    from ..functions.text import WS_CLASS

    return f"regexp_replace(coalesce(cast({x} as varchar), ''), '^{WS_CLASS}+|{WS_CLASS}+$', '', 'g')"


def predictions_cte(horizon_days: int = 5) -> str:
    from ..functions.dates import bday_offset_sql

    pr = "((((o_orderkey * 7919) % 2001) - 1000)::double / 10000.0::double)"
    sc = "((o_orderkey % 100)::double / 100.0::double)"
    label = (f"case when o_orderkey % 50 = 0 then null when {sc} >= 0.75::double then 'high' "
             f"when {sc} >= 0.6::double then 'medium' when {sc} >= 0.45::double then 'medium-low' else 'low' end")
    return f"""
predictions as (
  select cast(o_orderkey as varchar) as prediction_id,
         'BRAND#' || cast(o_custkey % 25 + 1 as varchar) as ticker,
         cast(o_orderdate as date) as as_of_date,
         '{horizon_days}d' as horizon,
         {bday_offset_sql('cast(o_orderdate as date)', horizon_days)} as target_date,
         o_totalprice as current_close,
         {pr} as predicted_return,
         o_totalprice * (1.0::double + {pr}) as predicted_close,
         o_totalprice * (1.0::double + {pr} - 0.05::double) as bear_case,
         o_totalprice * (1.0::double + {pr} + 0.05::double) as bull_case,
         {sc} as confidence_score,
         {label} as confidence,
         'synthetic' as model_name, 'v0' as model_version
  from orders
)"""


def recent_news_sql(anchors: str, anchor_cols: str, anchor_day: str, n: int, lookback: int, body_chars: int) -> str:
    """DuckDB text of the trailing top-n news operator, flattened like the Spark side."""
    return f"""
items as (
  select ticker, cast(published_at as date) as pday, published_at, url,
         {strip_sql('title')} as title, {strip_sql('source')} as source,
         substring({strip_sql('body')}, 1, {body_chars}) as body_excerpt
  from news
),
anchors as ({anchors}),
cand as (
  select a.ticker, a.{anchor_day} as aday, i.url, i.title, i.body_excerpt,
         row_number() over (partition by a.ticker, a.{anchor_day}
                            order by i.pday desc, i.published_at desc, i.url asc) as r
  from (select distinct ticker, {anchor_day} from anchors) a
  join items i on a.ticker = i.ticker and i.pday between a.{anchor_day} - {lookback} and a.{anchor_day}
),
packed as (
  select ticker, aday, cast(count(*) as integer) as n_items,
         string_agg(url, ' ' order by r) as item_urls,
         string_agg(title, chr(10) order by r) as item_titles,
         string_agg(body_excerpt, chr(10) order by r) as item_excerpts
  from cand where r <= {n} group by ticker, aday
)
select {anchor_cols}, coalesce(p.n_items, 0) as n_items, coalesce(p.item_urls, '') as item_urls,
       coalesce(p.item_titles, '') as item_titles, coalesce(p.item_excerpts, '') as item_excerpts
from anchors a left join packed p on a.ticker = p.ticker and a.{anchor_day} = p.aday"""


def any_sql(low: str, words) -> str:
    return "(" + " or ".join(f"contains({low}, '{w}')" for w in words) + ")"


def count_sql(low: str, words) -> str:
    return "(" + " + ".join(f"cast(contains({low}, '{w}') as integer)" for w in dict.fromkeys(words)) + ")"


def catalyst_sql(low: str, topics: dict, default: str = "general_news") -> str:
    whens = " ".join(f"when {any_sql(low, ws)} then '{t}'" for t, ws in topics.items())
    return f"(case {whens} else '{default}' end)"


def heuristic_events_sql() -> str:
    """DuckDB text of DS-2/DS-3 over ``news`` as CTEs ``payloads`` and ``events``."""
    from ..functions import lexicons as lx

    low = "low"
    p, n = count_sql(low, lx.POSITIVE_WORDS), count_sql(low, lx.NEGATIVE_WORDS)
    topic_cols = ",\n    ".join(f"cast({any_sql(low, ws)} as bigint) as {t}_count" for t, ws in lx.TOPIC_KEYWORDS.items())
    return f"""
texts as (
  select doc_id, upper(ticker) as ticker, cast(published_at as date) as date,
         {strip_sql("coalesce(title, '') || ' ' || coalesce(body, '')")} as text
  from news
),
scored as (
  select *, {p} as p, {n} as n from (select *, lower(text) as low from texts)
),
payloads as (
  select doc_id, ticker, date, text, low,
    case when p + n = 0 then 0.0::double else (p - n)::double / (p + n)::double end as raw_score,
    {catalyst_sql(low, lx.TOPIC_KEYWORDS)} as catalyst_type,
    list_filter([case when {any_sql(low, lx.LEGAL_FLAG_WORDS)} then 'legal_or_regulatory' end,
                 case when contains(low, 'guidance') and {any_sql(low, lx.GUIDANCE_CUT_WORDS)} then 'guidance_cut' end],
                lambda x: x is not null) as risk_flags,
    case when {any_sql(low, lx.LONG_HORIZON_WORDS)} then '5_20_trading_days' else '1_5_trading_days' end as likely_horizon
  from scored
),
events as (
  select doc_id, ticker, date,
    1.0::double as news_count,
    round(raw_score, 4) as avg_sentiment_stub,
    greatest(round(raw_score, 4), 0.0::double) as max_positive_sentiment_stub,
    least(round(raw_score, 4), 0.0::double) as max_negative_sentiment_stub,
    1.0::double as company_specific_score,
    0.0::double as macro_relevance_score,
    0.55::double as novelty_score,
    least(1.0::double, abs(round(raw_score, 4)) * 0.5::double + 0.35::double * 0.5::double) as materiality_score,
    0.35::double as event_confidence_score,
    cast(len(risk_flags) as bigint) as risk_flag_count,
    {topic_cols}
  from payloads
)"""


DAILY_AGG_SQL = """
  select ticker, date,
    sum(news_count) as news_count, sum(earnings_count) as earnings_count, sum(guidance_count) as guidance_count,
    sum(ai_count) as ai_count, sum(lawsuit_count) as lawsuit_count, sum(analyst_count) as analyst_count,
    sum(regulatory_count) as regulatory_count, sum(risk_flag_count) as risk_flag_count,
    avg(avg_sentiment_stub) as avg_sentiment_stub, avg(company_specific_score) as company_specific_score,
    avg(macro_relevance_score) as macro_relevance_score, avg(event_confidence_score) as event_confidence_score,
    max(max_positive_sentiment_stub) as max_positive_sentiment_stub, max(novelty_score) as novelty_score,
    max(materiality_score) as materiality_score, min(max_negative_sentiment_stub) as max_negative_sentiment_stub
  from events group by ticker, date"""


DRIVER_SPLIT_SQL = ("2000-01-01", "2000-12-31", "2001-01-01")


def model_frame_sql() -> str:
    """``model_frame``: prepared DS-1 rows (CTE over ``features``)."""
    from ..schemas import PRICE_FEATURE_COLUMNS

    feats = ", ".join(f"coalesce({c}, 0.0::double) as {c}" for c in PRICE_FEATURE_COLUMNS)
    v0, v1, t0 = DRIVER_SPLIT_SQL
    return f"""
model_frame as (
  select ticker, date, close, future_ret_5d, {feats},
    case when date < date '{v0}' then 'train'
         when date >= date '{v0}' and date <= date '{v1}' then 'validation'
         when date >= date '{t0}' then 'test' end as split
  from features
  where ticker is not null and date is not null and close is not null and future_ret_5d is not null
)"""


def score_sql(coefs: dict) -> str:
    out = "0.0::double"
    for c, w in coefs.items():
        out = f"({out} + {float(w)!r}::double * coalesce({c}, 0.0::double))"
    return out


def scored_sql(models) -> str:
    parts = " union all ".join(
        f"select '{n}' as model_name, '{v}' as model_version, *, {score_sql(c)} as prediction from model_frame"
        for n, v, c in models
    )
    return f"scored as ({parts})"


def py_float_sql(x: str, digits: int = 4) -> str:
    return (f"coalesce(regexp_replace(regexp_replace(printf('%.{digits}f', cast({x} as double)), '0+$', ''), "
            f"'\\.$', '.0'), 'NaN')")


def fixed_sql(x: str, digits: int) -> str:
    return f"coalesce(printf('%.{digits}f', cast({x} as double)), 'nan')"


def jstr(x: str) -> str:
    return f"('\"' || {x} || '\"')"


def jbool(x: str) -> str:
    return f"(case when {x} then 'true' else 'false' end)"


def jlist(x: str) -> str:
    return f"('[' || array_to_string(list_transform({x}, lambda v: '\"' || v || '\"'), ', ') || ']')"


def jobject(fields) -> str:
    parts = []
    for i, (k, v) in enumerate(sorted(fields, key=lambda kv: kv[0])):
        parts.append(f"'{'' if i == 0 else ', '}\"{k}\": ' || {v}")
    return "('{' || " + " || ".join(parts) + " || '}')"


def pystr_sql(x: str) -> str:
    esc = (f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), "
           f"chr(9), '\\t')")
    return (f"(case when contains({x}, '''') and not contains({x}, '\"') then '\"' || {esc} || '\"' "
            f"else '''' || replace({esc}, '''', '\\''') || '''' end)")


def pylist_sql(x: str) -> str:
    return f"('[' || array_to_string(list_transform({x}, lambda v: {pystr_sql('v')}), ', ') || ']')"
