"""DuckDB oracle text for every registered query that has one."""

from __future__ import annotations

from .sql_common import (
    DAILY_AGG_SQL, NEWS_CTE, OHLCV_CTE, features_sql, heuristic_events_sql, predictions_cte, present_sql, recent_news_sql,
)

ORACLES: dict[str, str] = {}

ORACLES["ds_1_feature_panel"] = present_sql(
    f"with {OHLCV_CTE}, {features_sql()} select * from features", ["ticker", "date", "rapid_move"]
)

_CTX = "f.ret_1d, f.ret_5d, f.volatility_20d, f.future_ret_1d, f.future_ret_5d, f.future_ret_20d"

ORACLES["join_4_asof_backward"] = present_sql(
    f"""with {OHLCV_CTE}, {features_sql()}, {NEWS_CTE}
    select n.doc_id, n.ticker, n.published_at, f.date as asof_date, {_CTX}
    from news n asof left join features f
      on n.ticker = f.ticker and cast(n.published_at as date) >= f.date""",
    ["doc_id", "ticker", "published_at", "asof_date"],
)

ORACLES["join_6_asof_forward"] = present_sql(
    f"""with {OHLCV_CTE}, {predictions_cte()}
    select p.prediction_id, p.ticker, p.target_date,
           case when o.date < p.target_date + 7 then o.date end as actual_date,
           case when o.date < p.target_date + 7 then o.close end as actual_close
    from predictions p asof left join ohlcv o on p.ticker = o.ticker and p.target_date <= o.date""",
    ["prediction_id", "ticker", "target_date", "actual_date"],
)

ORACLES["join_7_trailing_news"] = f"""with {NEWS_CTE}, {recent_news_sql(
    "select distinct ticker, cast(published_at as date) as date from news", "a.ticker, a.date", "date", 3, 7, 220)}"""

ORACLES["join_8_serving_news"] = f"""with {NEWS_CTE}, {predictions_cte()}, {recent_news_sql(
    "select prediction_id, ticker, as_of_date from predictions", "a.prediction_id, a.ticker, a.as_of_date",
    "as_of_date", 4, 7, 400)}"""

_EV = f"with {NEWS_CTE}, {heuristic_events_sql()}"
ORACLES["ds_2_heuristic_payload"] = present_sql(
    f"""{_EV} select doc_id,
      case when raw_score > 0.15::double then 'positive' when raw_score < -0.15::double then 'negative'
           else 'neutral' end as sentiment,
      round(raw_score, 4) as sentiment_score, catalyst_type,
      array_to_string(risk_flags, ',') as risk_flags, likely_horizon
    from payloads""",
    ["doc_id", "sentiment", "catalyst_type", "risk_flags", "likely_horizon"],
)
_EVKEEP = ["ticker", "date", "earnings_count", "guidance_count", "ai_count", "lawsuit_count", "analyst_count",
           "regulatory_count", "risk_flag_count"]
ORACLES["ds_3_article_events"] = present_sql(f"{_EV} select * from events", ["doc_id", *_EVKEEP])
ORACLES["agg_1_daily_events"] = present_sql(
    f"{_EV}, daily as ({DAILY_AGG_SQL}) select ticker, date, {', '.join(f'cast({c} as bigint) as {c}' if c in _EVKEEP else c for c in ['news_count','earnings_count','guidance_count','ai_count','lawsuit_count','analyst_count','regulatory_count','risk_flag_count'])}, "
    "avg_sentiment_stub, company_specific_score, macro_relevance_score, event_confidence_score, "
    "max_positive_sentiment_stub, novelty_score, materiality_score, max_negative_sentiment_stub from daily",
    _EVKEEP,
)
_NF = ["news_count", "avg_sentiment_stub", "max_positive_sentiment_stub", "max_negative_sentiment_stub",
       "earnings_count", "guidance_count", "ai_count", "lawsuit_count", "analyst_count", "regulatory_count",
       "company_specific_score", "macro_relevance_score", "novelty_score", "materiality_score",
       "event_confidence_score", "risk_flag_count"]
ORACLES["join_3_dense_news_features"] = present_sql(
    f"""{_EV}, {OHLCV_CTE}, daily as ({DAILY_AGG_SQL}),
    keys as (select distinct ticker, date from ohlcv)
    select k.ticker, k.date, {', '.join(f'coalesce(cast(d.{c} as double), 0.0) as {c}' for c in _NF)}
    from keys k left join daily d on k.ticker = d.ticker and k.date = d.date""",
    ["ticker", "date"],
)
ORACLES["agg_9_distinct_panel_keys"] = f"with {OHLCV_CTE} select distinct ticker, date from ohlcv"

# ------------------------------------------------------------- evaluation
from ..schemas import PRICE_FEATURE_COLUMNS  # noqa: E402
from .queries import AS_OF, MODELS  # noqa: E402
from .sql_common import model_frame_sql, scored_sql  # noqa: E402

_MF = f"with {OHLCV_CTE}, {features_sql()}, {model_frame_sql()}"
ORACLES["prj_3_model_frame"] = present_sql(
    f"{_MF} select ticker, date, close, future_ret_5d, {', '.join(PRICE_FEATURE_COLUMNS)} from model_frame",
    ["ticker", "date"],
)
ORACLES["prj_5_split_and_weights"] = present_sql(
    f"""{_MF} select ticker, date, split,
      greatest(0.2::double, least(1.0::double,
        pow(0.5::double, greatest(date_diff('day', date, (select max(date) from model_frame)), 0)::double / 180.0::double)))
        as weight
    from model_frame""",
    ["ticker", "date", "split"],
)
_SC = f"{_MF}, {scored_sql(MODELS)}"
ORACLES["ml_2_linear_scores"] = present_sql(
    f"{_SC} select model_name, model_version, ticker, date, split, prediction from scored",
    ["model_name", "model_version", "ticker", "date", "split"],
)
ORACLES["agg_5_regression_metrics"] = present_sql(
    f"""{_SC},
    ranked as (
      select model_name, model_version, split, future_ret_5d as y, prediction as p,
        row_number() over (partition by model_name, model_version, split order by prediction, ticker, date) as rk,
        count(*) over (partition by model_name, model_version, split) as cnt
      from scored
    )
    select model_name, model_version, split, count(*) as n,
      avg(abs(y - p)) as mae, sqrt(avg((y - p) * (y - p))) as rmse,
      case when count(*) * var_pop(y) > 0 then 1.0::double - sum((y - p) * (y - p)) / (count(*) * var_pop(y))
           when sum((y - p) * (y - p)) = 0 then 1.0::double else 0.0::double end as r2,
      avg(case when sign(y) = sign(p) then 1.0::double else 0.0::double end) as direction_accuracy,
      avg(case when rk > cnt - greatest(1, floor(cnt * 0.1::double)) then y end) as top_decile_avg_forward_return,
      avg(case when rk <= greatest(1, floor(cnt * 0.1::double)) then y end) as bottom_decile_avg_forward_return
    from ranked group by model_name, model_version, split""",
    ["model_name", "model_version", "split", "n"],
)
ORACLES["agg_8_training_window"] = (
    f"{_MF} select split, min(date) as start_date, max(date) as end_date, count(*) as rows from model_frame group by split"
)
ORACLES["agg_7_rebalance_dates"] = (
    f"{_MF} select cast(date_trunc('week', date) as date) as week, min(date) as date from model_frame "
    "where ticker not in ('BRAND#1', 'BRAND#2') group by 1"
)
_BT = f"""{_SC},
working as (select * from scored where ticker not in ('BRAND#1', 'BRAND#2') and future_ret_5d is not null),
rebal as (select min(date) as date from working group by date_trunc('week', date)),
picks as (
  select * from (
    select w.*, row_number() over (partition by model_name, model_version, w.date
                                   order by prediction desc, ticker asc) as rn
    from working w join rebal r on w.date = r.date) where rn <= 5
),
per as (
  select model_name, model_version, date, avg(future_ret_5d) - 0.001::double as portfolio_return,
         string_agg(ticker, ',' order by rn) as tickers
  from picks group by model_name, model_version, date
),
periods as (
  select p.model_name, p.model_version, p.date, p.portfolio_return,
         case when b.ticker is not null then b.future_ret_5d else 0.0::double end as benchmark_return, p.tickers
  from per p left join (select * from scored where ticker = 'BRAND#1') b
    on p.model_name = b.model_name and p.model_version = b.model_version and p.date = b.date
),
curve0 as (
  select *,
    product(1.0::double + portfolio_return) over w as cumulative,
    product(1.0::double + benchmark_return) over w as benchmark_cumulative
  from periods
  window w as (partition by model_name, model_version order by date rows between unbounded preceding and current row)
),
curve as (
  select *, max(cumulative) over (partition by model_name, model_version order by date
                                  rows between unbounded preceding and current row) as running_peak
  from curve0
)"""
ORACLES["ds_13_backtest_periods"] = present_sql(
    f"{_BT} select *, cumulative / running_peak - 1.0::double as drawdown from curve",
    ["model_name", "model_version", "date", "tickers"],
)
ORACLES["ds_13_backtest_summary"] = present_sql(
    f"""{_BT} select model_name, model_version, count(*) as periods,
      arg_max(cumulative, date) - 1.0::double as total_return,
      arg_max(benchmark_cumulative, date) - 1.0::double as benchmark_total_return,
      case when stddev_pop(portfolio_return) > 0
           then avg(portfolio_return) / stddev_pop(portfolio_return) * sqrt(52.0::double) else 0.0::double end
        as sharpe_like,
      abs(min(cumulative / running_peak - 1.0::double)) as max_drawdown
    from curve group by model_name, model_version""",
    ["model_name", "model_version", "periods"],
)
_OC = f"""with {OHLCV_CTE}, {predictions_cte()},
todo as (select * from predictions where target_date < date '{AS_OF}'),
hit as (
  select t.*, case when o.date < t.target_date + 7 then o.close end as actual_close
  from todo t asof left join ohlcv o on t.ticker = o.ticker and t.target_date <= o.date
),
outcomes as (
  select prediction_id, actual_close, actual_close / nullif(current_close, 0) - 1.0::double as actual_return,
    abs(actual_close - predicted_close) as absolute_error,
    abs((actual_close / nullif(current_close, 0) - 1.0::double) - predicted_return) as return_error,
    cast(sign(actual_close / nullif(current_close, 0) - 1.0::double) = sign(predicted_return) as integer)
      as direction_correct,
    cast(bear_case <= actual_close and actual_close <= bull_case as integer) as within_prediction_range,
    timestamp '{AS_OF} 00:00:00' as scored_at
  from hit where actual_close is not null
)"""
ORACLES["ds_11_outcomes"] = present_sql(
    f"{_OC} select * from outcomes", ["prediction_id", "direction_correct", "within_prediction_range", "scored_at"]
)
ORACLES["ds_12_scorecard"] = present_sql(
    f"""{_OC},
    s as (
      select p.ticker, coalesce(p.confidence, 'unknown') as confidence_bucket, p.prediction_id, o.absolute_error,
             o.direction_correct, o.within_prediction_range, p.predicted_return, o.actual_return,
             p.predicted_close, o.actual_close
      from predictions p join outcomes o on p.prediction_id = o.prediction_id
      where o.actual_close is not null and o.actual_return is not null
    ),
    g as (
      select 'overall' as section, null::varchar as key, count(prediction_id)::double as predictions,
        avg(absolute_error) as mae, sqrt(avg((predicted_close - actual_close) * (predicted_close - actual_close))) as rmse,
        avg(direction_correct::double) as direction_accuracy, avg(within_prediction_range::double) as range_coverage,
        avg(predicted_return) as avg_predicted_return, avg(actual_return) as avg_actual_return from s
      union all
      select 'ticker', ticker, count(prediction_id)::double, avg(absolute_error), null, avg(direction_correct::double),
        null, null, avg(actual_return) from s group by ticker
      union all
      select 'confidence_bucket', confidence_bucket, count(prediction_id)::double, avg(absolute_error), null,
        avg(direction_correct::double), null, null, avg(actual_return) from s group by confidence_bucket
    )
    select section, key, metric, value from (
      select section, key, 'mae' as metric, mae as value from g where section = 'overall'
      union all select section, key, 'rmse', rmse from g where section = 'overall'
      union all select section, key, 'direction_accuracy', direction_accuracy from g where section = 'overall'
      union all select section, key, 'range_coverage', range_coverage from g where section = 'overall'
      union all select section, key, 'avg_predicted_return', avg_predicted_return from g where section = 'overall'
      union all select section, key, 'avg_actual_return', avg_actual_return from g where section = 'overall'
      union all select section, key, 'predictions', predictions from g where section <> 'overall'
      union all select section, key, 'mae', mae from g where section <> 'overall'
      union all select section, key, 'direction_accuracy', direction_accuracy from g where section <> 'overall'
      union all select section, key, 'avg_actual_return', avg_actual_return from g where section <> 'overall'
    )""",
    ["section", "key", "metric"],
)

# ------------------------------------------------------ promotion, serving
from ..functions.dates import bday_offset_sql  # noqa: E402
from ..schemas import NEWS_FEATURE_COLUMNS, PRIOR_FEATURE_COLUMNS  # noqa: E402
from .queries import MODEL_A  # noqa: E402
from .sql_common import score_sql  # noqa: E402

_METRICS_BODY = """
  select model_name, model_version, count(*) as n,
    avg(abs(y - p)) as mae, sqrt(avg((y - p) * (y - p))) as rmse,
    case when count(*) * var_pop(y) > 0 then 1.0::double - sum((y - p) * (y - p)) / (count(*) * var_pop(y))
         when sum((y - p) * (y - p)) = 0 then 1.0::double else 0.0::double end as r2,
    avg(case when sign(y) = sign(p) then 1.0::double else 0.0::double end) as direction_accuracy,
    avg(case when rk > cnt - greatest(1, floor(cnt * 0.1::double)) then y end) as top_decile_avg_forward_return,
    avg(case when rk <= greatest(1, floor(cnt * 0.1::double)) then y end) as bottom_decile_avg_forward_return
  from (
    select model_name, model_version, future_ret_5d as y, prediction as p,
      row_number() over (partition by model_name, model_version order by prediction, ticker, date) as rk,
      count(*) over (partition by model_name, model_version) as cnt
    from scored where split = 'validation')
  group by model_name, model_version"""

_BT_SUMMARY_BODY = """
  select model_name, model_version, count(*) as periods,
    arg_max(cumulative, date) - 1.0::double as total_return,
    arg_max(benchmark_cumulative, date) - 1.0::double as benchmark_total_return,
    case when stddev_pop(portfolio_return) > 0
         then avg(portfolio_return) / stddev_pop(portfolio_return) * sqrt(52.0::double) else 0.0::double end
      as sharpe_like,
    abs(min(cumulative / running_peak - 1.0::double)) as max_drawdown
  from curve group by model_name, model_version"""

_EVAL = f"""{_BT},
roles as (select * from (values ('production', 'linear_a', 'v1'), ('candidate', 'linear_b', 'v2'))
          as t(role, model_name, model_version)),
metrics as ({_METRICS_BODY}),
bt as ({_BT_SUMMARY_BODY}),
evaluated as (
  select r.role, r.model_name, r.model_version, m.n, m.mae, m.rmse, m.r2, m.direction_accuracy,
         m.top_decile_avg_forward_return, m.bottom_decile_avg_forward_return,
         b.periods, b.total_return, b.benchmark_total_return, b.sharpe_like, b.max_drawdown
  from roles r
  left join metrics m on r.model_name = m.model_name and r.model_version = m.model_version
  left join bt b on r.model_name = b.model_name and r.model_version = b.model_version
)"""
ORACLES["ds_14_candidate_evaluation"] = present_sql(
    f"{_EVAL} select * from evaluated", ["role", "model_name", "model_version", "n", "periods"]
)
_SIDE_COLS = ["model_name", "model_version", "mae", "rmse", "r2", "direction_accuracy",
              "top_decile_avg_forward_return", "bottom_decile_avg_forward_return", "periods", "total_return",
              "benchmark_total_return", "sharpe_like", "max_drawdown"]
_SIDE = ", ".join(
    f"max(case when role = '{r}' then {c} end) as {r}_{c}" for r in ("candidate", "production") for c in _SIDE_COLS
)
ORACLES["join_14_side_by_side"] = present_sql(
    f"{_EVAL} select {_SIDE} from evaluated",
    [f"{r}_{c}" for r in ("candidate", "production") for c in ("model_name", "model_version", "periods")],
)
ORACLES["ds_15_promotion_gate"] = f"""{_EVAL}, side as (select {_SIDE} from evaluated),
g as (select *, coalesce(
    candidate_direction_accuracy >= production_direction_accuracy
    and candidate_rmse <= production_rmse * 1.02::double
    and candidate_top_decile_avg_forward_return > production_top_decile_avg_forward_return
    and candidate_total_return > production_total_return
    and candidate_max_drawdown <= production_max_drawdown * 1.10::double, false) as passed from side)
select 'ensemble' as model_name, candidate_model_version as model_version, 'promotion_check' as run_type,
       cast(passed as integer) as promoted, passed from g"""

_PRIORS = f"""
pr0 as (
  select ticker, date, close,
    ln(close / nullif(lag(close) over w, 0)) as lr,
    row_number() over w as rn, count(*) over (partition by ticker) as cnt
  from ohlcv where close is not null window w as (partition by ticker order by date)
),
pr1 as (
  select *, coalesce(avg(lr) over w60, 0.0::double) as mu, coalesce(stddev_samp(lr) over w60, 0.0::double) as sd
  from pr0 window w60 as (partition by ticker order by date rows between 59 preceding and current row)
),
pr2 as (
  select ticker, date, cnt, rn >= 120 and (rn - 120) % 5 = 0 as anchor,
    exp(mu * 5.0::double - 1.2815515655446004::double * sd * sqrt(5.0::double)) as lo,
    exp(mu * 5.0::double + 1.2815515655446004::double * sd * sqrt(5.0::double)) as hi, mu
  from pr1
),
pr3 as (
  select ticker, date,
    case when anchor then exp(mu * 1.0::double) - 1.0::double end as chronos_pred_ret_1d,
    case when anchor then exp(mu * 5.0::double) - 1.0::double end as chronos_pred_ret_5d,
    case when anchor then exp(mu * 20.0::double) - 1.0::double end as chronos_pred_ret_20d,
    case when anchor then lo - 1.0::double end as chronos_bear_ret_5d,
    case when anchor then hi - 1.0::double end as chronos_bull_ret_5d,
    case when anchor then greatest(0.15::double, least(0.95::double, 1.0::double - abs(hi - lo))) end
      as chronos_confidence_score
  from pr2 where cnt >= 120
),
priors as (
  select * from (
    select ticker, date, {', '.join(f'last_value({c} ignore nulls) over w as {c}' for c in PRIOR_FEATURE_COLUMNS)}
    from pr3 window w as (partition by ticker order by date rows between unbounded preceding and current row))
  where chronos_pred_ret_5d is not null
)"""
ORACLES["ml_3_drift_priors"] = present_sql(f"with {OHLCV_CTE}, {_PRIORS} select * from priors", ["ticker", "date"])
ORACLES["win_12_forecast_anchors"] = f"""with {OHLCV_CTE}
select ticker, date, close from (
  select ticker, date, close, row_number() over (partition by ticker order by date) as rn from ohlcv)
where rn >= 120 and (rn - 120) % 5 = 0"""
ORACLES["win_11_business_day_regrid"] = f"""with {OHLCV_CTE},
a as (select ticker, date, close, max(date) over (partition by ticker) as last,
             row_number() over (partition by ticker order by date desc) as k from ohlcv),
b as (select *, case when isodow(last) >= 6 then last - cast(isodow(last) - 5 as integer) else last end as e from a)
select ticker, date, close,
  cast(e - cast((k - 1) + 2 * floor((4 - (isodow(e) - 1) + (k - 1)) / 5) as integer) as date) as timestamp
from b"""
ORACLES["win_7_latest_rows"] = present_sql(
    f"""with {OHLCV_CTE}, {features_sql()}
    select ticker, date, close, ret_5d, volatility_20d from features where close is not null
    qualify row_number() over (partition by ticker order by date desc) = 1""",
    ["ticker", "date"],
)
ORACLES["top_4_recent_predictions"] = present_sql(
    f"""with {predictions_cte()}
    select prediction_id, ticker, as_of_date, predicted_return from predictions
    qualify row_number() over (partition by ticker order by cast(as_of_date as timestamp) desc, prediction_id) <= 25""",
    ["prediction_id", "ticker", "as_of_date"],
)
ORACLES["ds_10_prior_only_predictions"] = present_sql(
    f"""with {OHLCV_CTE}, {features_sql()}, {_PRIORS},
    latest as (select ticker, date, close from features where close is not null
               qualify row_number() over (partition by ticker order by date desc) = 1),
    j as (select l.ticker, l.date as as_of_date, l.close, p.date as pday, p.* exclude (ticker, date)
          from latest l asof left join priors p on l.ticker = p.ticker and l.date >= p.date),
    d as (select *, list_transform(list_slice(list_reverse(list_sort([
      {', '.join(f"{{'s': abs(coalesce({c}, 0.0::double)), 'i': -{i}, 'name': '{c}', 'v': coalesce({c}, 0.0::double)}}" for i, c in enumerate(PRIOR_FEATURE_COLUMNS))}
    ])), 1, 5), lambda x: x.name || '=' || printf('%.4f', x.v)) as drv from j)
    select ticker, as_of_date, close as current_close,
      case when pday is not null then coalesce(chronos_pred_ret_5d, 0.0::double) end as t1_predicted_return,
      case when pday is not null then close * (1.0::double + coalesce(chronos_pred_ret_5d, 0.0::double)) end
        as t1_expected_close,
      case when pday is not null then array_to_string(drv, ';') end as t1_drivers,
      case when pday is null then 'No prior features available for ticker ' || ticker end as error
    from d""",
    ["ticker", "as_of_date", "t1_drivers", "error"],
)

_PRICE = ", ".join(f"l.{c}" for c in PRICE_FEATURE_COLUMNS)
_DRV_COLS = PRICE_FEATURE_COLUMNS + PRIOR_FEATURE_COLUMNS + NEWS_FEATURE_COLUMNS
_DRV = ", ".join(
    f"{{'s': abs(coalesce({c}, 0.0::double)), 'i': -{i}, 'name': '{c}', 'v': coalesce({c}, 0.0::double)}}"
    for i, c in enumerate(_DRV_COLS)
)
_VER = "t1=t1;n1=n1;ensemble=ensemble;adjuster=disabled"
ORACLES["ds_9_predictions"] = present_sql(
    f"""with {OHLCV_CTE}, {features_sql()}, {_PRIORS}, {NEWS_CTE}, {heuristic_events_sql()},
    daily as ({DAILY_AGG_SQL}),
    nf as (
      select k.ticker, k.date, {', '.join(f'coalesce(cast(d.{c} as double), 0.0) as {c}' for c in NEWS_FEATURE_COLUMNS)}
      from (select distinct ticker, date from ohlcv) k left join daily d on k.ticker = d.ticker and k.date = d.date
    ),
    latest as (select * from features where close is not null
               qualify row_number() over (partition by ticker order by date desc) = 1),
    j1 as (select l.ticker, l.date as as_of_date, l.close, l.rapid_move, {_PRICE}, n.date as news_day,
                  {', '.join(f'n.{c}' for c in NEWS_FEATURE_COLUMNS)}
           from latest l asof left join nf n on l.ticker = n.ticker and l.date >= n.date),
    j2 as (select j1.*, p.date as prior_day, {', '.join(f'p.{c}' for c in PRIOR_FEATURE_COLUMNS)}
           from j1 asof left join priors p on j1.ticker = p.ticker and j1.as_of_date >= p.date),
    x as (select * replace ({', '.join(f'coalesce({c}, 0.0::double) as {c}' for c in NEWS_FEATURE_COLUMNS + PRIOR_FEATURE_COLUMNS)}),
             prior_day is not null as has_prior
          from j2),
    y as (select *, {score_sql(MODEL_A)} as baseline,
             coalesce(nullif(volatility_20d, 0.0::double), 0.02::double) as vol,
             news_count = 0.0::double as missing_news from x),
    z as (select *, baseline + 0::double / 10000.0::double as pred from y),
    s0 as (select *, round(greatest(0.2::double, least(0.95::double,
        0.62::double
        - (case when vol > 0.05::double then 0.18::double when vol > 0.03::double then 0.08::double else 0.0::double end)
        - (case when missing_news then 0.08::double else 0.0::double end)
        - (case when abs(pred) < 0.005::double then 0.08::double else 0.0::double end)
        + (case when sign(chronos_pred_ret_5d) = sign(pred) and abs(chronos_pred_ret_5d - pred) < 0.01::double
                then 0.08::double else 0.0::double end))), 4) as sc0 from z),
    s1 as (select *, round(greatest(0.2::double, least(0.95::double, sc0 - 0.03::double)), 4) as sc from s0),
    d as (select *, list_transform(list_slice(list_reverse(list_sort([{_DRV}])), 1, 5),
                                   lambda q: q.name || '=' || printf('%.4f', q.v)) as drv from s1),
    out as (
      select sha256(concat_ws('|', ticker, cast(as_of_date as varchar), '5d', '{_VER}')) as prediction_id,
        ticker, as_of_date, '5d' as target_horizon, {bday_offset_sql('as_of_date', 5)} as target_date,
        round(close, 4) as current_close, round(close * (1.0::double + baseline), 4) as baseline_expected_close,
        round(baseline, 6) as baseline_predicted_return, 0 as adjustment_bps,
        round(close * (1.0::double + pred), 4) as expected_close, round(pred, 6) as predicted_return,
        round(close * (1.0::double + pred - greatest(vol, 0.015::double)), 4) as bear_case,
        round(close * (1.0::double + pred + greatest(vol, 0.015::double)), 4) as bull_case,
        case when sc >= 0.75::double then 'high' when sc >= 0.6::double then 'medium'
             when sc >= 0.45::double then 'medium-low' else 'low' end as confidence,
        sc as confidence_score,
        array_to_string(drv, ';') as main_drivers,
        array_to_string(list_filter([
          case when missing_news then 'missing_news_features' end,
          case when vol > 0.05::double then 'high_volatility' end,
          case when rapid_move = 1 then 'recent_rapid_move' end,
          case when abs(baseline) > 0.08::double then 'large_baseline_move' end,
          case when abs(pred) > 0.08::double then 'large_adjusted_move' end], lambda f: f is not null), ';') as risk_flags,
        'No adjustment applied.' as reasoning,
        case when not has_prior then 'No prior features available for ticker ' || ticker || ' as of '
             || cast(as_of_date as varchar) end as error
      from d
    )
    select ticker, error, case when error is null then columns(lambda c: c not in ('ticker', 'error')) end
    from (select * from out where ticker not in ('BRAND#1', 'BRAND#2')
          union all by name select 'BRAND#99' as ticker, 'No features found for ticker BRAND#99' as error)""",
    ["prediction_id", "ticker", "as_of_date", "target_horizon", "target_date", "adjustment_bps", "confidence",
     "main_drivers", "risk_flags", "reasoning", "error"],
)

# ------------------------------------------------------------- training sets
from ..functions import lexicons as _lx  # noqa: E402
from .sql_common import (  # noqa: E402
    any_sql, catalyst_sql, count_sql, fixed_sql, jbool, jlist, jobject, jstr, py_float_sql, pylist_sql, pystr_sql,
    strip_sql,
)

_CTXC = ["ret_1d", "ret_5d", "volatility_20d", "future_ret_1d", "future_ret_5d", "future_ret_20d"]


def _pymax(a, b):
    return f"(case when {a} is null then null when abs({b}) > abs({a}) then abs({b}) else abs({a}) end)"


ORACLES["ds_5_outcome_labelled_set"] = present_sql(
    f"""with {OHLCV_CTE}, {features_sql()}, {NEWS_CTE},
    a as (
      select n.doc_id, upper(n.ticker) as ticker, n.published_at, n.title, n.body, f.date as fdate, f.rapid_move,
             {', '.join('f.' + c for c in _CTXC)}, f.future_ret_10d,
             {strip_sql("coalesce(n.title, '') || chr(10) || coalesce(n.body, '')")} as text
      from news n asof left join features f on upper(n.ticker) = f.ticker and cast(n.published_at as date) >= f.date
    ),
    b as (select *, lower(text) as low, fdate is not null as has_row,
                 fdate is not null and future_ret_5d is not null as labelled from a),
    c as (
      select *,
        case when labelled and future_ret_5d > 0.02::double then 'positive'
             when labelled and future_ret_5d < -0.02::double then 'negative' else 'neutral' end as sentiment,
        case when labelled then round(greatest(-1.0::double, least(1.0::double, future_ret_5d / 0.08::double)), 4)
             else 0.0::double end as sentiment_score,
        {catalyst_sql('low', _lx.OUTCOME_TOPICS)} as catalyst_type,
        contains(upper(text), ticker) as company_specific,
        list_sort(list_filter([
          case when {any_sql('low', _lx.OUTCOME_LEGAL_WORDS)} then 'legal_or_regulatory' end,
          case when {any_sql('low', _lx.OUTCOME_VALUATION_WORDS)} then 'valuation' end,
          case when has_row and coalesce(volatility_20d, 0.0::double) > 0.05::double then 'high_volatility' end,
          case when has_row and rapid_move = 1 then 'rapid_move' end], lambda v: v is not null)) as risk_flags,
        case when {any_sql('low', _lx.OUTCOME_NOVELTY_WORDS)} then 'high' else 'medium' end as novelty,
        case when has_row and {_pymax('future_ret_10d', 'future_ret_20d')} > {_pymax('future_ret_1d', 'future_ret_5d')}
             then '5_20_trading_days' else '1_5_trading_days' end as likely_horizon,
        round(least(0.55::double + case when labelled then least(0.25::double, abs(future_ret_5d) / 0.2::double)
                                        else 0.0::double end, 0.9::double), 4) as confidence
      from b
    )
    select doc_id, ticker, published_at, sentiment, sentiment_score, catalyst_type, company_specific,
      array_to_string(risk_flags, ';') as risk_flags, novelty, likely_horizon, confidence,
      '{_lx.INSTRUCTION_EXTRACT}' as instruction,
      'Ticker: ' || ticker || chr(10) || 'Date: ' || cast(cast(published_at as date) as varchar) || chr(10)
        || 'Headline: ' || coalesce(title, '') || chr(10) || 'Article: ' || coalesce(body, '') || chr(10)
        || 'MarketContext: ' || case when has_row then {jobject([(c, py_float_sql(c)) for c in _CTXC[:3]])} else '{{}}' end
        as input,
      {jobject([("sentiment", jstr("sentiment")), ("sentiment_score", py_float_sql("sentiment_score")),
                ("catalyst_type", jstr("catalyst_type")), ("company_specific", jbool("company_specific")),
                ("risk_flags", jlist("risk_flags")), ("novelty", jstr("novelty")),
                ("likely_horizon", jstr("likely_horizon")), ("confidence", py_float_sql("confidence"))])} as output
    from c""",
    ["doc_id", "ticker", "published_at", "sentiment", "catalyst_type", "company_specific", "risk_flags", "novelty",
     "likely_horizon", "instruction", "input", "output"],
)

ORACLES["ds_6_weak_supervision_set"] = present_sql(
    f"""with {NEWS_CTE},
    a as (select doc_id, ticker, published_at, title, body,
                 lower({strip_sql("coalesce(title, '') || chr(10) || coalesce(body, '')")}) as low from news),
    b as (select *, {count_sql('low', _lx.WEAK_POSITIVE_WORDS)} as p, {count_sql('low', _lx.WEAK_NEGATIVE_WORDS)} as n
          from a),
    c as (select *, case when p + n = 0 then 0.0::double else (p - n)::double / (p + n)::double end as s from b),
    d as (select *,
      case when s > 0.15::double then 'positive' when s < -0.15::double then 'negative' else 'neutral' end as sentiment,
      round(abs(s), 4) as sentiment_score,
      {catalyst_sql('low', _lx.WEAK_TOPICS, 'general')} as catalyst_type,
      list_filter([
        case when s < -0.25::double then 'negative_sentiment' end,
        case when {any_sql('low', ['lawsuit', 'litigation'])} then 'lawsuit' end,
        case when {any_sql('low', ['regulatory', 'sec', 'antitrust'])} then 'regulatory' end,
        case when contains(low, 'guidance') and {any_sql('low', ['cut', 'lower'])} then 'guidance_cut' end,
        case when contains(low, 'valuation') then 'valuation' end], lambda v: v is not null) as risk_flags,
      case when {any_sql('low', _lx.WEAK_SHORT_HORIZON_WORDS)} then '1-5_trading_days'
           when {any_sql('low', _lx.WEAK_LONG_HORIZON_WORDS)} then '5-20_trading_days'
           else '1-20_trading_days' end as likely_horizon
      from c)
    select doc_id, ticker, sentiment, sentiment_score, catalyst_type, array_to_string(risk_flags, ';') as risk_flags,
      likely_horizon, '{_lx.INSTRUCTION_EXTRACT}' as instruction,
      'Ticker: ' || coalesce(ticker, 'UNKNOWN') || chr(10) || 'Date: ' || strftime(published_at, '%Y-%m-%d')
        || chr(10) || 'Headline: ' || coalesce(title, '') || chr(10) || 'Article: ' || coalesce(body, '') as input,
      {jobject([("sentiment", jstr("sentiment")), ("sentiment_score", py_float_sql("sentiment_score")),
                ("catalyst_type", jstr("catalyst_type")), ("company_specific", "'true'"),
                ("risk_flags", jlist("risk_flags")), ("novelty", "'\"medium\"'"),
                ("likely_horizon", jstr("likely_horizon")), ("confidence", "'0.58'")])} as output
    from d""",
    ["doc_id", "ticker", "sentiment", "catalyst_type", "risk_flags", "likely_horizon", "instruction", "input",
     "output"],
)

_DENSE = f"""{NEWS_CTE}, {heuristic_events_sql()}, daily as ({DAILY_AGG_SQL}),
nf as (
  select k.ticker, k.date, {', '.join(f'coalesce(cast(d.{c} as double), 0.0) as {c}' for c in NEWS_FEATURE_COLUMNS)}
  from (select distinct ticker, date from ohlcv) k left join daily d on k.ticker = d.ticker and k.date = d.date
)"""
ORACLES["join_2_training_frame"] = present_sql(
    f"""with {OHLCV_CTE}, {features_sql()}, {_PRIORS}, {_DENSE}
    select f.ticker, f.date, f.close, f.ret_5d, {', '.join('p.' + c for c in PRIOR_FEATURE_COLUMNS)},
           {', '.join('n.' + c for c in NEWS_FEATURE_COLUMNS)}
    from features f left join priors p on f.ticker = p.ticker and f.date = p.date
    left join nf n on f.ticker = n.ticker and f.date = n.date""",
    ["ticker", "date"],
)
ORACLES["join_11_source_sets"] = f"""with {NEWS_CTE}
select upper(ticker) as ticker, cast(substring(strftime(published_at, '%Y-%m-%d'), 1, 10) as date) as date,
       array_to_string(list_sort(list_distinct(list(lower(coalesce(source, ''))))), ',') as sources_seen
from news group by 1, 2"""
ORACLES["top_2_tail_rows"] = present_sql(
    f"with {OHLCV_CTE}, {features_sql()} select ticker, date, close from features order by ticker desc, date desc "
    "limit 4000",
    ["ticker", "date"],
)
ORACLES["ds_17_sft_text"] = (
    "select 'Instruction: ' || instruction || chr(10) || 'Input: ' || input || chr(10) || 'Output: ' || output "
    f"as text from ({ORACLES['ds_6_weak_supervision_set']}) as _w"
)

_TRIG = [
    ("rapid_move = 1", "rapid_move", 0.35),
    ("volatility_20d > 0.05::double", "high_volatility", 0.2),
    ("news_count = 0.0::double", "missing_news", 0.2),
    ("(abs(future_ret_1d) > 0.03::double or abs(future_ret_5d) > 0.05::double)", "large_realized_move", 0.15),
    ("materiality_score > 0.6::double", "material_news_context", 0.1),
    ("(earnings_count > 0 or guidance_count > 0)", "earnings_or_guidance", 0.1),
]
_score = "0.1::double"
for _c, _n, _w in _TRIG:
    _score = f"(case when {_c} then {_score} + {_w!r}::double else {_score} end)"
_trig = "list_filter([" + ", ".join(f"case when {c} then '{n}' end" for c, n, _ in _TRIG) + "], lambda v: v is not null)"
ORACLES["ds_7_planner_set"] = f"""with {OHLCV_CTE}, {features_sql()}, {_DENSE},
fr as (
  select f.ticker, f.date, coalesce(f.rapid_move, 0) as rapid_move,
    {', '.join(f'coalesce(f.{c}, 0.0::double) as {c}' for c in ['ret_1d', 'ret_5d', 'volatility_20d', 'future_ret_1d', 'future_ret_5d'])},
    {', '.join(f'coalesce(n.{c}, 0.0::double) as {c}' for c in NEWS_FEATURE_COLUMNS)}
  from features f left join nf n on f.ticker = n.ticker and f.date = n.date
),
src as (
  select upper(ticker) as ticker, cast(strftime(published_at, '%Y-%m-%d') as date) as date,
         list_sort(list_distinct(list(lower(coalesce(source, ''))))) as seen
  from news group by 1, 2
),
a as (select fr.*, coalesce(src.seen, []::varchar[]) as seen, {_score} as score, {_trig} as triggers
      from fr left join src on fr.ticker = src.ticker and fr.date = src.date),
b as (select *, score >= 0.35::double as should_retrieve,
  list_distinct_ordered as x from (select *, list_filter([
      case when list_contains(triggers, 'earnings_or_guidance') then 'earnings_transcript' end,
      case when contains(array_to_string(seen, ' '), 'investor') then 'company_ir' end,
      case when list_contains(seen, 'sec') then 'sec_filings' end,
      case when list_contains(seen, 'reuters') or list_contains(seen, 'yahoo') then 'follow_existing_public_news' end],
      lambda v: v is not null) || ['public_finance_news', 'company_ir', 'sec_filings'] as list_distinct_ordered from a)),
c as (select *,
  list_filter(x, lambda v, i: list_position(x, v) = i) as srcs from b)
select ticker, date, should_retrieve,
  case when score >= 0.7::double then 'high' when score >= 0.45::double then 'medium' else 'low' end as urgency,
  round(least(score, 0.95::double), 4) as urgency_score,
  array_to_string(triggers, ';') as triggers,
  array_to_string(case when should_retrieve then srcs else []::varchar[] end, ';') as suggested_sources,
  '{_lx.INSTRUCTION_PLAN}' as instruction,
  'Ticker: ' || ticker || chr(10) || 'Date: ' || cast(date as varchar) || chr(10) || 'Horizon: 5d' || chr(10)
    || 'ret_1d: ' || {fixed_sql('ret_1d', 4)} || chr(10) || 'ret_5d: ' || {fixed_sql('ret_5d', 4)} || chr(10)
    || 'volatility_20d: ' || {fixed_sql('volatility_20d', 4)} || chr(10)
    || 'rapid_move: ' || cast(rapid_move as varchar) || chr(10)
    || 'news_count: ' || {fixed_sql('news_count', 0)} || chr(10)
    || 'materiality_score: ' || {fixed_sql('materiality_score', 4)} || chr(10)
    || 'sources_seen: ' || {pylist_sql('seen')} as input,
  {jobject([("should_retrieve", jbool("should_retrieve")),
            ("urgency", "'\"' || case when score >= 0.7::double then 'high' when score >= 0.45::double then 'medium' else 'low' end || '\"'"),
            ("urgency_score", py_float_sql("round(least(score, 0.95::double), 4)")),
            ("triggers", jlist("triggers")),
            ("suggested_sources", jlist("case when should_retrieve then srcs else []::varchar[] end")),
            ("query_terms", "case when should_retrieve then '[\"' || ticker || ' stock news\", \"' || ticker || ' sec filing\", \"' || ticker || ' investor relations\"]' else '[]' end"),
            ("notes", jstr(f"'{_lx.PLANNER_NOTES}'"))])} as output
from c"""

# ------------------------------------------------------------- streaming
ORACLES["str_m2_daily_events_stream"] = ORACLES["agg_1_daily_events"]
_MODEL = heuristic_events_sql().replace(
    "1.0::double as company_specific_score,", "case when hybrid and doc_id % 3 = 0 then 0.0::double else 1.0::double end as company_specific_score,"
).replace("0.0::double as macro_relevance_score,", "case when hybrid and doc_id % 3 = 0 then 1.0::double else 0.0::double end as macro_relevance_score,").replace(
    "0.35::double * 0.5::double", "case when hybrid then 0.8::double else 0.35::double end * 0.5::double"
).replace("0.35::double as event_confidence_score", "case when hybrid then 0.8::double else 0.35::double end as event_confidence_score").replace(
    "from payloads\n", "from (select *, doc_id % 20 <> 10 as hybrid from payloads)\n"
)
ORACLES["ds_4_hybrid_daily_events"] = ORACLES["agg_1_daily_events"].replace(heuristic_events_sql(), _MODEL)
ORACLES["json_1_first_json_object"] = present_sql(
    f"""{_EV} select doc_id, case when doc_id % 20 = 10 then 'no JSON object' end as parse_error,
      columns(lambda c: c not in ('doc_id', 'ok')), from (
      select doc_id, doc_id % 20 <> 10 as ok,
        case when ok then case when raw_score > 0.15::double then 'positive' when raw_score < -0.15::double then 'negative' else 'neutral' end end as sentiment,
        case when ok then round(raw_score, 4) end as sentiment_score, case when ok then catalyst_type end as catalyst_type,
        case when ok then doc_id % 3 <> 0 end as company_specific, case when ok then array_to_string(risk_flags, ',') end as risk_flags,
        case when ok then likely_horizon end as likely_horizon, case when ok then 0.8::double end as confidence
      from payloads)""",
    ["doc_id", "parse_error", "sentiment", "catalyst_type", "company_specific", "risk_flags", "likely_horizon"],
)
ORACLES["str_m1_dedupe_stream"] = f"with {NEWS_CTE} select doc_id, upper(ticker) as ticker, published_at from news"
ORACLES["snk_10_failed_tickers"] = f"""with {OHLCV_CTE}
select distinct upper(p_brand) as ticker from part where upper(p_brand) not in (select ticker from ohlcv)"""
ORACLES["src_5_universe"] = """select distinct upper(p_brand) as ticker,
  'cat' || cast(cast(regexp_extract(p_brand, '#(\\d+)$', 1) as integer) % 4 as varchar) as category,
  cast(cast(regexp_extract(p_brand, '#(\\d+)$', 1) as integer) in (1, 2) as integer) as is_benchmark
from part"""
ORACLES["str_m3_outcome_stream"] = ORACLES["ds_11_outcomes"]
ORACLES["join_10_category_lookup"] = present_sql(
    f"""with {OHLCV_CTE}, u as ({ORACLES['src_5_universe']})
    select o.ticker, o.date, o.close, coalesce(u.category, 'unknown') as category
    from ohlcv o left join u on o.ticker = u.ticker""",
    ["ticker", "date", "category"],
)
