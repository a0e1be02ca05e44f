"""Reports that records, stored tables and streams are made of, as SQL for both engines where SQL can say it.

A text may be for both engines or a pair (Spark, DuckDB), as in ``reports``.
"""

from __future__ import annotations

from ..config import DEFAULT as S
from . import reports

_MINUTES = S.bar_minutes
_FLAG = "lag({0}) OVER (PARTITION BY symbol, d, session, model, level ORDER BY slot)"


def _transitions(side: str) -> str:
    """Counts of (flag before, flag) within a session: n00, n01, n10, n11 of one side."""
    cells = [f"CAST(sum(CASE WHEN p_{side} = {a} AND {side} = {b} THEN 1 ELSE 0 END) AS BIGINT) AS {side}_n{a}{b}" for a in (0, 1) for b in (0, 1)]
    return ", ".join(cells)


_DAY_RECORDS = f"""SELECT symbol, CAST(d AS STRING) AS d, model, CAST(level AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n, round(sum(pinball), 8) AS pinball_sum,
    round(sum(width), 8) AS width_sum, CAST(sum(lower) AS BIGINT) AS lower_exceed, CAST(sum(upper) AS BIGINT) AS upper_exceed, {_transitions("lower")}, {_transitions("upper")}
    FROM (SELECT symbol, d, model, level, pinball, width, lower, upper, {_FLAG.format("lower")} AS p_lower, {_FLAG.format("upper")} AS p_upper FROM {{scored}}) t GROUP BY symbol, d, model, level"""

_PIT_RECORDS = f"""SELECT symbol, CAST(day_idx AS BIGINT) AS day_idx, CAST(count(*) AS BIGINT) AS n, round(sum(pit), 8) AS pit_sum, {", ".join(
    f"CAST(sum(CASE WHEN least(floor(pit * {S.pit_bins}), {S.pit_bins - 1}) = {b} THEN 1 ELSE 0 END) AS BIGINT) AS bin_{b}" for b in range(S.pit_bins))} FROM (PIT) p GROUP BY symbol, day_idx"""

# model against the empirical one, by symbol: differences of days, resampled in circular blocks; Holm over all
_DIFFS = """SELECT m.model, e.symbol, e.day_idx, sum(m.pinball_sum - e.pinball_sum) AS diff, sum(e.n) AS n FROM {day_scores} e JOIN {day_scores} m ON e.symbol = m.symbol AND e.day_idx = m.day_idx
    AND e.level = m.level WHERE e.model = 'empirical' AND m.model <> 'empirical' GROUP BY m.model, e.symbol, e.day_idx"""
_HOLM = f"""WITH reps AS (SERIES(rep,{S.replicates})), offs AS (SERIES(o,{S.block_days})), dd AS (SELECT model, symbol, diff, n, row_number() OVER (PARTITION BY model, symbol ORDER BY day_idx) - 1 AS idx FROM ({_DIFFS}) x),
    cnt AS (SELECT model, symbol, count(*) AS m, sum(diff) / sum(n) AS obs FROM dd GROUP BY model, symbol HAVING count(*) >= {2 * S.block_days}), blks AS (UPTO(blk,ceil(m / {S.block_days}e0);), model, symbol, m FROM cnt),
    pl AS (SELECT model, symbol, rep, blk * {S.block_days} + o AS place, ((rep * 7919 + blk * 104729 + rep * blk * 31) % m + o) % m AS idx, m FROM blks CROSS JOIN reps CROSS JOIN offs),
    st AS (SELECT pl.model, pl.symbol, rep, sum(diff) / sum(n) AS stat FROM pl JOIN dd ON pl.model = dd.model AND pl.symbol = dd.symbol AND pl.idx = dd.idx WHERE place < m GROUP BY pl.model, pl.symbol, rep),
    ps AS (SELECT st.model, st.symbol, max(obs) AS obs, round((1 + sum(CASE WHEN abs(stat - obs) >= abs(obs) THEN 1 ELSE 0 END)) / (count(*) + 1e0), 8) AS p FROM st JOIN cnt ON st.model = cnt.model AND st.symbol = cnt.symbol GROUP BY st.model, st.symbol),
    rk AS (SELECT *, count(*) OVER () AS tests, row_number() OVER (ORDER BY p, model, symbol) AS k FROM ps)
    SELECT model, symbol, round(obs, 8) AS observed, p, round(max(least(1e0, p * (tests - k + 1))) OVER (ORDER BY p, model, symbol ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS p_holm FROM rk"""

_HALF_LIVES = (360, 720, 1440)

SHARED: dict[str, str] = {
    "day_records": _DAY_RECORDS,
    "paired_ranking_or_none": """SELECT model, round(loss, 8) AS loss, CAST(CASE WHEN paired THEN rank() OVER (ORDER BY round(loss, 10)) END AS BIGINT) AS place FROM (
        SELECT model, sum(pinball_sum) / sum(n) AS loss FROM {day_scores} GROUP BY model) r CROSS JOIN (SELECT min(models) = max(models) AS paired FROM (
        SELECT symbol, d, count(DISTINCT model) AS models FROM {day_scores} GROUP BY symbol, d) x) y""",
    "unmatched_rows": """SELECT a.model AS model_a, b.model AS model_b, CAST(sum(CASE WHEN a.seq IS NULL OR b.seq IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched, CAST(count(*) AS BIGINT) AS n FROM (
        SELECT * FROM {scored} WHERE model = 'empirical' AND level = 950) a FULL JOIN (SELECT * FROM {scored} WHERE model = 'rolling' AND level = 950) b ON a.symbol = b.symbol AND a.seq = b.seq GROUP BY a.model, b.model""",
    "clock_labels_known": f"""SELECT symbol, CAST(sum(CASE WHEN slot BETWEEN 0 AND {1440 // _MINUTES - 1} AND (session = 'am') = (slot * {_MINUTES} < {S.session_split_minute}) THEN 0 ELSE 1 END) AS BIGINT) AS unknown,
        CAST(count(*) AS BIGINT) AS n FROM {{fine}} GROUP BY symbol""",
    "within_tolerance": """SELECT model, CAST(sum(CASE WHEN abs(width - (q_high - q_low)) <= 1e-12 THEN 0 ELSE 1 END) AS BIGINT) AS outside, CAST(count(*) AS BIGINT) AS n FROM {scored} GROUP BY model""",
    "monotone_levels": """SELECT model, CAST(sum(CASE WHEN p IS NULL OR width > p THEN 0 ELSE 1 END) AS BIGINT) AS not_rising, CAST(count(*) AS BIGINT) AS n FROM (
        SELECT model, width, lag(width) OVER (PARTITION BY symbol, seq, model ORDER BY level) AS p FROM {scored}) t GROUP BY model""",
    "model_name_parts": """SELECT DISTINCT model, substring(model, 1, 3) AS head, substring(model, length(model) - 2, 3) AS tail, CASE WHEN model LIKE 'norm%' THEN 1 ELSE 0 END AS has_prefix,
        CASE WHEN model LIKE '%ing' THEN 1 ELSE 0 END AS has_suffix FROM {day_scores}""",
    "pending_days": f"""SELECT symbol, CAST(day_idx AS BIGINT) AS day_idx FROM (SELECT symbol, day_idx, row_number() OVER (PARTITION BY symbol ORDER BY day_idx) AS place FROM (
        SELECT DISTINCT symbol, day_idx FROM {{samples}} WHERE day_idx >= {S.history_days}) a) b WHERE place <= 3""",
    "two_sided_rates": """SELECT model, CAST(level AS BIGINT) AS level, round(sum(lower_n) * 1e0 / sum(n), 8) AS lower_rate, round(sum(upper_n) * 1e0 / sum(n), 8) AS upper_rate,
        round(1 - sum(lower_n + upper_n) * 1e0 / sum(n) - level / 1000e0, 8) AS coverage_gap FROM {day_scores} GROUP BY model, level""",
}

PAIRS: dict[str, tuple[str, str]] = {
    "bootstrap_holm": reports._both(_HOLM),
    "day_pit_records": tuple(_PIT_RECORDS.replace("PIT", pit) for pit in (reports._PIT_RANKED, reports._PIT)),
    "sample_times": (
        f"""SELECT symbol, CAST(date_format(d, 'yyyyMMdd') AS BIGINT) AS day_key, CAST(slot AS BIGINT) AS slot,
        date_format(timestampadd(MINUTE, (slot + 1) * {_MINUTES}, CAST(d AS TIMESTAMP_NTZ)), 'yyyy-MM-dd HH:mm') AS available_at,
        date_format(timestampadd(MINUTE, (slot + 1) * {_MINUTES}, CAST(d AS TIMESTAMP_NTZ)), 'yyyy-MM-dd HH:mm') AS target_timestamp,
        CAST({_MINUTES} AS BIGINT) AS horizon_minutes FROM {{samples}}""",
        f"""SELECT symbol, CAST(strftime(d, '%Y%m%d') AS BIGINT) AS day_key, CAST(slot AS BIGINT) AS slot, strftime(d::TIMESTAMP + to_minutes((slot + 1) * {_MINUTES}), '%Y-%m-%d %H:%M') AS available_at,
        strftime(d::TIMESTAMP + to_minutes((slot + 1) * {_MINUTES}), '%Y-%m-%d %H:%M') AS target_timestamp, CAST({_MINUTES} AS BIGINT) AS horizon_minutes FROM {{samples}}""",
    ),
    "score_json": (
        """SELECT symbol, to_json(map_from_arrays(sort_array(collect_list(model)), array_sort(collect_list(struct(model, n))).n)) AS counts FROM (
        SELECT symbol, model, CAST(sum(n) AS BIGINT) AS n FROM {day_scores} GROUP BY symbol, model) t GROUP BY symbol""",
        """SELECT symbol, '{{' || string_agg('"' || model || '":' || n, ',' ORDER BY model) || '}}' AS counts FROM (
        SELECT symbol, model, CAST(sum(n) AS BIGINT) AS n FROM {day_scores} GROUP BY symbol, model) t GROUP BY symbol""",
    ),
}

QUERIES = {n: reports._query(t) for n, t in SHARED.items()} | {n: reports._query(a) for n, (a, _) in PAIRS.items()}
ORACLES = {n: reports._duck(t) for n, t in SHARED.items()} | {n: reports._duck(b) for n, (_, b) in PAIRS.items()}
