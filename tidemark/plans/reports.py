"""Reports as SQL over the core tables. ``{name}`` stands for a table of ``plans.core``.

Most texts are plain ANSI SQL. Where the two dialects part (series, arrays), a report has a
text for each.
"""

from __future__ import annotations

from ..config import DEFAULT as S
from . import core

#: name -> SQL for both engines
SHARED: dict[str, str] = {
    # bars and samples
    "audit_report": """SELECT CAST(count(*) AS BIGINT) AS n_bars, CAST(count(DISTINCT symbol) AS BIGINT) AS symbols, CAST(count(DISTINCT d) AS BIGINT) AS days,
        CAST(min(d) AS STRING) AS first_day, CAST(max(d) AS STRING) AS last_day, CAST(sum(n) AS BIGINT) AS n_ticks,
        CAST(sum(CASE WHEN session = 'am' THEN 1 ELSE 0 END) AS BIGINT) AS am_bars, CAST(sum(CASE WHEN session = 'pm' THEN 1 ELSE 0 END) AS BIGINT) AS pm_bars,
        round(sum(volume), 2) AS volume, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS one_tick_bars FROM {fine}""",
    "session_label": "SELECT symbol, session, CAST(count(*) AS BIGINT) AS bars, CAST(min(slot) AS BIGINT) AS first_slot, CAST(max(slot) AS BIGINT) AS last_slot FROM {fine} GROUP BY symbol, session",
    "ohlc_violations": """SELECT symbol, CAST(sum(CASE WHEN high < greatest(open, close, low) OR low > least(open, close, high) OR low <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_prices,
        CAST(sum(CASE WHEN volume < 0 OR volume IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad_volumes, CAST(count(*) AS BIGINT) AS bars FROM {fine} GROUP BY symbol""",
    "bars_fine": "SELECT symbol, CAST(d AS STRING) AS d, session, CAST(slot AS BIGINT) AS slot, CAST(n AS BIGINT) AS n, open, high, low, close, round(volume, 4) AS volume FROM {fine}",
    "bars_coarse_complete": "SELECT symbol, CAST(d AS STRING) AS d, session, CAST(bucket AS BIGINT) AS bucket, open, high, low, close, round(volume, 4) AS volume FROM {coarse} WHERE complete",
    "incomplete_buckets": "SELECT symbol, CAST(bucket AS BIGINT) AS bucket, CAST(sum(CASE WHEN complete THEN 0 ELSE 1 END) AS BIGINT) AS incomplete, CAST(count(*) AS BIGINT) AS buckets FROM {coarse} GROUP BY symbol, bucket",
    "forecast_samples": "SELECT symbol, CAST(d AS STRING) AS d, session, CAST(slot AS BIGINT) AS slot, close, round(r, 10) AS r, CAST(day_idx AS BIGINT) AS day_idx, CAST(seq AS BIGINT) AS seq FROM {samples}",
    "date_range_samples": "SELECT symbol, CAST(count(*) AS BIGINT) AS n, round(sum(r), 8) AS total_r FROM {samples} WHERE d BETWEEN DATE '2024-01-05' AND DATE '2024-01-20' GROUP BY symbol",
    # volatility and bands
    "rolling_sigma": "SELECT symbol, CAST(seq AS BIGINT) AS seq, round(sigma_roll, 8) AS sigma_roll FROM {sigma} WHERE sigma_roll IS NOT NULL",
    "ewma_sigma": "SELECT symbol, CAST(seq AS BIGINT) AS seq, round(sigma, 8) AS sigma FROM {sigma} WHERE sigma IS NOT NULL",
    "standardized_residuals": "SELECT symbol, CAST(seq AS BIGINT) AS seq, round(z, 8) AS z FROM {sigma} WHERE z IS NOT NULL",
    "empirical_quantiles_by_day": "SELECT symbol, CAST(day_idx AS BIGINT) AS day_idx, CAST(level AS BIGINT) AS level, round(z_low, 8) AS z_low, round(z_high, 8) AS z_high FROM {zq}",
    "empirical_bands": "SELECT symbol, CAST(seq AS BIGINT) AS seq, CAST(level AS BIGINT) AS level, round(q_low, 8) AS q_low, round(q_high, 8) AS q_high FROM {scored} WHERE model = 'empirical'",
    "normal_bands": "SELECT symbol, CAST(seq AS BIGINT) AS seq, model, CAST(level AS BIGINT) AS level, round(q_low, 8) AS q_low, round(q_high, 8) AS q_high FROM {scored} WHERE model <> 'empirical'",
    "price_bands": "SELECT symbol, CAST(seq AS BIGINT) AS seq, model, CAST(level AS BIGINT) AS level, round(ln(close * exp(q_low)), 8) AS log_low, round(ln(close * exp(q_high)), 8) AS log_high FROM {scored} WHERE level = 950",
    "band_order_guard": "SELECT model, CAST(sum(CASE WHEN q_low < q_high THEN 0 ELSE 1 END) AS BIGINT) AS crossed, CAST(count(*) AS BIGINT) AS n FROM {scored} GROUP BY model",
    # scores
    "pinball_by_model_level": """SELECT model, CAST(level AS BIGINT) AS level, CAST(sum(n) AS BIGINT) AS n, round(sum(pinball_sum) / sum(n), 8) AS mean_pinball,
        round(1 - sum(lower_n + upper_n) * 1e0 / sum(n), 8) AS coverage, round(sum(width_sum) / sum(n), 8) AS mean_width FROM {day_scores} GROUP BY model, level""",
    "equal_weight_score": """SELECT model, round(avg(loss), 8) AS score FROM (SELECT model, level, sum(pinball_sum) / sum(n) AS loss FROM {day_scores} GROUP BY model, level) GROUP BY model""",
    "coverage_summary": """SELECT symbol, model, CAST(level AS BIGINT) AS level, CAST(sum(n) AS BIGINT) AS n, round(sum(lower_n) * 1e0 / sum(n), 8) AS lower_rate, round(sum(upper_n) * 1e0 / sum(n), 8) AS upper_rate,
        round(sum(width_sum) / sum(n), 8) AS mean_width FROM {day_scores} GROUP BY symbol, model, level""",
    "day_scores": """SELECT symbol, CAST(d AS STRING) AS d, model, CAST(level AS BIGINT) AS level, CAST(n AS BIGINT) AS n, round(pinball_sum, 8) AS pinball_sum, round(width_sum, 8) AS width_sum,
        CAST(lower_n AS BIGINT) AS lower_n, CAST(upper_n AS BIGINT) AS upper_n FROM {day_scores}""",
    "model_symbol_rollup": """SELECT symbol, model, CAST(sum(n) AS BIGINT) AS n, round(sum(pinball_sum) / sum(n), 8) AS mean_pinball FROM {day_scores} GROUP BY ROLLUP (model, symbol)""",
    "year_scores": """SELECT symbol, CAST(year(d) AS BIGINT) AS year, CAST(level AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n, round(avg(pinball), 8) AS mean_pinball,
        round(1 - avg(lower + upper), 8) AS coverage FROM {daily_scored} GROUP BY symbol, year(d), level""",
    "period_grouping_sets": """SELECT period, CAST(level AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n, round(avg(pinball), 8) AS mean_pinball FROM (
        SELECT level, pinball, CASE WHEN d < DATE '1996-01-01' THEN 'early' ELSE 'late' END AS period FROM {daily_scored}) GROUP BY GROUPING SETS ((level), (level, period))""",
    "first_last_days": "SELECT symbol, CAST(min(d) AS STRING) AS first_day, CAST(max(d) AS STRING) AS last_day, CAST(count(*) AS BIGINT) AS days FROM {daily} GROUP BY symbol",
    "paired_days": f"""SELECT symbol, CAST(d AS STRING) AS d, CAST(count(DISTINCT model) AS BIGINT) AS models, CAST(sum(n) AS BIGINT) AS n FROM {{day_scores}}
        GROUP BY symbol, d HAVING count(DISTINCT model) = 3 AND count(*) = {3 * len(S.levels)}""",
    "paired_ranking": """SELECT model, round(loss, 8) AS loss, CAST(rank() OVER (ORDER BY round(loss, 10)) AS BIGINT) AS place FROM (
        SELECT model, sum(pinball_sum) / sum(n) AS loss FROM {day_scores} s JOIN (SELECT symbol AS sy, d AS dd FROM {day_scores} GROUP BY symbol, d HAVING count(DISTINCT model) = 3) p
        ON s.symbol = p.sy AND s.d = p.dd GROUP BY model)""",
    "align_check": """SELECT a.model AS model_a, b.model AS model_b, CAST(count(*) AS BIGINT) AS bars, round(max(abs(a.r - b.r)), 12) AS max_gap FROM {scored} a JOIN {scored} b
        ON a.symbol = b.symbol AND a.seq = b.seq AND a.level = b.level AND a.model < b.model GROUP BY a.model, b.model""",
    "missing_days": """SELECT DISTINCT s.symbol, CAST(s.d AS STRING) AS d FROM {samples} s LEFT ANTI JOIN {zq} q ON s.symbol = q.symbol AND s.day_idx = q.day_idx""",
    "common_days": """SELECT CAST(d AS STRING) AS d FROM {samples} WHERE symbol = 'click' INTERSECT SELECT CAST(d AS STRING) AS d FROM {samples} WHERE symbol = 'view'""",
    "unmatched_slots": """SELECT CAST(d AS STRING) AS d, CAST(slot AS BIGINT) AS slot FROM {fine} WHERE symbol = 'click' EXCEPT SELECT CAST(d AS STRING) AS d, CAST(slot AS BIGINT) AS slot FROM {fine} WHERE symbol = 'view'""",
    # independence of exceedances
    "transition_counts": """SELECT model, CAST(level AS BIGINT) AS level, CAST(sum(CASE WHEN p = 0 AND f = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n00, CAST(sum(CASE WHEN p = 0 AND f = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n01,
        CAST(sum(CASE WHEN p = 1 AND f = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n10, CAST(sum(CASE WHEN p = 1 AND f = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n11 FROM (
        SELECT model, level, lower + upper AS f, lag(lower + upper) OVER (PARTITION BY symbol, d, session, model, level ORDER BY slot) AS p FROM {scored}) t WHERE p IS NOT NULL GROUP BY model, level""",
    "independence_lr": """SELECT model, CAST(level AS BIGINT) AS level, CASE WHEN least((n00 + n01) * (n00 + n10), (n00 + n01) * (n01 + n11), (n10 + n11) * (n00 + n10), (n10 + n11) * (n01 + n11)) / t >= 5 THEN round(2 * (
          n00 * ln(greatest(n00, 1e-300) * t / ((n00 + n01) * (n00 + n10))) + n01 * ln(greatest(n01, 1e-300) * t / ((n00 + n01) * (n01 + n11)))
        + n10 * ln(greatest(n10, 1e-300) * t / ((n10 + n11) * (n00 + n10))) + n11 * ln(greatest(n11, 1e-300) * t / ((n10 + n11) * (n01 + n11)))), 8) END AS lr FROM (
        SELECT model, level, sum((1 - p) * (1 - f)) * 1e0 AS n00, sum((1 - p) * f) * 1e0 AS n01, sum(p * (1 - f)) * 1e0 AS n10, sum(p * f) * 1e0 AS n11, count(*) * 1e0 AS t FROM (
        SELECT model, level, lower + upper AS f, lag(lower + upper) OVER (PARTITION BY symbol, d, session, model, level ORDER BY slot) AS p FROM {scored}) x WHERE p IS NOT NULL GROUP BY model, level)""",
    # probability integral transform of the empirical model
    # seasonal volatility
    "seasonal_factors": "SELECT symbol, CAST(day_idx AS BIGINT) AS day_idx, CAST(bucket AS BIGINT) AS bucket, round(factor, 8) AS factor FROM {factors}",
    "seasonal_sigma": "SELECT symbol, CAST(seq AS BIGINT) AS seq, round(factor, 8) AS factor, round(sigma_season, 8) AS sigma_season FROM {seasonal} WHERE sigma_season IS NOT NULL",
    "bucket_coverage": f"""SELECT model, CAST(level AS BIGINT) AS level, CAST(floor((slot + 1) / {S.coarse_bars}e0) AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n, round(1 - avg(lower + upper), 8) AS coverage
        FROM {{scored}} GROUP BY model, level, CAST(floor((slot + 1) / {S.coarse_bars}e0) AS BIGINT)""",
    "coverage_pivot": "SELECT model, " + ", ".join(
        f"round(1 - sum(CASE WHEN level = {core.B.tag(c)} THEN lower_n + upper_n ELSE 0 END) * 1e0 / sum(CASE WHEN level = {core.B.tag(c)} THEN n ELSE 0 END), 8) AS cover_{core.B.tag(c)}" for c in S.levels
    ) + " FROM {day_scores} GROUP BY model",
    # residual diagnostics
    "residual_moments": """SELECT symbol, CAST(n AS BIGINT) AS n, round(m, 8) AS mean, round(sqrt(v), 8) AS std, round(m3 / (v * sqrt(v)), 6) AS skewness, round(m4 / (v * v) - 3, 6) AS excess_kurtosis, round(top, 8) AS max_abs FROM (
        SELECT s.symbol, count(*) AS n, any_value(m) AS m, avg((z - m) * (z - m)) AS v, avg((z - m) * (z - m) * (z - m)) AS m3, avg((z - m) * (z - m) * (z - m) * (z - m)) AS m4, max(abs(z)) AS top
        FROM {sigma} s JOIN (SELECT symbol AS sy, avg(z) AS m FROM {sigma} GROUP BY symbol) c ON s.symbol = c.sy WHERE z IS NOT NULL GROUP BY s.symbol)""",
    "tail_shares": """SELECT symbol, round(avg(CASE WHEN abs(z) > 2 THEN 1e0 ELSE 0e0 END), 8) AS above_2, round(avg(CASE WHEN abs(z) > 3 THEN 1e0 ELSE 0e0 END), 8) AS above_3,
        round(percentile_cont(9e-1) WITHIN GROUP (ORDER BY abs(z)), 8) AS q90, round(percentile_cont(99e-2) WITHIN GROUP (ORDER BY abs(z)), 8) AS q99 FROM {sigma} WHERE z IS NOT NULL GROUP BY symbol""",
    "clustered_mean_z2": """SELECT symbol, CAST(sum(n) AS BIGINT) AS n, CAST(count(*) AS BIGINT) AS days, round(max(m), 8) AS mean, round(sqrt(count(*) * 1e0 / nullif(count(*) - 1, 0) * sum(dev * dev)) / sum(n), 8) AS se FROM (
        SELECT s.symbol, d, count(*) AS n, max(m) AS m, sum(z * z - m) AS dev FROM {sigma} s JOIN (SELECT symbol AS sy, avg(z * z) AS m FROM {sigma} GROUP BY symbol) c ON s.symbol = c.sy
        WHERE z IS NOT NULL GROUP BY s.symbol, d) GROUP BY symbol""",
    "intraday_profile": """SELECT symbol, lpad(CAST(slot AS STRING), 2, '0') AS clock, CAST(count(*) AS BIGINT) AS n, round(avg(z * z), 8) AS mean_z2, round(stddev_pop(z), 8) AS std_z, round(avg(sigma), 8) AS mean_sigma,
        round(sqrt(avg(r * r)), 8) AS rms_r FROM {sigma} WHERE z IS NOT NULL GROUP BY symbol, lpad(CAST(slot AS STRING), 2, '0')""",
    "sigma_quantile_groups": """SELECT symbol, grp, CAST(count(*) AS BIGINT) AS n, round(avg(z * z), 8) AS mean_z2, round(avg(sigma), 8) AS mean_sigma FROM (
        SELECT s.symbol, z, sigma, CASE WHEN sigma < e1 THEN 'Q1' WHEN sigma < e2 THEN 'Q2' WHEN sigma < e3 THEN 'Q3' WHEN sigma < e4 THEN 'Q4' ELSE 'Q5' END AS grp FROM {sigma} s JOIN (
          SELECT symbol AS sy, percentile_cont(2e-1) WITHIN GROUP (ORDER BY sigma) AS e1, percentile_cont(4e-1) WITHIN GROUP (ORDER BY sigma) AS e2, percentile_cont(6e-1) WITHIN GROUP (ORDER BY sigma) AS e3,
                 percentile_cont(8e-1) WITHIN GROUP (ORDER BY sigma) AS e4 FROM {sigma} WHERE sigma IS NOT NULL GROUP BY symbol) e ON s.symbol = e.sy WHERE z IS NOT NULL) GROUP BY symbol, grp""",
    "lagged_abs_z_groups": """SELECT symbol, grp, CAST(count(*) AS BIGINT) AS n, round(avg(z * z), 8) AS mean_z2 FROM (
        SELECT symbol, z, CASE WHEN p IS NULL OR slot - ps <> 1 THEN 'first_or_gap' WHEN p < 1 THEN '<1' WHEN p < 2 THEN '1-2' WHEN p < 3 THEN '2-3' ELSE '>=3' END AS grp FROM (
          SELECT symbol, z, slot, lag(abs(z)) OVER w AS p, lag(slot) OVER w AS ps FROM {sigma} WHERE z IS NOT NULL WINDOW w AS (PARTITION BY symbol, d, session ORDER BY slot)) x) GROUP BY symbol, grp""",
    # refits
    "refit_schedule": f"""SELECT symbol, CAST(day_idx AS BIGINT) AS day_idx, CAST(floor((day_idx - {S.history_days}) / {S.refit_days}e0) AS BIGINT) AS refit,
        CASE WHEN (day_idx - {S.history_days}) % {S.refit_days} = 0 THEN 1 ELSE 0 END AS refits_now FROM (SELECT DISTINCT symbol, day_idx FROM {{samples}}) WHERE day_idx >= {S.history_days}""",
    "raw_vs_std_scale": """SELECT s.symbol, CAST(q.level AS BIGINT) AS level, round(sum(s.sigma * (z_high - z_low)), 6) AS std_width, round(sum(s.sigma * (c.m + c.sd * z_high) - s.sigma * (c.m + c.sd * z_low)), 6) AS raw_width
        FROM {sigma} s JOIN {zq} q ON s.symbol = q.symbol AND s.day_idx = q.day_idx JOIN (SELECT symbol AS sy, avg(z) AS m, stddev_pop(z) AS sd FROM {sigma} GROUP BY symbol) c ON s.symbol = c.sy
        WHERE s.sigma IS NOT NULL GROUP BY s.symbol, q.level""",
    "spearman_stability": """SELECT a.level AS level, round(corr(a.rk, b.rk), 8) AS rho, CAST(count(*) AS BIGINT) AS keys FROM (
        SELECT level, k, rank() OVER (PARTITION BY level ORDER BY x) + (count(*) OVER (PARTITION BY level, x) - 1) / 2e0 AS rk FROM (SELECT CAST(level AS BIGINT) AS level, concat(model, symbol) AS k, round(sum(pinball_sum) / sum(n), 10) AS x
          FROM {day_scores} WHERE day_idx < 20 GROUP BY level, model, symbol) u) a JOIN (
        SELECT level, k, rank() OVER (PARTITION BY level ORDER BY x) + (count(*) OVER (PARTITION BY level, x) - 1) / 2e0 AS rk FROM (SELECT CAST(level AS BIGINT) AS level, concat(model, symbol) AS k, round(sum(pinball_sum) / sum(n), 10) AS x
          FROM {day_scores} WHERE day_idx >= 20 GROUP BY level, model, symbol) u) b ON a.level = b.level AND a.k = b.k GROUP BY a.level HAVING count(*) >= 3""",
    "holm_adjust": """SELECT symbol, bucket, round(p, 8) AS p, round(max(least(1e0, p * (m - k + 1))) OVER (ORDER BY p, symbol, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 8) AS p_holm FROM (
        SELECT symbol, CAST(bucket AS BIGINT) AS bucket, round(exp(-n * dev * dev), 10) AS p, count(*) OVER () AS m, row_number() OVER (ORDER BY round(exp(-n * dev * dev), 10), symbol, bucket) AS k FROM (
          SELECT symbol, floor(slot / 4e0) AS bucket, count(*) AS n, avg(r) / 4 AS dev FROM {samples} GROUP BY symbol, floor(slot / 4e0)) g) t""",
    "representative_day": """SELECT symbol, CAST(min(day_idx) AS BIGINT) AS day_idx, round(max(dist), 8) AS dist FROM (SELECT symbol, day_idx, dist, min(dist) OVER (PARTITION BY symbol) AS least_dist FROM (
        SELECT q.symbol, day_idx, round(sum((z_low - ml) * (z_low - ml) + (z_high - mh) * (z_high - mh)), 10) AS dist FROM {zq} q JOIN (SELECT symbol AS sy, level AS lv, percentile_cont(5e-1) WITHIN GROUP (ORDER BY z_low) AS ml,
        percentile_cont(5e-1) WITHIN GROUP (ORDER BY z_high) AS mh FROM {zq} GROUP BY symbol, level) m ON q.symbol = m.sy AND q.level = m.lv GROUP BY q.symbol, day_idx) x) y WHERE dist = least_dist GROUP BY symbol""",
    "order_day_extremes": "SELECT symbol, CAST(d AS STRING) AS d, round(r, 8) AS r, CAST(place AS BIGINT) AS place FROM (SELECT symbol, d, r, row_number() OVER (PARTITION BY symbol ORDER BY abs(r) DESC, d) AS place FROM {daily}) WHERE place <= 5",
}

# A pair of lags lies within one day and session: Spark partitions by these, the oracle runs over the whole series and compares.
_ACF = """SELECT symbol, CAST(k AS BIGINT) AS lag, CAST(count(*) AS BIGINT) AS pairs, round(avg((z - m) * (zk - m)) / max(v), 8) AS acf, round(196e-2 / sqrt(count(*)), 8) AS band95 FROM (
        SELECT s.symbol, k, z, m, v, CASE k WHEN 1 THEN z1 WHEN 2 THEN z2 WHEN 3 THEN z3 ELSE z4 END AS zk, CASE k WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 ELSE s4 END AS sk, slot,
               CASE k WHEN 1 THEN g1 WHEN 2 THEN g2 WHEN 3 THEN g3 ELSE g4 END AS gk, g FROM (
          SELECT symbol, z, slot, g, lag(z, 1) OVER w AS z1, lag(z, 2) OVER w AS z2, lag(z, 3) OVER w AS z3, lag(z, 4) OVER w AS z4, lag(slot, 1) OVER w AS s1, lag(slot, 2) OVER w AS s2, lag(slot, 3) OVER w AS s3,
                 lag(slot, 4) OVER w AS s4, lag(g, 1) OVER w AS g1, lag(g, 2) OVER w AS g2, lag(g, 3) OVER w AS g3, lag(g, 4) OVER w AS g4
          FROM (SELECT symbol, z, slot, seq, day_idx * 2 + CASE WHEN session = 'pm' THEN 1 ELSE 0 END AS g FROM {sigma} WHERE z IS NOT NULL) i WINDOW w AS (PARTITION BY symbol ORDER BY seq)) s
        JOIN (SELECT symbol AS sy, avg(z) AS m, var_pop(z) AS v FROM {sigma} GROUP BY symbol) c ON s.symbol = c.sy CROSS JOIN (VALUES (1), (2), (3), (4)) AS lags(k)) t
        WHERE g = gk AND slot - sk = k GROUP BY symbol, k"""
_PORTMANTEAU = """SELECT symbol, round(sum(pairs * acf * acf), 8) AS q, CAST(count(*) AS BIGINT) AS lags, round(exp(-sum(pairs * acf * acf) / 2) * (1 + sum(pairs * acf * acf) / 2), 8) AS p_value FROM (
        SELECT s.symbol, k, count(*) AS pairs, avg((z - m) * (CASE k WHEN 1 THEN z1 WHEN 2 THEN z2 WHEN 3 THEN z3 ELSE z4 END - m)) / max(v) AS acf FROM (
          SELECT symbol, z, slot, g, lag(z, 1) OVER w AS z1, lag(z, 2) OVER w AS z2, lag(z, 3) OVER w AS z3, lag(z, 4) OVER w AS z4, lag(slot, 1) OVER w AS s1, lag(slot, 2) OVER w AS s2, lag(slot, 3) OVER w AS s3,
                 lag(slot, 4) OVER w AS s4, lag(g, 1) OVER w AS g1, lag(g, 2) OVER w AS g2, lag(g, 3) OVER w AS g3, lag(g, 4) OVER w AS g4
          FROM (SELECT symbol, z, slot, seq, day_idx * 2 + CASE WHEN session = 'pm' THEN 1 ELSE 0 END AS g FROM {sigma} WHERE z IS NOT NULL) i WINDOW w AS (PARTITION BY symbol ORDER BY seq)) s
        JOIN (SELECT symbol AS sy, avg(z) AS m, var_pop(z) AS v FROM {sigma} GROUP BY symbol) c ON s.symbol = c.sy CROSS JOIN (VALUES (1), (2), (3), (4)) AS lags(k)
        WHERE g = CASE k WHEN 1 THEN g1 WHEN 2 THEN g2 WHEN 3 THEN g3 ELSE g4 END AND slot - CASE k WHEN 1 THEN s1 WHEN 2 THEN s2 WHEN 3 THEN s3 ELSE s4 END = k GROUP BY s.symbol, k) GROUP BY symbol"""


def _within_sessions(text: str) -> str:
    return text.replace("SELECT symbol, z, slot, seq, day_idx", "SELECT symbol, z, slot, seq, d, session, day_idx").replace("PARTITION BY symbol ORDER BY seq", "PARTITION BY symbol, d, session ORDER BY seq")


_SEASON_MOMENTS = """SELECT symbol, round(stddev_pop(a), 8) AS std, round(max(abs(a)), 8) AS max_abs, round(avg(CASE WHEN abs(a) > 2 THEN 1e0 ELSE 0e0 END), 8) AS above_2 FROM (
        SELECT symbol, z / sqrt(avg(z * z) OVER (PARTITION BY symbol, slot)) AS a FROM {sigma} WHERE z IS NOT NULL) GROUP BY symbol"""
_SEASON_MOMENTS_JOINED = """SELECT symbol, round(stddev_pop(a), 8) AS std, round(max(abs(a)), 8) AS max_abs, round(avg(CASE WHEN abs(a) > 2 THEN 1e0 ELSE 0e0 END), 8) AS above_2 FROM (
    SELECT s.symbol, z / sqrt(m2) AS a FROM {sigma} s JOIN (SELECT symbol AS sy, slot AS sl, avg(z * z) AS m2 FROM {sigma} WHERE z IS NOT NULL GROUP BY symbol, slot) m ON s.symbol = m.sy AND s.slot = m.sl WHERE z IS NOT NULL) GROUP BY symbol"""
_ASOF = f"""SELECT b.symbol, CAST(b.day_idx AS BIGINT) AS day_idx, CAST(max(f.day_idx) AS BIGINT) AS refit_day FROM (SELECT DISTINCT symbol, day_idx FROM {{samples}}) b
        JOIN (SELECT DISTINCT symbol, day_idx FROM {{samples}} WHERE day_idx >= {S.history_days} AND (day_idx - {S.history_days}) % {S.refit_days} = 0) f ON b.symbol = f.symbol AND f.day_idx <= b.day_idx GROUP BY b.symbol, b.day_idx"""
_ASOF_LATEST = f"""SELECT symbol, CAST(day_idx AS BIGINT) AS day_idx, CAST(refit_day AS BIGINT) AS refit_day FROM (SELECT symbol, day_idx,
    max(CASE WHEN day_idx >= {S.history_days} AND (day_idx - {S.history_days}) % {S.refit_days} = 0 THEN day_idx END) OVER (PARTITION BY symbol ORDER BY day_idx) AS refit_day
    FROM (SELECT DISTINCT symbol, day_idx FROM {{samples}}) x) y WHERE refit_day IS NOT NULL"""
# Each residual is sent to the days that look back at it; there one running count ranks the day's own residuals.
_PIT_RANKED = f"""SELECT symbol, seq, day_idx, (below + 5e-1) / (n + 1) AS pit FROM (
    SELECT symbol, seq, day_idx, h, sum(h) OVER (PARTITION BY symbol, day_idx ORDER BY z) AS below, sum(h) OVER (PARTITION BY symbol, day_idx) AS n FROM (
      SELECT symbol, CAST(NULL AS BIGINT) AS seq, day_idx + o AS day_idx, z, 1 AS h FROM {{sigma}} CROSS JOIN (VALUES {", ".join(f"({o})" for o in range(1, S.history_days + 1))}) AS back(o) WHERE z IS NOT NULL
      UNION ALL SELECT symbol, CAST(seq AS BIGINT), day_idx, z, 0 FROM {{sigma}} WHERE z IS NOT NULL) u) v WHERE h = 0 AND n >= {S.min_history}"""
_PIT_BINS = f"""SELECT symbol, CAST(least(floor(pit * {S.pit_bins}), {S.pit_bins - 1}) AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM (PIT) p GROUP BY symbol, CAST(least(floor(pit * {S.pit_bins}), {S.pit_bins - 1}) AS BIGINT)"""
_PIT = """SELECT a.symbol, a.seq, a.day_idx, (sum(CASE WHEN b.z <= a.z THEN 1 ELSE 0 END) + 5e-1) / (count(*) + 1) AS pit FROM {sigma} a JOIN {sigma} b
    ON a.symbol = b.symbol AND b.day_idx BETWEEN a.day_idx - 10 AND a.day_idx - 1 AND a.z IS NOT NULL AND b.z IS NOT NULL GROUP BY a.symbol, a.seq, a.day_idx HAVING count(*) >= 20"""
_BOOT = f"""SELECT rep, CAST(count(*) AS BIGINT) AS days, round(sum(diff) / nullif(sum(n), 0), 8) AS stat FROM (
    SELECT rep, blk * {S.block_days} + o AS place, ((rep * 7919 + blk * 104729 + rep * blk * 31) % greatest(m, 1) + o) % greatest(m, 1) AS idx, m FROM reps CROSS JOIN blks CROSS JOIN offs CROSS JOIN cnt) p
    JOIN dd ON dd.idx = p.idx WHERE place < m GROUP BY rep"""
_DAYDIFF = """SELECT row_number() OVER (ORDER BY day_idx) - 1 AS idx, sum(CASE WHEN model = 'empirical' THEN pinball_sum ELSE -pinball_sum END) AS diff, sum(CASE WHEN model = 'empirical' THEN n ELSE 0 END) AS n
    FROM {day_scores} WHERE model IN ('empirical', 'normal') AND day_idx >= 15 GROUP BY day_idx"""
_GRID = """SELECT i, -8 + i * 16 / 2000e0 AS x, exp(-(-8 + i * 16 / 2000e0) * (-8 + i * 16 / 2000e0) / 2) / sqrt(2 * pi()) AS f FROM g"""
_CDF = """SELECT i, x, least(greatest(sum((f + coalesce(pf, f)) / 2 * CASE WHEN pf IS NULL THEN 0 ELSE 16 / 2000e0 END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0e0), 1e0) AS cdf
    FROM (SELECT i, x, f, lag(f) OVER (ORDER BY i) AS pf FROM d) u"""
_INT = "SELECT i, x, cdf, sum((cdf + coalesce(pc, cdf)) / 2 * CASE WHEN pc IS NULL THEN 0 ELSE 16 / 2000e0 END) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS area FROM (SELECT i, x, cdf, lag(cdf) OVER (ORDER BY i) AS pc FROM c) u"
_INTERP = """SELECT q.symbol, CAST(q.day_idx AS BIGINT) AS day_idx, CAST(q.level AS BIGINT) AS level, round(a.cdf + (b.cdf - a.cdf) * (v - a.x) / (b.x - a.x), 8) AS p_high
    FROM (SELECT symbol, day_idx, level, least(greatest(z_high, -8e0), 7999e-3) AS v FROM {zq}) q JOIN c a ON a.i = CAST(floor((v + 8) / 16e0 * 2000) AS BIGINT) JOIN c b ON b.i = a.i + 1"""
_LOSS = """SELECT q.symbol, CAST(q.level AS BIGINT) AS level, round(avg(-p * v + a.area + (b.area - a.area) * (v - a.x) / (b.x - a.x)), 8) AS expected_loss
    FROM (SELECT symbol, level, (1 + level / 1000e0) / 2 AS p, least(greatest(z_high, -8e0), 7999e-3) AS v FROM {zq}) q JOIN e a ON a.i = CAST(floor((v + 8) / 16e0 * 2000) AS BIGINT) JOIN e b ON b.i = a.i + 1 GROUP BY q.symbol, q.level"""


def _both(template: str) -> tuple[str, str]:
    """A text for Spark and one for DuckDB: SERIES(a,n) is a column of 0..n-1 named a, UPTO(a,e) one of 0..e-1 for each row, e at least 1."""
    import re

    spark = re.sub(r"SERIES\((\w+),(\d+)\)", r"SELECT id AS \1 FROM range(\2)", template)
    duck = re.sub(r"SERIES\((\w+),(\d+)\)", r"SELECT range AS \1 FROM range(\2)", template)
    spark = re.sub(r"UPTO\((\w+),([^;]+);\)", r"SELECT explode(sequence(0L, CAST(greatest(\2, 1) AS BIGINT) - 1)) AS \1", spark)
    duck = re.sub(r"UPTO\((\w+),([^;]+);\)", r"SELECT unnest(range(CAST(greatest(\2, 1) AS BIGINT))) AS \1", duck)
    return spark, duck


_REPS = f"""reps AS (SERIES(rep,{S.replicates})), offs AS (SERIES(o,{S.block_days})), dd AS ({_DAYDIFF}), cnt AS (SELECT count(*) AS m FROM dd),
    blks AS (UPTO(blk,ceil(m / {S.block_days}e0);) FROM cnt)"""
#: name -> (Spark SQL, DuckDB SQL); the texts start with their own common table expressions
PAIRS: dict[str, tuple[str, str]] = {
    "block_bootstrap": _both(f"WITH {_REPS}, st AS ({_BOOT}) SELECT CAST(rep AS BIGINT) AS rep, days, stat FROM st"),
    "bootstrap_summary": _both(
        f"""WITH {_REPS}, st AS ({_BOOT}), ob AS (SELECT sum(diff) / nullif(sum(n), 0) AS obs FROM dd)
        SELECT round(max(obs), 8) AS observed, round(percentile_cont(25e-3) WITHIN GROUP (ORDER BY stat), 8) AS low, round(percentile_cont(975e-3) WITHIN GROUP (ORDER BY stat), 8) AS high,
        round((1 + sum(CASE WHEN abs(stat - obs) >= abs(obs) THEN 1 ELSE 0 END)) / (count(*) + 1e0), 8) AS p_two_sided FROM st CROSS JOIN ob"""
    ),
    "trapezoid_cdf": _both(f"WITH g AS (SERIES(i,2001)), d AS ({_GRID}), c AS ({_CDF}) SELECT CAST(i AS BIGINT) AS i, round(x, 8) AS x, round(cdf, 8) AS cdf FROM c"),
    "interp_grid": _both(f"WITH g AS (SERIES(i,2001)), d AS ({_GRID}), c AS ({_CDF}) {_INTERP}"),
    "expected_loss_grid": _both(f"WITH g AS (SERIES(i,2001)), d AS ({_GRID}), c AS ({_CDF}), e AS ({_INT}) {_LOSS}"),
    "pending_cases": _both(
        """WITH r AS (SERIES(rep,20)), done AS (SELECT DISTINCT symbol AS dgp, day_idx AS rep FROM {samples} WHERE day_idx % 3 = 0)
        SELECT c.dgp, CAST(c.rep AS BIGINT) AS rep FROM (SELECT dgp, r.rep FROM (SELECT DISTINCT symbol AS dgp FROM {samples}) s CROSS JOIN r) c LEFT ANTI JOIN done ON c.dgp = done.dgp AND c.rep = done.rep"""
    ),
    "pit_histogram_empirical": (_PIT_BINS.replace("PIT", _PIT_RANKED), _PIT_BINS.replace("PIT", _PIT)),
    "acf_within_session": (_within_sessions(_ACF), _ACF),
    "portmanteau": (_within_sessions(_PORTMANTEAU), _PORTMANTEAU),
    "season_adjusted_moments": (_SEASON_MOMENTS_JOINED, _SEASON_MOMENTS),
    "asof_active_fit": (_ASOF_LATEST, _ASOF),
    "pit_recalibration_map": tuple(
        f"""WITH p AS (PIT), g AS (SELECT DISTINCT symbol, day_idx FROM p) SELECT g.symbol, CAST(g.day_idx AS BIGINT) AS day_idx, CAST(count(*) AS BIGINT) AS n,
        round(percentile_cont(5e-2) WITHIN GROUP (ORDER BY pit), 8) AS p05, round(percentile_cont(95e-2) WITHIN GROUP (ORDER BY pit), 8) AS p95 FROM g JOIN p ON p.symbol = g.symbol AND p.day_idx < g.day_idx GROUP BY g.symbol, g.day_idx""".replace("PIT", pit)
        for pit in (_PIT_RANKED, _PIT)
    ),
    "sample_row_hash": (
        "SELECT symbol, sha2(concat_ws('|', symbol, CAST(d AS STRING), CAST(slot AS STRING)), 256) AS h FROM {samples}",
        "SELECT symbol, sha256(concat_ws('|', symbol, CAST(d AS VARCHAR), CAST(slot AS VARCHAR))) AS h FROM {samples}",
    ),
    "rank_days_by_volume": (
        "SELECT symbol, CAST(d AS STRING) AS d, CAST(dense_rank() OVER (PARTITION BY symbol ORDER BY round(v, 4) DESC) AS BIGINT) AS place FROM (SELECT symbol, d, sum(volume) AS v FROM {fine} GROUP BY symbol, d)",
    ) * 2,
}


def needs(text: str) -> tuple[str, ...]:
    return tuple(n for n in core.TABLES if "{" + n + "}" in text)


def _query(text: str):
    def run(spark, sf_dir):
        return spark.sql(text, **{n: core.TABLES[n](spark, sf_dir) for n in needs(text)})

    return run


def _duck(text: str) -> str:
    """The report's own expressions join the list of those it needs; anti joins in DuckDB's words."""
    text = text.replace("LEFT ANTI JOIN", "ANTI JOIN")
    used = needs(text)
    if text.startswith("WITH ") and used:
        return core.oracle(", " + text[5:], used).replace(") , ", "), ")
    return core.oracle(text, used)


QUERIES = {n: _query(t) for n, t in SHARED.items()} | {n: _query(a) for n, (a, _) in PAIRS.items()}
ORACLES = {n: _duck(t) for n, t in SHARED.items()} | {n: _duck(b) for n, (_, b) in PAIRS.items()}
