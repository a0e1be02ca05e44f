"""Queries that SQL can't express: fits, walks, simulations, streams."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.families import MODELS, Fitted
from ..functions import columns
from ..operators import calibration, fitting, inference, simulate
from ..shipping import ship
from ..sources import stores
from ..streaming import streams
from . import core, reports


def _pools(spark, sf_dir):
    ship(spark)
    rows = core.sigma(spark, sf_dir)
    return rows, fitting.refit_pools(rows)


def fit_nine_families(spark, sf_dir):
    _, pools = _pools(spark, sf_dir)
    return fitting.fit_history(pools, MODELS).select("symbol", "refit", "model", "status", "n_train", F.round("loglik", 4).alias("loglik"), F.round("center", 6).alias("center"), F.round("spread", 6).alias("spread"))


def mixture_em_fit(spark, sf_dir):
    _, pools = _pools(spark, sf_dir)
    found = fitting.fit_history(pools, ("normal_mixture_2", "normal_mixture_3"))
    return found.select("symbol", "refit", "model", "status", F.round("loglik", 4).alias("loglik"), F.round(F.col("params")["weight_1"], 4).alias("weight_1"))


def walk_forward_scores(spark, sf_dir):
    rows, pools = _pools(spark, sf_dir)
    score = fitting.walk_forward(rows, fitting.fit_history(pools, MODELS), 0.95)
    return score.groupBy("model").agg(F.count("*").alias("n"), F.round(F.avg("pinball"), 8).alias("mean_pinball"), F.round(1 - F.avg(F.col("lower") + F.col("upper")), 6).alias("coverage"))


def fit_failure_counts(spark, sf_dir):
    _, pools = _pools(spark, sf_dir)
    return fitting.fit_history(pools, MODELS).groupBy("model").agg(F.count("*").alias("attempts"), F.sum((F.col("status") == "failed").cast("long")).alias("failures"))


def pit_parametric(spark, sf_dir):
    rows, pools = _pools(spark, sf_dir)
    pits = [fitting.pit(rows, fitting.fit_history(pools, (m,)), m).withColumn("model", F.lit(m)) for m in MODELS]
    return reduce(DataFrame.union, pits).groupBy("model", "symbol", F.least(F.floor(F.col("pit") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"))


def mc_case_summary(spark, sf_dir):
    ship(spark)
    probs = (0.025, 0.5, 0.975)
    laws = {
        "normal": Fitted("normal", {"loc": 0.0, "scale": 1.0}, 0.0, 1.0, 0, 0.0),
        "student_t": Fitted("student_t", {"df": 5.0, "loc": 0.0, "scale": 1.0}, 0.0, (5 / 3) ** 0.5, 0, 0.0),
    }
    cases = simulate.run_cases(spark, laws, 8, 300, ("normal", "student_t"), probs)
    truth = spark.createDataFrame([(d, i, float(q)) for d, f in laws.items() for i, q in enumerate(f.ppf(list(probs)))], "dgp string, place int, q double")
    out = simulate.summary(cases, truth)
    return out.select("dgp", "model", "place", "n", *(F.round(c, 6).alias(c) for c in ("bias", "rmse", "efficiency")))


_MC_MODELS = ("normal", "student_t")
_MC_PROBS = (0.025, 0.5, 0.975)


def _mc(spark, sf_dir, replications: int = 8):
    """Laws, cases and probabilities of a simulation whose laws and sample size come from the table's own fits."""
    _, pools = _pools(spark, sf_dir)
    laws, n = simulate.setup(fitting.fit_history(pools, _MC_MODELS), pools)
    return laws, simulate.run_cases(spark, laws, replications, n, _MC_MODELS, _MC_PROBS)


def representative_laws(spark, sf_dir):
    _, pools = _pools(spark, sf_dir)
    found = simulate.representatives(fitting.fit_history(pools, _MC_MODELS))
    return found.select("model", "symbol", "refit", "n_train", F.round("apart", 8).alias("apart"))


def mc_excess_loss(spark, sf_dir):
    laws, cases = _mc(spark, sf_dir)
    found = simulate.case_losses(cases, laws, _MC_PROBS)
    return found.groupBy("dgp", "model").agg(F.count("*").alias("n"), F.round(F.avg("excess"), 6).alias("excess"), F.round(F.avg("coverage"), 6).alias("coverage"))


def mc_parameter_recovery(spark, sf_dir):
    laws, cases = _mc(spark, sf_dir)
    found = simulate.recovery(cases, laws)
    return found.select("dgp", "parameter", "n", *(F.round(c, 6).alias(c) for c in ("bias", "rmse", "failure_rate")))


def calibrated_quantiles(spark, sf_dir):
    """Recalibrated quantiles of the t law, with the calibrated ranks' mean of the day beside them."""
    rows, pools = _pools(spark, sf_dir)
    history = fitting.fit_history(pools, ("student_t",))
    pits = fitting.pit(rows, history, "student_t")
    found = calibration.calibrated_quantiles(pits, history, "student_t")
    ranks = calibration.calibrated_pits(pits).groupBy("symbol", "day_idx").agg(F.avg("pit").alias("mean_rank"))
    cols = (F.round(c, 6).alias(c) for c in ("p_low", "p_high", "z_low", "z_high", "mean_rank"))
    return found.join(ranks, ["symbol", "day_idx"]).select("symbol", "day_idx", "level", "history", *cols)


def law_quantile_rows(spark, sf_dir):
    """The table function over the last fits of two families."""
    _, pools = _pools(spark, sf_dir)
    last = pools.groupBy("symbol").agg(F.max_by(F.struct("refit", "pool"), "refit").alias("l")).select("symbol", "l.*")
    fits = fitting.fit_history(last, _MC_MODELS).where("status = 'success'")
    fits.createOrReplaceTempView("tidemark_fits")
    spark.udtf.register("tidemark_law_quantiles", columns.LawQuantiles)
    return spark.sql(
        """SELECT f.symbol, q.model, q.place, q.probability, round(q.quantile, 6) AS quantile
        FROM tidemark_fits f, LATERAL tidemark_law_quantiles(f.model, f.params, f.center, f.spread, array(5e-2, 5e-1, 95e-2)) q"""
    )


def normal_pit_bins(spark, sf_dir):
    """Transforms under the standard normal law, by the scalar function over columns."""
    ship(spark)
    rows = core.sigma(spark, sf_dir).where("z is not null").withColumn("pit", columns.normal_cdf("z"))
    return rows.groupBy("symbol", F.least(F.floor(F.col("pit") * 10), F.lit(9)).alias("bin")).agg(F.count("*").alias("n"), F.round(F.max(F.abs(columns.normal_ppf("pit") - F.col("z"))), 4).alias("gap"))


def kurtosis_by_symbol(spark, sf_dir):
    """The grouped aggregate function."""
    ship(spark)
    return core.sigma(spark, sf_dir).groupBy("symbol").agg(F.round(columns.excess_kurtosis("z"), 6).alias("excess_kurtosis"))


def stored_bands(spark, sf_dir):
    """Bands stored by day, checked, and a range of days read back; a second write changes nothing."""
    rows = core.scored(spark, sf_dir).select("symbol", "d", "model", "level", "seq", "r", "q_low", "q_high", "pinball")
    path = stores.scratch_dir(spark)
    rows.write.parquet(f"{path}/once")
    rows, signed = spark.read.parquet(f"{path}/once"), {"settings": repr(DEFAULT)}
    stores.store_days(rows, f"{path}/store", signature=signed)
    stores.store_days(rows, f"{path}/store", signature=signed)
    stores.check_store(spark, f"{path}/store", signed)
    back = stores.read_days(spark, f"{path}/store", "2024-01-12", "2024-01-20")
    return back.groupBy(F.col("d").cast("string").alias("d"), "model").agg(F.count("*").alias("n"), F.round(F.sum("pinball"), 8).alias("pinball_sum"))


def next_cases(spark, sf_dir):
    """The next two days of each symbol after those that are done: a run with a budget."""
    rows = core.samples(spark, sf_dir).select("symbol", "day_idx")
    return stores.first_pending(rows, rows.where(f"day_idx < {DEFAULT.history_days}"), ["symbol"], "day_idx", 2).select("symbol", F.col("day_idx").cast("long").alias("day_idx"))


def ewma_by_half_life(spark, sf_dir):
    """Mean loss of normal 95 % bands for half-lives of a half, one and two times the study's."""
    from ..operators import bands, volatility

    rows, quantile = core.samples(spark, sf_dir), dict(bands.normal_quantiles())[950]
    found = []
    for minutes in HALF_LIVES:
        own = volatility.ewma(rows, decay=2 ** (-DEFAULT.bar_minutes / minutes)).where("sigma > 0")
        wide = own.select("r", F.lit(950).alias("level"), (-F.col("sigma") * quantile).alias("q_low"), (F.col("sigma") * quantile).alias("q_high"))
        score = bands.scored(wide).agg(F.count("*").alias("n"), F.round(F.avg("pinball"), 8).alias("mean_pinball"), F.round(1 - F.avg(F.col("lower") + F.col("upper")), 8).alias("coverage"))
        found.append(score.select(F.lit(minutes).cast("long").alias("half_life"), "*"))
    return reduce(DataFrame.union, found)


HALF_LIVES = tuple(DEFAULT.half_life_minutes * k // 2 for k in (1, 2, 4))


def _half_life_sql() -> str:
    """The recursion of each half-life on its own, scored."""
    n, q = DEFAULT.rolling_bars, dict(core.B.normal_quantiles())[950]
    parts = [(m, 2 ** (-DEFAULT.bar_minutes / m)) for m in HALF_LIVES]
    seeds = f"SELECT half_life, lam, symbol, {n} AS seq, avg(r * r) AS v FROM samples, (VALUES {', '.join(f'({m}::BIGINT, {x!r}::DOUBLE)' for m, x in parts)}) h(half_life, lam) WHERE seq < {n} GROUP BY ALL HAVING count(*) = {n}"
    step = "SELECT w.half_life, w.lam, s.symbol, s.seq + 1, w.lam * w.v + (1 - w.lam) * s.r * s.r FROM w JOIN samples s ON s.symbol = w.symbol AND s.seq = w.seq"
    body = f"""SELECT half_life, count(*) AS n, round(avg(pinball), 8) AS mean_pinball, round(1 - avg(lower + upper), 8) AS coverage FROM (
        SELECT half_life, (r < q_low)::INT AS lower, (r > q_high)::INT AS upper, {core._LOSS} FROM (SELECT half_life, r, 950 AS level, -sqrt(greatest(v, 1e-16)) * {q!r} AS q_low, sqrt(greatest(v, 1e-16)) * {q!r} AS q_high
        FROM w JOIN samples s USING (symbol, seq))) GROUP BY half_life"""
    return core.oracle(f", w AS ({seeds} UNION ALL {step}) {body}", ("samples",)).replace(") , w AS", "), w AS")


def independence_p(spark, sf_dir):
    ship(spark)
    return inference.independence_p(reports.QUERIES["independence_lr"](spark, sf_dir))


def seeded_bootstrap(spark, sf_dir):
    text = reports._DAYDIFF
    days = spark.sql(text, day_scores=core.day_scores(spark, sf_dir))
    reps = inference.block_bootstrap(days)
    return reps.select("rep", F.round("stat", 8).alias("stat"))


def stream_tumbling_bars(spark, sf_dir):
    ticks = streams.read_ticks(spark, f"{sf_dir}/events.parquet")
    bars = streams.drain(streams.tumbling_bars(ticks), f"bars_{uuid.uuid4().hex}", mode="complete")
    return bars.select("symbol", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "open", "high", "low", "close", F.round("volume", 4).alias("volume"))


def stream_sliding_bars(spark, sf_dir):
    """Windows of two bars that start at every bar."""
    ticks = streams.read_ticks(spark, f"{sf_dir}/events.parquet")
    found = streams.drain(streams.sliding_bars(ticks), f"sliding_{uuid.uuid4().hex}", mode="complete")
    return found.select("symbol", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n", "high", "low", F.round("volume", 4).alias("volume"))


def stream_ewma_state(spark, sf_dir):
    ship(spark)
    ticks = streams.read_ticks(spark, f"{sf_dir}/events.parquet")
    rows = streams.drain(streams.ewma_state(ticks), f"ewma_{uuid.uuid4().hex}")
    return rows.select("symbol", "event_id", F.round("v", 8).alias("v"))


QUERIES = {
    f.__name__: f
    for f in (
        fit_nine_families, mixture_em_fit, walk_forward_scores, fit_failure_counts, pit_parametric, mc_case_summary, independence_p, seeded_bootstrap,
        stream_tumbling_bars, stream_sliding_bars, stream_ewma_state, representative_laws, mc_excess_loss, mc_parameter_recovery, calibrated_quantiles,
        law_quantile_rows, normal_pit_bins, kurtosis_by_symbol, stored_bands, next_cases, ewma_by_half_life,
    )
}

#: Streams over all that is there equal their batch counterparts.
ORACLES = {
    "ewma_by_half_life": _half_life_sql(),
    "next_cases": core.oracle(
        f"""SELECT symbol, CAST(day_idx AS BIGINT) AS day_idx FROM (SELECT symbol, day_idx, row_number() OVER (PARTITION BY symbol ORDER BY day_idx) AS place
        FROM (SELECT DISTINCT symbol, day_idx FROM samples WHERE day_idx >= {DEFAULT.history_days})) WHERE place <= 2""",
        ("samples",),
    ),
    "stored_bands": core.oracle(
        """SELECT CAST(d AS VARCHAR) AS d, model, CAST(count(*) AS BIGINT) AS n, round(sum(pinball), 8) AS pinball_sum FROM scored
        WHERE d BETWEEN DATE '2024-01-12' AND DATE '2024-01-20' GROUP BY d, model""",
        ("scored",),
    ),
    "kurtosis_by_symbol": core.oracle(
        """SELECT symbol, round(avg((z - m) ** 4) / avg((z - m) ** 2) ** 2 - 3, 6) AS excess_kurtosis
        FROM sigma JOIN (SELECT symbol, avg(z) AS m FROM sigma GROUP BY symbol) USING (symbol) WHERE z IS NOT NULL GROUP BY symbol""",
        ("sigma",),
    ),
    "stream_tumbling_bars": core.oracle(
        f"""SELECT symbol, strftime(d::TIMESTAMP + to_minutes(slot * {DEFAULT.bar_minutes}), '%Y-%m-%d %H:%M') AS start, CAST(n AS BIGINT) AS n, open, high, low, close, round(volume, 4) AS volume FROM fine""",
        ("fine",),
    ),
    "stream_sliding_bars": core.oracle(
        f"""SELECT symbol, strftime(time_bucket(INTERVAL '{DEFAULT.bar_minutes} minutes', ts) - to_minutes({DEFAULT.bar_minutes} * o), '%Y-%m-%d %H:%M') AS start, CAST(count(*) AS BIGINT) AS n,
        max(value) AS high, min(value) AS low, round(sum(value), 4) AS volume FROM ticks CROSS JOIN range(2) t(o) GROUP BY ALL""",
        ("ticks",),
    ),
    "stream_ewma_state": """WITH RECURSIVE t AS (SELECT event_type AS symbol, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k FROM events),
        e AS (SELECT symbol, event_id, k, CASE WHEN value > 0 THEN value END AS last, 0::DOUBLE AS v FROM t WHERE k = 1
        UNION ALL SELECT t.symbol, t.event_id, t.k, CASE WHEN t.value > 0 THEN t.value ELSE e.last END, CASE WHEN t.value > 0 AND e.last IS NOT NULL THEN 0.94 * e.v + 0.06 * ln(t.value / e.last) ** 2 ELSE e.v END
        FROM e JOIN t ON t.symbol = e.symbol AND t.k = e.k + 1) SELECT symbol, event_id, round(v, 8) AS v FROM e""",
}
