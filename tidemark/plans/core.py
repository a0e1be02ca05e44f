"""The tables that reports are built on: DataFrame plans, and the same in DuckDB SQL for checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT as S
from ..operators import bands as B
from ..operators import bars, volatility


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ticks(spark, sf_dir):
    return bars.ticks(_read(spark, sf_dir, "events"))


def fine(spark, sf_dir):
    return bars.fine_bars(ticks(spark, sf_dir))


def coarse(spark, sf_dir):
    return bars.coarse_bars(fine(spark, sf_dir))


def samples(spark, sf_dir):
    return bars.samples(fine(spark, sf_dir))


def sigma(spark, sf_dir):
    """Samples with sigma, sigma_roll and z."""
    rows = volatility.rolling(volatility.ewma(samples(spark, sf_dir)))
    return rows.withColumn("z", F.when(F.col("sigma") > 0, F.col("r") / F.col("sigma")))


def zq(spark, sf_dir):
    return B.pooled_quantiles(sigma(spark, sf_dir))


def scored(spark, sf_dir):
    rows = sigma(spark, sf_dir)
    return B.scored(B.bands(rows, B.pooled_quantiles(rows)))


def day_scores(spark, sf_dir):
    return B.day_scores(scored(spark, sf_dir))


def factors(spark, sf_dir):
    return volatility.seasonal_factors(samples(spark, sf_dir))


def seasonal(spark, sf_dir):
    return volatility.seasonal_sigma(samples(spark, sf_dir))


def daily(spark, sf_dir):
    """Daily mean order price by priority; r is the log change to the next day present. seq is the day's place."""
    orders = _read(spark, sf_dir, "orders")
    day = orders.where("o_totalprice > 0").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("d")).agg(F.avg("o_totalprice").alias("price"))
    along = W.partitionBy("symbol").orderBy("d")
    rows = day.select("symbol", "d", F.ln(F.lead("price").over(along) / F.col("price")).alias("r"), (F.row_number().over(along) - 1).cast("long").alias("seq"))
    return rows.where("r is not null")


def daily_scored(spark, sf_dir):
    """Normal bands on a rolling volatility of 60 days, scored."""
    rows = volatility.rolling(daily(spark, sf_dir), bars=60).where("sigma_roll > 0")
    law = F.array(*(F.struct(F.lit(t).alias("level"), F.lit(q).alias("q")) for t, q in B.normal_quantiles()))
    wide = rows.withColumn("p", F.explode(law)).select("symbol", "d", "seq", "r", "p.level", (-F.col("sigma_roll") * F.col("p.q")).alias("q_low"), (F.col("sigma_roll") * F.col("p.q")).alias("q_high"))
    return B.scored(wide)


TABLES = {f.__name__: f for f in (ticks, fine, coarse, samples, sigma, zq, scored, day_scores, factors, seasonal, daily, daily_scored)}

_Q = B.normal_quantiles()
_LAM = repr(S.decay)
_PROBS = B.tails(S.levels)
_LEVELS = ", ".join(f"({B.tag(c)}, {_PROBS.index(round((1 - c) / 2, 12)) + 1}, {_PROBS.index(round((1 + c) / 2, 12)) + 1})" for c in S.levels)
_NORMAL = ", ".join(f"({t}, {q!r}::DOUBLE)" for t, q in _Q)
_LOSS = """((1 - level / 1000) / 2 - (r < q_low)::INT) * (r - q_low) / 2 + (1 - (1 - level / 1000) / 2 - (r < q_high)::INT) * (r - q_high) / 2 AS pinball"""
_BUCKETS = 1440 // S.bar_minutes // S.coarse_bars

#: name -> (tables it needs, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ticks": ((), "SELECT event_type AS symbol, ts, event_id, value FROM events WHERE value > 0 AND isfinite(value)"),
    "fine": (("ticks",), f"""SELECT symbol, ts::DATE AS d, CASE WHEN hour(ts) * 60 + minute(ts) < {S.session_split_minute} THEN 'am' ELSE 'pm' END AS session,
        ((hour(ts) * 60 + minute(ts)) // {S.bar_minutes})::INT AS slot, count(*) AS n, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
        min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS volume FROM ticks GROUP BY ALL"""),
    "coarse": (("fine",), f"""SELECT symbol, d, session, slot // {S.coarse_bars} AS bucket, count(*) AS source_bars, first(open ORDER BY slot) AS open,
        max(high) AS high, min(low) AS low, last(close ORDER BY slot) AS close, sum(volume) AS volume, count(*) = {S.coarse_bars} AS complete FROM fine GROUP BY symbol, d, session, slot // {S.coarse_bars}"""),
    "samples": (("fine",), """SELECT symbol, d, session, slot, close, ln(nc / close) AS r, dense_rank() OVER (PARTITION BY symbol ORDER BY d) - 1 AS day_idx,
        row_number() OVER (PARTITION BY symbol ORDER BY d, slot) - 1 AS seq FROM (SELECT *, lead(slot) OVER w AS ns, lead(close) OVER w AS nc FROM fine
        WINDOW w AS (PARTITION BY symbol, d, session ORDER BY slot)) WHERE ns = slot + 1"""),
    "ew": (("samples",), f"""SELECT symbol, seq + 1 AS seq, avg(r * r) OVER (PARTITION BY symbol ORDER BY seq) AS v FROM samples WHERE seq < {S.rolling_bars}
        QUALIFY seq = {S.rolling_bars - 1} UNION ALL SELECT s.symbol, s.seq + 1, {_LAM} * ew.v + (1 - {_LAM}) * s.r * s.r FROM ew JOIN samples s ON s.symbol = ew.symbol AND s.seq = ew.seq"""),
    "sigma": (("samples", "ew"), f"""SELECT *, CASE WHEN sigma > 0 THEN r / sigma END AS z FROM (SELECT s.*, CASE WHEN v IS NOT NULL THEN sqrt(greatest(v, 1e-16)) END AS sigma,
        CASE WHEN count(*) OVER b = {S.rolling_bars} THEN sqrt(greatest(avg(r * r) OVER b, 1e-16)) END AS sigma_roll FROM samples s LEFT JOIN ew USING (symbol, seq)
        WINDOW b AS (PARTITION BY s.symbol ORDER BY s.seq ROWS BETWEEN {S.rolling_bars} PRECEDING AND 1 PRECEDING))"""),
    "zq": (("sigma",), f"""SELECT symbol, day_idx, level, q[lo] AS z_low, q[hi] AS z_high FROM (SELECT d.symbol, d.day_idx, quantile_cont(z, {_PROBS}) AS q
        FROM (SELECT DISTINCT symbol, day_idx FROM sigma) d JOIN sigma s ON s.symbol = d.symbol AND s.day_idx BETWEEN d.day_idx - {S.history_days} AND d.day_idx - 1 AND z IS NOT NULL
        GROUP BY d.symbol, d.day_idx HAVING count(*) >= {S.min_history}), (VALUES {_LEVELS}) l(level, lo, hi)"""),
    "scored": (("sigma", "zq"), f"""SELECT *, (r < q_low)::INT AS lower, (r > q_high)::INT AS upper, q_high - q_low AS width, {_LOSS} FROM (
        SELECT s.symbol, d, s.day_idx, session, slot, seq, close, r, sigma, 'empirical' AS model, level, sigma * z_low AS q_low, sigma * z_high AS q_high
        FROM sigma s JOIN zq USING (symbol, day_idx) WHERE sigma > 0
        UNION ALL SELECT symbol, d, day_idx, session, slot, seq, close, r, sigma, 'normal', level, -sigma * q, sigma * q FROM sigma, (VALUES {_NORMAL}) l(level, q) WHERE sigma > 0
        UNION ALL SELECT symbol, d, day_idx, session, slot, seq, close, r, sigma, 'rolling', level, -sigma_roll * q, sigma_roll * q FROM sigma, (VALUES {_NORMAL}) l(level, q) WHERE sigma > 0 AND sigma_roll > 0)"""),
    "day_scores": (("scored",), """SELECT symbol, d, day_idx, model, level, count(*) AS n, sum(pinball) AS pinball_sum, sum(width) AS width_sum, sum(lower) AS lower_n, sum(upper) AS upper_n
        FROM scored GROUP BY ALL"""),
    "factors": (("samples",), f"""SELECT symbol, day_idx, bucket, CASE WHEN least(day_idx, {S.season_days}) >= {S.season_min_days} AND n >= {S.season_min_obs} AND s > 0 AND alls > 0
        THEN sqrt((s / n) / (alls / alln)) ELSE 1 END AS factor FROM (
        SELECT g.symbol, g.day_idx, b AS bucket, sum(r * r) FILTER ((slot + 1) // {S.coarse_bars} = b) AS s, count(*) FILTER ((slot + 1) // {S.coarse_bars} = b) AS n, sum(r * r) AS alls, count(r) AS alln
        FROM (SELECT DISTINCT symbol, day_idx FROM samples) g CROSS JOIN range({_BUCKETS}) t(b)
        LEFT JOIN samples h ON h.symbol = g.symbol AND h.day_idx BETWEEN g.day_idx - {S.season_days} AND g.day_idx - 1 GROUP BY ALL)"""),
    "flat": (("samples", "factors"), f"SELECT s.*, bucket, factor, r / factor AS f FROM samples s JOIN factors USING (symbol, day_idx) WHERE bucket = (slot + 1) // {S.coarse_bars}"),
    "ewf": (("flat",), f"""SELECT symbol, seq + 1 AS seq, avg(f * f) OVER (PARTITION BY symbol ORDER BY seq) AS v FROM flat WHERE seq < {S.rolling_bars}
        QUALIFY seq = {S.rolling_bars - 1} UNION ALL SELECT s.symbol, s.seq + 1, {_LAM} * ewf.v + (1 - {_LAM}) * s.f * s.f FROM ewf JOIN flat s ON s.symbol = ewf.symbol AND s.seq = ewf.seq"""),
    "seasonal": (("flat", "ewf"), "SELECT flat.* EXCLUDE (f), CASE WHEN v IS NOT NULL THEN sqrt(greatest(v, 1e-16)) END AS sigma_flat, factor * CASE WHEN v IS NOT NULL THEN sqrt(greatest(v, 1e-16)) END AS sigma_season FROM flat LEFT JOIN ewf USING (symbol, seq)"),
    "daily": ((), """SELECT symbol, d, r, seq FROM (SELECT symbol, d, ln(lead(price) OVER w / price) AS r, row_number() OVER w - 1 AS seq FROM (
        SELECT o_orderpriority AS symbol, o_orderdate::DATE AS d, avg(o_totalprice) AS price FROM orders WHERE o_totalprice > 0 GROUP BY ALL) WINDOW w AS (PARTITION BY symbol ORDER BY d)) WHERE r IS NOT NULL"""),
    "daily_scored": (("daily",), f"""SELECT *, (r < q_low)::INT AS lower, (r > q_high)::INT AS upper, q_high - q_low AS width, {_LOSS} FROM (
        SELECT symbol, d, seq, r, level, -s * q AS q_low, s * q AS q_high FROM (SELECT *, CASE WHEN count(*) OVER b = 60 THEN sqrt(greatest(avg(r * r) OVER b, 1e-16)) END AS s FROM daily
        WINDOW b AS (PARTITION BY symbol ORDER BY seq ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)), (VALUES {_NORMAL}) l(level, q) WHERE s > 0)"""),
}


def oracle(text: str, needs: tuple[str, ...]) -> str:
    """DuckDB SQL: the tables that ``text`` needs as common table expressions, then ``text``."""
    order: list[str] = []

    def visit(name):
        for n in CTES[name][0]:
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    head = ", ".join(f"{n} AS {'MATERIALIZED ' if n not in ('ew', 'ewf') else ''}({CTES[n][1]})" for n in order)
    body = text.format(**{n: n for n in TABLES})
    return f"WITH RECURSIVE {head} {body}" if order else body
