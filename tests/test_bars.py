from __future__ import annotations

import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.config import Study
from tidemark.operators import bands, bars, volatility

START = datetime(2026, 1, 2)


def events(spark, hours, symbol="x", price=lambda h: 100.0 + h):
    rows = [(i, START + timedelta(hours=h, minutes=5), 1, symbol, float(price(h)), None) for i, h in enumerate(hours)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")


def test_targets_never_cross_gaps_sessions_or_days(spark):
    hours = [h for h in range(48) if h != 5]
    rows = bars.samples(bars.fine_bars(bars.ticks(events(spark, hours)))).collect()
    assert len(rows) == 2 * 22 - 2
    assert all(r.slot not in (4, 5) or r.day_idx == 1 for r in rows)
    assert not any(r.slot in (11, 23) for r in rows)
    assert rows[0].r == pytest.approx(math.log((rows[0].close + 1) / rows[0].close))


def test_coarse_bars_need_every_slot(spark):
    out = bars.coarse_bars(bars.fine_bars(bars.ticks(events(spark, [h for h in range(24) if h != 5])))).collect()
    assert {r.bucket: r.complete for r in out} == {0: True, 1: False, 2: True, 3: True, 4: True, 5: True}
    first = next(r for r in out if r.bucket == 0)
    assert (first.open, first.high, first.low, first.close, first.volume) == (100.0, 103.0, 100.0, 103.0, 406.0)


def test_bad_prices_are_no_ticks(spark):
    out = bars.ticks(events(spark, range(4), price=lambda h: [1.0, 0.0, -2.0, float("inf")][h]))
    assert out.count() == 1


@pytest.mark.parametrize("changed", [0, 20, 30, 44])
def test_volatility_uses_only_earlier_rows(spark, changed):
    study = Study(rolling_bars=8, half_life_minutes=180)
    plain = spark.range(60).select(F.lit("x").alias("symbol"), (F.col("id") / 10).cast("int").alias("day_idx"), F.col("id").alias("seq"), F.sin("id").alias("r"))
    moved = plain.withColumn("r", F.when(F.col("seq") == changed, 5.0).otherwise(F.col("r")))

    def sigma(df):
        out = volatility.rolling(volatility.ewma(df, study), study)
        return {r.seq: (r.sigma, r.sigma_roll) for r in out.collect()}

    a, b = sigma(plain), sigma(moved)
    assert all(a[i] == pytest.approx(b[i]) for i in range(8, changed + 1))
    if changed >= 7:
        assert a[changed + 1][0] != pytest.approx(b[changed + 1][0])


def test_ewma_equals_the_recursion(spark):
    study = Study(rolling_bars=5, half_life_minutes=120)
    r = [math.sin(i * 1.7) for i in range(40)]
    df = spark.createDataFrame([("x", i // 7, i, v) for i, v in enumerate(r)], "symbol string, day_idx int, seq long, r double")
    got = {x.seq: x.sigma for x in volatility.ewma(df, study).collect()}
    v = sum(x * x for x in r[:5]) / 5
    for i in range(5, 40):
        assert got[i] == pytest.approx(math.sqrt(v), rel=1e-12)
        v = study.decay * v + (1 - study.decay) * r[i] ** 2
    assert all(got[i] is None for i in range(5))


def test_scores(spark):
    df = spark.createDataFrame([(950, r, -1.0, 1.0) for r in (-2.0, 0.0, 2.0)], "level int, r double, q_low double, q_high double")
    out = bands.scored(df).collect()
    assert [(x.lower, x.upper) for x in out] == [(1, 0), (0, 0), (0, 1)]
    assert out[0].pinball == pytest.approx(((0.025 - 1) * -1 + (0.975 - 1) * -3) / 2)


@pytest.mark.parametrize("bad", [{"levels": (0.95, 0.9)}, {"bar_minutes": 7}, {"rolling_bars": 0}])
def test_settings_are_checked(bad):
    with pytest.raises(ValueError):
        Study(**bad)
    with pytest.raises(ValueError):
        Study.from_json('{"unknown": 1}')
