"""Bootstrap and volatility at sizes the tables don't have; stores, calibration, simulation, column functions."""

from __future__ import annotations

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import columns
from tidemark.functions.families import Fitted, Law
from tidemark.operators import bands, calibration, simulate, volatility
from tidemark.plans import records, reports
from tidemark.sources import stores
from tidemark.sources.tables import DataError
from tidemark.streaming import streams

NORMAL = Fitted("normal", {"loc": 0.0, "scale": 1.0}, 0.0, 1.0, 0, 0.0)


def day_scores(spark, days: int):
    rng = np.random.default_rng(5)
    rows = [(s, t, m, l, int(n), float(x)) for s in ("a", "b") for t in range(15, 15 + days) for m in ("empirical", "normal") for l in (900, 950) for n, x in [(rng.integers(5, 9), rng.random())]]
    return spark.createDataFrame(rows, "symbol string, day_idx int, model string, level int, n long, pinball_sum double").cache()


@pytest.mark.parametrize("days", [3, 285])
def test_every_replicate_draws_as_many_days_as_there_are(spark, days):
    import duckdb

    table = day_scores(spark, days)
    own = spark.sql(reports.PAIRS["block_bootstrap"][0], day_scores=table).collect()
    con = duckdb.connect()
    con.register("day_scores", table.toPandas())
    duck = con.sql(reports.PAIRS["block_bootstrap"][1].format(day_scores="day_scores")).fetchall()
    assert {r.days for r in own} == {days} and len(own) == 200
    assert sorted((r.rep, r.days, round(r.stat, 7)) for r in own) == sorted((a, b, round(c, 7)) for a, b, c in duck)
    if days > 20:
        holm = spark.sql(records.PAIRS["bootstrap_holm"][0], day_scores=table).collect()
        assert len(holm) == 2 and all(r.p <= r.p_holm <= 1 for r in holm)


@pytest.mark.parametrize("decay", [0.94, 0.5])
def test_volatility_of_very_long_days_equals_the_recursion(spark, decay):
    rng, per_day = np.random.default_rng(1), 30_000
    r = rng.normal(size=2 * per_day)
    rows = spark.createDataFrame([("s", i // per_day, i, float(x)) for i, x in enumerate(r)], "symbol string, day_idx int, seq long, r double")
    got = {x.seq: x.sigma for x in volatility.ewma(rows, decay=decay).select("seq", "sigma").collect()}
    v, want = np.mean(r[:24] ** 2), {}
    for i in range(24, len(r)):
        want[i] = math.sqrt(max(v, 1e-16))
        v = decay * v + (1 - decay) * r[i] ** 2
    assert all(got[i] is None for i in range(24))
    assert max(abs(got[i] / want[i] - 1) for i in want) < 1e-9


def test_a_store_is_verified_and_refuses_changes(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(f"2024-01-0{d}", k, d * k * 1.5) for d in range(1, 6) for k in range(4)], "d string, k int, x double")
    signed = {"settings": "a"}
    stores.store_days(rows.where("d < '2024-01-04'"), path, signature=signed)
    first = (tmp_path / "store/manifest.json").read_text()
    stores.store_days(rows.where("d < '2024-01-04'"), path, signature=signed)
    assert (tmp_path / "store/manifest.json").read_text() == first
    stores.store_days(rows, path, signature=signed)
    assert stores.check_store(spark, path, signed) == 5
    back = stores.read_days(spark, path, "2024-01-02", "2024-01-03")
    assert sorted((str(r.d), r.k, r.x) for r in back.collect()) == sorted(tuple(r) for r in rows.where("d between '2024-01-02' and '2024-01-03'").collect())
    assert "PartitionFilters: [isnotnull" in back._jdf.queryExecution().explainString(back.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    with pytest.raises(DataError):
        stores.store_days(rows, path, signature={"settings": "b"})
    with pytest.raises(DataError):
        stores.store_days(rows.withColumn("x", F.col("x") + 1), path, signature=signed)
    manifest = json.loads((tmp_path / "store/manifest.json").read_text())
    manifest["days"]["2024-01-03"]["hash"] = "0"
    (tmp_path / "store/manifest.json").write_text(json.dumps(manifest))
    (tmp_path / "store/.manifest.json.crc").unlink(missing_ok=True)
    with pytest.raises(DataError):
        stores.check_store(spark, path)
    assert stores.read_days(spark, path, "2024-01-04").count() == 8
    with pytest.raises(DataError):
        stores.read_days(spark, f"file://{tmp_path}/none")


def test_cases_within_a_budget(spark):
    rows = spark.createDataFrame([(s, d) for s in "ab" for d in range(6)] * 2, "symbol string, day_idx int")
    got = stores.first_pending(rows, rows.where("day_idx < 2 or symbol = 'b' and day_idx = 3"), ["symbol"], "day_idx", 2).collect()
    assert sorted(map(tuple, got)) == [("a", 2), ("a", 3), ("b", 2), ("b", 4)]


def test_recalibration_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    pits = [("s", d, float(p)) for d in range(10, 22) for p in rng.beta(2, 2, 30)]
    history = spark.createDataFrame(
        [("s", k, "normal", "success", {"loc": 0.1, "scale": 2.0}, 0.1, 2.0) for k in range(3)],
        "symbol string, refit int, model string, status string, params map<string,double>, center double, spread double",
    )
    table = spark.createDataFrame(pits, "symbol string, day_idx int, pit double")
    got = {(r.day_idx, r.level): r for r in calibration.calibrated_quantiles(table, history, "normal").collect()}
    assert {d for d, _ in got} == set(range(15, 22))
    for (d, level), r in got.items():
        past = [p for _, t, p in pits if t < d]
        low, high = np.quantile(past, [(1 - level / 1000) / 2, (1 + level / 1000) / 2])
        assert r.history == len(past) and r.p_low == pytest.approx(low) and r.p_high == pytest.approx(high)
        assert r.z_low == pytest.approx(NORMAL.ppf(low)) and r.z_high == pytest.approx(NORMAL.ppf(high))
    ranks = calibration.calibrated_pits(table).collect()
    want = sorted((d, (sum(q <= p for _, t, q in pits if t < d) + 0.5) / (sum(t < d for _, t, _ in pits) + 1)) for _, d, p in pits if d >= 15)
    assert np.allclose(sorted((r.day_idx, r.pit) for r in ranks), want)


def test_losses_of_true_quantiles_have_no_excess(spark):
    probs, pool = [0.05, 0.5, 0.95], np.sort(np.random.default_rng(3).normal(size=4000))
    laws = {"normal": NORMAL, "pool": pool}
    truth = simulate.truths(laws, probs)
    cases = spark.createDataFrame([(d, 0, "true", "success", truth[d]) for d in laws] + [(d, 0, "wide", "success", [2 * q for q in truth[d]]) for d in laws], "dgp string, replication int, model string, status string, quantiles array<double>")
    got = {(r.dgp, r.model): r for r in simulate.case_losses(cases, laws, probs).collect()}
    for d in laws:
        assert abs(got[d, "true"].excess) < 1e-12 and got[d, "wide"].excess > 0.01
        assert got[d, "true"].coverage == pytest.approx(0.9, abs=1e-3)
    x = np.random.default_rng(4).normal(size=400_000)
    for q, p in ((0.7, 0.2), (-1.5, 0.9)):
        assert simulate.expected_loss(NORMAL, [q], [p])[0] == pytest.approx(np.mean((p - (x < q)) * (x - q)), abs=0.01)


def test_representative_fit_is_the_one_next_to_the_median(spark):
    rows = [("m", "s", k, "success", 100, {"loc": 0.0}, 0.0, 1.0, [-1.0 + x, 1.0 + x]) for k, x in enumerate((0.0, 0.1, 0.5))] + [("m", "s", 9, "failed", 1, None, None, None, None)]
    history = spark.createDataFrame(rows, "model string, symbol string, refit int, status string, n_train long, params map<string,double>, center double, spread double, quantiles array<double>")
    assert [(r.refit, r.apart) for r in simulate.representatives(history).collect()] == [(1, 0.0)]


@pytest.mark.parametrize("model, params", [("nig", {"a": 1.5, "b": 0.4, "loc": 0.1, "scale": 0.8}), ("gh", {"p": 1.0, "a": 2.0, "b": -0.5, "loc": 0.0, "scale": 1.2})])
def test_interpolated_distribution_functions_are_within_their_bound(model, params):
    law = Law(model, params)
    for lo, hi in ((-3.0, -1.0), (-0.5, 0.7), (1.0, 6.0)):
        x, w = np.polynomial.legendre.leggauss(200)
        mass = float(np.exp(law.logpdf((hi - lo) / 2 * x + (hi + lo) / 2)) @ w * (hi - lo) / 2)
        assert float(np.diff(law.cdf(np.array([lo, hi])))[0]) == pytest.approx(mass, abs=1e-6)
    q = np.array([0.001, 0.05, 0.5, 0.95, 0.999])
    assert np.allclose(law.cdf(law.ppf(q)), q, atol=1e-6)


def test_functions_over_columns(spark):
    df = spark.createDataFrame([(1, 0.0, 0.5), (1, 1.96, 0.975), (2, None, 2.0), (2, -1.0, None), (1, 5.0, 0.1)], "g int, x double, p double")
    rows = df.select(columns.normal_cdf("x").alias("c"), columns.normal_ppf("p").alias("q")).collect()
    assert rows[0].c == pytest.approx(0.5) and rows[1].q == pytest.approx(1.959964, abs=1e-6) and rows[2].c is None and rows[2].q is None and rows[3].q is None
    law = F.create_map(F.lit("loc"), F.lit(1.0), F.lit("scale"), F.lit(2.0))
    got = df.select(columns.law_column("cdf")(F.lit("normal"), law, F.lit(1.0), F.lit(2.0), "x").alias("c")).collect()
    assert got[1].c == pytest.approx(0.975, abs=1e-4) and got[2].c is None
    kurt = {r.g: r.k for r in df.groupBy("g").agg(columns.excess_kurtosis("x").alias("k")).collect()}
    assert kurt[2] is None and kurt[1] == pytest.approx(-1.5, abs=0.1)
    assert columns.LawQuantiles(F.lit("normal"), law, F.lit(1.0), F.lit(2.0), F.array(F.lit(0.5), F.lit(0.9))).collect()[1].quantile == pytest.approx(1.2816, abs=1e-4)


def test_bands_must_be_ordered_and_models_aligned(spark):
    a = spark.createDataFrame([("s", 1, 0.5, -1.0, 1.0), ("s", 2, 0.1, -1.0, 1.0)], "symbol string, seq int, r double, q_low double, q_high double")
    assert bands.require_ordered(a).count() == 2
    with pytest.raises(ValueError):
        bands.require_ordered(a.withColumn("q_high", F.when(F.col("seq") == 1, float("nan")).otherwise(1.0)))
    assert bands.aligned(a, a, ["symbol", "seq"], ["r"]).count() == 2
    for b in (a.where("seq = 1"), a.withColumn("r", F.col("r") + 1e-6), a.union(a)):
        with pytest.raises(ValueError):
            bands.aligned(a, b, ["symbol", "seq"], ["r"])


def test_a_stream_goes_on_where_it_ended_and_counts_late_rows(spark, tmp_path):
    def tick(i, minute, value=1.0):
        return (i, datetime(2026, 1, 2, 9) + timedelta(minutes=minute), 1, "x", value, None)

    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    source, name, report = f"{tmp_path}/ticks", f"t_{tmp_path.name}", {}
    spark.createDataFrame([tick(1, 5), tick(2, 70), tick(3, 200)], schema).write.parquet(source)

    def run():
        found = streams.drain(streams.tumbling_bars(streams.read_ticks(spark, source)), name, f"file://{tmp_path}/state", report=report)
        return sorted((r.start.hour, r.n) for r in found.collect())

    first = run()
    assert first == [(9, 1), (10, 1)]
    assert run() == first
    spark.createDataFrame([tick(4, 1), tick(5, 400)], schema).write.mode("append").parquet(source)
    assert run() == [(9, 1), (10, 1), (12, 1)] and report["late"] == 1
