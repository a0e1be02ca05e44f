from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import inference
from tidemark.plans import studies
from tidemark.sources import tables

HEAD = "SYMBOL,TRADING_DATE,TRADING_TIME,OPEN_PX,HIGH_PX,LOW_PX,CLOSE_PX,VOL,BUY_VOL,SELL_VOL\n"


def csv(tmp_path, *rows):
    path = tmp_path / "raw.csv"
    path.write_text(HEAD + "".join(r + "\n" for r in rows))
    return f"file://{path}"


GOOD = "A,20260102,09:00:00,1,2,0.5,1.5,3,2,1"


def test_raw_rows_are_read(spark, tmp_path):
    out = tables.read_raw(spark, csv(tmp_path, GOOD, GOOD.replace("09:00", "09:01")), "A")
    assert out.count() == 2 and str(out.first().ts) == "2026-01-02 09:00:00"


@pytest.mark.parametrize(
    "bad", [GOOD, GOOD.replace(",2,0.5", ",1.2,0.5"), GOOD.replace("A,", "B,"), GOOD.replace(",3,2,1", ",-3,2,1"), GOOD.replace("20260102", "20261302"), GOOD.replace(",1.5,", ",,")]
)
def test_bad_rows_are_rejected(spark, tmp_path, bad):
    with pytest.raises(tables.DataError):
        tables.read_raw(spark, csv(tmp_path, GOOD, bad), "A").count()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("b", 3.0)], "d string, x double")
    once, days = f"file://{tmp_path}/once", f"file://{tmp_path}/days"
    assert tables.write_or_compare(df, once)
    assert not tables.write_or_compare(df, once)
    with pytest.raises(tables.DataError):
        tables.write_or_compare(df.withColumn("x", F.col("x") + 1), once)
    tables.write_days(df, days)
    tables.write_days(df.where("d = 'b'").withColumn("x", F.col("x") * 10), days)
    assert sorted((r.d, r.x) for r in spark.read.parquet(days).collect()) == [("a", 1.0), ("b", 20.0), ("b", 30.0)]
    sig = tables.signature(df, {"k": 1})
    assert sig == tables.signature(df.orderBy("x"), {"k": 1})
    with pytest.raises(tables.DataError):
        tables.check_signature(sig, tables.signature(df.limit(2), {"k": 1}))


def test_bootstrap_is_seeded(spark):
    days = spark.range(20).select(F.col("id").alias("idx"), F.sin("id").alias("diff"), F.lit(2.0).alias("n"))
    a, b = (inference.block_bootstrap(days, 50).orderBy("rep").collect() for _ in range(2))
    assert a == b and len(a) == 50
    with pytest.raises(ValueError):
        inference.block_bootstrap(days.limit(5), 5)


@pytest.mark.parametrize("name", ["walk_forward_scores", "mc_case_summary", "stream_tumbling_bars", "stream_ewma_state"])
def test_studies_have_rows(spark, name):
    assert studies.QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_stream_equals_batch_where_windows_closed(spark):
    from tidemark.plans import core

    sf = "/root/testdata/sf0.001"
    live = {(r.symbol, r.start): (r.n, r.open, r.close) for r in studies.stream_tumbling_bars(spark, sf).collect()}
    start = F.concat(F.col("d").cast("string"), F.lit(" "), F.lpad(F.col("slot").cast("string"), 2, "0"), F.lit(":00"))
    batch = {(r.symbol, r.start): (r.n, r.open, r.close) for r in core.fine(spark, sf).withColumn("start", start).collect()}
    assert live.items() <= batch.items() and len(batch) - len(live) < 10


def test_streams_over_shuffled_files_equal_batch(spark, tmp_path):
    import math

    from tidemark.plans import core

    sf = f"file://{tmp_path}"
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(5, "event_id").write.parquet(f"{sf}/events.parquet")
    start = F.concat(F.col("d").cast("string"), F.lit(" "), F.lpad(F.col("slot").cast("string"), 2, "0"), F.lit(":00"))
    live = [(r.symbol, r.start, r.n, r.open, r.high, r.low, r.close) for r in studies.stream_tumbling_bars(spark, sf).collect()]
    batch = core.fine(spark, sf).withColumn("start", start).collect()
    assert sorted(live) == sorted((r.symbol, r.start, r.n, r.open, r.high, r.low, r.close) for r in batch)
    want, last, v = {}, {}, {}
    for r in sorted(events.collect(), key=lambda r: (r.ts, r.event_id)):
        s = r.event_type
        if r.value > 0:
            if s in last:
                v[s] = 0.94 * v.get(s, 0.0) + (1 - 0.94) * math.log(r.value / last[s]) ** 2
            last[s] = r.value
        want[r.event_id] = v.get(s, 0.0)
    got = {r.event_id: r.v for r in studies.stream_ewma_state(spark, sf).collect()}
    assert got == pytest.approx(want, abs=1e-7)


def test_bootstrap_draws_as_many_days_as_there_are(spark):
    from tidemark.plans import reports

    scores = spark.range(15, 138).selectExpr("cast(id as int) day_idx", "explode(array('empirical', 'normal')) model", "sin(id) + length(model) pinball_sum", "3L n")
    rows = spark.sql(reports.PAIRS["block_bootstrap"][0], day_scores=scores).collect()
    assert len(rows) == 200 and {r.days for r in rows} == {123}
    assert spark.sql(reports.PAIRS["bootstrap_summary"][0], day_scores=scores).count() == 1
    assert spark.sql(reports.PAIRS["block_bootstrap"][0], day_scores=scores.limit(0)).isEmpty()


def test_every_family_is_fitted_at_every_refit(spark):
    from tidemark.functions.families import MODELS

    sf = "/root/testdata/sf0.001"
    pools = studies._pools(spark, sf)[1].count()
    fits = studies.fit_nine_families(spark, sf).collect()
    assert len(fits) == pools * len(MODELS) and len({(r.symbol, r.refit) for r in fits}) == pools
    assert {(r.model, r.attempts) for r in studies.fit_failure_counts(spark, sf).collect()} == {(m, pools) for m in MODELS}
