"""Families fitted over past windows, as independent tasks, and bands and scores from them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Study
from ..functions.families import MODELS

FIT_SCHEMA = (
    "symbol string, refit int, model string, status string, reason string, n_train long, params map<string,double>, "
    "center double, spread double, loglik double, diagnostics map<string,string>, quantiles array<double>"
)


FIT_COLUMNS = ("model", "status", "reason", "n_train", "params", "center", "spread", "loglik", "diagnostics", "quantiles")


def fit_row(model: str, values, probs) -> dict:
    """The fit of one family as a row: what it found, or why it failed."""
    from ..functions.families import FitError, fit

    row = dict.fromkeys(FIT_COLUMNS) | {"model": model, "n_train": len(values)}
    try:
        found = fit(model, values)
    except FitError as e:
        return row | {"status": "failed", "reason": str(e)}
    quantiles = [float(q) for q in found.ppf(list(probs))]
    return row | {"status": "success", "quantiles": quantiles} | {c: getattr(found, c) for c in ("params", "center", "spread", "loglik", "diagnostics")}


def refit_pools(rows: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """(symbol, refit, refit_day, pool): residuals of the days before every ``refit_days``-th day."""
    days = rows.select("symbol", "day_idx").distinct().where(
        (F.col("day_idx") >= study.history_days) & ((F.col("day_idx") - study.history_days) % study.refit_days == 0)
    )
    ahead = rows.where("z is not null").select(
        "symbol", "z", "seq", F.explode(F.sequence(F.col("day_idx") + 1, F.col("day_idx") + study.history_days)).alias("day_idx")
    )
    pools = ahead.join(days, ["symbol", "day_idx"]).groupBy("symbol", "day_idx").agg(F.array_sort(F.collect_list(F.struct("seq", "z"))).alias("p"))
    return pools.select(
        "symbol",
        ((F.col("day_idx") - study.history_days) / study.refit_days).cast("int").alias("refit"),
        F.col("day_idx").cast("int").alias("refit_day"),
        F.col("p.z").alias("pool"),
    )


def fit_history(pools: DataFrame, models=MODELS, probs=(0.025, 0.975), tasks: int = 64) -> DataFrame:
    """One row for each pool and model; a fit that fails is a row that says why. Fits are independent tasks."""
    names, probs = list(models), list(probs)
    cases = pools.select("symbol", "refit", "pool", F.explode(F.array(*map(F.lit, names))).alias("model")).repartition(tasks, "symbol", "refit", "model")

    def run(batches):
        for batch in batches:
            out = [{"symbol": r.symbol, "refit": r.refit} | fit_row(r.model, r.pool, probs) for r in batch.itertuples(index=False)]
            yield pd.DataFrame(out, columns=["symbol", "refit", *FIT_COLUMNS])

    return cases.mapInPandas(run, FIT_SCHEMA)


def walk_forward(rows: DataFrame, history: DataFrame, level: float, study: Study = DEFAULT) -> DataFrame:
    """Scores bands of the fits in force (the latest refit day not after the day) by model."""
    from . import bands

    fits = history.where("status = 'success'").select("symbol", "refit", "model", F.col("quantiles")[0].alias("z_low"), F.col("quantiles")[1].alias("z_high"))
    live = rows.where((F.col("sigma") > 0) & (F.col("day_idx") >= study.history_days)).withColumn(
        "refit", F.floor((F.col("day_idx") - study.history_days) / study.refit_days).cast("int")
    )
    wide = live.join(fits, ["symbol", "refit"]).select(
        "symbol", "d", "day_idx", "session", "slot", "seq", "close", "r", "sigma", "model", F.lit(bands.tag(level)).alias("level"),
        (F.col("sigma") * F.col("z_low")).alias("q_low"), (F.col("sigma") * F.col("z_high")).alias("q_high"),
    )
    return bands.scored(wide)


def pit(rows: DataFrame, history: DataFrame, model: str, study: Study = DEFAULT) -> DataFrame:
    """(symbol, day_idx, seq, pit) under the fit in force of one family; clipped into [0, 1]."""
    fits = history.where((F.col("status") == "success") & (F.col("model") == model)).select("symbol", "refit", "params", "center", "spread")
    live = rows.where("z is not null").withColumn("refit", F.floor((F.col("day_idx") - study.history_days) / study.refit_days).cast("int"))
    joined = live.where(F.col("day_idx") >= study.history_days).join(fits, ["symbol", "refit"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from ..functions.families import Fitted

        p = pdf["params"].iloc[0]
        f = Fitted(model, dict(p), float(pdf["center"].iloc[0]), float(pdf["spread"].iloc[0]), len(pdf), 0.0)
        return pd.DataFrame({"symbol": pdf["symbol"], "day_idx": pdf["day_idx"], "seq": pdf["seq"], "pit": f.cdf(pdf["z"].to_numpy()).clip(0, 1)})

    return joined.select("symbol", "refit", "day_idx", "seq", "z", "params", "center", "spread").groupBy("symbol", "refit").applyInPandas(run, "symbol string, day_idx int, seq long, pit double")
