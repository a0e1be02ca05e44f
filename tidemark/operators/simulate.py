"""Monte-Carlo cases: draw from a law, refit every family, compare with the truth."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.families import SEED, Fitted
from .fitting import fit_row

CASE_SCHEMA = "dgp string, replication int, model string, status string, reason string, params map<string,double>, quantiles array<double>"


def draw(source: Fitted | np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """n standardized draws: by inversion of a law's distribution function, or with replacement from a pool."""
    if isinstance(source, np.ndarray):
        return rng.choice(source, n)
    return source.ppf(np.clip(rng.random(n), 1e-12, 1 - 1e-12))


def run_cases(spark: SparkSession, laws: dict[str, Fitted | np.ndarray], replications: int, n: int, models, probs, seed: int = SEED, done: DataFrame | None = None) -> DataFrame:
    """A row for each law (or pool), replication and model, ``empirical`` among them; cases in ``done`` (dgp, replication) are left out.

    The sample of a law and replication has a generator of its own, seeded by both, so all models
    see the same draws and neither order nor partitioning changes a result.
    """
    names, probs = sorted(laws), list(probs)
    law, model = (F.explode(F.array(*map(F.lit, x))) for x in (names, ["empirical", *models]))
    grid = spark.range(replications).select(F.col("id").cast("int").alias("replication"), law.alias("dgp")).select("*", model.alias("model"))
    if done is not None:
        grid = grid.join(done, ["dgp", "replication"], "left_anti")

    def one(dgp: str, replication: int, model: str) -> dict:
        x = draw(laws[dgp], n, np.random.default_rng(np.random.SeedSequence([seed, names.index(dgp), replication])))
        if model == "empirical":
            return {"status": "success", "reason": None, "params": None, "quantiles": np.quantile(x, probs).tolist()}
        return fit_row(model, x, probs)

    def run(batches):
        for batch in batches:
            keys = ["dgp", "replication", "model"]
            rows = [dict(zip(keys, key)) | one(*key) for key in batch[keys].itertuples(index=False, name=None)]
            yield pd.DataFrame(rows, columns=[*keys, "status", "reason", "params", "quantiles"])

    tasks = max(1, min(256, len(names) * replications))
    return grid.repartition(tasks, "dgp", "replication", "model").mapInPandas(run, CASE_SCHEMA)


GRID = np.linspace(-30.0, 30.0, 12_001)


def representatives(history: DataFrame) -> DataFrame:
    """Of each model, the successful fit whose quantiles are nearest (least squares) to the median quantiles of its fits."""
    good = history.where("status = 'success'")
    long = good.select("model", "symbol", "refit", F.posexplode("quantiles").alias("place", "q"))
    middle = long.groupBy("model", "place").agg(F.median("q").alias("m"))
    apart = long.join(middle, ["model", "place"]).groupBy("model", "symbol", "refit").agg(F.round(F.sum((F.col("q") - F.col("m")) ** 2), 12).alias("apart"))
    first = apart.groupBy("model").agg(F.min(F.struct("apart", "symbol", "refit")).alias("f")).select("model", "f.*")
    return good.join(first, ["model", "symbol", "refit"]).select("model", "symbol", "refit", "n_train", "params", "center", "spread", "quantiles", "apart")


def setup(history: DataFrame, pools: DataFrame) -> tuple[dict[str, Fitted | np.ndarray], int]:
    """(laws, n) of a study: each model's representative fit and the pooled residuals of the last windows; n is the median training size.

    A law a model and one pool of at most a window a symbol come to the driver.
    """
    laws: dict[str, Fitted | np.ndarray] = {
        r["model"]: Fitted(r["model"], dict(r["params"]), r["center"], r["spread"], r["n_train"], 0.0) for r in representatives(history).collect()
    }
    last = pools.groupBy("symbol").agg(F.max_by("pool", "refit").alias("pool"))
    values = np.concatenate([np.asarray(r["pool"], float) for r in last.collect()])
    laws["pool"] = np.sort((values - values.mean()) / values.std())
    return laws, int(history.agg(F.median("n_train")).first()[0])


def expected_loss(source: Fitted | np.ndarray, q, p) -> np.ndarray:
    """Expected pinball loss of the forecasts ``q`` for the probabilities ``p`` under a law of mean 0, or a pool.

    It is p (mean - q) and the integral of the distribution function up to q, by trapezoids on ``GRID``.
    """
    q, p = np.asarray(q, float), np.asarray(p, float)
    if isinstance(source, np.ndarray):
        return p * (source.mean() - q) + np.maximum(q[:, None] - source, 0).mean(axis=1)
    f = np.clip(source.cdf(GRID), 0, 1)
    area = np.concatenate([[0.0], np.cumsum((f[1:] + f[:-1]) / 2 * np.diff(GRID))])
    return np.interp(q, GRID, area) - p * q


def truths(laws: dict[str, Fitted | np.ndarray], probs) -> dict[str, list[float]]:
    return {d: [float(x) for x in (np.quantile(s, probs) if isinstance(s, np.ndarray) else s.ppf(list(probs)))] for d, s in laws.items()}


def case_losses(cases: DataFrame, laws: dict[str, Fitted | np.ndarray], probs) -> DataFrame:
    """(dgp, replication, model, excess, coverage): expected loss beyond that of the true quantiles, mean over ``probs``;
    true probability between the outermost quantiles."""
    probs, true = list(probs), truths(laws, probs)
    least = {d: float(expected_loss(s, true[d], probs).mean()) for d, s in laws.items()}

    def between(source, low, high):
        if isinstance(source, np.ndarray):
            return float(((source > low) & (source <= high)).mean())
        return float(np.diff(source.cdf(np.array([low, high])))[0])

    def run(batches):
        for batch in batches:
            rows = []
            for dgp, rep, model, q in batch.itertuples(index=False, name=None):
                rows.append((dgp, rep, model, float(expected_loss(laws[dgp], q, probs).mean()) - least[dgp], between(laws[dgp], q[0], q[-1])))
            yield pd.DataFrame(rows, columns=["dgp", "replication", "model", "excess", "coverage"])

    good = cases.where("status = 'success'").select("dgp", "replication", "model", "quantiles")
    return good.mapInPandas(run, "dgp string, replication int, model string, excess double, coverage double")


def recovery(cases: DataFrame, laws: dict[str, Fitted | np.ndarray]) -> DataFrame:
    """Bias and RMSE of each parameter where the model is the law that was drawn from, and rates of failed fits."""
    true = [(d, k, float(v)) for d, s in laws.items() if not isinstance(s, np.ndarray) for k, v in s.params.items()]
    known = cases.sparkSession.createDataFrame(true, "dgp string, parameter string, truth double")
    own = cases.where("model = dgp")
    found = own.where("status = 'success'").select("dgp", F.explode("params").alias("parameter", "value")).join(F.broadcast(known), ["dgp", "parameter"])
    err = F.col("value") - F.col("truth")
    stats = found.groupBy("dgp", "parameter").agg(F.count("*").alias("n"), F.avg(err).alias("bias"), F.sqrt(F.avg(err * err)).alias("rmse"))
    failed = own.groupBy("dgp").agg(F.avg((F.col("status") == "failed").cast("double")).alias("failure_rate"))
    return stats.join(failed, "dgp")


def summary(cases: DataFrame, truth: DataFrame) -> DataFrame:
    """Bias and RMSE of each quantile by law and model, and efficiency against the empirical quantiles.

    ``truth``: (dgp, place, q) with places from 0.
    """
    long = cases.where("status = 'success'").select("dgp", "model", F.posexplode("quantiles").alias("place", "value")).join(F.broadcast(truth), ["dgp", "place"])
    err = F.col("value") - F.col("q")
    stats = long.groupBy("dgp", "model", "place").agg(F.count("*").alias("n"), F.avg(err).alias("bias"), F.sqrt(F.avg(err * err)).alias("rmse"))
    base = stats.where("model = 'empirical'").select("dgp", "place", F.col("rmse").alias("empirical_rmse"))
    return stats.join(base, ["dgp", "place"]).withColumn("efficiency", F.col("rmse") / F.col("empirical_rmse")).drop("empirical_rmse")
