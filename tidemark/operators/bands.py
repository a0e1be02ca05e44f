"""Quantiles of past standardized residuals, and the bands they give."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Study


def tag(level: float) -> int:
    return round(level * 1000)


def tails(levels) -> list[float]:
    """Distinct tail probabilities of all levels, ascending."""
    return sorted({round(p, 12) for c in levels for p in ((1 - c) / 2, (1 + c) / 2)})


def pooled_quantiles(rows: DataFrame, study: Study = DEFAULT, value: str = "z", group: str = "symbol") -> DataFrame:
    """(symbol, day_idx, level, z_low, z_high): exact quantiles of the values of the days before.

    A row is sent to each of the ``history_days`` days that look back at it, and one aggregate
    gives all probabilities at once, so work is linear in the rows for a fixed history.
    """
    probs = tails(study.levels)
    days = rows.select(group, "day_idx").distinct()
    seen = rows.where(F.col(value).isNotNull()).select(
        group, F.explode(F.sequence(F.col("day_idx") + 1, F.col("day_idx") + study.history_days)).alias("day_idx"), value
    )
    pooled = (
        seen.join(days, [group, "day_idx"], "left_semi")
        .groupBy(group, "day_idx")
        .agg(F.percentile(value, F.array(*map(F.lit, probs))).alias("q"), F.count("*").alias("n"))
        .where(F.col("n") >= study.min_history)
    )
    pick = [
        F.struct(
            F.lit(tag(c)).alias("level"),
            F.col("q")[probs.index(round((1 - c) / 2, 12))].alias("z_low"),
            F.col("q")[probs.index(round((1 + c) / 2, 12))].alias("z_high"),
        )
        for c in study.levels
    ]
    return pooled.select(group, "day_idx", F.explode(F.array(*pick)).alias("p")).select(group, "day_idx", "p.*")


def normal_quantiles(study: Study = DEFAULT) -> list[tuple[int, float]]:
    return [(tag(c), NormalDist().inv_cdf((1 + c) / 2)) for c in study.levels]


def bands(rows: DataFrame, quantiles: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """Long bands: one row for each sample, model and level, where its volatility is known.

    Models: ``empirical`` (past quantiles times sigma), ``normal`` (normal quantiles times sigma),
    ``rolling`` (normal quantiles times rolling sigma).
    """
    keys = ["symbol", "d", "day_idx", "session", "slot", "seq", "close", "r", "sigma"]
    emp = rows.where("sigma > 0").join(quantiles, ["symbol", "day_idx"]).select(
        *keys, F.lit("empirical").alias("model"), "level", (F.col("sigma") * F.col("z_low")).alias("q_low"), (F.col("sigma") * F.col("z_high")).alias("q_high")
    )
    law = F.array(*(F.struct(F.lit(m).alias("model"), F.lit(t).alias("level"), F.lit(q).alias("q")) for m in ("normal", "rolling") for t, q in normal_quantiles(study)))
    par = rows.where("sigma > 0").withColumn("p", F.explode(law)).withColumn("_s", F.when(F.col("p.model") == "normal", F.col("sigma")).otherwise(F.col("sigma_roll")))
    par = par.where("_s > 0").select(*keys, "p.model", "p.level", (-F.col("_s") * F.col("p.q")).alias("q_low"), (F.col("_s") * F.col("p.q")).alias("q_high"))
    return emp.unionByName(par)


def scored(band: DataFrame) -> DataFrame:
    """Adds exceedance flags (strict), width and the mean pinball loss of the two edges."""
    a = (1 - F.col("level") / 1000) / 2
    low, high, r = F.col("q_low"), F.col("q_high"), F.col("r")
    loss = ((a - (r < low).cast("int")) * (r - low) + ((1 - a) - (r < high).cast("int")) * (r - high)) / 2
    return band.withColumns(
        {"lower": (r < low).cast("int"), "upper": (r > high).cast("int"), "width": high - low, "pinball": loss}
    )


def require_ordered(band: DataFrame) -> DataFrame:
    """``band``, or an error if any lower edge isn't below its upper edge."""
    bad = band.where(~(F.col("q_low") < F.col("q_high")) | F.isnan("q_low") | F.isnan("q_high") | F.col("q_low").isNull() | F.col("q_high").isNull())
    if n := bad.count():
        raise ValueError(f"{n} bands are not ordered")
    return band


def aligned(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """One to one join of two models' rows; ``values`` of both sides must agree. Any row without a partner is an error."""
    both = a.alias("a").join(b.alias("b"), keys, "full")
    apart = F.greatest(*(F.abs(F.col(f"a.{v}") - F.col(f"b.{v}")) for v in values), F.lit(0.0))
    alone = F.col(f"a.{values[0]}").isNull() | F.col(f"b.{values[0]}").isNull()
    found = both.agg(F.count("*").alias("n"), F.countDistinct(*keys).alias("keys"), F.sum(alone.cast("long")).alias("alone"), F.sum((apart > tolerance).cast("long")).alias("apart")).first()
    if found["n"] and (found["alone"] or found["apart"] or found["n"] != found["keys"]):
        raise ValueError(f"not aligned: {found['alone']} rows alone, {found['apart']} values apart, {found['n'] - found['keys']} keys repeated")
    return both


def day_scores(score: DataFrame) -> DataFrame:
    """Additive daily records by symbol, model and level; reports are ratios of their sums."""
    return score.groupBy("symbol", "d", "day_idx", "model", "level").agg(
        F.count("*").alias("n"),
        F.sum("pinball").alias("pinball_sum"),
        F.sum("width").alias("width_sum"),
        F.sum("lower").alias("lower_n"),
        F.sum("upper").alias("upper_n"),
    )
