"""Volatility that uses only earlier bars: exponential, rolling and seasonal."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Study
from .bars import overlapped

FLOOR = 1e-16
_FOLD = 256


def ewma(rows: DataFrame, study: Study = DEFAULT, value: str = "r", out: str = "sigma", decay: float | None = None) -> DataFrame:
    """Adds ``out``: sqrt of the exponentially weighted mean square of all earlier rows of the symbol.

    The recursion v' = decay * v + (1 - decay) * r^2 is seeded with the mean of the first
    ``rolling_bars`` squares and runs on over days and sessions; rows before have none. Each row
    is an affine map of v, and so is a unit, a run of rows of one day that is short enough for
    decay^-rows to stay within 1e100. Inside a unit a window sum does the rest; units are folded in
    order on small arrays, ``_FOLD`` of them at a time, so no array is copied more often than that.
    """
    lam = study.decay if decay is None else decay
    first = study.rolling_bars
    reach = max(1, math.floor(100 * math.log(10) / -math.log(lam))) if 0 < lam < 1 else 1 << 30
    square = F.col(value) * F.col(value)
    seed = rows.where(F.col("seq") < first).groupBy("symbol").agg(F.avg(square).alias("_seed"), F.count("*").alias("_n"))
    seed = seed.where(F.col("_n") == first).drop("_n")
    unit = ["symbol", "day_idx", "_u"]
    live = rows.where(F.col("seq") >= first)
    live = live.withColumn("_k", F.row_number().over(W.partitionBy("symbol", "day_idx").orderBy("seq")) - 1)
    live = live.withColumns({"_u": F.floor(F.col("_k") / reach), "_k": F.col("_k") % reach + 1})
    weighted = square * F.pow(F.lit(1 / lam), F.col("_k"))
    before = W.partitionBy(*unit).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    live = live.withColumn("_past", F.coalesce(F.sum(weighted).over(before), F.lit(0.0)))
    units = live.groupBy(*unit).agg(F.pow(F.lit(lam), F.count("*")).alias("a"), (F.pow(F.lit(lam), F.count("*")) * (1 - lam) * F.sum(weighted)).alias("b"))
    place = F.row_number().over(W.partitionBy("symbol").orderBy("day_idx", "_u")) - 1
    part = F.array_sort(F.collect_list(F.struct("day_idx", "_u", "a", "b"))).alias("m")
    parts = units.withColumn("_g", F.floor(place / _FOLD)).groupBy("symbol", "_g").agg(part)
    whole = "aggregate(m, named_struct('a', 1D, 'b', 0D), (s, x) -> named_struct('a', x.a * s.a, 'b', x.a * s.b + x.b))"
    maps = parts.select("symbol", "_g", F.expr(whole).alias("w")).groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("_g", "w.a", "w.b"))).alias("m"))
    heads = maps.join(seed, "symbol").select("symbol", F.explode(_scan("_g bigint", "_seed")).alias("s")).select("symbol", "s._g", F.col("s.v").alias("_seed"))
    starts = parts.join(heads, ["symbol", "_g"]).select("symbol", F.explode(_scan("day_idx int, _u bigint", "_seed")).alias("s"))
    starts = starts.select("symbol", "s.day_idx", "s._u", F.col("s.v").alias("_v"))
    v = F.pow(F.lit(lam), F.col("_k") - 1) * (F.col("_v") + (1 - lam) * F.col("_past"))
    done = live.join(starts, unit).withColumn(out, F.sqrt(F.greatest(v, F.lit(FLOOR))))
    early = rows.where(F.col("seq") < first).withColumn(out, F.lit(None).cast("double"))
    return done.drop("_k", "_u", "_past", "_v").unionByName(early)


def _scan(keys: str, start: str):
    """Column: for each affine map of the array ``m``, its keys and the value that it starts from."""
    names = [k.split()[0] for k in keys.split(", ")]
    kind = ", ".join(f"{n}: {t}" for n, t in (k.split() for k in keys.split(", ")))
    own = ", ".join(f"'{n}', x.{n}" for n in names)
    return F.expr(
        f"""aggregate(m, named_struct('v', {start}, 'out', cast(array() as array<struct<{kind}, v: double>>)),
        (s, x) -> named_struct('v', x.a * s.v + x.b, 'out', array_append(s.out, named_struct({own}, 'v', s.v))), s -> s.out)"""
    )


def rolling(rows: DataFrame, study: Study = DEFAULT, value: str = "r", out: str = "sigma_roll", bars: int | None = None) -> DataFrame:
    """Adds ``out``: root mean square of exactly the ``bars`` rows before, else null."""
    n = bars or study.rolling_bars
    back = W.partitionBy("symbol", "part").orderBy("seq").rowsBetween(-n, -1)
    square = F.col(value) * F.col(value)
    wide = overlapped(rows, n).withColumns({"_m": F.avg(square).over(back), "_n": F.count(square).over(back)})
    own = wide.where(F.col("part") == F.floor(F.col("seq") / 100_000))
    return own.withColumn(out, F.when(F.col("_n") == n, F.sqrt(F.greatest("_m", F.lit(FLOOR))))).drop("_m", "_n", "part")


def seasonal_factors(rows: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """(symbol, day_idx, bucket, factor): sqrt of a bucket's mean square over all buckets', on earlier days.

    Buckets are those of the target bar. The factor is 1 with too few days or observations.
    """
    bucket = F.floor((F.col("slot") + 1) / study.coarse_bars).cast("int")
    buckets = 1440 // study.bar_minutes // study.coarse_bars
    cells = rows.groupBy("symbol", "day_idx", bucket.alias("bucket")).agg(F.sum(F.col("r") * F.col("r")).alias("s"), F.count("*").alias("n"))
    grid = rows.select("symbol", "day_idx").distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    full = grid.join(cells, ["symbol", "day_idx", "bucket"], "left").fillna({"s": 0.0, "n": 0})
    own = W.partitionBy("symbol", "bucket").orderBy("day_idx").rangeBetween(-study.season_days, -1)
    total = full.groupBy("symbol", "day_idx").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    whole = W.partitionBy("symbol").orderBy("day_idx").rangeBetween(-study.season_days, -1)
    total = total.select("symbol", "day_idx", F.sum("s").over(whole).alias("all_s"), F.sum("n").over(whole).alias("all_n"))
    part = full.select("symbol", "day_idx", "bucket", F.sum("s").over(own).alias("own_s"), F.sum("n").over(own).alias("own_n"))
    usable = (
        (F.least(F.col("day_idx"), F.lit(study.season_days)) >= study.season_min_days)
        & (F.col("own_n") >= study.season_min_obs)
        & (F.col("own_s") > 0)
        & (F.col("all_s") > 0)
    )
    ratio = F.sqrt((F.col("own_s") / F.col("own_n")) / (F.col("all_s") / F.col("all_n")))
    return part.join(total, ["symbol", "day_idx"]).select("symbol", "day_idx", "bucket", F.when(usable, ratio).otherwise(1.0).alias("factor"))


def seasonal_sigma(rows: DataFrame, study: Study = DEFAULT) -> DataFrame:
    """Adds factor and sigma_season = factor * exponential sigma of r / factor."""
    keyed = rows.withColumn("bucket", F.floor((F.col("slot") + 1) / study.coarse_bars).cast("int"))
    joined = keyed.join(seasonal_factors(rows, study), ["symbol", "day_idx", "bucket"]).withColumn("_flat", F.col("r") / F.col("factor"))
    flat = ewma(joined, study, "_flat", "sigma_flat")
    return flat.withColumn("sigma_season", F.col("factor") * F.col("sigma_flat")).drop("_flat")
