"""p-values that SQL lacks, as an Arrow function, and the day-block bootstrap with seeded starts."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def chi2_1_sf(x: pd.Series) -> pd.Series:
    """Upper tail of chi-square with one degree of freedom; null stays null."""
    return x.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2)), na_action="ignore")


def independence_p(lr: DataFrame) -> DataFrame:
    return lr.withColumn("p_value", F.round(chi2_1_sf("lr"), 8))


def block_bootstrap(days: DataFrame, replicates: int = 2000, block: int = 5, seed: int = 20260923) -> DataFrame:
    """(rep, stat): ratio of sums over circular day blocks, truncated to the number of days.

    ``days``: (idx from 0, diff, n), a row a day. Starts come from one seeded generator on the
    driver (replicates x blocks integers); the gather is a join on the day's index.
    """
    spark: SparkSession = days.sparkSession
    m = days.count()
    if m < 2 * block:
        raise ValueError("too few days for a bootstrap")
    starts = np.random.default_rng(seed).integers(0, m, size=(replicates, -(-m // block)))
    table = spark.createDataFrame(pd.DataFrame({"rep": np.arange(replicates), "starts": starts.tolist()}))
    place = table.select("rep", F.posexplode("starts").alias("blk", "start")).select("rep", "blk", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("o"))
    picked = place.where(F.col("blk") * block + F.col("o") < m).select("rep", ((F.col("start") + F.col("o")) % m).alias("idx"))
    return picked.join(days, "idx").groupBy("rep").agg((F.sum("diff") / F.sum("n")).alias("stat"))
