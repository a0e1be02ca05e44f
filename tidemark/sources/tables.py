"""Readers that reject what they should not read, and writers that can run twice."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RAW = (
    T.StructType()
    .add("SYMBOL", "string").add("TRADING_DATE", "integer").add("TRADING_TIME", "string")
    .add("OPEN_PX", "double").add("HIGH_PX", "double").add("LOW_PX", "double").add("CLOSE_PX", "double")
    .add("VOL", "long").add("BUY_VOL", "long").add("SELL_VOL", "long")
)


class DataError(ValueError):
    pass


def read_raw(spark: SparkSession, path: str, symbol: str | None = None) -> DataFrame:
    """A CSV of bars with its schema given; one aggregate counts every kind of violation."""
    raw = spark.read.schema(RAW).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    rows = raw.withColumn("ts", F.try_to_timestamp(F.concat_ws(" ", F.col("TRADING_DATE").cast("string"), "TRADING_TIME"), F.lit("yyyyMMdd HH:mm:ss")).cast("timestamp_ntz"))
    px = [F.col(c) for c in ("OPEN_PX", "HIGH_PX", "LOW_PX", "CLOSE_PX")]
    bad = {
        "missing value": F.greatest(*(c.isNull().cast("int") for c in [*map(F.col, RAW.names), F.col("ts")])),
        "price": (F.least(*px) <= 0) | (F.col("HIGH_PX") < F.greatest(*px)) | (F.col("LOW_PX") > F.least(*px)),
        "volume": F.least("VOL", "BUY_VOL", "SELL_VOL") < 0,
    }
    if symbol is not None:
        bad["symbol"] = F.col("SYMBOL") != symbol
    counts = rows.agg(F.count("*").alias("rows"), F.countDistinct("SYMBOL", "ts").alias("distinct"), *(F.sum(c.cast("int")).alias(n) for n, c in bad.items())).first()
    if not counts["rows"]:
        raise DataError("no rows")
    wrong = [n for n in bad if counts[n]]
    if counts["distinct"] != counts["rows"]:
        wrong.append("repeated time")
    if wrong:
        raise DataError("rejected: " + ", ".join(wrong))
    return rows


def write_once(df: DataFrame, path: str) -> None:
    """Parquet that must not exist yet."""
    df.write.mode("errorifexists").parquet(path)


def write_days(df: DataFrame, path: str, day: str = "d") -> None:
    """Replaces only the days that ``df`` holds; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """One flat CSV file with numbers to eight significant digits."""
    cols = [F.format_string("%.8g", c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    df.select(*cols).coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same columns and rows, repeats counted."""
    if sorted(a.dtypes) != sorted(b.dtypes):
        return False
    b = b.select(a.columns)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def write_or_compare(df: DataFrame, path: str) -> bool:
    """Writes a report, or checks it against the one that is there. True if it was written."""
    jvm_path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    if not jvm_path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(jvm_path):
        write_once(df, path)
        return True
    if not same_rows(df, df.sparkSession.read.parquet(path)):
        raise DataError(f"{path} holds another result")
    return False


def file_hashes(spark: SparkSession, path: str, text: bool = False) -> DataFrame:
    """(path, sha256) of files; ``text`` counts CRLF as LF."""
    files = spark.read.format("binaryFile").load(path)
    body = F.regexp_replace(F.decode("content", "utf-8"), "\r\n", "\n") if text else F.col("content")
    return files.select("path", F.sha2(body.cast("binary"), 256).alias("sha256"))


def signature(df: DataFrame, settings: dict) -> dict[str, str]:
    """What a run depends on: an order-free hash of its input's rows, its settings, its versions."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")).first()
    return {"rows": str(row["n"]), "hash": str(row["h"]), "settings": json.dumps(settings, sort_keys=True), "spark": df.sparkSession.version}


def check_signature(stored: dict, now: dict) -> None:
    if changed := sorted(k for k in stored.keys() | now.keys() if stored.get(k) != now.get(k)):
        raise DataError(f"the run's inputs changed: {', '.join(changed)}")


def pending(cases: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Cases not finished yet."""
    return cases.join(done.select(*keys).distinct(), keys, "left_anti")
