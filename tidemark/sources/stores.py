"""Tables kept by day with a manifest: written once a day, read back pruned and verified.

A store is a folder with ``data/<day>=.../`` and ``manifest.json``. The manifest holds, for every
day, its rows and an order-free hash of them, and the signature of the run (what it was made from).
It is replaced by writing a new file and renaming it, so a reader sees the old one or the new one.
"""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import DataError, check_signature, write_days


def shared(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; a temporary one only on a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return where.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    return f"{shared(spark)}/tidemark-{uuid.uuid4().hex}"


def environment(spark: SparkSession) -> dict[str, str]:
    """Versions that a result may depend on."""
    import platform

    import numpy
    import pandas
    import pyarrow

    java = spark._jvm.java.lang.System.getProperty("java.version")
    return {"python": platform.python_version(), "spark": spark.version, "java": java, "numpy": numpy.__version__, "pandas": pandas.__version__, "pyarrow": pyarrow.__version__}


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Replaces a small file at once: the new content is written beside it and renamed over it."""
    fs, at = _fs(spark, path)
    beside = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(json.dumps(value, sort_keys=True, indent=1).encode()))
    out.close()
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    names = spark.sparkContext._gateway.new_array(options, 1)
    names[0] = options.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(beside, at, names)


def read_json(spark: SparkSession, path: str) -> dict | None:
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    finally:
        stream.close()


def digests(rows: DataFrame, day: str) -> dict[str, dict]:
    """Rows and order-free hash of every day; one small row a day comes to the driver."""
    cols = sorted(c for c in rows.columns if c != day)
    found = rows.groupBy(F.col(day).cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")).alias("h"))
    return {r["day"]: {"rows": r["n"], "hash": str(r["h"])} for r in found.collect()}


def store_days(rows: DataFrame, path: str, day: str = "d", signature: dict | None = None) -> dict:
    """Writes the days of ``rows``; days that the store has must come out the same. Returns the manifest.

    Run again after a failure, it changes nothing. A store of another signature is refused.
    """
    spark = rows.sparkSession
    held = read_json(spark, f"{path}/manifest.json")
    if held is not None:
        check_signature(held["signature"], signature or {})
    have = held["days"] if held else {}
    now = digests(rows, day)
    if changed := sorted(d for d in now.keys() & have.keys() if now[d] != have[d]):
        raise DataError(f"stored days would change: {', '.join(changed[:5])}")
    fresh = sorted(now.keys() - have.keys())
    if fresh:
        write_days(rows.where(F.col(day).cast("string").isin(fresh)), f"{path}/data", day)
    out = {"signature": signature or {}, "days": have | now, "written_at": datetime.now(UTC).isoformat(timespec="seconds"), "environment": environment(spark)}
    if fresh or held is None:
        write_json(spark, f"{path}/manifest.json", out)
    return out


def read_days(spark: SparkSession, path: str, first: str | None = None, last: str | None = None, day: str = "d", verify: bool = True) -> DataFrame:
    """The stored days from ``first`` to ``last``; only their folders are read, and each must be what the manifest says."""
    held = read_json(spark, f"{path}/manifest.json")
    if held is None:
        raise DataError(f"{path} is not a store")
    rows = spark.read.parquet(f"{path}/data")
    for bound, keep in ((first, F.col(day).cast("string") >= first), (last, F.col(day).cast("string") <= last)):
        rows = rows if bound is None else rows.where(keep)
    if verify:
        want = {d: x for d, x in held["days"].items() if (first is None or d >= first) and (last is None or d <= last)}
        found = digests(rows, day)
        if wrong := sorted(d for d in want.keys() | found.keys() if want.get(d) != found.get(d)):
            raise DataError(f"stored days differ from the manifest: {', '.join(wrong[:5])}")
    return rows


def check_store(spark: SparkSession, path: str, signature: dict | None = None, day: str = "d") -> int:
    """Verifies a whole store and, if given, its lineage, without writing anything. The number of its days."""
    held = read_json(spark, f"{path}/manifest.json")
    if held is None:
        raise DataError(f"{path} is not a store")
    if signature is not None:
        check_signature(held["signature"], signature)
    read_days(spark, path, day=day)
    return len(held["days"])


def first_pending(rows: DataFrame, done: DataFrame, keys: list[str], order: str, budget: int) -> DataFrame:
    """The next ``budget`` cases of every key that are not done, in their order: what a run with a budget works on."""
    from pyspark.sql import Window as W

    cases = rows.select(*keys, order).distinct().join(done.select(*keys, order).distinct(), [*keys, order], "left_anti")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    return cases.withColumn("_p", place).where(F.col("_p") <= budget).drop("_p")
