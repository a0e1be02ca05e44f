from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its oracle on the smallest tables and compares rows."""
    import duckdb

    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")

    def flat(rows, columns, order):
        at = [columns.index(c) for c in order]
        return sorted(repr(tuple(round(float(r[i]), 7) if isinstance(r[i], float) else r[i] for i in at)) for r in rows)

    def run(query, sql):
        got = query(spark, str(DATA))
        want = con.sql(sql)
        order = sorted(got.columns)
        assert order == sorted(want.columns)
        a, b = flat([tuple(r) for r in got.collect()], got.columns, order), flat(want.fetchall(), want.columns, order)
        assert a == b

    return run
