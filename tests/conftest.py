from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))
os.environ.setdefault("PYTHONPATH", str(Path(__file__).parents[1]))
os.environ.setdefault("OMP_NUM_THREADS", "1")

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.001/{t}.parquet'")
    return connection


@pytest.fixture
def same(spark, duck):
    """Asserts that a query and its SQL give the same rows, types apart."""
    import math

    def shown(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 9))
        return repr(float(v)) if hasattr(v, "as_tuple") else str(v)

    def check(run, sql):
        df = run(spark, f"{DATA}/sf0.001")
        columns = sorted(df.columns)
        there = duck.sql(sql)
        assert sorted(there.columns) == columns
        order = [there.columns.index(c) for c in columns]
        mine = sorted([shown(r[c]) for c in columns] for r in df.collect())
        theirs = sorted([shown(r[i]) for i in order] for r in there.fetchall())
        assert mine == theirs

    return check
