from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.dirname(os.path.abspath(__file__))]

from pagemill.session import configure  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]").appName("pagemill-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    )
    session = configure(builder).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def apply(spark):
    """Evaluate a column function over literal rows: ``apply(fn, [(a, b), …])``."""
    from pyspark.sql import functions as F

    def run(fn, rows, types=None):
        width = len(rows[0])
        types = types or ["string"] * width
        schema = "i int, " + ", ".join(f"c{k} {t}" for k, t in enumerate(types))
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)
        out = df.select("i", fn(*[F.col(f"c{k}") for k in range(width)]).alias("v"))
        return [r["v"] for r in out.orderBy("i").collect()]

    return run
