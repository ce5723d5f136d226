from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import SparkSession

SF = os.environ.get("TICKLOOM_TEST_SF", "/root/testdata/sf0.001")


def local_session(cpus: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("tickloom")
             .config("spark.sql.shuffle.partitions", str(cpus))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.driver.memory", "16g")
             .config("spark.checkpoint.dir", os.environ.get("TICKLOOM_SHARED") or tempfile.mkdtemp(prefix="tickloom-"))
             .config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return local_session()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF
