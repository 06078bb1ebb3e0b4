import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH", "")) if x)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{shared}")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def values(spark):
    """A function: the values of an expression over rows of columns a, b, c."""

    def of(rows, *columns, schema=None):
        rows = [r if isinstance(r, tuple) else (r,) for r in rows]
        names = schema or ", ".join(f"{n} string" for n, _ in zip("abc", rows[0]))
        out = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {names}").select("i", *[c.alias(f"v{k}") for k, c in enumerate(columns)]).collect()
        got = [tuple(r)[1:] for r in sorted(out)]
        return [x[0] for x in got] if len(columns) == 1 else got

    return of


SF = "/root/testdata/sf0.001"


@pytest.fixture
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    return SF
