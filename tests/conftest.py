import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.driver.memory", "3g").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def keyed(frame, columns):
    def text(v):
        if v is None or v != v:
            return "null"
        return repr(round(float(v), 9) + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(map(text, r)) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="session")
def same(spark, duck):
    """Compares a query with its SQL on the smallest tables."""

    def check(query, sql):
        a, b = query(spark, SF).toPandas(), duck.sql(sql).df()
        columns = sorted(a.columns)
        assert columns == sorted(b.columns)
        assert keyed(a, columns) == keyed(b, columns)

    return check
