import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "3g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        path = f"{SMALL}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return v if v is None or isinstance(v, (bool, int, str)) else float(v)


def same_rows(spark_df, relation):
    """Rows of both, sorted, with columns by name."""
    columns = sorted(spark_df.columns)
    assert columns == sorted(relation.columns)
    at = [relation.columns.index(c) for c in columns]
    mine = [tuple(normal(r[c]) for c in columns) for r in spark_df.collect()]
    theirs = [tuple(normal(r[i]) for i in at) for r in relation.fetchall()]
    key = lambda row: tuple((v is None, str(v)) for v in row)
    return sorted(mine, key=key), sorted(theirs, key=key)
