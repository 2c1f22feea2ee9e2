import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/sf0.01/{t}.parquet'")
    return con


def same(spark, duck, query, sql):
    """Spark's rows and DuckDB's, both sorted and as text."""
    got, want = query(spark, f"{DATA}/sf0.01").toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)

    def rows(df):
        return sorted(tuple("" if v is None or v != v else str(v)[:10] if hasattr(v, "year") else repr(float(v)) if hasattr(v, "dtype") or isinstance(v, (int, float)) else str(v) for v in r) for r in df[cols].itertuples(index=False))

    assert rows(got) == rows(want)
    assert len(got)
