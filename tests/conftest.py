import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def matches_sql(spark, sf_dir):
    """Whether a query gives the columns and rows that DuckDB gives for some SQL."""
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(sf_dir):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")

    def check(query, sql):
        want = con.execute(sql)
        columns = sorted(c[0] for c in want.description)
        place = {c[0]: i for i, c in enumerate(want.description)}
        plain = lambda x: None if x is None or x != x else round(x, 6) + 0.0 if isinstance(x, float) else x
        rows = sorted([tuple(plain(r[place[c]]) for c in columns) for r in want.fetchall()], key=repr)
        got = query(spark, sf_dir)
        assert sorted(got.columns) == columns
        assert sorted([tuple(plain(r[c]) for c in columns) for r in got.collect()], key=repr) == rows

    return check
