import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def same_as_duckdb(spark, sf_dir):
    """Asserts that a query and its SQL give the same rows over the driver's tables."""
    import duckdb

    con = duckdb.connect()
    for file in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")

    def compare(query, sql):
        ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        rows = [sorted(map(tuple, df[sorted(df.columns)].astype(object).fillna("~").astype(str).values)) for df in (ours, theirs)]
        assert len(rows[0]) == len(rows[1])
        assert rows[0] == rows[1]

    return compare
