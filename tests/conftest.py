import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def as_rows(columns, rows):
    """Rows with columns by name, sorted, floats to nine digits."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Compare a query with its SQL on the smallest tables."""

    def compare(query, sql):
        found = query(spark, SMALL)
        expected = duck.execute(sql)
        columns = [c[0] for c in expected.description]
        assert sorted(found.columns) == sorted(columns)
        assert as_rows(found.columns, found.collect()) == as_rows(columns, expected.fetchall())

    return compare
