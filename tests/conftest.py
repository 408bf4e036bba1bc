import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("TARN_TEST_DATA", "/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def same_as_sql(spark, sf):
    """Compares a query's rows and columns with those of its SQL in DuckDB on sf0.001."""
    import decimal
    import glob
    import math

    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")

    def plain(x):
        if hasattr(x, "asDict"):
            x = x.asDict()
        if isinstance(x, dict):
            return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
        if isinstance(x, (list, tuple)):
            return tuple(plain(v) for v in x)
        if isinstance(x, decimal.Decimal):
            x = float(x)
        if isinstance(x, float):
            return "nan" if math.isnan(x) else float(f"{x:.9g}")
        return x

    def rows(columns, found):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return sorted(([plain(r[i]) for i in order] for r in found), key=repr)

    def check(query, sql):
        df = query(spark, sf)
        result = con.execute(sql)
        columns = [x[0] for x in result.description]
        assert sorted(df.columns) == sorted(columns)
        assert rows(df.columns, df.collect()) == rows(columns, result.fetchall())

    return check
