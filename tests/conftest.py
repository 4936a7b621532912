import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Whether a query gives the rows of its SQL on the smallest tables."""
    import duckdb

    def rows(columns, found):
        order = sorted(range(len(columns)), key=columns.__getitem__)
        return sorted(str([r[k] for k in order]) for r in found)

    def check(query, sql, tables=("events", "customer", "pages", "documents", "conversations"), path=DATA):
        con = duckdb.connect()
        for t in tables:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/{t}.parquet'")
        out = con.execute(sql)
        wanted = rows([d[0] for d in out.description], out.fetchall())
        got = query(spark, path)
        assert rows(got.columns, [tuple(r) for r in got.collect()]) == wanted

    return check
