import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH", "")]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_as_sql():
    """Holds a query's rows at a scale against its SQL on DuckDB."""
    import duckdb

    def check(got, sql, folder):
        con = duckdb.connect()
        for name in os.listdir(folder):
            con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{folder}/{name}')")
        want = con.execute(sql).df()
        got = got.toPandas()
        assert sorted(got.columns) == sorted(want.columns)
        columns = sorted(got.columns)
        rows = [sorted(map(tuple, x[columns].astype(str).to_numpy())) for x in (got, want)]
        assert rows[0] == rows[1]

    return check
