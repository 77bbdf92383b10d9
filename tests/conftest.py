import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    place = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(place / "warehouse")).config("spark.checkpoint.dir", str(place / "checkpoints")).getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return tuple(sorted((k, _plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return round(v, 9) if isinstance(v, float) else v


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Whether a query's rows are those of its SQL, whatever their order."""
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")

    def check(query, sql):
        got = query(spark, SMALL)
        names = sorted(got.columns)
        rows = sorted(repr([_plain(r[c]) for c in names]) for r in got.collect())
        told = db.sql(sql)
        assert sorted(told.columns) == names
        at = [told.columns.index(c) for c in names]
        assert sorted(repr([_plain(r[i]) for i in at]) for r in told.fetchall()) == rows

    return check
