import math
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v if v is None or isinstance(v, (bool, int, str)) else str(v)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    def check(df, sql):
        rel = duck.sql(sql)
        names = sorted(rel.columns)
        assert sorted(df.columns) == names
        ours = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
        at = [rel.columns.index(c) for c in names]
        theirs = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
        assert ours == theirs

    return check
