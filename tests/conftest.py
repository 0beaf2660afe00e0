import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = os.environ.get("SEQLOOM_TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def data():
    if not os.path.isdir(DATA):
        pytest.skip(f"no test tables in {DATA}")
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import glob

    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def canonical_rows(columns, rows):
    """Rows as a multiset of texts, columns in order of name."""
    from collections import Counter

    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: repr(v.tolist() if hasattr(v, "tolist") else list(v) if isinstance(v, tuple) else v)
    return sorted(columns), Counter(tuple(plain(r[i]) for i in order) for r in rows)


def agrees(spark, duck, data, query, sql):
    df = query(spark, data)
    mine = canonical_rows(df.columns, [tuple(r) for r in df.collect()])
    c = duck.execute(sql)
    theirs = canonical_rows([x[0] for x in c.description], c.fetchall())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1], (list((mine[1] - theirs[1]).items())[:3], list((theirs[1] - mine[1]).items())[:3])
