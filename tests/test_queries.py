"""Every query with SQL gives the SQL's rows; every other one runs."""

import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from sparkgauge.queries import flagship, oracle_sql, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def canon(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    return tuple(map(canon, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    cols = sorted(df.columns)
    rows = sorted((tuple(canon(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name not in oracle_sql():
        assert rows
        return
    found = duck.sql(oracle_sql()[name])
    assert sorted(found.columns) == cols
    at = [found.columns.index(c) for c in cols]
    assert rows == sorted((tuple(canon(x[i]) for i in at) for x in found.fetchall()), key=repr)


def test_flagship(spark):
    assert flagship(spark, SF).count() == 5


def like_sql(spark, name, folder, *tables):
    """Whether a query gives its SQL's rows on the tables of a folder."""
    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    df = queries()[name](spark, str(folder))
    found = c.sql(oracle_sql()[name])
    at = [found.columns.index(x) for x in df.columns]
    return sorted((tuple(canon(x) for x in r) for r in df.collect()), key=repr) == sorted((tuple(canon(x[i]) for i in at) for x in found.fetchall()), key=repr)


def test_stringify_rounds_floats(spark, tmp_path):
    """Values whose product with 1000 is a half only in floats, on both sides of zero."""
    pq.write_table(pa.table({"vec_id": [1, 2, 3, 4], "embedding": pa.array([[0.3195, -0.1335, 0.1925, 0.0005, -0.0005], [], None, [None, 2.5, -1e6]], pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    assert like_sql(spark, "X27_stringify", tmp_path, "embeddings")


def test_range_join_counts_before_joining(spark, tmp_path):
    """Many events of few places: the join must not make a row for each part and event."""
    pq.write_table(pa.table({"p_partkey": pa.array(range(2000), pa.int64())}), tmp_path / "part.parquet")
    pq.write_table(pa.table({"event_id": pa.array([k % 50 + 3000 * (k // 50) for k in range(100_000)] + [-1, None], pa.int64())}), tmp_path / "events.parquet")
    assert like_sql(spark, "J8_range_join", tmp_path, "part", "events")
    plan = queries()["J8_range_join"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2 and plan.index("Join") < plan.rindex("Aggregate")
