"""Every registered query against its DuckDB statement on the smallest tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from check import TABLES, rows_of
from workload.queries import context
from workload.tables import flows

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLES:
        assert mine
        return
    cur = db.execute(ORACLES[name])
    columns = [d[0] for d in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert mine == rows_of(columns, cur.fetchall())


def test_scope_grows_with_the_flow_times(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    late = events.withColumn("event_id", (F.col("event_id") + 1_000_000).cast(events.schema["event_id"].dataType))
    events.unionByName(late).write.parquet(f"{tmp_path}/events.parquet")
    rows = flows(spark, str(tmp_path))
    after = rows.where("ts_us > 1706745600000000").count()
    assert after > 0
    assert context(spark, str(tmp_path), fresh=True).scoped.where("ts_us > 1706745600000000").count() == after
