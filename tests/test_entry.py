import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, ordered
from workload.oracles import ORACLES
from workload.queries import all_queries

SF_DIR = "/root/testdata/sf0.001"
CHECKED = (
    "rank_candidates", "parse_profiles", "expand_archives", "extract_default_skills",
    "tfidf_all_pairs", "notification_outbox", "delete_jobs", "latest_job_candidates",
)


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    return connection


def test_every_query_has_its_sql():
    assert set(all_queries()) == set(ORACLES)
    assert set(all_queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    result = entry.entry(spark)
    assert result.columns[:2] == ["job_id", "candidate_id"] and result.count() > 0


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, base, name):
    got = ordered(entry.queries()[name](spark, SF_DIR).toPandas())
    want = ordered(base.execute(entry.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns)
    assert got.map(repr).equals(want.map(repr))
