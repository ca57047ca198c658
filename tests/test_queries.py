"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    return value


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_matches_sql(spark, db, name):
    got = driver.queries()[name](spark, SF)
    result = db.execute(driver.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(got.columns) == sorted(columns)
    want = Counter(tuple(map(plain, r)) for r in result.fetchall())
    have = Counter(tuple(map(plain, r)) for r in got.select(*columns).collect())
    assert have == want


@pytest.mark.parametrize("name", sorted(set(driver.queries()) - set(driver.oracle_sql())))
def test_without_sql(spark, name):
    assert driver.queries()[name](spark, SF).count() > 0


def test_approximate_recall(spark):
    key = ["query_id", "chunk_key"]
    exact = driver.queries()["dense_topk"](spark, SF).select(*key)
    found = driver.queries()["dense_topk_ann"](spark, SF).select(*key)
    assert exact.join(found, key, "left_semi").count() >= 0.9 * exact.count()
