"""Every registered query of the engine against its SQL, over whole small tables."""

import os

import duckdb
import pytest

from palisade.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, sql, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = sql.sql(registry.ORACLES[name])
    assert sorted(rel.columns) == columns
    want = [tuple(r[rel.columns.index(c)] for c in columns) for r in rel.fetchall()]
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_run(spark, name):
    assert registry.QUERIES[name](spark, SF).collect()


def test_assignment_is_one_to_one(spark):
    rows = registry.QUERIES["match_assigned"](spark, SF).collect()
    assert len({r.path for r in rows}) == len({r.row_id for r in rows}) == len(rows)


def test_contract_without_the_optional_part():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
