"""Every registered query against its DuckDB SQL."""

import math

import duckdb
import pytest

from quillon import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 9) if isinstance(v, float) else v
    return sorted(names), sorted((tuple(clean(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    if name in catalogue.ORACLES:
        rel = con.execute(catalogue.ORACLES[name])
        want = rows([c[0] for c in rel.description], rel.fetchall())
        assert got == want
    else:
        assert got[1]


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_filters_and_columns_reach_the_scan(spark, sf_dir):
    plan = catalogue.QUERIES["scan_doc_range"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(vec_id,100)" in plan and "ReadSchema: struct<vec_id:bigint,label:int>" in plan


def test_documents_are_not_shuffled_by_a_search(spark, sf_dir):
    plan = catalogue.QUERIES["topk_filtered"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" in plan and plan.count("Exchange hashpartitioning") == 1 and "Partial" in plan
