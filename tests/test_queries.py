"""Every registered query against its SQL, and the shape of its plan."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
SLOW = {"classifier_scores", "classifier_evaluation"}  # covered by test_classifier
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def canonical(rows, columns):
    return sorted(tuple(repr(r[c]) for c in columns) for r in rows)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - SLOW))
def test_query(spark, duck, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    rows = [r.asDict() for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|NestedLoopJoin|BatchEvalPython|ArrowEvalPython", plan)
    if name not in ORACLE:
        assert rows
        return
    result = duck.sql(ORACLE[name])
    expected = [dict(zip(result.columns, r)) for r in result.fetchall()]
    assert sorted(result.columns) == sorted(df.columns)
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(result.columns, map(str, result.types)))
    columns = sorted(df.columns)
    assert canonical(rows, columns) == canonical(expected, columns)
    assert not any(isinstance(v, float) and math.isnan(v) for r in rows for v in r.values())


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


def test_entry(spark, sf_dir):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["validation_report", "pair_comparison", "model_summary", "routed_records", "rule_layer"])
def test_texts_are_not_dealt_out(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "RoundRobinPartitioning" not in plan and "REPARTITION_BY_NUM" not in plan
