"""Every catalogue query against the oracle engine, and its plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from rowmill.plans.catalogue import CATALOGUE
from rowmill.session import TABLES

DATA = "/root/testdata/sf0.001"


def canonical(rows):
    return sorted(repr(tuple(v.isoformat() if hasattr(v, "isoformat") else v for v in r)) for r in rows)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CATALOGUE)
def test_query_equals_oracle(spark, oracle, name):
    ours = entry.queries()[name](spark, DATA)
    theirs = oracle.sql(CATALOGUE[name])
    assert ours.columns == theirs.columns
    assert canonical(ours.collect()) == canonical(theirs.fetchall())


def test_entry_has_rows_and_schema(spark):
    df = entry.entry(spark)
    assert df.columns == ["n_name", "revenue"]
    df.collect()


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(entry.queries()["filter_date_range"](spark, DATA))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual" in text
    assert "o_totalprice" not in text


def test_comma_joins_become_equi_joins(spark):
    text = plan(entry.queries()["tpch_q5"](spark, DATA))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_filter_on_group_key_goes_below_the_aggregate(spark):
    assert "GreaterThan(n_regionkey,2)" in plan(entry.queries()["agg_having_groupkey"](spark, DATA))


def test_top_k_is_one_operator(spark):
    assert "TakeOrderedAndProject" in plan(entry.queries()["top_k"](spark, DATA))


def test_bare_column_beside_groups_is_rejected(spark):
    spark.sql("SELECT 1 AS a, 2 AS b").createOrReplaceTempView("bare")
    with pytest.raises(Exception, match="MISSING_AGGREGATION|GROUP BY"):
        spark.sql("SELECT a, b, count(*) AS n FROM bare GROUP BY a")


def test_strings_are_compared_after_the_hash_aggregate(spark):
    tree = plan(entry.queries()["agg_minmax_string_date"](spark, DATA)).split("\n\n")[0].split("\n")
    scan = next(i for i, line in enumerate(tree) if "Scan parquet" in line)
    below = "".join(tree[next(i for i in range(scan, 0, -1) if "Exchange" in tree[i]) : scan])
    assert "HashAggregate" in below and "Sort" not in below


def test_entry_works_without_a_library_of_the_operators(monkeypatch):
    import importlib
    import sys

    kept = {n: sys.modules.pop(n) for n in list(sys.modules) if n.startswith("rowmill.llm") or n == "corpus_pipeline"}
    monkeypatch.setitem(sys.modules, "xxhash", None)
    try:
        assert set(importlib.reload(entry).queries()) == set(CATALOGUE)
    finally:
        monkeypatch.undo()
        for n in [n for n in sys.modules if n.startswith("rowmill.llm") or n == "corpus_pipeline"]:
            del sys.modules[n]
        sys.modules.update(kept)
        importlib.reload(entry)
