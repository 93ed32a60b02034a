"""Small fixtures with answers derived by hand."""

import pytest

VIEWS = {
    "r": "SELECT * FROM (VALUES (1, 23), (12, 3), (1, 23), (2, 5)) AS v(a, b)",
    "s": "SELECT * FROM (VALUES (1, 23, 'x'), (12, 3, 'y'), (9, 9, 'z')) AS v(a, b, c)",
    "t": "SELECT * FROM (VALUES (1, DATE '1995-03-01', 'm', CAST(1.25 AS DOUBLE)), (1, DATE '1994-01-01', 'a', CAST(1.75 AS DOUBLE)), (2, DATE '1996-01-01', 'q', CAST(1.5 AS DOUBLE))) AS v(k, d, n, p)",
    "e": "SELECT * FROM (VALUES (1, 1)) AS v(a, b) WHERE 1 = 0",
}

CASES = {
    "group_key_no_collision": ("SELECT a, b, COUNT(*) AS c FROM r GROUP BY a, b ORDER BY a, b", [(1, 23, 2), (2, 5, 1), (12, 3, 1)]),
    "join_key_no_collision": ("SELECT r.a, r.b, s.c FROM r, s WHERE r.a = s.a AND r.b = s.b ORDER BY r.a, r.b", [(1, 23, 'x'), (1, 23, 'x'), (12, 3, 'y')]),
    "join_int_double": ("SELECT t.k, COUNT(*) AS c FROM t, (SELECT CAST(1.0 AS DOUBLE) AS x) q WHERE t.k = q.x GROUP BY t.k", [(1, 2)]),
    "minmax_date_string": ("SELECT k, CAST(MIN(d) AS VARCHAR(10)) AS mn, MAX(n) AS mx FROM t WHERE k = 1 GROUP BY k", [(1, '1994-01-01', 'm')]),
    "avg_int_is_double": ("SELECT AVG(a) AS v FROM r", [(4.0,)]),
    "avg_int_fraction": ("SELECT AVG(b) AS v FROM r", [(13.5,)]),
    "count_distinct": ("SELECT COUNT(a) AS c, COUNT(DISTINCT a) AS d FROM r", [(4, 3)]),
    "group_without_agg": ("SELECT a FROM r GROUP BY a ORDER BY a", [(1,), (2,), (12,)]),
    "global_agg_empty": ("SELECT COUNT(*) AS c, SUM(a) AS s FROM e", [(0, None)]),
    "having_no_group": ("SELECT COUNT(*) AS c FROM r HAVING COUNT(*) > 3", [(4,)]),
    "having_all_pushed": ("SELECT a, COUNT(*) AS c FROM r GROUP BY a HAVING a > 2", [(12, 1)]),
    "product_const_false": ("SELECT r.a, s.c FROM r, s WHERE 1 = 0", []),
    "product_paren_or": ("SELECT r.a, s.c FROM r, s WHERE (r.a = 2 OR s.a = 9) ORDER BY r.a, s.c", [(1, 'z'), (1, 'z'), (2, 'x'), (2, 'y'), (2, 'z'), (12, 'z')]),
    "mixed_side_equality": ("SELECT r.a, s.a AS sa FROM r, s WHERE r.a + s.a = 10", [(1, 9), (1, 9)]),
    "right_derived_table": ("SELECT x.a, y.n FROM (SELECT DISTINCT a FROM r WHERE a < 3) x, (SELECT k, COUNT(*) AS m, 2 - (k - 1) * 2 AS n FROM t GROUP BY k) y WHERE x.a = y.k ORDER BY x.a", [(1, 2), (2, 0)]),
    "filter_on_computed_alias": ("SELECT q.z FROM (SELECT a + b AS z FROM r) q WHERE q.z > 7 ORDER BY q.z", [(15,), (24,), (24,)]),
    "sort_double_desc": ("SELECT p FROM t ORDER BY p DESC", [(1.75,), (1.5,), (1.25,)]),
    "sort_by_expression": ("SELECT a, b FROM r ORDER BY a + b DESC, a", [(1, 23), (1, 23), (12, 3), (2, 5)]),
    "union_all_order_limit": ("SELECT a FROM r UNION ALL SELECT a FROM s ORDER BY a DESC LIMIT 3", [(12,), (12,), (9,)]),
    "product_empty_right": ("SELECT r.a, e.a AS ea FROM r, e", []),
    "star_after_column": ("SELECT b AS bb, r.* FROM r WHERE a = 12", [(3, 12, 3)]),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    for view, sql in VIEWS.items():
        spark.sql(sql).createOrReplaceTempView(view)
    sql, expected = CASES[name]
    rows = [tuple(r) for r in spark.sql(sql).collect()]
    assert rows == expected or sorted(rows) == sorted(expected)


@pytest.mark.parametrize("rows", [5_001, 10_003])
def test_sort_keeps_every_row(spark, rows):
    out = [r.id for r in spark.range(rows).orderBy("id").collect()]
    assert out == list(range(rows))


def test_product_and_join_keep_every_row(spark):
    big = spark.range(10_001)
    assert big.crossJoin(spark.range(1).withColumnRenamed("id", "x")).count() == 10_001
    assert big.join(spark.range(10_001), "id").count() == 10_001
