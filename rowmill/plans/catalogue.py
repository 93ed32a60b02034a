"""The query catalogue: one text for Spark SQL and for the oracle engine.

Each query exercises the operators of the inventory; every computed column has an alias and every LIMIT a total order.
Joins stand in the order in which they run without statistics: filtered dimensions first, the largest table as the
probe side. MIN and MAX of strings come last, over the few rows of a hash aggregate, for they would sort their input.
"""

from __future__ import annotations

CATALOGUE: dict[str, str] = {
    "scan_region": """SELECT * FROM region""",
    "filter_eq": """SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'""",
    "filter_conjunct": """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.03 AND l_returnflag = 'R'""",
    "filter_or_not": """SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'P' OR o_orderpriority = '1-URGENT') AND NOT (o_totalprice < 200000)""",
    "filter_between": """SELECT l_orderkey, l_extendedprice FROM lineitem WHERE l_shipdate BETWEEN TIMESTAMP '1996-01-01 00:00:00' AND TIMESTAMP '1996-01-31 00:00:00'""",
    "filter_in": """SELECT p_partkey, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL') AND p_size IN (1, 2, 3)""",
    "filter_like": """SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget'""",
    "filter_date_range": """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS odate FROM orders WHERE o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01'""",
    "project_expr_alias": """SELECT l_orderkey AS okey, ROUND(l_extendedprice * (1 - l_discount) * (1 + l_tax), 2) AS charge FROM lineitem WHERE l_quantity = 50""",
    "project_table_star": """SELECT n.*, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey""",
    "project_table_star_group": """SELECT r.*, COUNT(*) AS cnt FROM region r, nation n WHERE n.n_regionkey = r.r_regionkey GROUP BY r.r_regionkey, r.r_name""",
    "cross_product": """SELECT r.r_name, s.s_suppkey FROM region r, supplier s""",
    "equi_join": """SELECT o.o_orderkey, c.c_name FROM orders o, customer c WHERE o.o_custkey = c.c_custkey AND c.c_acctbal > 5000""",
    "join_on": """SELECT s.s_name, n.n_name FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""",
    "join_multi_key": """SELECT l.l_orderkey, s.s_suppkey, c.c_custkey FROM supplier s, lineitem l, orders o, customer c WHERE c.c_custkey = o.o_custkey AND o.o_orderkey = l.l_orderkey AND l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey""",
    "join_expr_key": """SELECT a.n_nationkey AS na, b.n_nationkey AS nb FROM nation a, nation b WHERE a.n_nationkey + 1 = b.n_nationkey * 2""",
    "join_theta": """SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a, nation b WHERE a.n_nationkey < b.n_nationkey""",
    "join_equi_residual": """SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey""",
    "join_residual_or": """SELECT n.n_name, r.r_name FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND (n.n_nationkey = 1 OR r.r_name = 'ASIA')""",
    "join_mixed_side_eq": """SELECT n.n_nationkey, r.r_regionkey FROM nation n, region r WHERE n.n_nationkey + r.r_regionkey = 10""",
    "product_false_const": """SELECT n.n_name, r.r_name FROM nation n, region r WHERE 1 = 0""",
    "self_join": """SELECT a.s_suppkey AS s1, b.s_suppkey AS s2 FROM supplier a, supplier b WHERE a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""",
    "agg_global": """SELECT COUNT(*) AS cnt, CAST(SUM(l_linenumber) AS BIGINT) AS s, ROUND(AVG(l_quantity), 4) AS a, MIN(l_extendedprice) AS mn, MAX(l_extendedprice) AS mx FROM lineitem""",
    "agg_global_empty": """SELECT COUNT(*) AS cnt, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_quantity < 0""",
    "agg_group": """SELECT o_orderpriority, COUNT(*) AS cnt, ROUND(SUM(o_totalprice), 2) AS total FROM orders GROUP BY o_orderpriority""",
    "agg_group_multi_int": """SELECT q.a, q.b, COUNT(*) AS cnt FROM (SELECT p_size AS a, p_partkey % 70 AS b FROM part) q GROUP BY q.a, q.b""",
    "agg_minmax_string_date": """SELECT q.l_returnflag, CAST(MIN(q.lo) AS DATE) AS first_ship, CAST(MAX(q.hi) AS DATE) AS last_ship, MIN(q.l_linestatus) AS mn, MAX(q.l_linestatus) AS mx FROM (SELECT l_returnflag, l_linestatus, MIN(l_shipdate) AS lo, MAX(l_shipdate) AS hi FROM lineitem GROUP BY l_returnflag, l_linestatus) q GROUP BY q.l_returnflag""",
    "agg_avg_int": """SELECT p_brand, ROUND(AVG(p_size), 6) AS avg_size FROM part GROUP BY p_brand""",
    "agg_avg_trunc": """SELECT p_brand, CAST(FLOOR(SUM(p_size) / COUNT(p_size)) AS BIGINT) AS avg_size FROM part GROUP BY p_brand""",
    "agg_count_distinct": """SELECT l_returnflag, COUNT(DISTINCT l_suppkey) AS suppliers, COUNT(l_suppkey) AS cnt FROM lineitem GROUP BY l_returnflag""",
    "agg_expr_over_aggs": """SELECT l_returnflag, ROUND(SUM(l_extendedprice) / SUM(l_quantity), 4) AS unit_price FROM lineitem GROUP BY l_returnflag""",
    "agg_having": """SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey HAVING COUNT(*) > 15 AND SUM(o_totalprice) > 1000""",
    "agg_having_groupkey": """SELECT n_regionkey, COUNT(*) AS cnt FROM nation GROUP BY n_regionkey HAVING n_regionkey > 2""",
    "agg_having_only": """SELECT c_nationkey FROM customer GROUP BY c_nationkey HAVING MAX(c_acctbal) > 9900""",
    "agg_having_no_group": """SELECT COUNT(*) AS cnt FROM orders HAVING COUNT(*) > 1""",
    "group_no_agg": """SELECT c_mktsegment FROM customer GROUP BY c_mktsegment""",
    "distinct": """SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem""",
    "order_by_multi": """SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment ASC, c_acctbal DESC, c_custkey""",
    "order_by_expr": """SELECT p_partkey, p_size, p_retailprice FROM part ORDER BY p_size * p_retailprice DESC, p_partkey LIMIT 20""",
    "top_k": """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
    "limit_zero": """SELECT r_name FROM region LIMIT 0""",
    "union_all": """SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region UNION ALL SELECT r_name FROM region""",
    "union_distinct": """SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region""",
    "union_all_order_limit": """SELECT n_nationkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region ORDER BY k DESC LIMIT 7""",
    "subquery_from": """SELECT q.nm, q.k FROM (SELECT n_name AS nm, n_regionkey + 1 AS k FROM nation) q WHERE q.k > 2""",
    "subquery_agg": """SELECT q.pri, q.cnt FROM (SELECT o_orderpriority AS pri, COUNT(*) AS cnt FROM orders GROUP BY o_orderpriority) q WHERE q.cnt > 3000""",
    "subquery_join_left": """SELECT q.rk, r.r_name, q.cnt FROM (SELECT n_regionkey AS rk, COUNT(*) AS cnt FROM nation GROUP BY n_regionkey) q, region r WHERE q.rk = r.r_regionkey""",
    "subquery_join_right": """SELECT a.n_name, q.cnt FROM nation a, (SELECT c_nationkey AS nk, COUNT(*) AS cnt FROM customer GROUP BY c_nationkey) q WHERE a.n_nationkey = q.nk""",
    "subquery_limit_filter": """SELECT q.o_orderkey FROM (SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50) q WHERE q.o_totalprice < 498600""",
    "subquery_distinct_ordered": """SELECT q.seg FROM (SELECT DISTINCT c_mktsegment AS seg FROM customer ORDER BY seg) q WHERE q.seg > 'B'""",
    "subquery_union": """SELECT q.k, COUNT(*) AS cnt FROM (SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey AS k FROM region) q GROUP BY q.k""",
    "agg_any_case": """SELECT o_orderstatus, count(*) AS cnt, Sum(o_totalprice) > 0 AS positive, mAx(o_orderkey) AS mx FROM orders GROUP BY o_orderstatus""",
    "join_left": """SELECT p.p_brand, COUNT(*) AS cnt, COUNT(l.l_partkey) AS hits FROM part p LEFT JOIN lineitem l ON p.p_partkey = l.l_partkey AND l.l_quantity > 49 GROUP BY p.p_brand""",
    "join_right": """SELECT n.n_name, COUNT(c.c_custkey) AS cnt FROM customer c RIGHT JOIN nation n ON c.c_nationkey = n.n_nationkey AND c.c_acctbal > 9000 GROUP BY n.n_name""",
    "join_full": """SELECT a.k AS ak, b.k AS bk FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 8) a FULL JOIN (SELECT r_regionkey + 5 AS k FROM region) b ON a.k = b.k""",
    "semi_exists": """SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 450000)""",
    "anti_not_exists": """SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)""",
    "semi_in": """SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n.n_nationkey FROM nation n, region r WHERE n.n_regionkey = r.r_regionkey AND r.r_name = 'EUROPE')""",
    "intersect": """SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""",
    "except": """SELECT n_nationkey AS k FROM nation EXCEPT SELECT r_regionkey FROM region""",
    "offset": """SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 5""",
    "cte": """WITH big AS (SELECT o_custkey, COUNT(*) AS cnt FROM orders GROUP BY o_custkey) SELECT c.c_mktsegment, MAX(b.cnt) AS mx FROM big b, customer c WHERE b.o_custkey = c.c_custkey GROUP BY c.c_mktsegment""",
    "window_rank": """SELECT q.o_orderkey, q.rnk FROM (SELECT o_orderkey, ROW_NUMBER() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rnk FROM orders) q WHERE q.rnk <= 3""",
    "tpch_q1": """SELECT l_returnflag, l_linestatus, ROUND(SUM(l_quantity), 2) AS sum_qty, ROUND(SUM(l_extendedprice), 2) AS sum_base, ROUND(SUM(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, ROUND(AVG(l_discount), 6) AS avg_disc, COUNT(*) AS cnt FROM lineitem WHERE l_shipdate <= DATE '2000-09-01' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "tpch_q3": """SELECT l.l_orderkey, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM customer c, orders o, lineitem l WHERE c.c_mktsegment = 'BUILDING' AND c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND o.o_orderdate < DATE '1998-03-15' AND l.l_shipdate > DATE '1998-03-15' GROUP BY l.l_orderkey ORDER BY revenue DESC, l.l_orderkey LIMIT 10""",
    "tpch_q5": """SELECT n.n_name, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue FROM region r, nation n, supplier s, lineitem l, orders o, customer c WHERE c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND l.l_suppkey = s.s_suppkey AND c.c_nationkey = s.s_nationkey AND s.s_nationkey = n.n_nationkey AND n.n_regionkey = r.r_regionkey AND r.r_name = 'ASIA' AND o.o_orderdate >= DATE '1996-01-01' AND o.o_orderdate < DATE '1997-01-01' GROUP BY n.n_name ORDER BY revenue DESC""",
    "tpch_q6": """SELECT ROUND(SUM(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1995-01-01' AND l_shipdate < DATE '1996-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""",
    "tpch_q10": """SELECT c.c_custkey, c.c_name, ROUND(SUM(l.l_extendedprice * (1 - l.l_discount)), 2) AS revenue, n.n_name FROM customer c, orders o, lineitem l, nation n WHERE c.c_custkey = o.o_custkey AND l.l_orderkey = o.o_orderkey AND o.o_orderdate >= DATE '1996-10-01' AND o.o_orderdate < DATE '1997-01-01' AND l.l_returnflag = 'R' AND c.c_nationkey = n.n_nationkey GROUP BY c.c_custkey, c.c_name, n.n_name ORDER BY revenue DESC, c.c_custkey LIMIT 20""",
}
