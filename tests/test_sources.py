"""DDL, text tables, loading, scripts, sinks and the command line."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowmill import cli
from rowmill.functions.aggregates import avg_trunc
from rowmill.operators import relational as ra
from rowmill.plans.script import UnsupportedStatement, kind_of, run_script, split_statements
from rowmill.sources.catalog import Catalog
from rowmill.sources.ddl import DdlError, parse_create_table
from rowmill.sources.sinks import print_lines, timed_scan, write_delimited

DDL = "CREATE TABLE T (id int PRIMARY KEY, name varchar(20), price decimal, d date)"
DATA = '1|x y|2.50|1994-01-02|\n2|"q|3|1995-01-01|\n3||4.00|1996-01-01\n1|dup|9.99|1996-01-01|\n'


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "T.dat").write_text(DATA)
    return tmp_path


def test_types_keep_their_class():
    made = parse_create_table("create table Foo (a INT, b Decimal(10,2), c char(3), d VARCHAR (9), e string, f date, primary key (a, b));")
    assert [f.dataType for f in made.schema] == [T.LongType(), T.DoubleType(), T.StringType(), T.StringType(), T.StringType(), T.DateType()]
    assert made.name == "Foo" and made.primary_key == ("a", "b")


@pytest.mark.parametrize("sql", ["CREATE TABLE t (a blob)", "CREATE TABLE t", "CREATE TABLE t (a int, A int)", "CREATE TABLE t (a int, primary key (z))", "SELECT 1"])
def test_bad_definitions_raise(sql):
    with pytest.raises(DdlError):
        parse_create_table(sql)


def test_text_scan(spark, folder):
    catalog = Catalog(spark, str(folder))
    catalog.register(DDL)
    rows = spark.sql("SELECT id, name, price, CAST(d AS STRING) AS d FROM t ORDER BY id, name").collect()
    assert [tuple(r) for r in rows] == [(1, "dup", 9.99, "1996-01-01"), (1, "x y", 2.5, "1994-01-02"), (2, '"q', 3.0, "1995-01-01"), (3, "", 4.0, "1996-01-01")]


def test_mistyped_field_raises(spark, tmp_path):
    (tmp_path / "T.dat").write_text("x|a|1|1994-01-01|\n")
    catalog = Catalog(spark, str(tmp_path))
    catalog.register(DDL)
    with pytest.raises(Exception, match="(?i)malformed"):
        spark.table("t").collect()


def test_surplus_fields_raise_and_unread_columns_are_not_parsed(spark, tmp_path):
    (tmp_path / "T.dat").write_text("1|a|2.5|1994-01-01|junk|more\n")
    catalog = Catalog(spark, str(tmp_path))
    catalog.register(DDL)
    with pytest.raises(Exception, match="more than 4 fields"):
        spark.sql("SELECT name FROM t").collect()
    (tmp_path / "T.dat").write_text("1|a|x|1994-01-01\n\n2|b\n3|c|1.5||\n")
    catalog.register(DDL)
    assert [tuple(r) for r in spark.sql("SELECT id, name, d IS NULL FROM t ORDER BY id").collect()] == [(1, "a", False), (2, "b", True), (3, "c", True)]
    with pytest.raises(Exception, match="(?i)malformed field of column price"):
        spark.sql("SELECT price FROM t").collect()


def test_load_lays_rows_out_so_that_every_index_column_prunes(spark, tmp_path):
    import datetime
    import random

    import pyarrow.parquet as pq

    from rowmill.sources.loader import load_table

    rng = random.Random(1)
    day = lambda n: (datetime.date(1992, 1, 1) + datetime.timedelta(n)).isoformat()
    lines = [f"{i}|{day(rng.randrange(2_500))}|{rng.randrange(11) / 100}|{rng.randrange(1, 51)}|{rng.choice('ANR')}|{rng.choice(['AIR', 'FOB', 'MAIL', 'RAIL', 'SHIP', 'TRUCK'])}|" for i in range(60_000)]
    (tmp_path / "LINEITEM.dat").write_text("\n".join(lines) + "\n")
    catalog = Catalog(spark, str(tmp_path), str(tmp_path / "db"))
    ddl = "CREATE TABLE LINEITEM (orderkey int, shipdate date, discount decimal, quantity decimal, returnflag char(1), shipmode char(10))"
    load_table(spark, catalog.define(ddl), catalog.text_path("LINEITEM"), catalog.stored_path("LINEITEM"), **{"parquet.block.size": "8192", "parquet.page.size": "2048", "parquet.block.row.check.min": "100", "parquet.page.size.row.check.min": "100", "parquet.page.size.row.check.max": "100"})
    ranges = {"shipdate": (datetime.date(1994, 1, 1), datetime.date(1994, 2, 1)), "discount": (0.02, 0.02), "quantity": (5.0, 7.0), "returnflag": ("R", "R"), "shipmode": ("MAIL", "MAIL")}
    skipped, groups = dict.fromkeys(ranges, 0), 0
    for file in (tmp_path / "db" / "LINEITEM.parquet").glob("*.parquet"):
        meta = pq.ParquetFile(file).metadata
        for g in range(meta.num_row_groups):
            groups += 1
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                if column.path_in_schema in ranges:
                    low, high = ranges[column.path_in_schema]
                    skipped[column.path_in_schema] += column.statistics.max < low or column.statistics.min > high
    assert groups > 30 and all(n > groups / 4 for n in skipped.values()), (groups, skipped)
    catalog.register(ddl)
    query = spark.sql("SELECT COUNT(*) AS n FROM lineitem WHERE shipdate >= DATE '1994-01-01' AND shipdate < DATE '1994-02-01' AND shipmode = 'MAIL'")
    expected = sum("1994-01-01" <= x.split("|")[1] < "1994-02-01" and x.split("|")[5] == "MAIL" for x in lines)
    assert query.first().n == expected
    text = query._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(shipdate" in text


def test_load_keeps_the_last_row_of_a_key_and_can_be_repeated(spark, folder):
    for _ in range(2):
        catalog = Catalog(spark, str(folder), str(folder / "db"))
        catalog.load(DDL)
        catalog.register(DDL)
        assert [tuple(r) for r in spark.sql("SELECT id, name FROM t ORDER BY id").collect()] == [(1, "dup"), (2, '"q'), (3, "")]


def test_load_over_many_splits_keeps_the_last_row(spark, tmp_path):
    (tmp_path / "K.dat").write_text("".join(f"{i % 7}|{i}|\n" for i in range(5_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        catalog = Catalog(spark, str(tmp_path), str(tmp_path / "db"))
        catalog.load("CREATE TABLE K (k int PRIMARY KEY, v int)")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    catalog.register("CREATE TABLE K (k int PRIMARY KEY, v int)")
    assert {r.k: r.v for r in spark.table("k").collect()} == {k: max(i for i in range(5_000) if i % 7 == k) for k in range(7)}


def test_load_without_key_keeps_all_rows_and_sorts_by_index(spark, tmp_path):
    (tmp_path / "ORDERS.dat").write_text("1|1996-01-02|\n2|1995-01-02|\n2|1995-01-02|\n")
    catalog = Catalog(spark, str(tmp_path), str(tmp_path / "db"))
    catalog.load("CREATE TABLE ORDERS (orderkey int, orderdate date)")
    catalog.register("CREATE TABLE ORDERS (orderkey int, orderdate date)")
    assert spark.table("orders").count() == 3
    text = spark.sql("SELECT orderkey FROM orders WHERE orderdate >= DATE '1996-01-01'")._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(orderdate" in text


def test_statements_split_outside_quotes_and_comments():
    text = "SELECT ';' AS a; -- x; y\nSELECT 2 /* ; */ AS b;;\n"
    assert len(split_statements(text)) == 2
    assert [kind_of(s) for s in split_statements("create table t(a int); (select 1) ; with x as (select 1) select * from x; drop table t")] == ["create", "query", "query", "drop"]


def test_script_rejects_other_statements(spark, folder):
    with pytest.raises(UnsupportedStatement):
        list(run_script(spark, Catalog(spark, str(folder)), "DROP TABLE t"))
    with pytest.raises(UnsupportedStatement):
        list(run_script(spark, Catalog(spark, str(folder), str(folder / "db")), "SELECT 1", load=True))


def test_lines_spell_out_null_and_boolean(spark, tmp_path):
    df = spark.sql("SELECT 1L AS a, CAST(1e7 AS DOUBLE) AS b, true AS c, CAST(NULL AS STRING) AS d, DATE '1995-01-02' AS e, '' AS f")
    assert list(print_lines(df)) == ["1|1.0E7|true|NULL|1995-01-02|"]
    write_delimited(df, str(tmp_path / "out"))
    assert [r.value for r in spark.read.text(str(tmp_path / "out")).collect()] == ["1|1.0E7|true|NULL|1995-01-02|"]
    assert timed_scan(df) > 0


def test_command_line(spark, folder, capsys):
    (folder / "q.sql").write_text(f"{DDL};\nSELECT id, COUNT(*) AS n FROM T GROUP BY id ORDER BY id;")
    (folder / "bad.sql").write_text("UPDATE t SET a = 1;")
    assert cli.main(["--data", str(folder), str(folder / "q.sql")]) == 0
    assert capsys.readouterr().out == "1|2\n2|1\n3|1\n"
    assert cli.main(["--data", str(folder), str(folder / "bad.sql"), str(folder / "q.sql")]) == 1
    assert capsys.readouterr().out == "1|2\n2|1\n3|1\n"
    (folder / "ddl.sql").write_text(DDL + ";")
    assert cli.main(["--data", str(folder), "--db", str(folder / "db"), "--load", str(folder / "ddl.sql")]) == 0
    assert cli.main(["--data", str(folder), "--db", str(folder / "db"), str(folder / "q.sql")]) == 0
    assert capsys.readouterr().out == "1|1\n2|1\n3|1\n"


def test_helpers_agree_with_sql(spark):
    spark.sql("SELECT * FROM VALUES (1, 23), (12, 3), (1, 23), (2, 5) AS v(a, b)").createOrReplaceTempView("r")
    r = spark.table("r")
    checks = [
        (ra.aggregate(ra.select(r, "b > 3"), ["a"], "count(*) AS n", having="n > 1"), "SELECT a, COUNT(*) AS n FROM r WHERE b > 3 GROUP BY a HAVING n > 1"),
        (ra.aggregate(r, ["a"]), "SELECT a FROM r GROUP BY a"),
        (ra.limit(ra.order_by(r, "a + b DESC", "a"), 2), "SELECT * FROM r ORDER BY a + b DESC, a LIMIT 2"),
        (ra.union_all(r, ra.distinct(r)), "SELECT * FROM r UNION ALL SELECT DISTINCT * FROM r"),
        (ra.project(ra.join(ra.rename(r, "x"), ra.rename(r, "y"), "x.a = y.a AND x.b < y.b"), "x.*", "y.b AS yb"), "SELECT x.*, y.b AS yb FROM r x JOIN r y ON x.a = y.a AND x.b < y.b"),
        (ra.product(r, r.select(F.col("a").alias("z"))), "SELECT r.*, q.a AS z FROM r, r q"),
    ]
    for ours, sql in checks:
        theirs = spark.sql(sql)
        assert ours.columns == theirs.columns and sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))
    assert r.agg(avg_trunc("b").alias("m")).first().m == 13
    assert r.filter("a > 99").agg(avg_trunc("b").alias("m")).first().m is None
    assert spark.sql("SELECT -7 AS a UNION ALL SELECT 0").agg(avg_trunc("a").alias("m")).first().m == -3
