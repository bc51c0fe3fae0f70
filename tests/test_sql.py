"""Queries on rows that the tables seldom hold, against their SQL: ties, odd white space, sums whose order matters."""

import duckdb
import pytest

import __spark_entry__ as entry

CELL = "".join(f"<td>{x}</td>" for x in ["12,345.67 100%", "12+34!?56789", "１２３４５６７８", "x\x0by\x0b\x0bz abcdef", "\u00a0\u3000word one two\u2003", "\u00a012345678", "<b>1234</b>567 (8)"])
PAGES = f"SELECT 1 AS page_id, 'https://a.org/' AS url, '{CELL}' AS html UNION ALL SELECT 2, 'https://b.org/', NULL"
ITEMS = "SELECT 7 AS l_orderkey, k * 7 % 60 AS l_partkey, k * 11 % 100 AS l_suppkey, CAST(1 + k // 150 AS INT) AS l_linenumber, CAST(k % 50 AS DOUBLE) AS l_quantity, CAST(1000 + k * 37 % 91 AS DOUBLE) AS l_extendedprice, k % 11 / 100 AS l_discount, k % 9 / 100 AS l_tax, ['A', 'N', 'R'][1 + k % 3] AS l_returnflag, ['F', 'O'][1 + k % 2] AS l_linestatus, DATE '1995-01-01' + CAST(k % 5 AS INT) AS l_shipdate FROM range(300) t(k)"


def both(spark, tmp_path, name, table, sql):
    """The query's rows and those of its SQL, sorted."""
    con = duckdb.connect()
    con.execute(f"COPY ({sql}) TO '{tmp_path}/{table}.parquet'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    got = [tuple(r) for r in entry.queries()[name](spark, str(tmp_path)).collect()]
    return sorted(got, key=str), sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=str)


@pytest.mark.parametrize("name", ["j18_dedup_records", "s9c_fact_details"])
def test_records_of_one_place(spark, tmp_path, name):
    """Many rows of one order and line number: which is taken and how they are numbered is fixed by their columns."""
    got, want = both(spark, tmp_path, name, "lineitem", ITEMS)
    assert got == want
    (tmp_path / "turned").mkdir()
    assert both(spark, tmp_path / "turned", name, "lineitem", ITEMS + " ORDER BY k DESC")[0] == want


def test_order_of_fact_details(spark, tmp_path):
    """Ids repeat among companies: the sheet has the order of its SQL, however rows lie and are dealt."""
    name, partitions = "s9c_fact_details", spark.conf.get("spark.sql.shuffle.partitions")
    con = duckdb.connect()
    try:
        for k, (turn, n, adaptive) in enumerate([("", 4, "true"), (" ORDER BY k DESC", 4, "true"), (" ORDER BY k * 7 % 300", 37, "false")]):
            (tmp_path / str(k)).mkdir()
            con.execute(f"COPY ({ITEMS}{turn}) TO '{tmp_path}/{k}/lineitem.parquet'")
            con.execute(f"CREATE OR REPLACE VIEW lineitem AS SELECT * FROM '{tmp_path}/{k}/lineitem.parquet'")
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
            got = [tuple(r) for r in entry.queries()[name](spark, f"{tmp_path}/{k}").collect()]
            assert len({(r[0], r[15], r[1]) for r in got}) < len(got)
            assert got == con.execute(entry.oracle_sql()[name]).fetchall()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_blocks_of_digits_and_odd_white_space(spark, tmp_path):
    got, want = both(spark, tmp_path, "p6_html_to_text_blocks", "pages", PAGES)
    assert got == want == [(1, "12,345.67 100% x y z abcdef word one two"), (2, "")]


def test_mean_of_confidences_at_halves(spark, tmp_path):
    """Means that end in a half of the last place, in both orders of the rows; none; and none over 0."""
    rows = [(1, [0.04, 0.05]), (2, [0.05, 0.06]), (3, [0.1, 0.03, 0.005]), (4, [0.07, 0.02, 0.045]), (5, [0.14, 0.15, 0.0]), (6, [0.01, 0.1, 0.09, 0.06, 0.04, 0.03]), (7, [0.0]), (8, [None]), (9, [0.335, 0.335])]
    for turn in (1, -1):
        items = " UNION ALL ".join(f"SELECT {k} AS l_orderkey, CAST({'NULL' if x is None else x} AS DOUBLE) AS l_discount" for k, xs in rows for x in xs[::turn])
        got, want = both(spark, tmp_path, "q12_overall_confidence", "lineitem", items)
        assert got == want == [(1, 0.04), (2, 0.06), (3, 0.04), (4, 0.04), (5, 0.14), (6, 0.06), (7, 0.0), (8, 0.0), (9, 0.34)]
