"""Rows that a query's order leaves equal, or that lack a place in it, against DuckDB."""

import duckdb

from attesta.plans import catalogue


def test_first_assignment_of_equal_and_missing_places(spark, tmp_path):
    odd = "(7, 1, 5, 1), (7, 1, 6, 1), (7, 1, 4, 1), (8, NULL, 5, 1), (8, 3, 6, 1), (8, 2, NULL, 1), (9, NULL, 4, 3), (10, 2, NULL, 1), (11, 1, 7, 250), (11, 2, 8, 1), (NULL, 1, 9, 1)"
    many = "SELECT range % 50, range % 3, range, 1 FROM range(100, 20000)"
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"COPY (SELECT p::BIGINT AS l_partkey, o::BIGINT AS l_orderkey, s::BIGINT AS l_suppkey, l::INTEGER AS l_linenumber FROM (SELECT * FROM (VALUES {odd}) UNION ALL {many}) t(p, o, s, l)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet, ROW_GROUP_SIZE 2048)")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet'")
    want = con.execute(catalogue.oracle_sql()["q33_first_assignment"]).fetchall()
    got = catalogue.queries()["q33_first_assignment"](spark, str(tmp_path)).select("member", "shelf").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
