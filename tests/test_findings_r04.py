"""What a review of the fourth round led to, on small tables."""

import duckdb

from spanlab.queries import ORACLES, QUERIES


def test_display_forms_of_names_with_line_ends(spark, tmp_path):
    """Only what a name ends in takes its plural away; a line end behind a hiss or a number isn't one."""
    names = [("red stapler", "Brand 60"), ("red bus", "box"), ("red bus\n", "Brand 60\n"), ("red box\r\n", "dash\u2028"), ("red clip\n", "60\n")]
    con = duckdb.connect()
    con.execute("create table part (p_partkey bigint, p_name varchar, p_brand varchar)")
    con.executemany("insert into part values (?, ?, ?)", [(k, *row) for k, row in enumerate(names)])
    con.execute(f"copy part to '{tmp_path}/part.parquet'")
    columns = ["p_partkey", "noun", "brands", "many"]
    got = sorted(map(tuple, QUERIES["q_display_forms"](spark, str(tmp_path)).select(*columns).collect()))
    assert got == sorted(con.sql(ORACLES["q_display_forms"]).select(*columns).fetchall())
    assert [r[2:] for r in got] == [(None, "red staplers"), (None, None), ("Brand 60\ns", "red bus\ns"), ("dash\u2028s", "red box\r\ns"), ("60\ns", "red clip\ns")]
