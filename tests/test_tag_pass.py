"""The pass of tags against SQL, over a table whose first batch is whole."""

import duckdb

from quern.plans import catalog


def test_tags_for_records_of_other_batches_do_not_count(spark, tmp_path):
    """A first batch whose list is whole, with a record 0 in it."""
    rows = ", ".join(f"({k}, '{'abc' if k % 3 else 'abcd'} ring{'s' * (k % 4)}')" for k in range(60))
    con = duckdb.connect()
    con.execute(f"create table part as select * from (values {rows}) t(p_partkey, p_name)")
    con.execute("alter table part alter p_partkey type bigint")
    con.execute(f"copy part to '{tmp_path}/part.parquet' (format parquet)")
    got = {(r["kind"], r["name"], r["id"]) for r in catalog.queries()["tag_pass"](spark, str(tmp_path)).collect()}
    assert got == set(con.execute(catalog.oracle_sql()["tag_pass"]).fetchall())
    assert ("link", "abcd", 0) in got
