"""Pairs of parts against SQL, with copies and a missing name; overlaps are not computed for each pair."""

import duckdb

from quern.plans import catalog


def test_overlaps_of_copies(spark, tmp_path):
    con = duckdb.connect()
    con.execute("create table part as select i::bigint as p_partkey, case when i % 11 = 0 then null else ['red ring', 'Red bolt', 'red red', ''][i % 4 + 1] end as p_name, 'b' || i % 2 as p_brand, (i % 3)::int as p_size from range(60) t(i)")
    con.execute(f"copy part to '{tmp_path}/part.parquet' (format parquet)")
    df = catalog.queries()["topic_jaccard"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, con.execute(catalog.oracle_sql()["topic_jaccard"]).fetchall()))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    # The overlap stands below the join that makes the pairs.
    assert plan.index("array_intersect") > plan.index("Join")
