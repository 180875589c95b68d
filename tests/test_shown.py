"""Shown values against SQL, on sizes that the small tables do not have."""

import duckdb
from pyspark.sql import functions as F

from quern.functions import text as T


def test_sizes_between_two_decimals(spark):
    """Halves go to the even digit, as in DuckDB's printf."""
    sizes = [1023, 1024, 1536, 1048575, 1048576, 262144 * 997, 3 * 262144 * 997, 262144 * 5, 262144 * 7, 262144 * 5 + 1, 1048576 * 10 - 1, 1200000 * 997]
    got = {r["n"]: r["s"] for r in spark.createDataFrame([(n,) for n in sizes], "n long").select("n", T.file_size(F.col("n")).alias("s")).collect()}
    assert all(got[n] == duckdb.sql(f"select printf('%.1f', {n} / 1048576)").fetchall()[0][0] + " MB" for n in sizes if n >= 1048576)
    assert got[262144 * 5] == "1.2 MB" and got[262144 * 7] == "1.8 MB" and got[1536] == "2 KB"
