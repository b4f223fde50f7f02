"""Column expressions over odd values, against their SQL."""

import duckdb
from pyspark.sql import functions as F

from foliate.functions import text
from foliate.jobs import registry


def test_pages_of_odd_sizes_and_none_as_in_sql(spark, tmp_path):
    sizes = [None, 0, 1023, 1024, 1076, 1126, 1280, 1281, 1792, 2304, 1024**2 - 256, 1024**2 - 1, 1024**2, 1024**2 * 5 // 4, 1024**2 * 9 // 4]
    urls = ["a//b/./c/", None, "", "/", "a/../b", "a/..b"]
    made = [(k, urls[k % len(urls)], n if n is None else "h" * n) for k, n in enumerate(sizes)]
    spark.createDataFrame(made, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    found = registry.queries()["text_expressions"](spark, str(tmp_path)).select("page_id", "size", "path").collect()
    assert sorted(map(tuple, found)) == sorted(con.execute(registry.oracle_sql()["text_expressions"]).fetchall())  # not oracle.rows, to which null and an empty text are one


def test_ties_of_sizes_go_to_even_tenths(spark):
    expected = {1280: "1.2 KB", 1792: "1.8 KB", 1279: "1.2 KB", 1281: "1.3 KB", 10 * 1024**2 + 2**18: "10.2 MB", 10 * 1024**2 + 2**18 + 1: "10.3 MB", 1024**3: "1024.0 MB", None: None}
    rows = spark.createDataFrame([(n,) for n in expected], "n long").select("n", text.human_size(F.col("n")))
    assert dict(map(tuple, rows.collect())) == expected
