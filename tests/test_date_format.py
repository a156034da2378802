"""The detected date format of the queries against their SQL: separators of cells that vote, ties by the first row, halves rounded up."""

import datetime as dt

import duckdb
import pytest
from pyspark.sql import functions as F

from veracity.operators import clean, profile
from veracity.plans import queries as Q
from veracity.plans import cleaning, scoring  # noqa: F401 - they register their queries
from veracity.sources.tables import ROW

ROLES = "role string, invalid_count long, missing_count long, min_value string, max_value string, detected_format string, confidence double, examples string"


def orders(spark, path, keys, day):
    """Orders of one day: by key % 8 the dirty dates are 0 y-m-d, 1 d/m/y, 2 m/d/y, 3 ymd, 4 none, 5 null, 6 a timestamp, 7 31-02-2024."""
    rows = [(k, 1, "O", 100.0 + k, dt.datetime(1998, 2, day), "5-LOW") for k in keys]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").coalesce(1).write.parquet(f"{path}/orders.parquet")
    spark.range(1, 2).select(F.col("id").alias("c_custkey"), F.lit("Ann").alias("c_name")).write.parquet(f"{path}/customer.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # with more, mode() takes either of two equally frequent separators
    for t in ("orders", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    return str(path), con


@pytest.mark.parametrize("day, keys, want", [
    (20, [0, 1, 6, 9, 14, 17, 22, 30], ("Dominant Format: dd/mm/yyyy", 75.0)),  # timestamps cast no vote
    (20, [1, 7], ("dd/mm/yyyy", 99.0)), (20, [7, 9], ("dd-mm-yyyy", 99.0)),  # equally frequent: as the first row
    (20, [*range(1, 73, 8), *range(2, 50, 8), 0], ("Dominant Format: dd/mm/yyyy", 56.3)),  # 9 of 16 are 56.25 percent
    (5, [2, 6, 10], ("Mixed Formats", 50.0)), (20, [4, 5, 6], (None, None)), (20, [3, 4, 5], (None, None)),  # no clear vote; none at all
])
def test_format_is_that_of_the_sql(spark, tmp_path, day, keys, want):
    path, con = orders(spark, tmp_path, keys, day)
    assert con.execute(f"{Q._CTE}, {Q.ORDER} SELECT form, sure FROM o").fetchone() == want
    df = Q.nullified(spark, path)
    assert profile.date_order(df, "transaction_date", Q.order)[1:] == want
    facts = clean.analyse(df, "SOFT", Q.order)
    assert (facts.date_format, facts.date_confidence) == want


def test_role_profiles_equal_their_sql(spark, tmp_path):
    path, con = orders(spark, tmp_path, [0, 1, 6, 9, 14, 17, 22, 30], 20)
    got = Q.QUERIES["role_profiles"](spark, path)
    assert got.schema.simpleString() == spark.createDataFrame([], ROLES).schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(Q.ORACLE_SQL["role_profiles"]).fetchall())


def test_operator_counts_separators_of_all_cells(spark):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(["20/02/1998", "1998-02-20T10:00:00", "1998-02-20T11:00:00"])], f"{ROW} long, day string")
    assert profile.date_order(df, "day") == (True, "dd-mm-yyyy", 99.0)
    assert profile.date_order(df, "day", Q.order) == (True, "dd/mm/yyyy", 99.0)


@pytest.mark.parametrize("keys", [[1, 7], [3, 4, 5]])
def test_cleaning_stats_have_the_format_of_their_sql(spark, tmp_path, keys):
    path, con = orders(spark, tmp_path, keys, 20)
    names = "detected_date_format, date_confidence_score"
    got = Q.QUERIES["cleaning_stats_soft"](spark, path).select(*names.split(", "))
    assert got.dtypes == [(n, "string") for n in names.split(", ")]
    assert [tuple(got.first())] == con.execute(f"SELECT {names} FROM ({Q.ORACLE_SQL['cleaning_stats_soft']})").fetchall()
