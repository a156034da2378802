"""Scalar tables and whole runs of the data-quality operators."""

import io
import os
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from veracity.functions import cells as C
from veracity.functions import phone as P
from veracity.functions import temporal as D
from veracity.operators import profile, schema
from veracity.operators.chunk import chunk_archives
from veracity.plans import queries as Q
from veracity.sources.tables import ROW, with_row_ids


def one(spark, value, f, *more):
    df = spark.createDataFrame([(value, *more)], "v string" + "".join(f", m{i} string" for i in range(len(more))))
    return df.select(f(*[F.col(c) for c in df.columns])).first()[0]


@pytest.mark.parametrize("name", ["preprocess_nullify", "date_standardize", "phone_standardize", "parse_time", "clean_name", "business_duplicates_later", "impute_mode", "rule_summary", "issue_summary", "failed_rows_sample", "chunk_sizes"])
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    df, rel = Q.QUERIES[name](spark, sf_dir), con.sql(Q.ORACLE_SQL[name])
    cols = sorted(df.columns)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


@pytest.mark.parametrize("text, dayfirst, want", [("12-05-2026", False, "2026-12-05"), ("12-05-2026", True, "2026-05-12"), ("16/06/2026", False, "2026-06-16"), ("01/02/03", False, "2003-01-02"), ("20260618", False, "2026-06-18"), ("2026-04-10", True, "2026-10-04"), ("2026-04-13", True, "2026-04-13"), ("June 18 2026", False, "2026-06-18"), ("Thu, 18 Jun 2026", False, "2026-06-18"), ("99999999", False, None), ("32-12-2025", False, None), ("18-13-2026", False, None), ("2026-06-18T14:30:45Z", False, "2026-06-18"), ("abc", False, None), (None, False, None)])
def test_dates(spark, text, dayfirst, want):
    got = one(spark, text, lambda c: D.parse_date(c, dayfirst))
    assert (str(got) if got else None) == want


@pytest.mark.parametrize("text, want", [("2:5:9", "02:05:09"), ("02:30 PM", "14:30:00"), ("12:00 AM", "00:00:00"), ("07:08:09.999", "07:08:09"), ("24:00:00", "ERROR"), ("14-30-45", "ERROR"), ("11:30:60", "ERROR"), ("2026-06-18T14:30:45Z", "14:30:45"), ("14:30 PM", "ERROR"), (None, "ERROR")])
def test_times(spark, text, want):
    assert one(spark, text, D.standardize_time) == want


@pytest.mark.parametrize("number, country, want", [("+91 98765 43210", "India", "9876543210"), ("(98765)43210", "IN", "9876543210"), ("09876543210", "India", "9876543210"), ("447911123456", "UK", "07911123456"), ("971501234567", "UAE", "0501234567"), ("13125550192", "USA", "3125550192"), ("6581234567", "SG", "81234567"), ("7911123456", "UK", "7911123456"), ("491570156", "AU", "491570156"), ("71234567", "SG", "71234567")])
def test_phones(spark, number, country, want):
    assert one(spark, number, P.clean_phone, country) == want


def test_cells(spark):
    assert one(spark, "PAYPAL ACCT", C.clean_name) == "PAYPAL Acct" and one(spark, "USD CURRENCY", C.clean_name) == "USD Currency"
    assert one(spark, "$1,000.50", C.to_number) == 1000.5 and one(spark, "-$50", C.to_number) is None and one(spark, "$-50", C.to_number) == -50
    assert one(spark, " A b@X.com ", C.clean_email) == "ab@x.com" and one(spark, "u@mailinator.com", C.email_ok) is False


def test_headers():
    assert schema.classify(["id", "country", "phone_number"]) == "Customer Dataset"
    assert schema.resolve_roles(["Order_ID", "Mobile", "Nation"]) == {"transaction_id": "Order_ID", "country": "Nation", "phone_number": "Mobile"}


def test_row_ids(spark):
    got = [r[0] for r in with_row_ids(spark.range(0, 1000, 1, 7)).select(ROW).orderBy("id").collect()]
    assert got == list(range(1000))


def test_chunk_archives(spark):
    rows = spark.createDataFrame([(i, f"v{i}" if i else None) for i in range(7)], f"{ROW} long, v string")
    got = {r.chunk_id: r for r in chunk_archives(rows, 3).collect()}
    assert {i: (r.name, r.n) for i, r in got.items()} == {1: ("chunk_001.csv", 3), 2: ("chunk_002.csv", 3), 3: ("chunk_003.csv", 1)}
    with zipfile.ZipFile(io.BytesIO(got[2].archive)) as z:
        assert z.namelist() == ["chunk_002.csv"] and z.read("chunk_002.csv").decode().split() == ["v", "v3", "v4", "v5"]
    assert chunk_archives(rows.limit(0), 3).count() == 0
    with pytest.raises(ValueError):
        chunk_archives(rows, 0)


def test_column_types_match_sql(spark, sf_dir):
    test_matches_sql(spark, sf_dir, "column_types")


def test_column_types_read_all_rows(spark):
    rows = [(i, None if i < 150 else "word", "5" if i < 100 else "text", "2024-01-05") for i in range(1000)]
    df = spark.createDataFrame(rows, f"{ROW} long, late string, turned string, day string")
    assert {tuple(r) for r in profile.column_types(df, ["late", "turned", "day"]).collect()} == {("late", "Text/String"), ("turned", "Text/String"), ("day", "Date")}
    apart = df.withColumn(ROW, F.col(ROW) * 7 + 1000)
    assert {tuple(r) for r in profile.column_types(apart, ["late", "turned", "day"], first_rows=100).collect()} == {("late", "Email"), ("turned", "Numeric"), ("day", "Date")}


def test_date_votes():
    assert D.decide_date_format({"dd": 2})[0] is True and D.decide_date_format({"mm": 1, "dd": 1})[:2] == (None, "Mixed Formats")


def test_stream_counts(spark, tmp_path):
    from veracity.streaming.stream import issue_counts

    spark.createDataFrame([("a@b.com", "5"), ("bad", "x")], "email string, amount string").withColumn("ts", F.lit("2024-01-01 00:10:00").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("email string, amount string, ts timestamp").parquet(str(tmp_path / "in"))
    q = issue_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.column_name, r.n) for r in spark.table("counts").collect()} == {("email", 1), ("amount", 1)}
