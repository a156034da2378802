"""Cleaning modes, audit trail and scores: small tables with known results, and whole runs against SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from veracity.operators import clean, score, validate
from veracity.operators.profile import nullify_all
from veracity.sources.tables import ROW

PAID = ["transaction_id", "customer_name", "email", "phone_number", "country", "transaction_date", "payment_mode", "amount", "currency"]
CALLS = ["Test_ID", "Country", "Phone_Number", "Transaction_Date", "Transaction_Time"]


def table(spark, headers, rows):
    return nullify_all(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW} long, " + ", ".join(f"{h} string" for h in headers)))


@pytest.mark.parametrize("name", ["clean_smart", "audit_trail", "quality_scores"])
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        con.execute(f"create view {t.split('.')[0]} as select * from '{sf_dir}/{t}'")
    df, rel = entry.queries()[name](spark, sf_dir), con.sql(entry.oracle_sql()[name])
    cols = sorted(df.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(str(tuple(r[c] for c in cols)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_repeated_ids_are_removed_and_not_cleaned(spark):
    row = ("T1", "PAYPAL ACCT", "a@b.com", "+91 98765 43210", "IN", "2024-01-05", "card", "5", "$")
    out = clean.clean_table(table(spark, PAID, [row, row]), "SMART")
    assert out.cleaned.count() == 0 and out.duplicates.count() == 2
    assert [(r.row_no, r.action, r.cleaned) for r in out.audit.orderBy("row_no").collect()] == [(1, "duplicate_removal", "DELETED"), (2, "duplicate_removal", "DELETED")]


def test_business_copies_keep_the_first(spark):
    rows = [("1", "India", "+91 98765 43210", "2024-01-05", "14:05:09"), ("2", "IN", "9876543210", "05 January 2024", "14:5:9"), ("3", "SG", "81234567", "2024-02-01", "02:30 PM"), ("4", "Singapore", "6581234567", "2024/02/01", "14:30:00")]
    out = clean.clean_table(table(spark, CALLS, rows), "SMART")
    assert [(r.Test_ID, r.Phone_Number, r.Transaction_Time) for r in out.cleaned.orderBy(ROW).collect()] == [("1", "9876543210", "14:05:09"), ("3", "81234567", "14:30:00")]


@pytest.mark.parametrize("dates, want, form", [
    (["16/06/2026", "05/12/2026"], ["2026-06-16", "2026-12-05"], ("dd/mm/yyyy", 99.0)),
    (["06/16/2026", "05/12/2026"], ["2026-06-16", "2026-05-12"], ("mm/dd/yyyy", 99.0)),
    (["16.06.2026", "06.16.2026", "05.12.2026"], ["2026-06-16", "2026-06-16", "2026-05-12"], ("Mixed Formats", 50.0)),
    (["16/06/2026", "17/06/2026", "06/16/2026", "05/12/2026"], ["2026-06-16", "2026-06-17", "2026-06-16", "2026-12-05"], ("Dominant Format: dd/mm/yyyy", 66.7)),
    ([None, None], ["ERROR", "ERROR"], ("unknown", 0.0)),
])
def test_date_order_is_inferred(spark, dates, want, form):
    rows = [(str(i), "India", f"98765432{i:02}", d, "14:05:09") for i, d in enumerate(dates)] + [("us", "USA", "3125550100", "05/12/2026", "14:05:09")]
    out = clean.clean_table(table(spark, CALLS, rows), "SOFT")
    assert [r.Transaction_Date for r in out.rows.orderBy(ROW).collect()] == [*want, "2026-05-12"]
    if any(dates):
        assert (out.date_format, out.date_confidence) == form
        entries = out.audit.where("action = 'date_standardization'").collect()
        assert {(r.row_no, r.cleaned) for r in entries} == {(i + 1, d) for i, d in enumerate([*want, "2026-05-12"])}


def test_given_date_order_is_kept(spark):
    rows = [("1", "India", "9876543210", "16/06/2026", "14:05:09"), ("2", "India", "9876543211", "05/12/2026", "14:05:09")]
    assert [r.Transaction_Date for r in clean.clean(table(spark, CALLS, rows), "SOFT", dayfirst=False).orderBy(ROW).collect()] == ["2026-06-16", "2026-05-12"]


def test_modes(spark):
    rows = [("T1", "usd currency", "A b@X.com", "+91 98765 43210", "India", "2024-01-05", "card", "5", "$"), ("T2", None, "a@x.com", "9876543210", "IN", "1999-01-05", None, "7", "rs"), ("T3", "n", "bad", "12", "IN", "nope", "cash", "-1", "XYZ")]
    got = {m: {r.transaction_id: r for r in clean.clean(table(spark, PAID, rows), m).collect()} for m in ("STRICT", "SMART", "SOFT")}
    assert {i: r.route for i, r in got["STRICT"].items()} == {"T1": "errors", "T2": "warnings", "T3": "errors"}
    assert {i: r.route for i, r in got["SMART"].items()} == {"T1": "cleaned", "T2": "cleaned", "T3": "errors"}
    assert {r.route for r in got["SOFT"].values()} == {"cleaned"} and got["SOFT"]["T3"].row_status == "ERROR"
    one = got["SMART"]["T1"]
    assert (one.customer_name, one.email, one.phone_number, one.country, one.payment_mode, one.currency) == ("USD Currency", "ab@x.com", "9876543210", "India", "Credit Card", "USD")
    assert got["SMART"]["T2"].customer_name is not None and got["SMART"]["T2"].payment_mode is not None
    assert {a.action for a in got["SMART"]["T2"].audit} >= {"missing_imputation", "currency_mapping"}


def test_no_rows_and_no_roles(spark):
    assert clean.clean(table(spark, PAID, [("T", *[None] * 8)]), "SMART").where("false").count() == 0
    empty = table(spark, PAID, [("T", *[None] * 8)]).where("false")
    assert clean.clean(empty, "STRICT").count() == 0
    assert clean.cleaning_stats(clean.clean(empty, "STRICT")).first().total_processed == 0
    other = table(spark, ["sepal", "petal"], [("1", "2"), (None, None)])
    assert [(r.sepal, r.row_status) for r in clean.clean(other, "STRICT").orderBy(ROW).collect()] == [("1", "VALID")]  # a row without any value is left out


def test_scores_of_clean_rows(spark):
    rows = [("T1", "An", "a@b.com", "9876543210", "India", "2024-01-05", "card", "5", "USD"), ("T2", "Bo", "c@b.com", "9876543211", "India", "2024-01-06", "card", "6", "USD")]
    whole = [(f"C{i}", *r) for i, r in enumerate(rows)]
    got = score.quality_scores(validate.with_issues(table(spark, ["customer_id", *PAID], whole), "2025-01-01")).first()
    assert (got.overall_score, got.quality_rating, got.main_issue) == (100.0, "Excellent", "No major issues")
    # a missing field is a warning of the schema, so the table is not without issues
    got = score.quality_scores(validate.with_issues(table(spark, PAID, rows), "2025-01-01")).first()
    assert (got.overall_score, got.main_issue) == (100.0, "Data format inconsistencies")
    checked = validate.with_issues(table(spark, PAID, [(*r[:2], "bad", *r[3:]) for r in rows]), "2025-01-01")
    assert [(r.rule, r.value, r.first_row) for r in score.invalid_examples(checked).collect()] == [("email", "bad", 0)]
    trail = spark.createDataFrame([(1, "x", "UPI", "INFO"), (2, "upi", "y", "ERROR")], "row_no int, original string, cleaned string, severity string")
    assert clean.audit_search(trail, "upi").count() == 2 and clean.audit_search(trail, "upi", severity="INFO").select(F.max("row_no")).first()[0] == 1
