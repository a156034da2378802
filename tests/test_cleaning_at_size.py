"""Cleaning works its facts out once, and only those that are asked for."""

import pytest

from veracity.operators import clean, dedupe
from veracity.operators.profile import nullify_all
from veracity.sources.tables import ROW

HEADERS = ["transaction_id", "customer_name", "country", "phone_number", "transaction_date", "transaction_time", "amount", "currency", "payment_mode", "email"]
ROWS = [
    ("T1", " ann ", "IN", "+91 98765 43210", "2024-01-05", "14:5:9", "$5", "$", "card", "A b@x.COM"),
    ("T2", None, "USA", "(312) 555-0100", "31/12/2023", None, "abc", "XYZ", "bitcoin", "x@@y.com"),
    ("T2", "bob", None, "12345", None, "25:00", "-3", None, None, None),
    ("T3", "eve", "Atlantis", None, "2024-02-01T10:00:00Z", None, None, "rs", "Cash", "u@mailinator.com"),
    ("T4", "joe", "uk", "07911 123456", "1999-02-01", "02:30 PM", "7", "GBP", "upi", "j@mail.org"),
]


def table(spark):
    return nullify_all(spark.createDataFrame([(i, *r) for i, r in enumerate(ROWS)], f"{ROW} long, " + ", ".join(f"{h} string" for h in HEADERS)))


@pytest.mark.parametrize("mode", ["STRICT", "SMART", "SOFT"])
def test_rows_without_audit_are_the_same(spark, mode):
    df = table(spark)
    facts = clean.analyse(df, mode)
    whole, slim = (clean.clean(df, mode, facts=facts, as_of="2024-06-30", audit=a) for a in (True, False))
    assert whole.columns == [*slim.columns, "audit"]
    assert whole.drop("audit").orderBy(ROW).collect() == slim.orderBy(ROW).collect()
    assert all(r.corrections == sum(a.action != "duplicate_removal" and a.cleaned != "ERROR" for a in r.audit) for r in whole.collect() if r.row_status != "CRITICAL")


def test_distinct_values_are_counted_of_numbers_only(spark, monkeypatch):
    df = spark.createDataFrame([(0, "TXN-1", "a"), (1, "2", "b")], f"{ROW} long, place string, name string")
    numbers = spark.createDataFrame([(0, "1", "a"), (1, " 2 ", "b"), (2, None, "c")], f"{ROW} long, place string, name string")
    assert dedupe.record_columns(numbers) == ["name"]
    monkeypatch.setattr(dedupe, "row_identifier_probe", lambda *_: pytest.fail("distinct values counted"))
    assert dedupe.record_columns(df) == ["place", "name"]
