"""What is asked of every cell costs no trimming and no exception, and a validated table is worked out once."""

import pytest
from pyspark.sql import functions as F

from veracity.functions import cells as C
from veracity.operators import validate
from veracity.operators.profile import nullify_all
from veracity.sources.tables import ROW

WORDS = ["", "null", "NaN", "none", "Undefined", "nul", "nulll", "nan\n", "İ", "K", "N/A", "x", "UNDEFİNED", "null\x00", "nu ll"]
NUMBERS = ["1", "-1.", ".5", ".", "1e5", "1e", "1d", "0x1p3", "0x.8p1", "0x", "Infinity", "+inf", "-nan", "infinit", " 1 ", "\t1\n", "\x0b1", " 1", "1_0", "1,000", "abc", "$1", "--1", "1 2", "TXN-1", "1e400", "in"]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_missing_and_empty_cells_are_those_of_the_trimmed_text(spark):
    cells = [(p + w + q,) for w in WORDS for p in ("", " ", "　", "\x0b", "a", "\x1f") for q in ("", "\n", "\u0085", " ", "b")]
    df, c = spark.createDataFrame([*cells, (None,)], "c string"), F.col("c")
    low = F.lower(C.strip(c))
    missing = F.coalesce(low.isin("", *C.NULL_WORDS), F.lit(True))
    nullified = F.when(c.isin(*C.NA_SENTINELS) | low.isin("", *C.NULL_WORDS), F.lit(None)).otherwise(c)
    differ = (C.is_missing(c) != missing) | (C.is_missing_trimmed(C.strip(c)) != missing) | (C.is_empty(c) != F.coalesce(low.isin(*C.EMPTY_WORDS), F.lit(True))) | ~C.nullify(c).eqNullSafe(nullified)
    assert df.where(differ).collect() == []
    assert "trim" not in _plan(df.repartition(2).select(C.nullify(c).alias("n"), C.is_empty_row(c).alias("e")))


def test_only_what_may_be_a_number_is_cast(spark):
    df, c = spark.createDataFrame([(x,) for x in [*NUMBERS, None]], "c string"), F.col("c")
    assert df.where(~C.to_double(c).eqNullSafe(c.try_cast("double"))).collect() == []
    tried = {r.c for r in df.where(c.rlike(C._NUMERIC)).collect()}
    assert not tried & {"TXN-1", "abc", "$1", "", "1,000"} and {"1", " 1 ", "0x1p3", "+inf"} <= tried


def test_cells_are_parsed_once_for_keys_and_issues(spark):
    """Dates and phones were parsed for the keys, and once more for the rows that met them."""
    headers = ["transaction_id", "customer_name", "country", "phone_number", "transaction_date", "transaction_time", "amount", "email"]
    rows = [(0, "T1", "An", "IN", "+91 98765 43210", "2024-01-05", "14:5:9", "5", "a@b.com"), (1, "T1", "an", "India", "9876543210", "05 Jan 2024", "14:05:09", "5", "A@b.com"), (2, "T2", "Bo", "uk", "12345", "x", None, "-3", None)]
    df = nullify_all(spark.createDataFrame(rows, f"{ROW} long, " + ", ".join(f"{h} string" for h in headers)))
    checked = validate.with_issues(df, "2024-06-30")
    assert "regexp_extract_all" not in _plan(checked)
    found = {r[ROW]: [i.message for i in r.issues] for r in checked.collect()}
    assert found[0] == ["Duplicate transaction ID: T1"] and found[1] == ["Duplicate transaction ID: T1", "Duplicate Record Detected"]
    assert {"Invalid phone format: 12345", "Invalid date format: x", "Negative amount: -3", "Missing Time"} <= set(found[2])


@pytest.mark.parametrize("rule, n", [("duplicates", 1), ("phone", 2), ("date", 0)])
def test_affected_rows_count_each_row_once(spark, rule, n):
    issue = lambda r: (r, "phone_number" if r == "phone" else "duplicate_record", "c", "m", "ERROR" if r == "phone" else "WARNING")
    df = spark.createDataFrame([(0, [issue("phone"), issue("phone"), issue("duplicates")]), (1, [issue("phone")]), (2, [])], f"{ROW} long, issues array<{validate.ISSUE}>")
    assert df.agg(validate.hit(rule)).first()[0] == n
    assert df.agg(validate.copies()).first()[0] == 1
    assert [r.row_status for r in validate.row_classes(df).orderBy(ROW).collect()] == ["ERROR", "ERROR", "VALID"]
