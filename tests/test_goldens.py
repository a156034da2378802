"""Whole tables with known results: dates, phones and a mixed table, as cleaned in SMART mode."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from veracity.functions import phone as P
from veracity.functions import temporal as D
from veracity.operators import clean, score, validate
from veracity.operators.dedupe import duplicate_profile, record_columns
from veracity.operators.profile import exact_median, nullify_all
from veracity.sources import tables
from veracity.sources.tables import ROW

# Inputs and the results they must give.
DATES = ['2026-06-18', '18-06-2026', '06/18/2026', '18/06/2026', '2026/06/18', '2024-02-29', '2025-02-29', '2026-02-31', '2026-04-31', '2026-12-32', '2026-13-01', '2026-00-10', '2026-01-00', '31/11/2026', '2026-06-18 14:30:00', '2026-06-18T14:30:00Z', '2026-06-18T14:30:00+05:30', '2099-01-01', '1900-01-01', '1800-01-01', '05-06-2026', '06-05-2026', '', '', 'abcdef', '12345', '99999999', '18 Jun 2026', 'June 18 2026', '20260618', '2026-W25-4', '2026-06-18 25:00:00', '2026-06-18 14:61:00', '2026-06-18 14:30:61', '2026-02-29T12:00:00', '2024-02-29T12:00:00', '0000-01-01', '9999-12-31', '01/02/03', '18-13-2026']
VALID_DATES = {1: "2026-06-18", 2: "2026-06-18", 3: "2026-06-18", 4: "2026-06-18", 5: "2026-06-18", 6: "2024-02-29", 15: "2026-06-18", 16: "2026-06-18", 17: "2026-06-18", 18: "2099-01-01", 19: "1900-01-01", 20: "1800-01-01", 21: "2026-05-06", 22: "2026-06-05", 28: "2026-06-18", 29: "2026-06-18", 30: "2026-06-18", 36: "2024-02-29", 38: "9999-12-31", 39: "2003-01-02"}
PHONES = [('India', '9876543210'), ('India', '+919876543210'), ('India', '91 9876543210'), ('India', '+91 98765 43210'), ('India', '09876543210'), ('India', '1234567890'), ('India', '98765'), ('India', ''), ('Singapore', '81234567'), ('Singapore', '6581234567'), ('Singapore', '+6581234567'), ('Singapore', '71234567'), ('Singapore', '8123456'), ('USA', '2025550183'), ('USA', '12025550183'), ('USA', '+12025550183'), ('USA', '0000000000'), ('USA', '1234567890'), ('USA', '202555018'), ('UK', '07911123456'), ('UK', '447911123456'), ('UK', '+447911123456'), ('UK', '7911123456'), ('UK', '07123'), ('Australia', '0491570156'), ('Australia', '61491570156'), ('Australia', '+61491570156'), ('Australia', '491570156'), ('Australia', '04123'), ('UAE', '0501234567'), ('UAE', '971501234567'), ('UAE', '+971501234567'), ('UAE', '501234567'), ('UAE', '05012345'), ('Germany', '+491701234567'), ('France', '+33612345678'), ('Canada', '+14165550123'), ('Brazil', '+5511999999999'), ('India', '9876543210'), ('India', '9876543210'), ('India', '  +91 98765 43210  '), ('India', '98765-43210'), ('India', '(98765)43210'), ('India', '९८७६५४३२१०'), ('India', 'abcdefghij'), ('India', '987654321O'), ('India', '999999999999999'), ('India', ''), ('India', ''), ('India', '')]
VALID_PHONES = {1: "9876543210", 2: "9876543210", 3: "9876543210", 4: "9876543210", 5: "9876543210", 6: "1234567890", 9: "81234567", 10: "81234567", 11: "81234567", 14: "2025550183", 15: "2025550183", 16: "2025550183", 20: "07911123456", 21: "07911123456", 22: "07911123456", 25: "0491570156", 26: "0491570156", 27: "0491570156", 30: "0501234567", 31: "0501234567", 32: "0501234567", 35: "01701234567", 36: "0612345678", 37: "4165550123", 38: "11999999999", 39: "9876543210", 40: "9876543210", 41: "9876543210", 42: "9876543210", 43: "9876543210", 44: "9876543210"}
MIXED = """Test_ID,Country,Phone_Number,Transaction_Date,Transaction_Time
T001,India,+91 9876543210,31-12-2024,23:59
T002,US,(415) 555-2671,12/31/2024,11:59 PM
T003,UK,+44 20 7946 0958,31/12/2024,23:59:59
T004,Singapore,+65 6123 4567,2024-12-31,23:59:59.123
T005,UAE,+971 50 123 4567,01-01-2025,00:00
T006,Australia,+61 412 345 678,15/08/2024,14:30
T007,India,09876543210,29-02-2024,12:00
T008,US,4155552671,02/29/2024,00:15
T009,UK,+44-20-7946-0958,2024-02-28,18:45:10
T010,Singapore,61234567,2024-03-01,08:05
T011,India,+91 9123456780,14-Aug-2024,07:30
T012,US,+1 212 555 0199,"Wed, 31 Dec 2024 10:00:00 GMT",10:00:00
T013,UK,02079460958,2024-12-31T23:59:59Z,23:59:59Z
T014,Singapore,+65 9876 5432,2024-02-29T12:34:56+08:00,12:34:56.789
T015,India,+91 9999999999,31/01/2025,9:00 AM
T016,US,555-012-3456,01/15/2025,13:05
T017,UK,+44 7700 900123,2025-06-18,06:18:00
T018,Australia,0412 345 678,18/06/2025,18:06
T019,UAE,+971501234567,2025-07-01,07:01:01
T020,Singapore,+65 6789 0123,2025-08-09,09:09:09
T021,India,+91 9876543210,31-12-2024,23:59
T022,India,+91 9876543210,31-12-2024,23:59
T023,US,+1 415 555 2671,2024-12-31,23:59
T024,US,+1 415 555 2671,2024-12-31,23:59
T025,UK,+44 20 7946 0958,2024-12-31,23:59
T026,India,+91 98765AB210,31-12-2024,23:59
T027,India,,31-12-2024,23:59
T028,US,,12/31/2024,11:59 PM
T029,UK,,31/12/2024,23:59:59
T030,Singapore,+65 6123 4567,2024-13-01,23:59:59
T031,UAE,+971 50 123 4567,2024-02-30,00:00
T032,Australia,+61 412 345 678,31-04-2024,14:30
T033,India,+91 9876543210,29-02-2023,12:00
T034,US,(415) 555-267,02/29/2024,00:15
T035,UK,+44 20 7946 0958,2024-02-28,25:00
T036,Singapore,61234567,2024-03-01,24:01
T037,India,+91 9123456780,14-Aug-2024,07:60
T038,US,+1 212 555 0199,"Wed, 31 Dec 2024 10:00:00 GMT",10:00:60
T039,UK,02079460958,2024-12-31T23:59:59Z,99:99
T040,Singapore,+65 9876 5432,2024-02-29T12:34:56+08:00,
T041,India,+91 9999999999,,9:00 AM
T042,US,555-012-3456,01/15/2025,
T043,UK,+44 7700 900123,,06:18:00
T044,Australia,0412 345 678,18/06/2025,
T045,UAE,+971501234567,garbage-date,07:01:01
T046,Singapore,+65 6789 0123,2025-08-09,garbage-time
T047,India,+91 9876543210,2024-02-29T12:34:56+05:30,12:34:56
T048,US,+1 415 555 2671,2024-12-31T23:59:59Z,11:59 PM
T049,UK,+44 20 7946 0958,2024-12-31T23:59:59.999Z,23:59:59.999
T050,Singapore,+65 6123 4567,2024-02-29T00:00:00+08:00,00:00:00.000001
T051,India,+91 9876543210,31-12-2024,23:59
T052,India,+91 9123456780,31-12-2024,23:59
T053,India,+91 9876543210,2024-12-31,23:59
T054,US,+1 415 555 2671,12/31/2024,23:59
T055,US,4155552671,12/31/2024,23:59
T056,UK,+44 20 7946 0958,31/12/2024,23:59:59
T057,UK,+44 20 7946 0958,31/12/2024,23:59:59
T058,Australia,+61 412 345 678,2025-06-18,18:06
T059,Australia,+61 412 345 678,18/06/2025,18:06
T060,UAE,+971 50 123 4567,2025-07-01,07:01:01
T061,UAE,+971501234567,2025-07-01,07:01:01
T062,Singapore,+65 6123 4567,2024-03-01,08:05
T063,Singapore,+65 6123 4567,2024-03-01,08:05
T064,India,0009876543210,31-12-2024,23:59
T065,US,+1 000 555 0199,2024-12-31,23:59
T066,UK,+44 20 7946 0958,2024-02-29,23:59
T067,India,+91 9876543210,2024-02-29,23:59
T068,US,+1 415 555 2671,2024-02-29,23:59
T069,UK,+44 20 7946 0958,2024-02-29,23:59
T070,Singapore,+65 6123 4567,2024-02-29,23:59
T071,India,abcd1234,31-12-2024,23:59
T072,US,+1-415-555-ABCD,12/31/2024,11:59 PM
T073,UK,+44 20 7946 0958 ext 12,31/12/2024,23:59:59
T074,Australia,+61 4 1234 5678,18/06/2025,18:06
T075,UAE,+971 50 123 4567,2025/07/01,07:01:01
T076,Singapore,+65-6123-4567,01-03-2024,08:05
T077,India,+91 9876543210,2024-02-29T12:34:56Z,12:34:56
T078,US,+1 415 555 2671,2024-12-31T23:59:59Z,23:59:59
T079,UK,+44 20 7946 0958,2024-12-31T23:59:59+00:00,23:59:59+00:00
T080,Singapore,+65 6123 4567,2024-02-29T12:34:56.123456+08:00,12:34:56.123456
T081,India,+91 9876543210,31-12-2024,23:59
T082,India,+91 9876543210,31-12-2024,23:59
T083,US,+1 415 555 2671,12/31/2024,11:59 PM
T084,US,+1 415 555 2671,12/31/2024,11:59 PM
T085,UK,+44 20 7946 0958,31/12/2024,23:59:59
T086,India,,,
T087,US,,,
T088,UK,,,
T089,Singapore,,,
T090,UAE,garbage,2024-02-30,99:99:99
T091,Australia,+61 412 345 678,"Mon, 01 Apr 2024 10:20:30 GMT",10:20:30
T092,India,+91 9876543210,2024-04-01T10:20:30.123Z,10:20:30.123
T093,US,+1 415 555 2671,2024-04-01T10:20:30.123456Z,10:20:30.123456
T094,UK,+44 20 7946 0958,2024-04-01T10:20:30+00:00,10:20:30+00:00
T095,Singapore,+65 6123 4567,2024-04-01,10:20
T096,India,+91 9876543210,2024-04-01,10:20:00
T097,US,+1 415 555 2671,2024-04-01,10:20:00.500
T098,UK,+44 20 7946 0958,2024-04-01,10:20:00.500000
T099,Singapore,+65 6123 4567,2024-04-01,10:20:00
T100,India,+91 9876543210,2024-04-01,10:20:00"""
CLEANED = ["T001", "T002", "T003", "T004", "T005", "T006", "T007", "T008", "T009", "T010", "T011", "T012", "T014", "T015", "T018", "T019", "T020", "T025", "T047", "T050", "T052", "T066", "T067", "T068", "T070", "T073", "T076", "T078", "T080", "T091", "T092", "T093", "T095", "T096", "T097", "T098"]
ERRORS = ["T013", "T016", "T017", *[f"T{i:03}" for i in range(26, 40)], *[f"T{i:03}" for i in range(41, 47)], "T064", "T065", "T071", "T072", "T079", *[f"T{i:03}" for i in range(86, 91)], "T094"]


def table(spark, headers, rows):
    return nullify_all(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"{ROW} long, " + ", ".join(f"`{h}` string" for h in headers)))


def test_dates(spark):
    df = spark.createDataFrame(list(enumerate(DATES, 1)), "id int, v string")
    got = {r.id: r.d for r in df.select("id", F.date_format(D.parse_date(F.col("v")), "yyyy-MM-dd").alias("d")).collect() if r.d}
    assert got == VALID_DATES
    warned = {r.id: r.w for r in df.select("id", D.date_warning(F.col("v"), "2026-11-01").alias("w")).collect() if r.w}
    assert {i: w.split(":")[0] for i, w in warned.items()} == {18: "Future date", 19: "Date before year 2000", 20: "Date before year 2000", 38: "Future date"}


@pytest.mark.parametrize("text, dayfirst, want", [("2026-13-01", False, None), ("2026-13-01", True, "2026-01-13"), ("99-01-05", False, "1999-01-05"), ("05-06-99", True, "1999-06-05"), ("Wed, 31 Dec 2024 10:00:00 GMT", False, "2024-12-31"), ("2024-05-01 13:00 PM", False, None), ("2024-05-01 11:00 PM", False, "2024-05-01")])
def test_date_forms(spark, text, dayfirst, want):
    assert spark.createDataFrame([(text,)], "v string").select(F.date_format(D.parse_date(F.col("v"), dayfirst), "yyyy-MM-dd")).first()[0] == want


def test_phones(spark):
    df = nullify_all(spark.createDataFrame([(i, c, n) for i, (c, n) in enumerate(PHONES, 1)], "id int, c string, v string"), ["v"])
    got = {r.id: r.n for r in df.select("id", P.national_number(F.col("v"), P.country_region(F.col("c"))).alias("n")).collect() if r.n}
    assert got == VALID_PHONES


def test_phone_details(spark):
    rows = [("+91 98765 43210", "India"), ("+44 20 7946 0958 ext 12", "UK"), ("7911123456", "UK"), ("1", "Atlantis"), ("+48 512345678", "pl")]
    one = [r[0] for r in spark.createDataFrame(rows, "v string, c string").select(P.phone_details(F.col("v"), F.col("c"))).collect()]
    assert tuple(one[0]) == (True, "IN", "+919876543210", "9876543210", "+91 98765 43210", "MOBILE")
    assert (one[1].national, one[1].e164, one[1].type) == ("0207946095812", "+442079460958", "FIXED_LINE")
    assert (one[2].is_valid, one[2].e164, one[3]) == (False, "", None) and (one[4].region, one[4].type) == ("PL", "MOBILE")


def test_mixed_table(spark, tmp_path):
    headers, *rows = list(csv.reader(io.StringIO(MIXED)))
    out = clean.clean_table(table(spark, headers, rows), "SMART")
    ids = lambda df: [r.Test_ID for r in df.orderBy(ROW).collect()]
    assert ids(out.cleaned) == CLEANED and ids(out.errors) == ERRORS and ids(out.removed) == ERRORS and out.duplicates.count() == 30
    by_id = {r.Test_ID: r for r in out.cleaned.collect()}
    assert tuple(by_id["T012"])[2:] == ("United States", "2125550199", "2024-12-31", "10:00:00") and by_id["T073"].Phone_Number == "0207946095812" and by_id["T076"].Transaction_Date == "2024-01-03"
    stats = out.stats.first()
    assert (stats.total_processed, stats.rows_retained, stats.rows_removed, stats.duplicates_removed, stats.validity_score, stats.quality_rating) == (100, 36, 64, 30, 100.0, "Excellent")
    assert out.audit.where("action = 'Duplicate Removed' and column_name = 'Entire_Row' and cleaned = 'DELETED'").count() == 30
    tables.write_run(out, str(tmp_path / "run"))
    assert tables.read_csv(spark, str(tmp_path / "run/cleaned")).count() == 36 and tables.file_sizes(spark, str(tmp_path / "run/cleaned")).count() >= 1


def test_empty_columns_rows_and_generated_numbers(spark):
    rows = [("1", "India", "9876543210", "2024-01-05", "14:05:09", None), ("24", "IN", "+91 9876543210", "05 January 2024", "14:5:9", "none"), ("3", "SG", "81234567", "2024-02-01", "02:30 PM", ""), (None,) * 6]
    df = table(spark, ["Number", "Country", "Phone_Number", "Transaction_Date", "Transaction_Time", "Notes"], rows)
    assert record_columns(df) == ["Country", "Phone_Number", "Transaction_Date", "Transaction_Time", "Notes"]
    out = clean.clean_table(df, "SMART")
    assert out.removed_columns == ("Notes",) and "Notes" not in out.cleaned.columns
    assert [r.Number for r in out.cleaned.orderBy(ROW).collect()] == ["1", "3"] and [r.Number for r in out.duplicates.collect()] == ["24"]
    stats = out.stats.first()
    assert (stats.total_processed, stats.empty_rows_removed, stats.empty_columns_removed, stats.duplicates_removed) == (3, 1, 1, 1)


def test_future_dates_are_warned_of(spark):
    df = table(spark, ["Test_ID", "Country", "Phone_Number", "Transaction_Date", "Transaction_Time"], [("1", "India", "9876543210", "2030-01-05", "14:05:09"), ("2", "India", "9876543211", "2024-01-05", "14:05:09")])
    out = clean.clean_table(df, "STRICT", as_of="2026-01-01")
    assert [r.Test_ID for r in out.cleaned.collect()] == ["2"] and [r.Test_ID for r in out.warnings.collect()] == ["1"] and out.removed.count() == 1


def test_rule_status_and_main_issue(spark):
    headers = ["customer_id", "full_name", "email", "phone_number", "city", "signup_date"]
    checked = validate.with_issues(table(spark, headers, [("1", "An", "a@b.com", "9876543210", "X", "2024-01-05"), ("2", "Bo", "bad", "9876543211", "Y", "2024-01-06")]), "2026-01-01")
    got = {r.rule: (r.affected_rows, r.status) for r in validate.rule_summary(checked).collect()}
    assert got["email"] == (1, "FAILED") and got["date"] == (0, "PASSED") and {got[r][1] for r in ("duplicates", "currency", "payment_mode", "time", "country")} == {"SKIPPED"} and got["schema"] == (0, "PASSED")
    assert score.transaction_rules(checked).count() == 0 and score.expectations(headers) == 5
    paid = ["order_id", "mobile", "country", "payment_method", "amount", "order_date"]
    status = {r.rule: (r.affected_rows, r.status) for r in validate.rule_summary(validate.with_issues(table(spark, paid, [("1", "9876543210", "India", "card", "5", "2024-01-05")]), "2026-01-01")).collect()}
    assert status["schema"] == (2, "WARNING") and status["currency"][1] == "SKIPPED" and status["duplicates"] == (0, "PASSED")
    every = ["transaction_id", "customer_id", "customer_name", "email", "phone_number", "country", "transaction_date", "payment_mode", "amount", "currency"]
    rows = [("T1", "C1", "An", "a@b.com", "9876543210", "Atlantis", "2024-01-05", "card", "5", "USD"), ("T2", "C2", "Bo", "c@b.com", "9876543211", "Atlantis", "2024-01-06", "card", "6", "USD")]
    assert score.quality_scores(validate.with_issues(table(spark, every, rows), "2026-01-01")).first().main_issue == "Data format inconsistencies"
    bell = validate.with_issues(table(spark, every, [(*rows[0][:2], "A\x07n", *rows[0][3:])]), "2026-01-01")
    assert [r.message for r in validate.issue_log(bell).collect()] == ["Corrupted text: A\x07n", "Unknown country: Atlantis"]


def test_duplicate_profile(spark):
    df = table(spark, ["transaction_id", "email", "phone_number"], [("a", "x@y.com", "98 76"), ("a", "x@y.com", "9876"), ("b", None, "1"), ("b", "z@y.com", None)])
    got = {r.metric: (r.rows, list(r.examples)) for r in duplicate_profile(df).collect()}
    assert got == {"duplicate_ids": (4, ["a", "b"]), "duplicate_emails": (2, ["x@y.com"]), "duplicate_phones": (2, ["98 76", "9876"]), "duplicate_business": (1, [])}


@pytest.mark.parametrize("values, want", [([], None), ([None], None), ([5.0], 5.0), ([1.0, 2.0], 1.5), ([3.0] * 9 + [1.0], 3.0), ([float(i * i % 101) for i in range(1001)], None)])
def test_median(spark, values, want):
    import statistics

    got = exact_median(spark.createDataFrame([(v,) for v in values], "v double"), "v")
    assert got == (statistics.median(values) if len(values) > 10 else want)


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", 'a "b", c'), ("2", None)], "id string, `a name` string")
    tables.write_csv(df, str(tmp_path / "t"))
    tables.append_csv(df, str(tmp_path / "t"))
    back = tables.read_csv(spark, str(tmp_path / "t"))
    assert back.columns == ["id", "a name"] and sorted((r[0], r[1]) for r in back.where("id = 1").collect()) == [("1", 'a "b", c')] * 2 and back.count() == 4
    (tmp_path / "m.csv").write_text('id,v\n1,"two\nlines"\n')
    assert tables.read_csv(spark, str(tmp_path / "m.csv"), multi_line=True).first().v == "two\nlines"
    tables.write_routes(spark.createDataFrame([("1", "cleaned"), ("2", "errors")], "id string, route string"), str(tmp_path / "r"))
    assert tables.read_csv(spark, str(tmp_path / "r")).groupBy("route").count().count() == 2
