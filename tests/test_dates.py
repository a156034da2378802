"""Written dates against the library whose rules they follow, and by hand."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from veracity.functions import temporal as D

FORMS = {
    "18th June 2026": "2026-06-18", "June 18th, 2026": "2026-06-18", "2026 Jun 18": "2026-06-18", "18-Jun-26": "2026-06-18", "20260618T143045": "2026-06-18", "2026-06-18T14": "2026-06-18",
    "2026/6/18 2pm": "2026-06-18", "18 June, 2026 at 10:00": "2026-06-18", "2026, June 18": "2026-06-18", "06 18 2026": "2026-06-18", "20260618143045": "2026-06-18", "18/Jun/2026": "2026-06-18",
    "18.Jun.2026": "2026-06-18", "2026-06-18 14h30": "2026-06-18", "18jun2026": "2026-06-18", "Thursday, 18 of June 2026": "2026-06-18", "2026-06-18t14:30:45z": "2026-06-18", "10:00 JUN 18 2026": "2026-06-18",
    "Sept 5, 2024": "2024-09-05", "1-1-1": "2001-01-01", "75-1-2": "2075-01-02", "76-1-2": "1976-01-02",
    # without a day, or without a year, or with a wrong time
    "Jun 2026": None, "2026-06": None, "June": None, "Monday": None, "14:30": None, "5/6": None, "2026-06-18 25:00": None, "2026-06-18 14:30 PM": None, "2024-02-30": None, "2024 13 13": None, "18 Junuary 2026": None,
    "0000-01-01": None, "c2026_06_18": None, "D2026-06-18": None, "1234567": None, "": None, "nan": None,
}


def parsed(spark, forms, dayfirst):
    df = spark.createDataFrame([(f,) for f in forms], "v string")
    flag = F.lit(dayfirst) if dayfirst == "column" else dayfirst
    return {r.v: r.d for r in df.select("v", D.parse_date(F.col("v"), flag).cast("string").alias("d")).collect()}


def test_written_dates(spark):
    assert parsed(spark, FORMS, False) == FORMS


@pytest.mark.parametrize("dayfirst", [False, True])
def test_dates_against_the_library(spark, dayfirst):
    parser = pytest.importorskip("dateutil.parser")
    rng = random.Random(1)
    kinds = ["%d %B %Y", "%b %d, %Y", "%d-%m-%Y", "%m/%d/%y", "%Y.%m.%d", "%d.%m.%y", "%A, %d %b %Y", "%Y %b %d", "%y-%b-%d", "%d%b%y", "%H:%M %d %b %Y", "%Y%m%dT%H%M", "%Y%m%d%H%M%S", "%Y-%d-%m", "%B %d %Y %I:%M %p", "%Y%m%d", "%d/%b/%Y:%H", "%m %d %Y"]
    forms = {(datetime.datetime(1950, 1, 1) + datetime.timedelta(minutes=rng.randrange(60_000_000))).strftime(rng.choice(kinds)) for _ in range(600)}

    def want(text):
        try:
            return str(parser.parse(text, dayfirst=dayfirst).date())
        except (ValueError, OverflowError):
            return None

    got = parsed(spark, forms, dayfirst)
    assert {t: (got[t], want(t)) for t in forms if got[t] != want(t)} == {}


def test_order_of_each_row(spark):
    df = spark.createDataFrame([("05/06/2024", True), ("05/06/2024", False), ("2024-05-06", True), ("13/06/2024", False), ("05/13/2024", True)], "v string, first boolean")
    got = [r[0] for r in df.select(D.parse_date(F.col("v"), F.col("first")).cast("string")).collect()]
    assert got == ["2024-06-05", "2024-05-06", "2024-06-05", "2024-06-13", "2024-05-13"]
