"""The stateless rules and cleaners on streams, and windowed counts of issues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.functions import cells as C
from veracity.functions import temporal as D


def standardize_stream(stream: DataFrame, currency: str = "currency", payment: str = "payment_mode", email: str = "email") -> DataFrame:
    done = {currency: C.clean_currency, payment: C.clean_payment, email: C.clean_email}
    return stream.withColumns({c: f(F.col(c)) for c, f in done.items() if c in stream.columns})


def issue_counts(stream: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Missing or wrong values by event-time window and column, for columns the stream has."""
    checks = {"email": lambda c: ~C.email_ok(c), "amount": lambda c: C.to_number(c).isNull(), "transaction_time": lambda c: D.parse_time(c).isNull()}
    bad = [F.when(f(F.col(c)), F.lit(c)) for c, f in checks.items() if c in stream.columns]
    t = stream.withWatermark(ts, late).select(ts, F.explode(F.array_compact(F.array(*bad))).alias("column_name"))
    return t.groupBy(F.window(ts, window), "column_name").agg(F.count(F.lit(1)).alias("n"))


def first_seen(stream: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
