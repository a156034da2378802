"""Column types, completeness, profiles, imputation values and scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.functions.cells import EMPTY_WORDS, email_ok, is_empty, is_missing, nullify, stage, strip, to_double
from veracity.functions.temporal import ISO, SEPARATORS, date_separator, date_vote, decide_date_format, parse_date, parse_time
from veracity.operators.quantiles import exact_quantiles
from veracity.sources.tables import ROW, stored


def unpivot(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value, row id): one pass over a wide table, one group a column afterwards."""
    ids = [ROW] if ROW in df.columns else []
    return df.select(*ids, F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("value")) for c in cols])).alias("_c")).select(*ids, "_c.*")


def per_column(df: DataFrame, cols: list[str], **aggs) -> DataFrame:
    """column_name and an aggregate of each kind for every column: one pass, one row from each task, nothing exploded before."""
    one = df.agg(*[f(F.col(f"`{c}`")).alias(f"{k}_{i}") for i, c in enumerate(cols) for k, f in aggs.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), *[F.col(f"{k}_{i}").alias(k) for k in aggs]) for i, c in enumerate(cols)])))


def nullify_all(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or [c for c in df.columns if c != ROW]
    return df.withColumns({c: nullify(F.col(f"`{c}`")) for c in cols})


def drop_empty_rows(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.na.drop("all", subset=cols or [c for c in df.columns if c != ROW])


def has_value(c: Column) -> Column:
    """Whether any cell of a column holds a value; an empty table's columns count as filled."""
    return F.coalesce(F.max(~is_empty(c)), F.lit(True))


def empty_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """column_name of the columns without any value."""
    return per_column(df, cols, full=has_value).where("not full").select("column_name")


def completeness(df: DataFrame, cols: list[str]) -> DataFrame:
    """column_name, non_empty, empty, completeness (percent, one decimal); of an empty table nothing."""
    t = per_column(df, cols, non_empty=F.count, n=lambda c: F.count(F.lit(1))).where("n > 0")
    return t.select("column_name", "non_empty", (F.col("n") - F.col("non_empty")).alias("empty"), F.bround(F.col("non_empty") * 100.0 / F.col("n"), 1).alias("completeness"))


def column_types(df: DataFrame, cols: list[str], first_rows: int | None = None) -> DataFrame:
    """column_name, column_type from all rows; a column of blanks counts as Email.

    ``first_rows`` is there for compatibility with the reference, which looks at 100 cells: only so many
    rows, the first by row id, are read then.
    """
    head = df if first_rows is None else df.orderBy(ROW).limit(first_rows)
    v = F.coalesce("value", F.lit(""))
    filled = strip(v) != ""
    digits = F.regexp_replace(v, r"[^0-9.\-]", "")
    hit = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t = unpivot(head, cols).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("n"), hit(filled & ~email_ok(v)).alias("no_email"), hit(filled & parse_time(v).isNotNull()).alias("times"),
        hit(filled & parse_date(v).isNotNull()).alias("dates"), hit(filled & digits.try_cast("double").isNotNull()).alias("numbers"),
        hit(filled & F.length(F.regexp_replace(v, "[^0-9]", "")).between(7, 15)).alias("phones"), hit(filled & ~F.lower(strip(v)).isin("true", "false", "yes", "no", "0", "1", "t", "f", "y", "n")).alias("no_boolean"),
    )
    kind = F.when(F.col("no_email") == 0, "Email").when(F.col("times") > 0.7 * F.col("n"), "Time").when(F.col("dates") > 0.7 * F.col("n"), "Date").when(F.col("numbers") > 0.8 * F.col("n"), "Numeric")
    return t.select("column_name", kind.when(F.col("phones") > 0.7 * F.col("n"), "Phone").when(F.col("no_boolean") == 0, "Boolean").otherwise("Text/String").alias("column_type"))


def exact_median(df: DataFrame, col: str) -> float | None:
    """The exact median of a column without sending its values to one task; null when it has none."""
    return exact_quantiles(stored(df.select(F.col(f"`{col}`").cast("double").alias(col)), "median"), [col])[col][0]


def numeric_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Least, largest, mean, median and spread of the numbers in each column; columns without a number have no row.

    The numbers of all columns are written once; their medians take four passes over them, however many columns there are.
    """
    number = lambda c: F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")
    t = stored(df.select(*[number(F.col(f"`{c}`")).alias(c) for c in cols]), "numbers")
    stats = per_column(t, cols, min_value=F.min, max_value=F.max, mean_value=lambda c: F.round(F.avg(c), 4), std_value=lambda c: F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 4), n=F.count).where("n > 0").drop("n")
    middles = [(c, m[0]) for c, m in exact_quantiles(t, cols).items()]
    # one row a column
    return stats.join(F.broadcast(df.sparkSession.createDataFrame(middles, "column_name string, median_value double")), "column_name").select("column_name", "min_value", "max_value", "mean_value", "median_value", "std_value")


def quartiles(df: DataFrame, cols: list[str]) -> DataFrame:
    """column_name, q1, median_value, q3 of the numbers in each column, all columns together; null without a number."""
    number = lambda c: F.regexp_replace(c, r"[^0-9.\-]", "").try_cast("double")
    found = exact_quantiles(stored(df.select(*[number(F.col(f"`{c}`")).alias(c) for c in cols]), "numbers"), cols, (0.25, 0.5, 0.75))
    return df.sparkSession.createDataFrame([(c, *q) for c, q in found.items()], "column_name string, q1 double, median_value double, q3 double")


def text_profile(df: DataFrame, cols: list[str]) -> DataFrame:
    return unpivot(df, cols).where("value is not null").groupBy("column_name").agg(F.count_distinct("value").alias("distinct_values"), F.round(F.avg(F.length("value")), 4).alias("mean_length"))


def top_values(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """The most frequent values; equal counts in order of first appearance."""
    t = df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first_row"))
    return t.orderBy(F.desc("n"), "first_row").limit(n)


def date_profile(df: DataFrame, col: str, as_of: str) -> DataFrame:
    d = df.select(parse_date(F.col(col)).alias("d"))
    return d.agg(F.date_format(F.min("d"), "yyyy-MM-dd").alias("min_date"), F.date_format(F.max("d"), "yyyy-MM-dd").alias("max_date"), F.count_if(F.col("d") > F.lit(as_of).cast("date")).alias("future_dates"), F.count_if(F.year("d") < 2000).alias("ancient_dates"))


def time_profile(df: DataFrame, col: str, as_of: str | None = None) -> DataFrame:
    """Earliest and latest time of a column and how many cells hold one.

    A timestamp keeps its date and a plain time of day is one of the day ``as_of`` (today), so the
    earliest time is that of the earliest moment, not the smallest time of day.
    """
    c = strip(F.col(f"`{col}`"))
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    day = F.when(c.rlike(ISO), F.date_add(F.substring(c, 1, 10).try_cast("date"), F.when(F.substring(c, 12, 2) == "24", 1).otherwise(0))).otherwise(today)
    moment = F.struct(day.alias("day"), F.col("t"))
    t = df.select(F.col(f"`{col}`"), parse_time(F.col(f"`{col}`")).alias("t"))
    found = t.where("t is not null").agg(F.min(moment)["t"].alias("min_time"), F.max(moment)["t"].alias("max_time"), F.count("t").alias("valid_times"))
    return found


def date_votes(df: DataFrame, col: str) -> DataFrame:
    """(vote, n): input of ``temporal.decide_date_format``."""
    return df.select(date_vote(F.col(col)).alias("vote")).where("vote is not null").groupBy("vote").agg(F.count(F.lit(1)).alias("n"))


VOTES = ("yyyy", "dd", "mm", "ambiguous")


def with_order(df: DataFrame, v: Column) -> DataFrame:
    """``df`` with what a date cell votes for and what parts it, worked out once a row: input of ``order_counts``."""
    return stage(df, {"_vote": date_vote(v), "_mark": date_separator(v)})


def order_counts() -> dict[str, Column]:
    """Aggregates of the votes and separators of ``with_order`` (and row ids): input of ``order_of``.

    Of each separator: cells parted by it, those of them that vote (``voted``), and the least row id of these (``first``).
    """
    out = {k: F.count_if(F.col("_vote") == k) for k in VOTES} | {x: F.count_if(F.col("_mark") == x) for x in SEPARATORS}
    voted = {x: F.col("_vote").isNotNull() & (F.col("_mark") == x) for x in SEPARATORS}
    return out | {f"voted{x}": F.count_if(c) for x, c in voted.items()} | {f"first{x}": F.min(F.when(c, F.col(ROW))) for x, c in voted.items()}


def order_of(counts: dict[str, int]) -> tuple[bool | None, str, float]:
    """(dayfirst, format, confidence) from ``order_counts``; dayfirst is null where they are undecided."""
    used = {x: counts[x] for x in SEPARATORS}
    votes = {k: counts[k] for k in VOTES}
    if any(used.values()) and not any(votes.values()):
        votes["ambiguous"] = 1  # three parts, none of them of digits only: undecided rather than unknown
    return decide_date_format(votes, max(used, key=used.get))


def date_order(df: DataFrame, col: str, decide: Callable[[dict], tuple] = order_of) -> tuple[bool | None, str, float]:
    """(dayfirst, format, confidence) of a date column (of a table with row ids), decided from the votes of all its cells in one aggregation."""
    counts = order_counts()
    return decide(with_order(df.select(ROW, F.col(f"`{col}`")), F.col(f"`{col}`")).agg(*[c.alias(k) for k, c in counts.items()]).first().asDict())


def mode_values(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column_name, value): most frequent trimmed value of each column, the smallest of equally frequent ones; empty words are none."""
    trimmed = unpivot(df, cols).select("column_name", strip(F.col("value")).alias("value"))
    counts = trimmed.where(F.col("value").isNotNull() & ~F.lower("value").isin(*EMPTY_WORDS)).groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("column_name").agg(F.min_by("value", F.struct(-F.col("n"), "value")).alias("value"))


def median_value(df: DataFrame, col: str) -> DataFrame:
    return df.sparkSession.createDataFrame([(exact_median(df.select(to_double(F.col(f"`{col}`")).alias("v")), "v"),)], "median_value double")


def missing_cells(df: DataFrame, cols: list[str]) -> DataFrame:
    return per_column(df, cols, n=lambda c: F.count_if(is_missing(c))).agg(F.sum("n").alias("missing_cells"))


def rating(score):
    return F.when(score >= 95, "Excellent").when(score >= 85, "Good").when(score >= 70, "Average").otherwise("Poor")
