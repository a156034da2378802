"""Duplicate identifiers and duplicate business records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.functions.cells import lookup, stage, strip, text_key, to_double
from veracity.functions.phone import country_region, national_number, phone_digits
from veracity.functions.temporal import parse_date, parse_time
from veracity.operators.schema import is_identifier, resolve_roles
from veracity.sources.tables import ROW

# Country names as they stand in a business key.
COUNTRY_KEY = {
    "in": "india", "ind": "india", "india": "india", "us": "united states", "usa": "united states", "unitedstates": "united states", "unitedstatesofamerica": "united states",
    "uk": "united kingdom", "gb": "united kingdom", "unitedkingdom": "united kingdom", "ae": "united arab emirates", "uae": "united arab emirates", "unitedarabemirates": "united arab emirates",
    "sg": "singapore", "sgp": "singapore", "singapore": "singapore", "au": "australia", "aus": "australia", "australia": "australia",
}


def key_value(header: str, c: Column, country: Column | None = None, known: dict[str, Column] | None = None) -> Column:
    """A cell as it counts in the business key, by what its header says it is.

    ``known`` has columns already worked out for the cell: its national number, date or time of day.
    """
    h, c, known = header.lower(), strip(F.coalesce(c, F.lit(""))), known or {}
    if "phone" in h or "mobile" in h:
        # without a country there is no national form
        number = known.get("number", national_number(c, country_region(country)) if country is not None else F.lit(None).cast("string"))
        return F.coalesce(number, phone_digits(c))
    if "date" in h:
        return F.coalesce(F.date_format(known.get("date", parse_date(c)), "yyyy-MM-dd"), c)
    if "time" in h:
        return F.coalesce(known.get("time", parse_time(c)), F.lower(c))
    if "country" in h or "nation" in h:
        return F.coalesce(lookup(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", ""), COUNTRY_KEY), F.lower(c))
    return text_key(c)


def business_columns(headers: list[str], row_identifier: str | None = None) -> list[str]:
    return [h for h in headers if not is_identifier(h) and h != row_identifier and h != ROW]


def record_columns(df: DataFrame) -> list[str]:
    """Columns that say what a record is: no identifiers, and not the first column if it holds generated row numbers.

    A cell that is no number settles that; only where none is found are distinct values counted.
    """
    headers = [c for c in df.columns if c != ROW]
    v = strip(F.col(f"`{headers[0]}`")) if headers else None
    generated = bool(headers) and not is_identifier(headers[0]) and df.where((v != "") & to_double(v).isNull()).isEmpty() and row_identifier_probe(df, headers[0]).first()["is_identifier"]
    return business_columns(headers, headers[0] if generated else None)


def business_key(df: DataFrame, cols: list[str], out: str = "business_key", known: dict[str, dict[str, Column]] | None = None) -> DataFrame:
    country = next((c for c in cols if "country" in c.lower() or "nation" in c.lower()), None)
    where = F.col(f"`{country}`") if country else None
    return stage(df, {out: F.concat_ws("\x1f", *[key_value(c, F.col(f"`{c}`"), where, (known or {}).get(c)) for c in cols])})


def row_identifier_probe(df: DataFrame, col: str) -> DataFrame:
    """Whether a column is a generated row number: all numbers, at least 95 % of them distinct."""
    v = strip(F.col(f"`{col}`"))
    t = df.select(v.alias("v")).where("v <> ''").agg(F.count(F.lit(1)).alias("n"), F.count_if(to_double(F.col("v")).isNotNull()).alias("numbers"), F.count_distinct("v").alias("distinct_values"))
    return t.select("n", "numbers", "distinct_values", ((F.col("n") > 0) & (F.col("n") == F.col("numbers")) & (F.col("distinct_values") >= 0.95 * F.col("n"))).alias("is_identifier"))


def repeated(df: DataFrame, key: Column) -> DataFrame:
    """Rows whose non-empty key stands in more than one row: counted first, then met by key."""
    t = df.withColumn("_key", key)
    many = t.where("_key <> ''").groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
    return t.join(many, "_key", "left_semi").drop("_key")


def without_repeated(df: DataFrame, key: Column) -> DataFrame:
    """Rows whose key is missing or stands in one row only."""
    t = df.withColumn("_key", key)
    many = t.where("_key <> ''").groupBy("_key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")
    return t.join(many, "_key", "left_anti").drop("_key")


def later_copies(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows that repeat the business key of an earlier row."""
    t = business_key(df, cols, "_key")
    first = t.groupBy("_key").agg(F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key", "_first")
    return t.join(first, "_key").where(F.col(ROW) > F.col("_first")).drop("_key", "_first")


def all_copies(df: DataFrame, cols: list[str]) -> DataFrame:
    return repeated(business_key(df, cols, "_bk"), F.col("_bk")).drop("_bk")


def keep_first(df: DataFrame, cols: list[str]) -> DataFrame:
    """One row for each business key, the earliest; rows travel with their key and meet their group's least number."""
    t = business_key(df, cols, "_key")
    first = t.groupBy("_key").agg(F.min(ROW).alias(ROW)).select(ROW)
    return t.join(first, ROW, "left_semi").drop("_key")


def duplicate_profile(df: DataFrame, n: int = 5) -> DataFrame:
    """metric, rows, examples: rows with repeated ids, e-mails and phones and later business copies, with up to ``n`` repeated values each.

    Values are listed by the row they first stand in; copies of whole records have no examples.
    """
    roles = resolve_roles([c for c in df.columns if c != ROW])
    keys = {"duplicate_ids": ("transaction_id", strip), "duplicate_emails": ("email", strip), "duplicate_phones": ("phone_number", phone_digits)}
    parts = []
    for name, (role, key) in keys.items():
        if role in roles:
            c = F.col(f"`{roles[role]}`")
            values = df.select(ROW, c.alias("value"), key(F.coalesce(c, F.lit(""))).alias("k")).where("k <> ''")
            values = values.groupBy("k", "value").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first"))
            many = values.groupBy("k").agg(F.sum("n").alias("total")).where("total > 1").select("k")
            found = values.join(many, "k", "left_semi")
            first = found.groupBy("value").agg(F.min("first").alias("first")).orderBy("first").limit(n)
            count = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
            listed = first.agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "value"))), lambda x: x["value"]).alias("examples"))
            parts += [count.select(F.lit(name).alias("metric"), "rows", F.lit(None).cast("array<string>").alias("examples")), listed.select(F.lit(name).alias("metric"), F.lit(None).cast("long").alias("rows"), "examples")]
    copies = later_copies(df, record_columns(df)).agg(F.count(F.lit(1)).alias("rows"))
    parts.append(copies.select(F.lit("duplicate_business").alias("metric"), "rows", F.array().cast("array<string>").alias("examples")))
    both = reduce(DataFrame.unionByName, parts).groupBy("metric")
    return both.agg(F.max("rows").alias("rows"), F.first("examples", ignorenulls=True).alias("examples"))


def nth_copy(df: DataFrame, key: Column) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(ROW))
