"""Queries of phone numbers in every region that has a rule, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from veracity.functions import numbering, phone
from veracity.plans import queries as Q
from veracity.sources.tables import spread

_REGIONS = sorted(phone.RULES)
_CALLS = [phone.CODES[r] for r in _REGIONS]
_ARRAY = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
#: a number of 6 to 11 digits behind +, the calling code or the trunk prefix, and a country, by order
_DIGITS = "substr(CAST(10 + (o_orderkey * 7919 + o_custkey) % 90 AS varchar(20)) || lpad(CAST((o_orderkey * 104729 + o_custkey * 31) % 1000000007 AS varchar(20)), 10, '0'), 1, 6 + CAST(o_orderkey % 6 AS int))"
_SQL_NUMBERS = f"""SELECT o_orderkey, at(regions, i) AS country, CASE o_custkey % 3 WHEN 0 THEN '+' || at(calls, i) || ' ' WHEN 1 THEN at(trunks, i) ELSE '00' || at(calls, i) || '-' END || digits AS phone
  FROM (SELECT o_orderkey, o_custkey, {_DIGITS} AS digits, CAST((o_orderkey + o_custkey) % {len(_REGIONS)} AS int) AS i FROM orders)"""
_PLAN = numbering.expand(numbering.PLAN)


def _numbers(spark, sf_dir):
    lists = {"regions": _REGIONS, "calls": _CALLS, "trunks": [phone.TRUNKS[r] for r in _REGIONS]}
    at = lambda name: F.get(F.split(F.lit(",".join(lists[name])), ","), F.col("i"))
    o = spread(spark.read.parquet(f"{sf_dir}/orders.parquet")).select("o_orderkey", "o_custkey", F.expr(_DIGITS).alias("digits"), ((F.col("o_orderkey") + F.col("o_custkey")) % len(_REGIONS)).cast("int").alias("i"))
    way = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("+"), at("calls"), F.lit(" "))).when(F.col("o_custkey") % 3 == 1, at("trunks")).otherwise(F.concat(F.lit("00"), at("calls"), F.lit("-")))
    return o.select("o_orderkey", at("regions").alias("country"), F.concat(way, "digits").alias("phone"))


def _sql() -> str:
    numbers = _SQL_NUMBERS
    for name, xs in (("regions", _REGIONS), ("calls", _CALLS), ("trunks", [phone.TRUNKS[r] for r in _REGIONS])):
        numbers = numbers.replace(f"at({name}, i)", f"({_ARRAY(xs)})[i + 1]")
    plan = ", ".join(f"('{r}', {n}, '{p}', '{k}', '^{a}$', '{b.replace('$', chr(92))}')" for r, n, p, k, a, b in _PLAN)
    n = f"substr(national, {'1 + length(' + Q.s_look('country', phone.TRUNKS) + ')'})"
    return f"""WITH x AS (SELECT *, {Q.s_national('phone', 'country')} AS national FROM ({numbers})),
s AS (SELECT o_orderkey, country, phone, national, {n} AS n, {Q.s_look('country', phone.CODES)} AS code FROM x),
p(region, len, prefix, kind, pattern, grouping) AS (VALUES {plan}),
b AS (SELECT o_orderkey, kind, pattern, grouping FROM s JOIN p ON region = country AND len = length(n) AND starts_with(n, prefix) QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY length(prefix) DESC) = 1)
SELECT o_orderkey, country AS region, phone, n IS NOT NULL AS is_valid, coalesce('+' || code || n, '') AS e164, coalesce(national, '') AS "national",
  coalesce('+' || code || ' ' || coalesce(regexp_replace(n, pattern, grouping), n), '') AS international, coalesce(kind, 'UNKNOWN') AS type FROM s LEFT JOIN b USING (o_orderkey)"""


@Q.query("phone_details", _sql())
def phone_details(spark, sf_dir):
    df = _numbers(spark, sf_dir)
    return df.select("o_orderkey", "phone", F.inline(F.array(phone.phone_details(F.col("phone"), F.col("country")))))


@Q.query("phone_types", f'SELECT region, type, count(*) AS numbers, count(DISTINCT e164) AS distinct_numbers FROM ({_sql()}) WHERE is_valid GROUP BY 1, 2')
def phone_types(spark, sf_dir):
    return phone_details(spark, sf_dir).where("is_valid").groupBy("region", "type").agg(F.count("*").alias("numbers"), F.countDistinct("e164").alias("distinct_numbers"))
