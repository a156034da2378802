"""A table with every kind of fault, derived by rule from orders and customers; the same SQL in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veracity.sources.tables import spread

HEADERS = ["transaction_id", "customer_id", "customer_name", "country", "phone_number", "transaction_date", "transaction_time", "amount", "currency", "payment_mode", "email"]

DIRTY = """
SELECT k AS _row_id,
  'TXN-' || CAST(k % 14000 AS varchar(20)) AS transaction_id,
  CASE WHEN k % 53 = 0 THEN '' ELSE 'C' || CAST(ck AS varchar(20)) END AS customer_id,
  CASE k % 11 WHEN 0 THEN NULL WHEN 1 THEN '  ' || cn || chr(9) || 'paypal acct ' WHEN 2 THEN 'USD currency_desk' WHEN 4 THEN 'bell' || chr(7) || lower(cn) WHEN 3 THEN 'N/A' ELSE lower(cn) END AS customer_name,
  CASE k % 9 WHEN 0 THEN 'IN' WHEN 1 THEN 'USA' WHEN 2 THEN 'uk' WHEN 3 THEN 'SG' WHEN 4 THEN 'AU' WHEN 5 THEN 'UAE' WHEN 6 THEN 'Atlantis' WHEN 7 THEN '' ELSE 'India' END AS country,
  CASE k % 10 WHEN 0 THEN '+91 98765 ' || lpad(CAST(k % 100000 AS varchar(20)), 5, '0') WHEN 1 THEN '(312) 555-' || lpad(CAST(k % 10000 AS varchar(20)), 4, '0')
    WHEN 2 THEN '07911 1' || lpad(CAST(k % 100000 AS varchar(20)), 5, '0') WHEN 3 THEN '8123' || lpad(CAST(k % 10000 AS varchar(20)), 4, '0')
    WHEN 4 THEN '0491 57' || lpad(CAST(k % 10000 AS varchar(20)), 4, '0') WHEN 5 THEN '050-123' || lpad(CAST(k % 10000 AS varchar(20)), 4, '0')
    WHEN 6 THEN '12345' WHEN 7 THEN NULL WHEN 8 THEN '9876543210' ELSE '7700 900123' END AS phone_number,
  CASE k % 8 WHEN 0 THEN y || '-' || m || '-' || d WHEN 1 THEN d || '/' || m || '/' || y WHEN 2 THEN m || '/' || d || '/' || y WHEN 3 THEN y || m || d WHEN 4 THEN 'not a date'
    WHEN 5 THEN NULL WHEN 6 THEN y || '-' || m || '-' || d || 'T14:30:45Z' ELSE '31-02-2024' END AS transaction_date,
  CASE k % 7 WHEN 0 THEN '14:5:9' WHEN 1 THEN '02:30 PM' WHEN 2 THEN '24:00:00' WHEN 3 THEN NULL WHEN 4 THEN 'abc' WHEN 5 THEN '12:00 AM' ELSE '07:08:09.999' END AS transaction_time,
  CASE k % 13 WHEN 0 THEN '$' || units || '.' || lpad(CAST(cents % 100 AS varchar(20)), 2, '0') WHEN 1 THEN '-' || units WHEN 2 THEN 'abc' WHEN 3 THEN '1,234.50' WHEN 4 THEN NULL WHEN 5 THEN '$-50' ELSE units END AS amount,
  CASE k % 6 WHEN 0 THEN 'USD' WHEN 1 THEN '$' WHEN 2 THEN 'rs' WHEN 3 THEN 'gbp' WHEN 4 THEN 'XYZ' ELSE NULL END AS currency,
  CASE k % 7 WHEN 0 THEN 'card' WHEN 1 THEN 'UPI payment' WHEN 2 THEN 'wire' WHEN 3 THEN 'Cash' WHEN 4 THEN 'bitcoin' WHEN 5 THEN NULL ELSE 'WALLET' END AS payment_mode,
  CASE k % 8 WHEN 0 THEN 'a' || CAST(ck AS varchar(20)) || '@example.com' WHEN 1 THEN 'A b' || CAST(ck AS varchar(20)) || '@Example.COM' WHEN 2 THEN 'x@@y.com' WHEN 3 THEN 'u@mailinator.com'
    WHEN 4 THEN NULL WHEN 5 THEN 'no-at' WHEN 6 THEN 'u..v@x.com' ELSE 'U' || CAST(ck AS varchar(20)) || '@mail.org' END AS email
FROM (SELECT o_orderkey AS k, c_custkey AS ck, c_name AS cn, CAST(year(o_orderdate) AS varchar(20)) AS y, lpad(CAST(month(o_orderdate) AS varchar(20)), 2, '0') AS m,
        lpad(CAST(day(o_orderdate) AS varchar(20)), 2, '0') AS d, CAST(round(o_totalprice * 100) AS bigint) AS cents, CAST(CAST(floor(o_totalprice) AS bigint) AS varchar(20)) AS units
      FROM {orders} JOIN {customer} ON o_custkey = c_custkey)
"""


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Java compiles no method of more than 8,000 bytes: rules in one such run several times as long as in Spark's smaller methods
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", 8000)
    return spark.sql(DIRTY, orders=spread(spark.read.parquet(f"{sf_dir}/orders.parquet")), customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


SQL = DIRTY.format(orders="orders", customer="customer")
