"""Registered queries of written forms, files and headers, and of profiles of all columns together."""

from __future__ import annotations

from pyspark.sql import functions as F

from veracity.functions import temporal as D
from veracity.operators import chunk, frequent, profile, schema
from veracity.plans.dirty import HEADERS
from veracity.plans.queries import _CTE, nullified, query
from veracity.sources.delimited import read_table
from veracity.sources.runs import read_routed, write_routed
from veracity.sources.tables import scratch, with_row_ids

_FORMS = ["d MMMM yyyy", "MMM d, yyyy", "EEEE, d MMM yyyy", "dd/MMM/yyyy", "yyyy MMM dd", "MM/dd/yyyy", "yyyyMMdd'T'HHmmss", "MM dd yyyy", "dd-MMM-yy", "yyyy/M/d h a", "yyyy, MMMM d", "d MMMM, yyyy 'at' HH:mm", "yyyyMMddHHmmss", "d'th of' MMMM yyyy", "HH:mm d MMM yyyy", "yyyy.MM.dd"]


@query("date_free_forms", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS parsed FROM orders")
def date_free_forms(spark, sf_dir):
    """Every order's date written in one of many forms, and read again."""
    at, form = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % len(_FORMS)
    text = F.coalesce(*[F.when(form == i, F.date_format(at, f)) for i, f in enumerate(_FORMS)])
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", D.parse_date(text).cast("string").alias("parsed"))


@query("csv_quoted_lines", "SELECT doc_id, lang, length(t)::BIGINT AS chars, md5(t) AS digest FROM (SELECT doc_id, lang, nullif(text, '') AS t FROM documents)")
def csv_quoted_lines(spark, sf_dir):
    """All documents, line breaks and quotes included, through CSV files that are read in splits."""
    path = scratch(spark, "csv")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    docs.write.option("header", True).option("quoteAll", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    rows = read_table(spark, path).rows
    # an empty text and no text are one in a CSV file
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.length("text").cast("long").alias("chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


def _each(sql: str, between: str = " UNION ALL ") -> str:
    return between.join(sql.replace("{c}", h) for h in HEADERS)


@query("top_values_all", f"{_CTE} " + _each("SELECT '{c}' AS column_name, row_number() OVER (ORDER BY n DESC, first_row)::INT AS rank, value, n, first_row FROM (SELECT {c} AS value, count(*) AS n, min(_row_id) AS first_row FROM d WHERE {c} IS NOT NULL GROUP BY 1) QUALIFY rank <= 10"))
def top_values_all(spark, sf_dir):
    return frequent.top_values(nullified(spark, sf_dir), HEADERS)


@query("profile_quartiles", f"{_CTE} " + _each("SELECT '{c}' AS column_name, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median_value, quantile_cont(v, 0.75) AS q3 FROM (SELECT TRY_CAST(regexp_replace({c}, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS v FROM d)"))
def profile_quartiles(spark, sf_dir):
    return profile.quartiles(nullified(spark, sf_dir), HEADERS)


@query("routed_run", "SELECT CASE WHEN l_returnflag = 'R' THEN 'returned' WHEN l_quantity > 40 THEN 'large' ELSE 'rest' END AS route, l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem")
def routed_run(spark, sf_dir):
    """All order lines through the routed writer in one pass, and read again by its manifest."""
    path, columns, routes = scratch(spark, "run"), ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"], ["returned", "large", "rest"]
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    write_routed(lines.withColumn("route", F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_quantity") > 40, "large").otherwise("rest")), path, "route", columns, routes)
    parts = [read_routed(spark, path, r).select(F.lit(r).alias("route"), F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_quantity").cast("double").alias("l_quantity"), "l_returnflag") for r in routes]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("chunk_archive", "SELECT (k // 1000 + 1)::BIGINT AS chunk_id, printf('chunk_%03d.csv', k // 1000 + 1) AS name, count(*) AS n FROM (SELECT row_number() OVER () - 1 AS k FROM orders) GROUP BY ALL")
def chunk_archive(spark, sf_dir):
    """One ZIP archive of the orders in chunks of 1,000 rows: its members."""
    orders = with_row_ids(spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return chunk.write_archive(orders, scratch(spark, "chunks").removeprefix("file://") + ".zip").select("chunk_id", "name", "n")


_MOMENT = """SELECT CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T' || lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') || ':07Z'
  WHEN 1 THEN lpad((o_orderkey % 24)::VARCHAR, 2, '0') || ':' || lpad((o_orderkey % 60)::VARCHAR, 2, '0') END AS cell, o_orderkey, o_orderdate FROM orders"""


@query("profile_time_of_timestamps", f"""WITH m AS (SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate::DATE ELSE DATE '1995-06-17' END AS day, CASE WHEN length(cell) = 5 THEN cell || ':00' ELSE substr(cell, 12, 8) END AS t FROM ({_MOMENT}) WHERE cell IS NOT NULL)
SELECT right(min(day || ' ' || t), 8) AS min_time, right(max(day || ' ' || t), 8) AS max_time, count(*) AS valid_times FROM m""")
def profile_time_of_timestamps(spark, sf_dir):
    """Timestamps and plain times in one column: the ends are those of moments."""
    k, two = F.col("o_orderkey"), lambda n: F.lpad((F.col("o_orderkey") % n).cast("string"), 2, "0")
    cell = F.when(k % 3 == 0, F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("T"), two(24), F.lit(":"), two(60), F.lit(":07Z"))).when(k % 3 == 1, F.concat(two(24), F.lit(":"), two(60)))
    return profile.time_profile(spark.read.parquet(f"{sf_dir}/orders.parquet").select(cell.alias("cell")), "cell", "1995-06-17")


@query("csv_table_info", "SELECT (SELECT count(*) FROM orders) AS row_count, count(*) AS column_count, string_agg(column_name, ',') AS column_names FROM (DESCRIBE orders)")
def csv_table_info(spark, sf_dir):
    """Rows, columns and headers of the orders as a CSV file says them."""
    path = scratch(spark, "csv")
    spark.read.parquet(f"{sf_dir}/orders.parquet").write.option("header", True).csv(path)
    found = read_table(spark, path)
    return found.rows.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(found.headers)).cast("long").alias("column_count"), F.lit(",".join(found.headers)).alias("column_names"))


_TABLES = ("customer", "supplier", "orders", "part", "lineitem")
_FILLED = " UNION ALL ".join(f"SELECT table_name, substr(regexp_extract(name, '\\w_\\w+'), 3) AS header, filled FROM (UNPIVOT (SELECT '{t}' AS table_name, count(COLUMNS(*)) FROM {t}) ON COLUMNS(* EXCLUDE table_name) INTO NAME name VALUE filled)" for t in _TABLES)


@query("headers_of_tables", f"SELECT table_name, header, CASE header WHEN 'name' THEN 'customer_name' WHEN 'totalprice' THEN 'amount' WHEN 'orderdate' THEN 'transaction_date' END AS role, filled FROM ({_FILLED})")
def headers_of_tables(spark, sf_dir):
    """The role of every column of the given tables by its header (without the table's letter), and how many cells it fills."""
    parts = []
    for name in _TABLES:
        df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        df = df.toDF(*[c[2:] for c in df.columns])
        roles = {h: r for r, h in schema.resolve_roles(df.columns).items()}
        known = F.element_at(F.create_map(*[F.lit(x) for h, r in roles.items() for x in (h, r)]), F.col("column_name")) if roles else F.lit(None).cast("string")
        counts = profile.per_column(df, df.columns, filled=F.count)
        parts.append(counts.select(F.lit(name).alias("table_name"), F.col("column_name").alias("header"), known.alias("role"), "filled"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
