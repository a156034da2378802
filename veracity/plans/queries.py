"""Registered queries of the data-quality operators and the SQL each is held against."""

from __future__ import annotations

from math import floor

from pyspark.sql import functions as F

from veracity.functions import cells as C
from veracity.functions import numbering as N
from veracity.functions import phone as P
from veracity.functions import temporal as D
from veracity.operators import chunk, dedupe, profile, schema, validate
from veracity.plans.dirty import HEADERS, SQL, dirty_orders
from veracity.sources.tables import ROW

AS_OF = "2024-06-30"

# --- SQL of the scalar rules, over a column name -------------------------------------------------


def _list(xs) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def s_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def s_missing(c: str) -> str:
    return f"({c} IS NULL OR {s_strip(c)} = '' OR lower({s_strip(c)}) IN ({_list(C.NULL_WORDS)}))"


def s_nullify(c: str) -> str:
    return f"CASE WHEN {c} IN ({_list(C.NA_SENTINELS)}) OR {s_missing(c)} THEN NULL ELSE {c} END"


def s_map(key: str, table: dict, default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def s_look(key: str, table: dict) -> str:
    return "map_extract_value(MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in table.items()) + f"}}, {key})"


def s_clean_text(c: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(regexp_replace({c}, '[\t\r\n]+', ' ', 'g'), '[^\x20-\x7E]', '', 'g'), ' +', ' ', 'g'))"


def s_title(c: str) -> str:
    return rf"array_to_string(list_transform(regexp_extract_all({c}, '(\w+|\W+)', 1), lambda w: CASE WHEN upper(w) IN ({_list(C.ABBREVIATIONS)}) THEN upper(w) WHEN regexp_matches(w, '^[0-9A-Za-z]+$') THEN upper(w[1:1]) || lower(w[2:]) ELSE w END), '')"


def s_normal(c: str) -> str:
    mark = r"[A-Za-z$\x{20A0}-\x{20CF}\s¢£¤¥₹₨]+"
    return f"regexp_replace(regexp_replace(replace({c}, ',', ''), '^{mark}', ''), '{mark}$', '')"


def s_number(c: str) -> str:
    return rf"CASE WHEN NOT {s_missing(c)} AND regexp_matches({s_normal(c)}, '^[+-]?([0-9][0-9_]*\.?[0-9_]*|\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST(replace({s_normal(c)}, '_', '') AS DOUBLE) END"


def s_email_ok(c: str) -> str:
    e = s_strip(c)
    return rf"coalesce(regexp_matches({e}, '^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}$') AND NOT contains({e}, '..') AND lower(split_part({e}, '@', -1)) NOT IN ({_list(C.THROWAWAY_DOMAINS)}), FALSE)"


def s_clean_email(c: str) -> str:
    fixed = rf"lower(regexp_replace({c}, '\s+', '', 'g'))"
    return f"CASE WHEN {s_email_ok(fixed)} THEN {fixed} ELSE {c} END"


def s_date(c: str, first: str = "FALSE") -> str:
    t = s_strip(c)
    minutes = r":[0-5][0-9](?::[0-5][0-9](?:\.[0-9]+)?)?"
    tail = rf"(?:[T ]+(?:[01]?[0-9]|2[0-3]){minutes}\s*(?:Z|[A-Z]{{3,5}}|[+-][0-9]{{2}}:?[0-9]{{2}})?)?$"
    ymd, dmy, plain = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})" + tail, r"^([0-9]{1,2})[-/.]([0-9]{1,2})[-/.]([0-9]{4})" + tail, "^([0-9]{4})([0-9]{2})([0-9]{2})$"
    g = lambda p, i: f"regexp_extract({t}, '{p}', {i})"
    n = lambda p, i: f"TRY_CAST({g(p, i)} AS INTEGER)"
    mk = lambda y, m, d: f"try_strptime({y} || '-' || {m} || '-' || {d}, '%Y-%m-%d')::DATE"
    behind = f"CASE WHEN {first} AND {n(ymd, 3)} <= 12 THEN {mk(g(ymd, 1), g(ymd, 3), g(ymd, 2))} ELSE {mk(g(ymd, 1), g(ymd, 2), g(ymd, 3))} END"
    before = f"CASE WHEN {n(dmy, 1)} > 12 OR ({first} AND {n(dmy, 2)} <= 12) THEN {mk(g(dmy, 3), g(dmy, 2), g(dmy, 1))} ELSE {mk(g(dmy, 3), g(dmy, 1), g(dmy, 2))} END"
    digits = f"CASE WHEN {first} AND {n(plain, 3)} <= 12 THEN {mk(g(plain, 1), g(plain, 3), g(plain, 2))} ELSE {mk(g(plain, 1), g(plain, 2), g(plain, 3))} END"
    return f"CASE WHEN {s_missing(c)} THEN NULL WHEN regexp_matches({t}, '{ymd}') THEN {behind} WHEN regexp_matches({t}, '{dmy}') THEN {before} WHEN regexp_matches({t}, '{plain}') THEN {digits} END"


def s_time(c: str) -> str:
    t = s_strip(c)
    p = r"(?i)^([0-9]{1,2}):([0-9]{1,2})(?::([0-9]{1,2})(?:\.[0-9]+)?)?\s*(AM|PM)?$"
    iso = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([0-9]{2}):([0-9]{2}):([0-9]{2})(?:\.[0-9]+)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?$"
    g = lambda q, i: f"TRY_CAST(regexp_extract({t}, '{q}', {i}) AS INTEGER)"
    half = f"upper(regexp_extract({t}, '{p}', 4))"
    hour = f"CASE WHEN {half} = '' THEN {g(p, 1)} WHEN {g(p, 1)} <= 12 THEN {g(p, 1)} % 12 + CASE WHEN {half} = 'PM' THEN 12 ELSE 0 END END"
    two = lambda x: f"lpad(({x})::VARCHAR, 2, '0')"
    sec = f"coalesce({g(p, 3)}, 0)"
    return (
        f"CASE WHEN {s_missing(c)} THEN NULL WHEN regexp_matches({t}, '{p}') THEN CASE WHEN {hour} <= 23 AND {g(p, 2)} <= 59 AND {sec} <= 59 THEN {two(hour)} || ':' || {two(g(p, 2))} || ':' || {two(sec)} END "
        f"WHEN regexp_matches({t}, '{iso}') AND try_strptime(substr({t}, 1, 10), '%Y-%m-%d') IS NOT NULL THEN CASE WHEN {g(iso, 1)} = 24 AND {g(iso, 2)} = 0 AND {g(iso, 3)} = 0 THEN '00:00:00' WHEN {g(iso, 1)} <= 23 AND {g(iso, 2)} <= 59 AND {g(iso, 3)} <= 59 THEN {two(g(iso, 1))} || ':' || {two(g(iso, 2))} || ':' || {two(g(iso, 3))} END END"
    )


def s_region(c: str) -> str:
    return s_look(f"upper({s_strip(c)})", {r: r for r in P.RULES} | P.COUNTRY_REGION)


def s_national(phone: str, region: str) -> str:
    t = f"regexp_replace({s_strip(phone)}, '{P.EXTENSION}', '')"
    d = rf"regexp_replace({t}, '\D', '', 'g')"
    far, home = (f"coalesce({s_look(region, x)}, '^$')" for x in (P.ABROAD, P.HOME))
    n = f"nullif(CASE WHEN {t} LIKE '+%' THEN regexp_extract({d}, {far}, 1) WHEN {t} LIKE '00%' THEN regexp_extract(substr({d}, 3), {far}, 1) ELSE coalesce(nullif(regexp_extract({d}, {home}, 1), ''), regexp_extract({d}, {far}, 1)) END, '')"
    trunk = s_look(region, P.TRUNKS)
    return f"CASE WHEN {region} = 'GB' AND regexp_matches({n}, '{P.SET_ASIDE}') THEN NULL ELSE {trunk} || {n} || regexp_extract({s_strip(phone)}, '{P.EXTENSION}', 1) END"


def s_phone_ok(phone: str, country: str) -> str:
    return f"({s_region(country)} IS NULL OR {s_national(phone, s_region(country))} IS NOT NULL)"


# --- registry ------------------------------------------------------------------------------------

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _scalar(name: str, table: str, columns: dict):
    """columns: output -> (function giving its Column, SQL), over the dirty orders or a named table."""

    def run(spark, sf_dir):
        df = dirty_orders(spark, sf_dir) if table == "dirty" else spark.read.parquet(f"{sf_dir}/{table}.parquet")
        return df.select(*[c().alias(k) for k, (c, _) in columns.items()])

    QUERIES[name] = run
    ORACLE_SQL[name] = f"WITH dirty AS ({SQL}) SELECT " + ", ".join(f"{s} AS {k}" for k, (_, s) in columns.items()) + f" FROM {table}"


def _row(*cols: str) -> dict:
    return {c: (lambda c=c: F.col(c), c) for c in (ROW, *cols)}


def _register_scalars() -> None:
    col = F.col
    _scalar("preprocess_nullify", "dirty", {ROW: (lambda: col(ROW), ROW)} | {h: (lambda h=h: C.nullify(col(h)), s_nullify(h)) for h in HEADERS})
    _scalar("missing_predicate", "dirty", {ROW: (lambda: col(ROW), ROW)} | {f"{h}_missing": (lambda h=h: C.is_missing(col(h)), s_missing(h)) for h in HEADERS})
    _scalar("clean_text", "documents", {"doc_id": (lambda: col("doc_id"), "doc_id"), "cleaned": (lambda: C.clean_text(col("text")), s_clean_text("text"))})
    _scalar("text_integrity", "documents", {"doc_id": (lambda: col("doc_id"), "doc_id"), "ok": (lambda: C.text_ok(col("text")), r"NOT regexp_matches(regexp_replace(text, '[\n\r\t]', '', 'g'), '\p{C}')")})
    _scalar("title_case", "part", {"p_partkey": (lambda: col("p_partkey"), "p_partkey"), "titled": (lambda: C.title_case(col("p_name")), s_title("p_name"))})
    _scalar("clean_name", "dirty", _row("customer_name") | {"cleaned": (lambda: C.clean_name(col("customer_name")), s_title(s_clean_text("customer_name")))})
    _scalar("normalize_numeric", "dirty", _row("amount") | {"normalized": (lambda: C.normalize_numeric(col("amount")), s_normal("amount"))})
    _scalar("numeric_valid", "dirty", _row("amount") | {"ok": (lambda: C.to_number(col("amount")).isNotNull(), f"({s_number('amount')}) IS NOT NULL")})
    _scalar("negative_amount", "dirty", _row("amount") | {"negative": (lambda: F.coalesce(C.to_number(col("amount")) < 0, F.lit(False)), f"coalesce(({s_number('amount')}) < 0, FALSE)")})
    _scalar("email_valid", "dirty", _row("email") | {"ok": (lambda: C.email_ok(col("email")), s_email_ok("email"))})
    _scalar("email_standardize", "dirty", _row() | {"email": (lambda: C.clean_email(col("email")), s_clean_email("email"))})
    _scalar("currency_standardize", "dirty", _row() | {"currency": (lambda: C.clean_currency(col("currency")), s_map(f"upper({s_strip('currency')})", C.CURRENCY_FORMS, "currency")), "ok": (lambda: C.currency_ok(col("currency")), f"coalesce(upper({s_strip('currency')}) IN ({_list(C.CURRENCIES)}), FALSE)")})
    _scalar("payment_standardize", "dirty", _row() | {"payment_mode": (lambda: C.clean_payment(col("payment_mode")), s_map(f"lower({s_strip('payment_mode')})", C.PAYMENT_FORMS, "payment_mode")), "ok": (lambda: C.payment_ok(col("payment_mode")), f"coalesce(lower({s_strip('payment_mode')}) IN ({_list(C.PAYMENT_MODES)}), FALSE)")})
    _scalar("country_standardize", "dirty", _row() | {"country": (lambda: C.clean_country(col("country")), s_map(f"upper({s_strip('country')})", C.COUNTRY_FORMS, "country")), "region": (lambda: P.country_region(col("country")), s_region("country"))})
    _scalar("phone_digits", "dirty", _row() | {"digits": (lambda: P.phone_digits(col("phone_number")), r"regexp_replace(phone_number, '\D', '', 'g')")})
    _scalar("phone_valid", "dirty", _row("phone_number", "country") | {"ok": (lambda: P.phone_ok(col("phone_number"), col("country")), s_phone_ok("phone_number", "country"))})
    _scalar("phone_standardize", "dirty", _row() | {"phone": (lambda: P.clean_phone(col("phone_number"), col("country")), f"coalesce({s_national('phone_number', s_region('country'))}, {s_strip('phone_number')})")})
    _scalar("date_standardize", "dirty", _row("transaction_date") | {"standard": (lambda: D.standardize_date(col("transaction_date")), f"coalesce(strftime({s_date('transaction_date')}, '%Y-%m-%d'), transaction_date)"), "ok": (lambda: D.parse_date(col("transaction_date")).isNotNull(), f"({s_date('transaction_date')}) IS NOT NULL")})
    _scalar("date_warnings", "dirty", _row() | {"warning": (lambda: D.date_warning(col("transaction_date"), AS_OF), f"CASE WHEN {s_date('transaction_date')} > DATE '{AS_OF}' THEN 'Future date: ' || transaction_date WHEN year({s_date('transaction_date')}) < 2000 THEN 'Date before year 2000: ' || transaction_date END")})
    _scalar("parse_time", "dirty", _row("transaction_time") | {"standard": (lambda: D.standardize_time(col("transaction_time")), f"coalesce({s_time('transaction_time')}, 'ERROR')")})
    _scalar("time_extraction", "dirty", _row() | {"found": (lambda: F.coalesce(D.parse_time(col("transaction_time")), F.when(C.is_missing(col("transaction_time")), D.parse_time(col("transaction_date")))), f"coalesce({s_time('transaction_time')}, CASE WHEN {s_missing('transaction_time')} THEN {s_time('transaction_date')} END)")})


_register_scalars()
_CTE = f"WITH raw AS ({SQL}), d AS (SELECT _row_id, " + ", ".join(f"{s_nullify(h)} AS {h}" for h in HEADERS) + " FROM raw)"


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return keep


def nullified(spark, sf_dir):
    return profile.nullify_all(dirty_orders(spark, sf_dir), HEADERS)


_LONG = " UNION ALL ".join(f"SELECT '{h}' AS column_name, {h} AS value, _row_id FROM d" for h in HEADERS)
_RATES = f"SELECT column_name, count(value) AS non_empty, count(*) - count(value) AS empty, round_even(count(value) * 100.0::DOUBLE / count(*), 1)::DOUBLE AS completeness FROM ({_LONG}) GROUP BY 1"


@query("column_completeness", f"{_CTE} {_RATES}")
def column_completeness(spark, sf_dir):
    return profile.completeness(nullified(spark, sf_dir), HEADERS)


@query("completeness_score", f"{_CTE} SELECT round_even(avg(completeness), 1)::DOUBLE AS score FROM ({_RATES})")
def completeness_score(spark, sf_dir):
    return column_completeness(spark, sf_dir).agg(F.bround(F.avg("completeness"), 1).alias("score"))


@query("missing_cells", f"{_CTE} SELECT count(*) - count(value) AS missing_cells FROM ({_LONG})")
def missing_cells(spark, sf_dir):
    return profile.missing_cells(nullified(spark, sf_dir), HEADERS)


@query("drop_empty_rows", f"{_CTE} SELECT _row_id FROM d WHERE coalesce(transaction_date, transaction_time, phone_number) IS NOT NULL")
def drop_empty_rows(spark, sf_dir):
    return profile.drop_empty_rows(nullified(spark, sf_dir), ["transaction_date", "transaction_time", "phone_number"]).select(ROW)


@query("empty_row_filter", f"WITH raw AS ({SQL}) SELECT _row_id FROM raw WHERE coalesce(trim(country), '') <> '' OR coalesce(trim(customer_id), '') <> ''")
def empty_row_filter(spark, sf_dir):
    return dirty_orders(spark, sf_dir).where(~C.is_empty_row(F.col("country"), F.col("customer_id"))).select(ROW)


@query("empty_columns", "SELECT 'notes' AS column_name")
def empty_columns(spark, sf_dir):
    df = dirty_orders(spark, sf_dir).withColumn("notes", F.when(F.col(ROW) % 2 == 0, "").otherwise("None"))
    return profile.empty_columns(df, [*HEADERS, "notes"])


_DIGITS = r"regexp_replace(v, '[^0-9.\-]', '', 'g')"
_FILLED = {
    "no_email": f"NOT {s_email_ok('v')}", "times": f"({s_time('v')}) IS NOT NULL", "dates": f"({s_date('v')}) IS NOT NULL", "numbers": f"TRY_CAST({_DIGITS} AS DOUBLE) IS NOT NULL",
    "phones": "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 7 AND 15", "no_boolean": f"lower({s_strip('v')}) NOT IN ('true', 'false', 'yes', 'no', '0', '1', 't', 'f', 'y', 'n')",
}
_TYPES = f"""{_CTE}, c AS (SELECT column_name, coalesce(value, '') AS v FROM ({_LONG})),
t AS (SELECT column_name, count(*) AS n, {", ".join(f"count_if({s_strip('v')} <> '' AND {x}) AS {k}" for k, x in _FILLED.items())} FROM c GROUP BY 1)
SELECT column_name, CASE WHEN no_email = 0 THEN 'Email' WHEN times > 0.7 * n THEN 'Time' WHEN dates > 0.7 * n THEN 'Date' WHEN numbers > 0.8 * n THEN 'Numeric' WHEN phones > 0.7 * n THEN 'Phone' WHEN no_boolean = 0 THEN 'Boolean' ELSE 'Text/String' END AS column_type FROM t"""


@query("column_types", _TYPES)
def column_types(spark, sf_dir):
    return profile.column_types(nullified(spark, sf_dir), HEADERS)


_NUM = r"TRY_CAST(regexp_replace(amount, '[^0-9.\-]', '', 'g') AS DOUBLE)"


@query("profile_numeric", f"{_CTE}, n AS (SELECT {_NUM} AS v FROM d WHERE amount IS NOT NULL) SELECT 'amount' AS column_name, min(v) AS min_value, max(v) AS max_value, round(avg(v), 4) AS mean_value, median(v) AS median_value, round(coalesce(stddev_samp(v), 0), 4) AS std_value FROM n WHERE v IS NOT NULL")
def profile_numeric(spark, sf_dir):
    return profile.numeric_profile(nullified(spark, sf_dir), ["amount"])


@query("profile_text", f"{_CTE} SELECT column_name, count(DISTINCT value) AS distinct_values, round(avg(length(value)), 4) AS mean_length FROM ({_LONG}) WHERE value IS NOT NULL GROUP BY 1")
def profile_text(spark, sf_dir):
    return profile.text_profile(nullified(spark, sf_dir), HEADERS)


@query("top_values", f"{_CTE} SELECT customer_name AS value, count(*) AS n, min(_row_id) AS first_row FROM d WHERE customer_name IS NOT NULL GROUP BY 1 ORDER BY n DESC, first_row LIMIT 10")
def top_values(spark, sf_dir):
    return profile.top_values(nullified(spark, sf_dir), "customer_name")


@query("profile_date", f"{_CTE}, p AS (SELECT {s_date('transaction_date')} AS v FROM d) SELECT strftime(min(v), '%Y-%m-%d') AS min_date, strftime(max(v), '%Y-%m-%d') AS max_date, count(*) FILTER (v > DATE '{AS_OF}') AS future_dates, count(*) FILTER (year(v) < 2000) AS ancient_dates FROM p")
def profile_date(spark, sf_dir):
    return profile.date_profile(nullified(spark, sf_dir), "transaction_date", AS_OF)


@query("profile_time", f"{_CTE}, p AS (SELECT {s_time('transaction_time')} AS v FROM d) SELECT min(v) AS min_time, max(v) AS max_time, count(v) AS valid_times FROM p")
def profile_time(spark, sf_dir):
    return profile.time_profile(nullified(spark, sf_dir), "transaction_time", AS_OF)


_VOTES = """p AS (SELECT regexp_extract(trim(transaction_date), '^([0-9]+)[-/.]([0-9]+)[-/.]([0-9]+)$', ['a', 'b', 'c']) AS g, regexp_extract(transaction_date, '[-/.]') AS mark FROM d WHERE regexp_matches(trim(transaction_date), '^[0-9]+[-/.][0-9]+[-/.][0-9]+$')),
w AS (SELECT mark, CASE WHEN length(g.a) = 4 OR g.a::INT > 31 THEN 'yyyy' WHEN length(g.c) = 4 OR g.c::INT > 31 THEN CASE WHEN g.a::INT > 12 AND g.b::INT <= 12 THEN 'dd' WHEN g.a::INT <= 12 AND g.b::INT > 12 THEN 'mm' ELSE 'ambiguous' END ELSE 'ambiguous' END AS vote FROM p)"""
#: one row: whether the day stands first (undecided: no), the format found and its confidence
ORDER = _VOTES + """, c AS (SELECT count_if(vote = 'yyyy') AS y, count_if(vote = 'dd') AS dd, count_if(vote = 'mm') AS mm, count_if(vote <> 'ambiguous') AS total, mode(mark) AS mark FROM w),
b AS (SELECT *, greatest(y, dd, mm) * 1.0::DOUBLE / total AS best, (y > 0.05 * total)::INT + (dd > 0.05 * total)::INT + (mm > 0.05 * total)::INT AS kinds FROM c),
o AS (SELECT total > 0 AND dd > y AND dd >= mm AND (kinds <= 1 OR best > 0.5) AS dayfirst,
  CASE WHEN total = 0 OR (kinds > 1 AND best <= 0.5) THEN 'Mixed Formats' ELSE CASE WHEN kinds > 1 THEN 'Dominant Format: ' ELSE '' END || replace(CASE WHEN y >= dd AND y >= mm THEN 'yyyy-mm-dd' WHEN dd >= mm THEN 'dd-mm-yyyy' ELSE 'mm-dd-yyyy' END, '-', mark) END AS form,
  CASE WHEN total = 0 THEN 50.0 ELSE round(CASE WHEN best > 0.9 THEN 95 + (best * 100 - 90) * 0.4 ELSE best * 100 END, 1) END::DOUBLE AS sure FROM b)"""


def order(counts: dict) -> tuple[bool | None, str | None, float | None]:
    """``ORDER`` from ``profile.order_counts``.

    Unlike in ``profile.order_of``, which follows the reference, separators count where the cell votes, the first row's of equally frequent
    ones is taken, halves are rounded up, and a column without a vote has no format.
    """
    if not any(counts[k] for k in profile.VOTES):
        return None, None, None
    clear = [counts[k] for k in ("yyyy", "dd", "mm")]
    if not sum(clear):
        return None, "Mixed Formats", 50.0
    mark = min((x for x in D.SEPARATORS if counts[f"voted{x}"]), key=lambda x: (-counts[f"voted{x}"], counts[f"first{x}"]))
    dayfirst, form, _ = D.decide_date_format({k: counts[k] for k in profile.VOTES}, mark)
    best = max(clear) / sum(clear)
    return dayfirst, form, floor((95 + (best * 100 - 90) * 0.4 if best > 0.9 else best * 100) * 10 + 0.5) / 10


@query("date_format_votes", f"{_CTE}, {_VOTES} SELECT vote, count(*) AS n FROM w GROUP BY 1")
def date_format_votes(spark, sf_dir):
    return profile.date_votes(nullified(spark, sf_dir), "transaction_date")


@query("impute_mode", f"""{_CTE}, c AS (SELECT column_name, {s_strip('value')} AS value, count(*) AS n FROM ({_LONG}) WHERE value IS NOT NULL AND lower({s_strip('value')}) NOT IN ({_list(C.EMPTY_WORDS)}) GROUP BY 1, 2)
SELECT column_name, value FROM c QUALIFY row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) = 1""")
def impute_mode(spark, sf_dir):
    return profile.mode_values(nullified(spark, sf_dir), HEADERS)


@query("impute_median", f"{_CTE} SELECT median(TRY_CAST(amount AS DOUBLE)) AS median_value FROM d")
def impute_median(spark, sf_dir):
    return profile.median_value(nullified(spark, sf_dir), "amount")


@query("row_identifier_probe", f"{_CTE} SELECT count(*) AS n, count(*) AS numbers, count(DISTINCT _row_id) AS distinct_values, TRUE AS is_identifier FROM d")
def row_identifier_probe(spark, sf_dir):
    return dedupe.row_identifier_probe(nullified(spark, sf_dir).withColumn("serial", F.col(ROW).cast("string")), "serial")


@query("duplicate_ids", f"{_CTE} SELECT _row_id, transaction_id FROM d QUALIFY count(*) OVER (PARTITION BY transaction_id) > 1")
def duplicate_ids(spark, sf_dir):
    return dedupe.repeated(nullified(spark, sf_dir), C.strip(F.col("transaction_id"))).select(ROW, "transaction_id")


@query("id_duplicates_removed", f"{_CTE} SELECT _row_id, transaction_id FROM d QUALIFY count(*) OVER (PARTITION BY transaction_id) = 1")
def id_duplicates_removed(spark, sf_dir):
    return dedupe.without_repeated(nullified(spark, sf_dir), C.strip(F.col("transaction_id"))).select(ROW, "transaction_id")


@query("duplicate_emails", f"{_CTE} SELECT _row_id, email FROM d WHERE email IS NOT NULL QUALIFY count(*) OVER (PARTITION BY email) > 1")
def duplicate_emails(spark, sf_dir):
    return dedupe.repeated(nullified(spark, sf_dir), C.strip(F.col("email"))).select(ROW, "email")


@query("duplicate_phones", rf"{_CTE} SELECT _row_id, phone_number FROM d WHERE phone_number IS NOT NULL QUALIFY count(*) OVER (PARTITION BY regexp_replace(phone_number, '\D', '', 'g')) > 1")
def duplicate_phones(spark, sf_dir):
    return dedupe.repeated(nullified(spark, sf_dir), P.phone_digits(F.col("phone_number"))).select(ROW, "phone_number")


_KEY = ["country", "currency", "payment_mode", "transaction_date"]
_LAND = s_map("regexp_replace(lower(coalesce(country, '')), '[^0-9a-z]', '', 'g')", dedupe.COUNTRY_KEY, f"lower({s_strip("coalesce(country, '')")})")
_DAY = f"coalesce(strftime({s_date('transaction_date')}, '%Y-%m-%d'), {s_strip('transaction_date')}, '')"
_SKEY = f"""{_CTE}, k AS (SELECT _row_id, {_LAND} || '|' || lower(trim(coalesce(currency, ''))) || '|' || lower(trim(coalesce(payment_mode, ''))) || '|' || {_DAY} AS key FROM d)"""


@query("business_duplicates_later", f"{_SKEY} SELECT _row_id FROM k QUALIFY row_number() OVER (PARTITION BY key ORDER BY _row_id) > 1")
def business_duplicates_later(spark, sf_dir):
    return dedupe.later_copies(nullified(spark, sf_dir), _KEY).select(ROW)


@query("business_duplicates_all", f"{_SKEY} SELECT _row_id FROM k QUALIFY count(*) OVER (PARTITION BY key) > 1")
def business_duplicates_all(spark, sf_dir):
    return dedupe.all_copies(nullified(spark, sf_dir), _KEY).select(ROW)


@query("business_keep_first", f"{_SKEY} SELECT min(_row_id) AS _row_id FROM k GROUP BY key")
def business_keep_first(spark, sf_dir):
    return dedupe.keep_first(nullified(spark, sf_dir), _KEY).select(ROW)


@query("lineitem_key_duplicates", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def lineitem_key_duplicates(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def checked(spark, sf_dir):
    return validate.with_issues(nullified(spark, sf_dir), AS_OF)


_NOTIME = f"({s_missing('transaction_time')} AND ({s_time('transaction_date')}) IS NOT NULL)"


def _issue(rule: str, role: str, severity: str, message: str, when: str, column: str | None = None) -> str:
    return f"SELECT _row_id + 1 AS row_no, '{rule}' AS rule, '{role}' AS role, '{column or role}' AS column_name, {message} AS message, {severity} AS severity FROM d WHERE {when}"


_FULLKEY = " || '|' || ".join(
    {"country": _LAND, "transaction_date": _DAY, "phone_number": r"coalesce(_national, regexp_replace(phone_number, '\D', '', 'g'), '')",
     "transaction_time": f"coalesce({s_time('transaction_time')}, lower({s_strip('transaction_time')}), '')"}.get(h, rf"trim(regexp_replace(lower(coalesce({h}, '')), '\s+', ' ', 'g'))")
    for h in HEADERS
)


def keyed(source: str, more: str = "") -> str:
    """(_row_id, key) of the rows of a table."""
    land = f"SELECT *, {s_region('country')} AS _region FROM {source}"
    return f"SELECT _row_id, {_FULLKEY}{more} AS key FROM (SELECT *, {s_national('phone_number', '_region')} AS _national FROM ({land}))"


_MUST = schema.mandatory("Mixed Dataset")
_ISSUES = " UNION ALL ".join(
    [_issue("mandatory", r, "'CRITICAL'", f"'Missing mandatory field: {r}'", f"{r} IS NULL") for r in _MUST]
    + [_issue("integrity", r, "'ERROR'", f"'Missing value: {r}'", f"{r} IS NULL") for r in HEADERS if r not in _MUST and r != "transaction_time"]
    + [
        "SELECT row_no, 'duplicates' AS rule, 'transaction_id' AS role, 'transaction_id' AS column_name, 'Duplicate transaction ID: ' || transaction_id AS message, 'ERROR' AS severity FROM (SELECT _row_id + 1 AS row_no, transaction_id FROM d WHERE transaction_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY transaction_id) > 1)",
        f"SELECT row_no, 'duplicates', 'duplicate_record', 'Entire_Row', 'Duplicate Record Detected', 'WARNING' FROM (SELECT _row_id + 1 AS row_no FROM ({keyed('d')}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY _row_id) > 1)",
        _issue("email", "email", "'ERROR'", "'Invalid email format: ' || email", f"email IS NOT NULL AND NOT {s_email_ok('email')}"),
        _issue("country", "country", "'WARNING'", "'Unknown country: ' || country", f"phone_number IS NOT NULL AND country IS NOT NULL AND {s_region('country')} IS NULL"),
        _issue("phone", "phone_number", "'ERROR'", "'Invalid phone format: ' || phone_number", f"phone_number IS NOT NULL AND NOT {s_phone_ok('phone_number', 'country')}"),
        _issue("date", "transaction_date", "'ERROR'", "'Invalid date format: ' || transaction_date", f"transaction_date IS NOT NULL AND ({s_date('transaction_date')}) IS NULL"),
        _issue("none", "transaction_date", "'INFO'", "'Future date: ' || transaction_date", f"{s_date('transaction_date')} > DATE '{AS_OF}'"),
        _issue("none", "transaction_date", "'WARNING'", "'Date before year 2000: ' || transaction_date", f"year({s_date('transaction_date')}) < 2000"),
        _issue("time", "transaction_time", "'ERROR'", "'Missing Time'", f"transaction_time IS NULL AND ({s_time('transaction_date')}) IS NULL"),
        _issue("time", "transaction_time", "'ERROR'", "'Invalid Time: ' || transaction_time", f"transaction_time IS NOT NULL AND ({s_time('transaction_time')}) IS NULL"),
        _issue("integrity", "amount", "'ERROR'", f"CASE WHEN ({s_number('amount')}) IS NULL THEN 'Invalid numeric amount: ' ELSE 'Negative amount: ' END || amount", f"NOT {_NOTIME} AND amount IS NOT NULL AND coalesce(({s_number('amount')}) < 0, TRUE)"),
        _issue("integrity", "customer_name", "'ERROR'", "'Corrupted text: ' || customer_name", rf"NOT {_NOTIME} AND regexp_matches(regexp_replace(customer_name, '[\n\r\t]', '', 'g'), '\p{{C}}')"),
        _issue("currency", "currency", "'WARNING'", "'Invalid currency code: ' || currency", f"NOT {_NOTIME} AND upper(trim(currency)) NOT IN ({_list(C.CURRENCIES)})"),
        _issue("payment_mode", "payment_mode", "'WARNING'", "'Invalid payment mode: ' || payment_mode", f"NOT {_NOTIME} AND lower(trim(payment_mode)) NOT IN ({_list(C.PAYMENT_MODES)})"),
    ]
)
_LOG = f"{_CTE}, log AS ({_ISSUES})"


@query("issue_log", f"{_LOG} SELECT * FROM log")
def issue_log(spark, sf_dir):
    return validate.issue_log(checked(spark, sf_dir)).drop("seq")


_AFFECTED = ", ".join(f"(SELECT count(DISTINCT row_no) FROM log WHERE rule = '{r}') AS {r}" for r in validate.RULES)
_STATUSES = " UNION ALL ".join(f"SELECT '{r}' AS rule, {r} AS affected_rows, CASE WHEN {r} > 0 THEN 'FAILED' ELSE 'PASSED' END AS status FROM h" for r in validate.RULES)


# the table has every column that a rule needs, so none is skipped and the schema passes
@query("rule_summary", f"{_LOG}, h AS (SELECT {_AFFECTED}) {_STATUSES} UNION ALL SELECT 'schema', 0, 'PASSED'")
def rule_summary(spark, sf_dir):
    return validate.rule_summary(checked(spark, sf_dir))


_CLASS = f"{_LOG}, s AS (SELECT _row_id, max(CASE WHEN severity IN ('ERROR', 'CRITICAL') THEN 2 WHEN severity IS NOT NULL THEN 1 ELSE 0 END) AS worst FROM d LEFT JOIN log ON row_no = _row_id + 1 GROUP BY 1)"


@query("row_classification", f"{_CLASS} SELECT count(*) AS total_records, count(*) FILTER (worst < 2) AS valid_records, count(*) FILTER (worst = 2) AS invalid_records, count(*) FILTER (worst = 1) AS warning_records, round_even(count(*) FILTER (worst < 2) * 100.0::DOUBLE / count(*), 1)::DOUBLE AS success_rate FROM s")
def row_classification(spark, sf_dir):
    return validate.row_classification(checked(spark, sf_dir))


# rules in the order in which a row lists its issues
_PLACE = f"""(CASE WHEN rule = 'mandatory' THEN 0 WHEN message LIKE 'Missing value%' THEN 1 WHEN rule = 'duplicates' THEN CASE WHEN role = 'transaction_id' THEN 2 ELSE 3 END
  ELSE 4 + list_position(['email', 'country', 'phone_number', 'transaction_date', 'transaction_time', 'amount', 'currency', 'payment_mode', 'customer_name'], role) END) * 100 + coalesce(list_position([{_list(_MUST)}], role), 50 + list_position([{_list(list(schema.ALIASES))}], role), 0)"""


@query("failed_rows_sample", f"{_LOG} SELECT row_no, first(message ORDER BY {_PLACE}) AS reason FROM log WHERE severity IN ('ERROR', 'CRITICAL') GROUP BY 1 ORDER BY row_no LIMIT 10")
def failed_rows_sample(spark, sf_dir):
    return validate.failed_rows(checked(spark, sf_dir))


_FRIENDLY = """CASE WHEN contains(message, 'Missing') THEN 'Missing ' || role WHEN role = 'email' THEN 'Invalid Email' WHEN role = 'phone_number' THEN 'Invalid Phone' WHEN role = 'duplicate_record' THEN 'Duplicate Business Record'
  WHEN role = 'currency' THEN 'Invalid Currency Code' WHEN role = 'payment_mode' THEN 'Invalid Payment Mode' WHEN role = 'country' THEN 'Unknown Country'
  WHEN role = 'transaction_date' THEN CASE WHEN contains(message, 'Future') THEN 'Future Date' WHEN contains(message, 'before year 2000') THEN 'Ancient Date' ELSE 'Invalid Date' END
  WHEN role = 'transaction_time' THEN 'Invalid Time' WHEN role = 'transaction_id' AND contains(message, 'Duplicate') THEN 'Duplicate Transaction'
  WHEN role = 'amount' THEN CASE WHEN contains(message, 'Negative') THEN 'Negative Amount' ELSE 'Invalid Amount' END WHEN role = 'customer_name' AND contains(message, 'Corrupted') THEN 'Corrupted Text' ELSE 'General Validation Issue' END"""
_SUMMARY = f"""{_LOG}, i AS (SELECT {_FRIENDLY} AS rule, *, CASE WHEN contains(message, ': ') THEN split_part(message, ': ', -1) END AS value FROM (SELECT * EXCLUDE (rule) FROM log)),
s AS (SELECT rule, column_name, count(*) AS n, min(row_no) AS first_row, first(severity ORDER BY row_no) AS severity, first(split_part(message, ': ', 1) ORDER BY row_no) AS message FROM i GROUP BY 1, 2),
v AS (SELECT rule, column_name, value, min(row_no) AS place FROM i WHERE value <> '' GROUP BY 1, 2, 3),
x AS (SELECT rule, column_name, list(value ORDER BY place)[1:5] AS examples FROM v GROUP BY 1, 2)
SELECT s.*, coalesce(array_to_string(x.examples, ' | '), '') AS examples, CASE WHEN contains(lower(rule), 'country') OR contains(lower(rule), 'payment') THEN 'Manual Review' WHEN contains(lower(rule), 'missing') THEN 'Imputation' WHEN contains(lower(rule), 'duplicate') THEN 'Deduplicate' ELSE 'Standardize' END AS recoverability FROM s LEFT JOIN x USING (rule, column_name)"""


@query("issue_summary", _SUMMARY)
def issue_summary(spark, sf_dir):
    t = validate.issue_summary(validate.issue_log(checked(spark, sf_dir)))
    return t.withColumns({"recoverability": validate.recoverability(F.col("rule"), F.col("column_name")), "examples": F.array_join("examples", " | ")})


_CHUNKS = "SELECT floor(k / 1000)::BIGINT + 1 AS chunk_id, count(*) AS n, min(k) AS first_row, max(k) AS last_row FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS k FROM orders) GROUP BY 1"


@query("chunk_sizes", _CHUNKS)
def chunk_sizes(spark, sf_dir):
    from veracity.sources.tables import with_row_ids

    rows = with_row_ids(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"))
    return chunk.assign_chunks(rows, 1000).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first_row"), F.max(ROW).alias("last_row"))


@query("preview_rows", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 10")
def preview_rows(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus").orderBy("o_orderkey").limit(10)


@query("csv_metadata", "SELECT count(*) AS row_count, 6::BIGINT AS column_count FROM orders")
def csv_metadata(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.lit(len(df.columns)).cast("long").alias("column_count"))


def _schema_facts(spark, sf_dir):
    roles, kind = schema.resolve_roles(HEADERS), schema.classify(HEADERS)
    return spark.createDataFrame([(kind, schema.confidence(roles, kind), len(roles), "; ".join(schema.schema_warnings(roles, kind)))], "dataset_type string, schema_confidence long, roles long, warnings string")


QUERIES["schema_resolution"] = _schema_facts
ORACLE_SQL["schema_resolution"] = "SELECT 'Mixed Dataset' AS dataset_type, 100::BIGINT AS schema_confidence, 11::BIGINT AS roles, '' AS warnings"
