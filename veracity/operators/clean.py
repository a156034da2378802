"""Cleaning in STRICT, SMART or SOFT mode: standardised cells, audit trail and routes.

Steps depend on each other only in stages (country before phone and date, date before time), so a
row is cleaned in a few projections.  What they need to know of the whole table (values to impute,
empty columns, order of day and month, columns of the business key) is worked out first.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.functions import cells as C
from veracity.functions import phone as P
from veracity.functions import temporal as D
from veracity.operators.dedupe import business_key, record_columns
from veracity.operators.profile import exact_median, has_value, mode_values, order_counts, order_of, rating, with_order
from veracity.operators.schema import classify, mandatory, resolve_roles
from veracity.sources.tables import ROW, stored

IMPUTED = ("customer_name", "country", "amount", "currency", "payment_mode")
ENTRY = "struct<step:int,column:string,original:string,cleaned:string,action:string,severity:string>"
FLAW = "struct<column:string,original:string,message:string,severity:string>"


@dataclass(frozen=True)
class Facts:
    """What cleaning knows of the whole table."""

    values: dict[str, str] = field(default_factory=dict)
    empty: tuple[str, ...] = ()
    dayfirst: bool | None = None
    date_format: str | None = "unknown"
    date_confidence: float | None = 0.0
    keys: tuple[str, ...] = ()


@dataclass(frozen=True)
class CleanResult:
    rows: DataFrame
    cleaned: DataFrame
    errors: DataFrame
    warnings: DataFrame
    duplicates: DataFrame
    removed: DataFrame
    audit: DataFrame
    stats: DataFrame
    removed_columns: tuple[str, ...] = ()
    date_format: str = "unknown"
    date_confidence: float = 0.0


def analyse(df: DataFrame, mode: str = "SMART", decide: Callable[[dict], tuple] = order_of) -> Facts:
    """What cleaning has to know of the whole table beforehand.

    One aggregation finds the columns without a value, the order of day and month and whether amounts are
    numbers; SMART mode takes one more for the most frequent values and those of ``exact_median``.
    ``decide`` finds the order, format and confidence of dates from ``profile.order_counts``.
    """
    headers = [c for c in df.columns if c != ROW]
    roles, keys = resolve_roles(headers), tuple(record_columns(df))
    if not headers:
        return Facts(keys=keys)
    cell = lambda r: F.col(f"`{roles[r]}`")
    aggs = {f"full_{i}": has_value(F.col(f"`{h}`")) for i, h in enumerate(headers)}
    order = order_counts() if "transaction_date" in roles else {}
    aggs |= {f"order_{k}": c for k, c in order.items()}
    if "amount" in roles:
        aggs |= {"numbers": F.count_if(C.to_double(cell("amount")).isNotNull()), "amounts": F.count(cell("amount"))}
    got = (with_order(df, cell("transaction_date")) if order else df).agg(*[c.alias(k) for k, c in aggs.items()]).first().asDict()
    values, imputed = {}, {h: r for r, h in roles.items() if r in IMPUTED}
    if mode == "SMART" and imputed:
        values = {imputed[r["column_name"]]: r["value"] for r in mode_values(df, list(imputed)).collect()}
        if "amount" in roles and got["numbers"] > 0.8 * got["amounts"]:
            m = exact_median(df.select(C.to_double(cell("amount")).alias("v")), "v")
            values["amount"] = str(int(m)) if m == int(m) else str(m)
    found = decide({k: got[f"order_{k}"] for k in order}) if order else (None, "unknown", 0.0)
    return Facts(values, tuple(h for i, h in enumerate(headers) if not got[f"full_{i}"]), *found, keys)


def _entry(step: int, column: str, original: Column, cleaned: Column, action: Column | str, severity: str, when: Column) -> Column:
    return F.when(when, F.struct(F.lit(step).alias("step"), F.lit(column).alias("column"), original.alias("original"), cleaned.alias("cleaned"), (action if isinstance(action, Column) else F.lit(action)).alias("action"), F.lit(severity).alias("severity")))


def clean(df: DataFrame, mode: str = "SMART", dayfirst: bool | None = None, values: dict[str, str] | None = None, facts: Facts | None = None, as_of: str | None = None, audit: bool = True) -> DataFrame:
    """``df`` (nullified, with row ids) cleaned, plus row_status, route, has_warning, corrections and audit entries.

    Rows without any value are left out.  A row whose id (the customer's in a customer dataset) stands
    in several rows is a duplicate: it is not cleaned further.  Errors go to ``errors``, else warnings
    to ``warnings`` where the mode drops them, the rest is ``cleaned``; SOFT keeps every row.  The order
    of day and month is inferred from the whole date column unless ``dayfirst`` is given; undecided
    columns and rows of the US have the month first.  Dates after ``as_of`` (today) are warned of.
    Columns without any value take no part.  Without ``audit`` entries are only counted and there is no such column.
    """
    headers = [c for c in df.columns if c != ROW]
    facts = analyse(df, mode) if facts is None else facts
    roles, kind = {r: h for r, h in resolve_roles(headers).items() if h not in facts.empty}, classify(headers)
    must = mandatory(kind)
    values = facts.values if values is None else values
    dayfirst = bool(facts.dayfirst) if dayfirst is None else dayfirst
    today = F.current_date() if as_of is None else F.lit(as_of).cast("date")
    id_role = "customer_id" if kind == "Customer Dataset" else "transaction_id"
    t = df.where(~C.is_empty_row(*[F.col(f"`{h}`") for h in headers])) if headers else df
    if id_role in roles:
        ident = F.col(f"`{roles[id_role]}`")
        many = df.where(~C.is_missing(ident)).groupBy(C.strip(ident).alias("_id")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        t = t.join(many, C.strip(ident) == F.col("_id"), "left").withColumn("_dup", F.col("_n").isNotNull())
    else:
        t = t.withColumn("_dup", F.lit(False))
    # the trimmed cells, and whether they are missing, once for all stages; those left as they are keep their white space
    raw = {r: f"_raw_{r}" for r in roles}
    if roles:
        t = C.stage(t, {raw[r]: C.strip(F.col(f"`{h}`")) for r, h in roles.items()} | {f"_missing_{r}": C.is_missing_trimmed(C.strip(F.col(f"`{h}`"))) for r, h in roles.items()})
    entries: list[Column] = []
    errors: list[Column] = []
    warnings: list[Column] = []
    out: dict[str, Column] = {}

    def cell(role: str) -> Column:
        return F.col(raw[role])

    def absent(role: str) -> Column:
        return F.col(f"_missing_{role}")

    def given(role: str) -> Column:
        """The cell, or in SMART mode the value imputed for it."""
        if role in IMPUTED and role in values:
            return F.when(absent(role), F.lit(values[role])).otherwise(cell(role))
        return cell(role)

    country = C.clean_country(given("country")) if "country" in roles else F.lit(None).cast("string")
    if "country" in roles:
        t = C.stage(t, {"_country": country, "_region": P.country_region(country)})
        country, region = F.col("_country"), F.col("_region")
    else:
        region = F.lit(None).cast("string")
    day = F.when(region == "US", F.lit(False)).otherwise(F.lit(dayfirst))
    parsed = {"_date": D.parse_date(cell("transaction_date"), day)} if "transaction_date" in roles else {}
    if "phone_number" in roles:
        parsed["_number"] = P.national_number(given("phone_number"), region)
    if parsed:
        t = C.stage(t, parsed)
    standard = {
        "transaction_id": C.clean_text, "customer_id": C.clean_text, "customer_name": C.clean_name, "country": lambda c: country, "phone_number": lambda c: F.coalesce(F.col("_number"), c), "amount": lambda c: c,
        "currency": C.clean_currency, "payment_mode": C.clean_payment, "email": (lambda c: C.clean_email(c)) if mode == "SMART" else (lambda c: F.when(C.email_ok(c), F.lower(c)).otherwise(c)),
    }
    action = {"phone_number": "phone_normalization", "transaction_date": "date_standardization", "email": "email_cleanup", "currency": "currency_mapping", "payment_mode": "payment_mode_mapping", "country": "country_mapping"}
    # a stage of its own for the new cells: entries and errors below only refer to them
    news: dict[str, Column] = {}
    for role in roles:
        c, missing = cell(role), absent(role)
        if role == "transaction_date":
            news[f"_new_{role}"] = F.when(missing, "ERROR").when(F.col("_date").isNotNull(), F.date_format("_date", "yyyy-MM-dd")).otherwise(c)
        elif role == "transaction_time":
            from_date = D.parse_time(cell("transaction_date")) if "transaction_date" in roles else F.lit(None).cast("string")
            news[f"_new_{role}"] = F.coalesce(F.when(missing, from_date).otherwise(D.parse_time(c)), F.lit("ERROR"))
        else:
            news[f"_new_{role}"] = standard[role](given(role))
            if role == "amount":
                news["_number_of_amount"] = C.to_number(given(role))
    if news:
        t = C.stage(t, news)
    blank = lambda c: F.coalesce(c, F.lit(""))
    flaw = lambda header, original, message, severity="ERROR": F.struct(F.lit(header).alias("column"), blank(original).alias("original"), (message if isinstance(message, Column) else F.lit(message)).alias("message"), F.lit(severity).alias("severity"))
    for step, (role, header) in enumerate(roles.items()):
        c, missing, new = cell(role), absent(role), F.col(f"_new_{role}")
        was = given(role)
        unfilled = missing & C.is_missing(F.lit(values[role])) if role in IMPUTED and role in values else missing
        if role == "transaction_date":
            errors.append(F.when(missing, flaw(header, c, "Missing Date")).when(F.col("_date").isNull(), flaw(header, c, "Invalid date")))
            warning = D.warning_of(F.col("_date"), new, today)
            warnings.append(F.when(warning.isNotNull(), flaw(header, c, warning)))
        elif role == "transaction_time":
            source = cell("transaction_date") if "transaction_date" in roles else F.lit("")
            entries.append(_entry(step * 4, header, blank(source), new, "Time Extraction", "INFO", missing & (new != "ERROR")))
            errors.append(F.when(new == "ERROR", flaw(header, c, F.when(missing, "Missing Time").otherwise("Invalid Time"))))
        else:
            if role in IMPUTED and role in values:
                entries.append(_entry(step * 4, header, F.lit(""), F.lit(values[role]), "missing_imputation", "INFO", missing))
            elif role in must:
                errors.append(F.when(missing, flaw(header, c, "Missing mandatory field", "CRITICAL")))
            else:
                warnings.append(F.when(missing, flaw(header, c, f"Missing optional: {header}")))
            bad = {
                "phone_number": ("Invalid phone format", lambda x: region.isNotNull() & F.col("_number").isNull()), "email": ("Invalid email format", lambda x: ~C.email_ok(x)),
                "currency": ("Unsupported currency code", lambda x: ~C.currency_ok(x)), "payment_mode": ("Unsupported payment mode", lambda x: ~C.payment_ok(x)),
            }.get(role)
            if bad:
                errors.append(F.when(~C.is_missing(new) & bad[1](new), flaw(header, was, bad[0])))
            if role == "amount" and kind != "Customer Dataset":
                errors.append(F.when(~unfilled, F.when(F.col("_number_of_amount").isNull(), flaw(header, was, "Invalid numeric amount")).when(F.col("_number_of_amount") < 0, flaw(header, was, "Negative amount"))))
        what = "Time Standardization" if role == "transaction_time" else action.get(role, "whitespace_trim")
        changed = F.coalesce(new != was, F.lit(False))
        entries.append(_entry(step * 4 + 1, header, was, new, what, "INFO", ~unfilled & changed & (new != "ERROR")))
        out[header] = F.when(F.col("_dup") | ~(changed | missing), F.col(f"`{header}`")).otherwise(new)
    if audit:
        t = C.listed(C.listed(t, {"_errors": errors, "_warnings": warnings}, FLAW), {"_done": entries}, ENTRY)
        last = F.lit(len(roles) * 4 + 1)
        failed = F.transform("_errors", lambda e: F.struct(last.alias("step"), e["column"].alias("column"), e["original"].alias("original"), F.lit("ERROR").alias("cleaned"), e["message"].alias("action"), e["severity"].alias("severity")))
        only = F.array(F.struct(F.lit(0).alias("step"), F.lit(roles.get(id_role, "")).alias("column"), F.col(f"`{roles[id_role]}`") if id_role in roles else F.lit(None).cast("string"), F.lit("DELETED").alias("cleaned"), F.lit("duplicate_removal").alias("action"), F.lit("ERROR").alias("severity"))).cast(f"array<{ENTRY}>")
        trail = [F.when(F.col("_dup"), only).otherwise(F.concat(F.col("_done").cast(f"array<{ENTRY}>"), failed.cast(f"array<{ENTRY}>"))).alias("audit")]
        bad, warned, corrections = F.size("_errors") > 0, F.size("_warnings") > 0, F.size("_done")
    else:
        count = lambda items: sum([F.when(x.isNotNull(), 1).otherwise(0) for x in items], F.lit(0))
        t = C.stage(t, {"_errors": count(errors), "_warnings": count(warnings), "_done": count(entries)})
        trail, bad, warned, corrections = [], F.col("_errors") > 0, F.col("_warnings") > 0, F.col("_done")
    status = F.when(F.col("_dup"), "CRITICAL").when(bad, "ERROR").when(warned, "WARNING").otherwise("VALID")
    route = F.when(F.col("_dup"), "duplicates").when(bad, "errors").when(warned, "warnings" if mode == "STRICT" else "cleaned").otherwise("cleaned")
    return t.select(
        ROW, *[out[h].alias(h) if h in out else F.col(f"`{h}`") for h in headers], status.alias("row_status"), (F.lit("cleaned") if mode == "SOFT" else route).alias("route"),
        warned.alias("has_warning"), corrections.alias("corrections"), *trail,
    )


def remove_copies(rows: DataFrame, keys: list[str] | tuple[str, ...], headers: list[str], mode: str = "SMART") -> DataFrame:
    """Cleaned rows that repeat an earlier one's business key go to ``duplicates``, with an audit entry that holds the row.

    In SOFT mode the status is part of the key.  ``copy`` marks the rows.  ``rows`` are read twice here
    and once for every output, so they are written to the shared folder first, by columns.
    """
    rows = stored(rows, "rows")
    if not keys:
        return rows.withColumn("copy", F.lit(False))
    kept = business_key(rows.where("route = 'cleaned'"), [*keys, *(["row_status"] if mode == "SOFT" else [])], "_key").select(ROW, "_key")
    first = kept.groupBy("_key").agg(F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("_same")).where("_same > 1").select("_key", "_first")
    later = kept.join(first, "_key").where(F.col(ROW) > F.col("_first")).select(F.col(ROW).alias("_later"))
    t = rows.join(later, F.col(ROW) == F.col("_later"), "left").withColumn("copy", F.col("_later").isNotNull()).drop("_later")
    if "audit" not in rows.columns:
        return t.withColumn("route", F.when(F.col("copy"), "duplicates").otherwise(F.col("route")))
    whole = F.to_json(F.struct(*[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(h) for h in headers]))
    entry = F.array(F.struct(F.lit(1 << 20).alias("step"), F.lit("Entire_Row").alias("column"), whole.alias("original"), F.lit("DELETED").alias("cleaned"), F.lit("Duplicate Removed").alias("action"), F.lit("INFO").alias("severity"))).cast(f"array<{ENTRY}>")
    return t.withColumns({"route": F.when(F.col("copy"), "duplicates").otherwise(F.col("route")), "audit": F.when(F.col("copy"), F.concat("audit", entry)).otherwise(F.col("audit"))})


def audit_trail(rows: DataFrame) -> DataFrame:
    """row_no (from 1, of the table cleaned), seq, column_name, original, cleaned, action, severity."""
    return rows.select((F.col(ROW) + 1).alias("row_no"), F.posexplode("audit").alias("seq", "a")).select("row_no", "seq", F.col("a.column").alias("column_name"), "a.original", "a.cleaned", "a.action", "a.severity")


#: counters and the actions of the audit trail that they count
FIXED = {
    "phones_fixed": ("phone_normalization",), "emails_fixed": ("email_cleanup",), "dates_fixed": ("date_standardization",), "times_fixed": ("Time Standardization", "Time Extraction"),
    "currencies_fixed": ("currency_mapping",), "countries_fixed": ("country_mapping",), "payment_modes_fixed": ("payment_mode_mapping",), "rows_imputed": ("missing_imputation",),
}


def cleaning_stats(rows: DataFrame, facts: Facts | None = None, empty_rows: int = 0, mode: str = "SMART") -> DataFrame:
    """The counters of a run and the scores of what it leaves, one row; ``rows`` are those of ``remove_copies`` or of ``clean``."""
    facts, hit = facts or Facts(), F.count_if
    rows = rows if "copy" in rows.columns else rows.withColumn("copy", F.lit(False))
    count = lambda actions: F.coalesce(F.sum(F.size(F.filter("audit", lambda a: a["action"].isin(*actions)))), F.lit(0)).cast("long")
    copy, dup = F.col("copy"), F.col("row_status") == "CRITICAL"
    t = rows.agg(
        F.count(F.lit(1)).alias("total_processed"), hit((F.col("corrections") > 0) & ~dup).alias("rows_corrected"), hit(F.col("route") != "cleaned").alias("rows_removed"), hit(F.col("route") == "cleaned").alias("rows_retained"),
        *[count(actions).alias(name) for name, actions in FIXED.items()], (hit(dup) + hit(copy)).alias("duplicates_removed"), hit((F.col("route") == "cleaned") & (F.col("row_status") == "ERROR")).alias("invalid_rows"),
    )
    kept = F.col("rows_retained")
    valid = F.bround(F.when(kept > 0, (kept - F.col("invalid_rows")) * 100.0 / kept).otherwise(100.0), 1)
    t = t.withColumns({"empty_rows_removed": F.lit(empty_rows).cast("long"), "empty_columns_removed": F.lit(len(facts.empty)).cast("long"), "total_records": kept, "unique_records": kept, "valid_rows": kept - F.col("invalid_rows"), "completeness_score": F.lit(100.0), "uniqueness_score": F.lit(100.0), "validity_score": valid, "success_rate": valid})
    t = t.withColumn("quality_score", F.bround(0.3 * F.col("completeness_score") + 0.5 * F.col("validity_score") + 0.2 * F.col("uniqueness_score"), 1))
    return t.withColumns({"quality_rating": rating(F.col("quality_score")), "detected_date_format": F.lit(facts.date_format).cast("string"), "date_confidence_score": F.when(F.lit(facts.date_confidence is not None), f"{facts.date_confidence}%" if facts.date_confidence else "0%")})


def clean_table(df: DataFrame, mode: str = "SMART", dayfirst: bool | None = None, as_of: str | None = None) -> CleanResult:
    """All outputs of a cleaning run; columns without any value are in none of them.

    ``removed`` holds errors and warnings in STRICT mode, errors otherwise.
    """
    facts = analyse(df, mode)
    headers = [c for c in df.columns if c != ROW and c not in facts.empty]
    keys = [k for k in facts.keys if k not in facts.empty]
    rows = remove_copies(clean(df, mode, dayfirst, facts=facts, as_of=as_of), keys, headers, mode)
    status = [F.col("row_status").alias("status")] if mode == "SOFT" else []
    pick = lambda what: rows.where(what).select(ROW, *headers)
    failed, warned = "row_status = 'ERROR'", "has_warning and row_status = 'WARNING'"
    cleaned = rows.where("route = 'cleaned'").select(ROW, *headers, *status)
    every = [F.col(f"`{c}`") for c in df.columns if c != ROW]
    empty_rows = df.where(C.is_empty_row(*every)).count() if every else 0
    removed = pick(f"{failed} or {warned}") if mode == "STRICT" else pick(failed)
    return CleanResult(rows, cleaned, pick(failed), pick(warned), pick("copy or row_status = 'CRITICAL'"), removed, audit_trail(rows), cleaning_stats(rows, facts, empty_rows, mode), facts.empty, facts.date_format, facts.date_confidence)


#: actions that count as repairs in the resolution rate
REPAIRS = ("duplicate_removal", "phone_normalization", "date_standardization", "email_cleanup", "currency_mapping", "missing_imputation")


def cleaning_rates(rows: DataFrame) -> DataFrame:
    """Retention and correction rates of all rows and the share of repairs among repairs and removals (percent, one decimal)."""
    t = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("route") == "cleaned").alias("kept"), F.count_if((F.col("corrections") > 0) & (F.col("row_status") != "CRITICAL")).alias("corrected"),
        F.coalesce(F.sum(F.size(F.filter("audit", lambda a: a["action"].isin(*REPAIRS)))), F.lit(0)).alias("repairs"),
    )
    rate = lambda part, whole: F.bround(F.when(whole == 0, 0.0).otherwise(part * 100.0 / whole), 1)
    return t.select(rate(F.col("kept"), F.col("n")).alias("retention_rate"), rate(F.col("corrected"), F.col("n")).alias("correction_rate"), rate(F.col("repairs"), F.col("repairs") + F.col("n") - F.col("kept")).alias("resolution_rate"))


def audit_search(trail: DataFrame, text: str = "", severity: str | None = None, action: str | None = None) -> DataFrame:
    """Entries of one severity and action whose fields hold ``text`` in any case."""
    t = trail if severity is None else trail.where(F.col("severity") == severity)
    t = t if action is None else t.where(F.col("action") == action)
    return t.where(F.lower(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in trail.columns])).contains(text.lower())) if text else t
