"""Row rules as one array of issues per row, and what follows from it.

A rule is a role, a severity and a Column that gives its message or null.  Rules are kept in a list
so that users can add their own; a table is validated in one projection, duplicates excepted.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.functions import cells as C
from veracity.functions import phone as P
from veracity.functions import temporal as D
from veracity.operators.dedupe import business_key, record_columns
from veracity.operators.schema import classify, is_identifier, mandatory, resolve_roles, schema_warnings
from veracity.sources.tables import ROW, stored


ISSUE = "struct<rule:string,role:string,column:string,message:string,severity:string>"


@dataclass(frozen=True)
class Rule:
    """``message(cells, kind)`` gives the issue's text or null; ``set_`` names the rule in summaries."""

    set_: str
    role: str
    severity: str
    message: Callable[[dict[str, Column]], Column]
    needs: tuple[str, ...] = ()


def _present(c: Column) -> Column:
    return ~C.is_missing(c)


def _say(bad: Column, text: str, c: Column) -> Column:
    return F.when(bad, F.concat(F.lit(text), c))


def rules(kind: str, as_of: str) -> list[Rule]:
    """The built-in rules in the order in which a row's issues are listed; warnings follow all errors."""
    out = [
        Rule("email", "email", "ERROR", lambda v: _say(_present(v["email"]) & ~C.email_ok(v["email"]), "Invalid email format: ", v["email"])),
        Rule("country", "country", "WARNING", lambda v: _say(_present(v["phone_number"]) & _present(v["country"]) & v["region!"].isNull(), "Unknown country: ", v["country"]), ("phone_number",)),
        Rule("phone", "phone_number", "ERROR", lambda v: _say(_present(v["phone_number"]) & v["region!"].isNotNull() & v["number!"].isNull(), "Invalid phone format: ", v["phone_number"]), ("country",)),
        Rule("date", "transaction_date", "ERROR", lambda v: _say(_present(v["transaction_date"]) & v["date!"].isNull(), "Invalid date format: ", v["transaction_date"])),
        Rule("none", "transaction_date", "INFO", lambda v: D.warning_of(v["date!"], v["transaction_date"], as_of)),
        Rule("time", "transaction_time", "ERROR", lambda v: F.when(C.is_missing(v["transaction_time"]), F.when(~_time_from_date(v), F.lit("Missing Time"))).when(v["time!"].isNull(), F.concat(F.lit("Invalid Time: "), v["transaction_time"]))),
    ]
    tail = lambda v: ~_time_from_date(v)
    if kind != "Customer Dataset":
        number = lambda v: F.when(v["amount!"].isNull(), F.concat(F.lit("Invalid numeric amount: "), v["amount"])).when(v["amount!"] < 0, F.concat(F.lit("Negative amount: "), v["amount"]))
        out += [
            Rule("integrity", "amount", "ERROR", lambda v: F.when(tail(v) & _present(v["amount"]), number(v))),
            Rule("currency", "currency", "WARNING", lambda v: _say(tail(v) & _present(v["currency"]) & ~C.currency_ok(v["currency"]), "Invalid currency code: ", v["currency"])),
            Rule("payment_mode", "payment_mode", "WARNING", lambda v: _say(tail(v) & _present(v["payment_mode"]) & ~C.payment_ok(v["payment_mode"]), "Invalid payment mode: ", v["payment_mode"])),
        ]
    return [*out, Rule("integrity", "customer_name", "ERROR", lambda v: _say(tail(v) & _present(v["customer_name"]) & ~C.text_ok(v["customer_name"]), "Corrupted text: ", v["customer_name"]))]


def _time_from_date(v: dict[str, Column]) -> Column:
    """The time cell is missing and the date cell holds one: the checks behind the time are left out."""
    if "transaction_time" not in v or "transaction_date" not in v:
        return F.lit(False)
    return C.is_missing(v["transaction_time"]) & v["date time!"].isNotNull()


def parsed(df: DataFrame, roles: dict[str, str]) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with what its cells mean, worked out once, and the columns by role; names with ! are the meanings.

    region!, number!, date!, time!, amount! and date time! (the time of day in the date cell).
    """
    v = {r: F.col(f"`{h}`") for r, h in roles.items()}
    none = F.lit(None).cast("string")
    first = {"_region": P.country_region(v["country"]) if "country" in v else none}
    if "transaction_date" in v:
        first |= {"_date": D.parse_date(v["transaction_date"]), "_date_time": D.parse_time(v["transaction_date"])}
    if "transaction_time" in v:
        first["_time"] = D.parse_time(v["transaction_time"])
    if "amount" in v:
        first["_amount"] = C.to_number(v["amount"])
    df = C.stage(df, first)
    if "phone_number" in v:
        df = C.stage(df, {"_number": P.national_number(v["phone_number"], F.col("_region"))})
    names = {"region!": "_region", "number!": "_number", "date!": "_date", "time!": "_time", "amount!": "_amount", "date time!": "_date_time"}
    return df, v | {k: F.col(c) for k, c in names.items() if c in df.columns}


def with_issues(df: DataFrame, as_of: str, extra: tuple[Rule, ...] = ()) -> DataFrame:
    """``df`` (with row ids) plus ``issues``: array of (rule, role, column, message, severity), errors before warnings."""
    headers = [c for c in df.columns if c != ROW]
    roles, kind = resolve_roles(headers), classify(headers)
    must = mandatory(kind)
    keys = record_columns(df)
    t, v = parsed(df, roles)
    found: list[tuple[bool, Column]] = []

    def issue(set_: str, role: str, severity: str | Column, message: Column, column: str | None = None) -> None:
        what = F.struct(F.lit(set_).alias("rule"), F.lit(role).alias("role"), F.lit(column or roles.get(role, role)).alias("column"), message.alias("message"), (severity if isinstance(severity, Column) else F.lit(severity)).alias("severity"))
        found.append((severity in ("ERROR", "CRITICAL") if isinstance(severity, str) else False, F.when(message.isNotNull(), what)))

    for r in must:
        if r in roles:
            issue("mandatory", r, "CRITICAL", _say(C.is_missing(v[r]), "Missing mandatory field: ", F.lit(roles[r])))
    for r in roles:
        if r not in must and r != "transaction_time":
            issue("integrity", r, "ERROR", _say(C.is_missing(v[r]), "Missing value: ", F.lit(roles[r])))
    known = {roles[r]: {k: v[m]} for r, k, m in (("transaction_date", "date", "date!"), ("transaction_time", "time", "time!"), ("phone_number", "number", "number!")) if r in roles and (r != "phone_number" or "country" in roles)}
    if keys:
        # cells are worked out once: the keys are read by themselves for the copies, and with their rows for the issues
        t = stored(business_key(t, keys, "_key", known), "parsed")
        first = t.groupBy("_key").agg(F.min(ROW).alias("_first"), F.count(F.lit(1)).alias("_same")).where("_same > 1").select("_key", "_first")
        t = t.join(first, "_key", "left")
    if roles.get("transaction_id") in keys:
        ids = t.where(_present(v["transaction_id"])).groupBy(C.strip(v["transaction_id"]).alias("_tid")).agg(F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
        t = t.join(ids, C.strip(v["transaction_id"]) == F.col("_tid"), "left")
        issue("duplicates", "transaction_id", "ERROR", _say(F.col("_copies").isNotNull(), "Duplicate transaction ID: ", v["transaction_id"]))
    if keys:
        issue("duplicates", "duplicate_record", "WARNING", F.when(F.col(ROW) > F.col("_first"), F.lit("Duplicate Record Detected")), "Entire_Row")
    for rule in [*rules(kind, as_of), *extra]:
        if rule.role in v and all(n in v for n in rule.needs):
            message = rule.message(v)
            issue(rule.set_, rule.role, F.when(message.startswith("Future"), "INFO").otherwise("WARNING") if rule.severity == "INFO" else rule.severity, message)
    ordered = [c for bad, c in found if bad] + [c for bad, c in found if not bad]
    return C.listed(t, {"issues": ordered}, ISSUE).select(*[F.col(f"`{c}`") for c in df.columns], "issues")


def issue_log(checked: DataFrame) -> DataFrame:
    """row_no (from 1), seq, rule, role, column_name, message, severity."""
    return checked.select((F.col(ROW) + 1).alias("row_no"), F.posexplode("issues").alias("seq", "i")).select("row_no", "seq", "i.rule", "i.role", F.col("i.column").alias("column_name"), "i.message", "i.severity")


def friendly_rule(role: Column, message: Column) -> Column:
    named = {"email": "Invalid Email", "phone_number": "Invalid Phone", "duplicate_record": "Duplicate Business Record", "currency": "Invalid Currency Code", "payment_mode": "Invalid Payment Mode", "country": "Unknown Country"}
    out = F.when(message.contains("Missing"), F.concat(F.lit("Missing "), role))
    for r, name in named.items():
        out = out.when(role == r, name)
    out = out.when(role == "transaction_date", F.when(message.contains("Future"), "Future Date").when(message.contains("before year 2000"), "Ancient Date").otherwise("Invalid Date"))
    out = out.when(role == "transaction_time", "Invalid Time").when((role == "transaction_id") & message.contains("Duplicate"), "Duplicate Transaction")
    out = out.when(role == "amount", F.when(message.contains("Negative"), "Negative Amount").otherwise("Invalid Amount"))
    return out.when((role == "customer_name") & message.contains("Corrupted"), "Corrupted Text").otherwise("General Validation Issue")


def issue_summary(log: DataFrame, examples: int = 5) -> DataFrame:
    """Issues by friendly rule and column: how many, first severity and message, first row, and the first different values.

    Values are what stands behind the last colon of the message; counts are made by value before
    anything is put in a list, and at most ``examples`` values of a rule are.
    """
    t = log.withColumn("friendly", friendly_rule(F.col("role"), F.col("message"))).withColumn("value", F.when(F.col("message").contains(": "), F.substring_index("message", ": ", -1)))
    order = F.struct("row_no", "seq")
    out = t.groupBy("friendly", "column_name").agg(
        F.count(F.lit(1)).alias("n"), F.min("row_no").alias("first_row"), F.min_by("severity", order).alias("severity"), F.min_by(F.substring_index("message", ": ", 1), order).alias("message")
    )
    values = t.where("value <> ''").groupBy("friendly", "column_name", "value").agg(F.min(order).alias("first"))
    place = Window.partitionBy("friendly", "column_name").orderBy("first")
    few = values.withColumn("place", F.row_number().over(place)).where(F.col("place") <= examples)
    few = few.groupBy("friendly", "column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("examples"))
    none = F.array().cast("array<string>")
    return out.join(few, ["friendly", "column_name"], "left").withColumn("examples", F.coalesce("examples", none)).withColumnRenamed("friendly", "rule")


def recoverability(rule: Column, column: Column) -> Column:
    text = F.lower(rule)
    return F.when(text.contains("country") | text.contains("payment"), "Manual Review").when(text.contains("missing"), "Imputation").when(text.contains("duplicate"), "Deduplicate").otherwise("Standardize")


RULES = ("phone", "date", "time", "mandatory", "integrity", "duplicates", "currency", "payment_mode", "email", "country")
#: the role without which a rule is skipped
RULE_ROLE = {"phone": "phone_number", "date": "transaction_date", "time": "transaction_time", "currency": "currency", "payment_mode": "payment_mode", "email": "email", "country": "country"}


def hit(rule: str) -> Column:
    """How many rows have an issue of the rule."""
    return F.count_if(F.array_contains("issues.rule", rule))


def failing() -> Column:
    """Whether a row has an error."""
    return F.array_contains("issues.severity", "ERROR") | F.array_contains("issues.severity", "CRITICAL")


def copies() -> Column:
    return F.count_if(F.array_contains("issues.role", "duplicate_record"))


def rule_statuses(counts: DataFrame, headers: list[str]) -> DataFrame:
    """rule, affected_rows, status from one row of counts: a column for each rule, and ``copies``."""
    roles, kind = resolve_roles(headers), classify(headers)
    customer = kind == "Customer Dataset"
    missing = len(schema_warnings(roles, kind))
    rows = []
    for r in RULES:
        off = r in RULE_ROLE and RULE_ROLE[r] not in roles or customer and r in ("currency", "payment_mode")
        if r == "duplicates":
            off = not any(not is_identifier(h) for h in headers)
        skipped = F.lit(off) | ((F.col("copies") == 0) if r == "duplicates" and customer else F.lit(False))
        rows.append(F.struct(F.lit(r).alias("rule"), F.when(skipped, 0).otherwise(F.col(r)).alias("affected_rows"), F.when(skipped, "SKIPPED").when(F.col(r) > 0, "FAILED").otherwise("PASSED").alias("status")))
    rows.append(F.struct(F.lit("schema").alias("rule"), F.lit(missing).cast("long").alias("affected_rows"), F.lit("WARNING" if missing else "PASSED").alias("status")))
    return counts.select(F.inline(F.array(*rows)))


def rule_summary(checked: DataFrame) -> DataFrame:
    """rule, affected_rows, status for every rule, in one aggregation: FAILED, PASSED or SKIPPED, of the schema WARNING or PASSED.

    A rule without its column is skipped, currency and payment mode in a customer dataset too; there
    duplicates count only if whole records are repeated.
    """
    counts = checked.agg(*[hit(r).alias(r) for r in RULES], copies().alias("copies"))
    return rule_statuses(counts, [c for c in checked.columns if c not in (ROW, "issues")])


def row_classes(checked: DataFrame) -> DataFrame:
    """``checked`` with row_status: ERROR, WARNING or VALID."""
    bad = failing()
    return checked.withColumn("row_status", F.when(bad, "ERROR").when(F.size("issues") > 0, "WARNING").otherwise("VALID"))


def row_classification(checked: DataFrame) -> DataFrame:
    """Totals; a row with warnings only counts as valid too."""
    t = row_classes(checked).agg(F.count(F.lit(1)).alias("total_records"), F.count_if(F.col("row_status") == "ERROR").alias("invalid_records"), F.count_if(F.col("row_status") == "WARNING").alias("warning_records"))
    valid = F.col("total_records") - F.col("invalid_records")
    return t.select("total_records", valid.alias("valid_records"), "invalid_records", "warning_records", F.bround(F.when(F.col("total_records") == 0, 100.0).otherwise(valid * 100.0 / F.col("total_records")), 1).alias("success_rate"))


def failed_rows(checked: DataFrame, n: int = 10) -> DataFrame:
    t = row_classes(checked).where("row_status = 'ERROR'").orderBy(ROW).limit(n)
    return t.select((F.col(ROW) + 1).alias("row_no"), F.filter("issues", lambda i: i["severity"].isin("ERROR", "CRITICAL"))[0]["message"].alias("reason"))


def overall_score(complete: float, valid: float, unique: float) -> float:
    return round(0.3 * complete + 0.5 * valid + 0.2 * unique, 1)
