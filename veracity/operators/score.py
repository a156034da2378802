"""Quality scores of a validated table, its main issue, and examples of offending values."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from veracity.functions.cells import is_missing, stage, strip
from veracity.functions.phone import phone_digits
from veracity.functions.temporal import parse_date, parse_time
from veracity.operators.profile import date_order, order_of, rating
from veracity.operators.schema import classify, confidence, resolve_roles, schema_warnings
from veracity.operators.validate import copies, failed_rows, failing, friendly_rule, hit, issue_log, issue_summary, rule_statuses, rule_summary, with_issues
from veracity.sources.tables import ROW, scratch, stored

#: roles that have a validity of their own, and the rule whose affected rows are their faults
RULE_OF = {"email": "email", "phone_number": "phone", "transaction_date": "date", "transaction_time": "time", "currency": "currency", "payment_mode": "payment_mode"}
FAILING = ("mandatory", "integrity", "duplicates", *RULE_OF.values(), "country")


def _long(one_row: DataFrame, names: list[str]) -> DataFrame:
    """A row of numbers as (metric, value)."""
    return one_row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])))


def in_groups(df: DataFrame, key: Column, name: str) -> DataFrame:
    """(metric, value): how many rows share their non-empty key with another row."""
    groups = df.select(key.alias("k")).where("k <> ''").groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return _long(groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name)), [name])


def metric_columns(headers: list[str]) -> dict[str, Column]:
    """Counts over rows with ``issues``: rows, rows with errors and with warnings only, affected rows of each rule, present and faulty cells of each role, filled cells of each column (by its place).

    They are plain aggregates: of one aggregation, or observed while the rows pass to a sink.
    """
    roles = resolve_roles(headers)
    error = lambda i: i["severity"].isin("ERROR", "CRITICAL")
    out = {"n": F.count(F.lit(1)), "invalid": F.count_if(failing()), "warned": F.count_if((F.size("issues") > 0) & ~failing()), "later_copies": copies()}
    out |= {f"hit_{r}": hit(r) for r in FAILING}
    out |= {f"present_{r}": F.count(F.col(f"`{roles[r]}`")) for r in (*RULE_OF, "amount") if r in roles}
    out["bad_amount"] = F.count_if(F.exists("issues", lambda i: (i["role"] == "amount") & error(i)))
    return out | {f"filled_{i}": F.count(F.col(f"`{h}`")) for i, h in enumerate(headers)}


def shared_values(checked: DataFrame) -> dict[str, DataFrame]:
    """(metric, value) of the rows that share their e-mail or phone number with another."""
    roles = resolve_roles([c for c in checked.columns if c not in (ROW, "issues")])
    keys = {"same_email": ("email", strip), "same_phone": ("phone_number", phone_digits)}
    return {name: in_groups(checked, key(F.col(f"`{roles[r]}`")), name) for name, (r, key) in keys.items() if r in roles}


def metrics(checked: DataFrame) -> DataFrame:
    """One row of ``metric_columns`` and of the rows in groups of equal e-mails and phones."""
    counts = metric_columns([c for c in checked.columns if c not in (ROW, "issues")])
    parts, names = _long(checked.agg(*[c.alias(k) for k, c in counts.items()]), list(counts)), list(counts)
    for name, part in shared_values(checked).items():
        parts = parts.unionByName(part)
        names.append(name)
    return parts.agg(*[F.max(F.when(F.col("metric") == k, F.col("value"))).alias(k) for k in names])


def quality_scores(checked: DataFrame) -> DataFrame:
    """The scores (``scores_of``) of a table with ``issues``; it is written once, as it is read several times."""
    return scores_of(metrics(stored(checked, "checked")), [c for c in checked.columns if c not in (ROW, "issues")])


def scores_of(t: DataFrame, headers: list[str]) -> DataFrame:
    """completeness, validity, uniqueness, overall score, rating, success and pass rates and main issue from one row of metrics.

    Validity is the mean share of sound cells among a role's present ones (a missing time counts as a
    fault, so it can fall below 0); uniqueness the mean share of rows outside duplicates.  An empty
    table scores 100 throughout.
    """
    roles, kind, n = resolve_roles(headers), classify(headers), F.col("n")
    part = lambda bad, whole: F.when(whole > 0, 100.0 * (whole - bad) / whole).otherwise(100.0)
    mean = lambda xs: F.bround(sum(xs[1:], xs[0]) / len(xs), 1) if xs else F.lit(100.0)
    valid = [part(F.col(f"hit_{rule}"), F.col(f"present_{r}")) for r, rule in RULE_OF.items() if r in roles and not (kind == "Customer Dataset" and r in ("currency", "payment_mode"))]
    if "amount" in roles and kind != "Customer Dataset":
        valid.append(part(F.col("bad_amount"), F.col("present_amount")))
    unique = [part(F.col("later_copies"), n)] + [part(F.col(c), n) for c in ("same_email", "same_phone") if c in t.columns]
    full = [F.bround(F.when(n > 0, F.col(f"filled_{i}") * 100.0 / n), 1) for i in range(len(headers))]
    complete = F.bround(reduce(Column.__add__, full) / len(full), 1) if full else F.lit(None).cast("double")
    t = t.select(
        F.coalesce(complete, F.lit(100.0)).alias("completeness"), mean(valid).alias("validity"), mean(unique).alias("uniqueness"), F.bround(part(F.col("invalid"), n), 1).alias("success_rate"),
        *[F.round(part(F.col(f"hit_{r}"), n), 1).alias(f"{r}_pass_rate") for r in ("phone", "date", "time")], *[(F.col(f"hit_{r}") > 0).alias(f"failed_{r}") for r in FAILING], F.lit(bool(schema_warnings(roles, kind))).alias("failed_schema"),
    )
    t = t.withColumn("overall_score", F.bround(0.3 * F.col("completeness") + 0.5 * F.col("validity") + 0.2 * F.col("uniqueness"), 1))
    return t.select("completeness", "validity", "uniqueness", "overall_score", rating(F.col("overall_score")).alias("quality_rating"), "success_rate", "phone_pass_rate", "date_pass_rate", "time_pass_rate", main_issue().alias("main_issue"))


def main_issue() -> Column:
    """The first trouble by rank: clear failures first, then anything under 99 percent."""
    failed_any = F.greatest(*[F.col(f"failed_{r}").cast("int") for r in (*FAILING, "schema")]) == 1
    shares = {"Missing required values": "completeness", "High duplicate rate detected": "uniqueness", "Phone validation failures": "phone_pass_rate", "Date validation failures": "date_pass_rate", "Time validation failures": "time_pass_rate", "Large number of invalid records": "success_rate", "Data format inconsistencies": "validity"}
    floor = {"completeness": (95, "mandatory"), "uniqueness": (80, "duplicates"), "phone_pass_rate": (90, "phone"), "date_pass_rate": (90, "date"), "time_pass_rate": (90, "time"), "success_rate": (80, None), "validity": (90, "integrity")}
    sound = F.least("completeness", "validity", "uniqueness", "success_rate") >= 99
    out = F.when(sound & ~failed_any, "No major issues")
    for label, c in shares.items():
        low, rule = floor[c]
        out = out.when((F.col(c) < low) | (F.col(f"failed_{rule}") if rule else F.lit(False)), label)
    for label, c in shares.items():
        out = out.when(F.col(c) < 99, label)
    return out.otherwise("Data format inconsistencies")


def invalid_examples(checked: DataFrame, n: int = 5) -> DataFrame:
    """rule, place (from 1), value, first_row: the first ``n`` different offending values of each format rule, in row order."""
    roles = resolve_roles([c for c in checked.columns if c not in (ROW, "issues")])
    cells = {RULE_OF[r]: F.col(f"`{roles[r]}`") for r in ("email", "phone_number", "transaction_date", "transaction_time") if r in roles}
    broken = F.transform("issues", lambda i: i["rule"])
    each = F.array_compact(F.array(*[F.when(F.array_contains(broken, rule) & c.isNotNull(), F.struct(F.lit(rule).alias("rule"), c.alias("value"))) for rule, c in cells.items()]))
    firsts = checked.select(ROW, F.inline(each)).groupBy("rule", "value").agg(F.min(ROW).alias("first_row"))
    parts = [firsts.where(F.col("rule") == rule).orderBy("first_row").limit(n) for rule in cells]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def role_profiles(checked: DataFrame, n: int = 5, decide: Callable[[dict], tuple] = order_of) -> DataFrame:
    """role, invalid_count, missing_count, min_value, max_value, detected_format, confidence, examples of the e-mail, phone, date and time columns.

    Counts come from one aggregation; ends and format are those of dates (and the ends those of times),
    null elsewhere; examples are the first ``n`` different offending values.  ``decide`` finds the
    format and its confidence from ``profile.order_counts``.
    """
    checked = stored(checked, "checked")
    roles = resolve_roles([c for c in checked.columns if c not in (ROW, "issues")])
    there = {r: F.col(f"`{roles[r]}`") for r in ("email", "phone_number", "transaction_date", "transaction_time") if r in roles}
    parse = {"transaction_date": lambda c: F.date_format(parse_date(c), "yyyy-MM-dd"), "transaction_time": parse_time}
    t = stage(checked, {f"_{r}": parse[r](c) for r, c in there.items() if r in parse} | {"_one": F.lit(1)})
    aggs = [x for r, c in there.items() for x in (hit(RULE_OF[r]).alias(f"{r}_bad"), F.count_if(is_missing(c)).alias(f"{r}_missing"))]
    aggs += [f(f"_{r}").alias(f"{r}_{k}") for r in there if r in parse for k, f in (("min", F.min), ("max", F.max))]
    got = t.agg(*(aggs or [F.count(F.lit(1)).alias("n")])).first()
    _, form, sure = date_order(checked, roles["transaction_date"], decide) if "transaction_date" in roles else (None, None, None)
    dated = lambda r, x: x if r == "transaction_date" else None
    rows = [(r, RULE_OF[r], got[f"{r}_bad"], got[f"{r}_missing"], got[f"{r}_min"] if r in parse else None, got[f"{r}_max"] if r in parse else None, dated(r, form), dated(r, sure)) for r in there]
    facts = checked.sparkSession.createDataFrame(rows, "role string, rule string, invalid_count long, missing_count long, min_value string, max_value string, detected_format string, confidence double")
    if not there:
        return facts.drop("rule").withColumn("examples", F.array().cast("array<string>"))
    few = invalid_examples(checked, n).groupBy("rule").agg(F.transform(F.array_sort(F.collect_list(F.struct("first_row", "value"))), lambda x: x["value"]).alias("examples"))
    return facts.join(few, "rule", "left").withColumn("examples", F.coalesce("examples", F.array().cast("array<string>"))).drop("rule")


@dataclass(frozen=True)
class ValidationResult:
    """Everything a validation finds: small facts as values, the rest as DataFrames over the written table.

    ``summary``: dataset type, confidence and warnings of the schema, records by class, scores, rating, rates and main issue;
    ``rules``: rule -> (affected rows, status); ``columns``: header -> (filled, empty, completeness in percent);
    ``checked``: the rows with their issues; ``issues``: the log; ``issue_summary``; ``failed_rows``: the first ten.
    """

    summary: dict
    rules: dict[str, tuple[int, str]]
    columns: dict[str, tuple[int, int, float]]
    checked: DataFrame
    issues: DataFrame
    issue_summary: DataFrame
    failed_rows: DataFrame
    mapping: dict[str, str]


def validate_table(df: DataFrame, as_of: str) -> ValidationResult:
    """All results of validating ``df`` (nullified, with row ids), from one pass that writes its rows with their issues.

    Counts, rules and completeness are observed while the rows are written; scores follow from them and
    from two grouped counts (equal e-mails and phones) over the written columns.  Profiles and
    examples read the written table too.  An empty table is valid and scores 100.
    """
    headers = [c for c in df.columns if c != ROW]
    spark, roles, kind = df.sparkSession, resolve_roles(headers), classify(headers)
    seen, path = Observation(), scratch(df.sparkSession, "validated")
    counts = metric_columns(headers)
    checked = with_issues(df, as_of)
    checked.observe(seen, *[c.alias(k) for k, c in counts.items()]).write.parquet(path)
    kept = spark.read.schema(checked.schema).parquet(path)
    got = {k: int(seen.get[k] or 0) for k in counts}
    # the further metrics are one row each
    more = {name: float(part.first()["value"]) for name, part in shared_values(kept).items()}
    row = spark.createDataFrame([tuple(float(v) for v in (*got.values(), *more.values()))], ", ".join(f"`{k}` double" for k in (*got, *more)))
    scores = scores_of(row, headers).first().asDict()
    rules = rule_statuses(row.select(*[F.col(f"hit_{r}").cast("long").alias(r) for r in FAILING], F.col("later_copies").alias("copies")), headers)
    n = got["n"]
    summary = {
        "dataset_type": kind, "schema_confidence": confidence(roles, kind), "schema_warnings": schema_warnings(roles, kind), "total_records": n, "valid_records": n - got["invalid"],
        "invalid_records": got["invalid"], "warning_records": got["warned"], **scores,
    }
    share = lambda k: round(k * 100.0 / n, 1) if n else 0.0
    columns = {h: (got[f"filled_{i}"], n - got[f"filled_{i}"], share(got[f"filled_{i}"])) for i, h in enumerate(headers)}
    log = issue_log(kept)
    return ValidationResult(summary, {r.rule: (r.affected_rows, r.status) for r in rules.collect()}, columns, kept, log, issue_summary(log), failed_rows(kept), roles)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= 90, "High certainty").when(confidence >= 70, "Moderate certainty").otherwise("Low certainty")


def expectations(headers: list[str]) -> int:
    """How many suites are evaluated: completeness and uniqueness always, others by the columns there are."""
    roles = resolve_roles(headers)
    return 2 + sum(r in roles for r in ("email", "phone_number", "transaction_date")) + (classify(headers) != "Customer Dataset")


def transaction_rules(checked: DataFrame) -> DataFrame:
    """status, currency_rows, payment_rows, amount_rows, affected: the card of the transaction rules; no row for a customer dataset.

    amount_rows counts the issues of the amount column's first rule in the issue summary.
    """
    checked = stored(checked, "checked")
    headers = [c for c in checked.columns if c not in (ROW, "issues")]
    amount = resolve_roles(headers).get("amount")
    rule = {r["rule"]: r for r in rule_summary(checked).where("rule in ('currency', 'payment_mode')").collect()}
    log = issue_log(checked).where(F.col("column_name") == amount) if amount else issue_log(checked).where("false")
    first = log.groupBy(friendly_rule(F.col("role"), F.col("message")).alias("r")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("row_no", "seq")).alias("first"))
    t = first.agg(F.coalesce(F.min_by("n", "first"), F.lit(0)).alias("amount_rows"))
    c, p = (rule[r]["affected_rows"] for r in ("currency", "payment_mode"))
    status = "FAILED" if any(x["status"] == "FAILED" for x in rule.values()) else "PASSED"
    out = t.select(F.lit(status).alias("status"), F.lit(c).alias("currency_rows"), F.lit(p).alias("payment_rows"), "amount_rows", (F.col("amount_rows") + c + p).alias("affected"))
    return out.where(F.lit(classify(headers) != "Customer Dataset"))
