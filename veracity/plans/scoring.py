"""Registered queries of scores, main issue and examples, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from veracity.operators import dedupe, score
from veracity.plans import queries as Q

_HITS = ", ".join(f"(SELECT count(DISTINCT row_no) FROM log WHERE rule = '{r}') AS hit_{r}" for r in score.FAILING)
_PRESENT = ", ".join(f"(SELECT count({r}) FROM d) AS present_{r}" for r in (*score.RULE_OF, "amount"))
_VALID = [f"100.0::DOUBLE * (present_{r} - hit_{x}) / present_{r}" for r, x in score.RULE_OF.items()] + ["100.0::DOUBLE * (present_amount - bad_amount) / present_amount"]
_FAILED = " + ".join(f"hit_{r}" for r in score.FAILING)
_SCORES = f"""{Q._LOG}, m AS (SELECT (SELECT count(*) FROM d) AS n, (SELECT count(DISTINCT row_no) FROM log WHERE severity IN ('ERROR', 'CRITICAL')) AS invalid, {_HITS}, {_PRESENT},
  (SELECT count(*) FROM log WHERE role = 'duplicate_record') AS later, (SELECT count(DISTINCT row_no) FROM log WHERE role = 'amount' AND severity IN ('ERROR', 'CRITICAL')) AS bad_amount,
  (SELECT round_even(avg(completeness), 1)::DOUBLE FROM ({Q._RATES})) AS completeness,
  (SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM d WHERE email IS NOT NULL GROUP BY {Q.s_strip('email')} HAVING count(*) > 1)) AS same_email,
  (SELECT coalesce(sum(c), 0) FROM (SELECT count(*) AS c FROM d WHERE phone_number IS NOT NULL GROUP BY regexp_replace(phone_number, '\\D', '', 'g') HAVING count(*) > 1)) AS same_phone),
q AS (SELECT completeness, round_even(({' + '.join(_VALID)}) / {len(_VALID)}, 1)::DOUBLE AS validity, round_even((100.0::DOUBLE * (n - later) / n + 100.0::DOUBLE * (n - same_email) / n + 100.0::DOUBLE * (n - same_phone) / n) / 3, 1)::DOUBLE AS uniqueness,
  round_even(100.0::DOUBLE * (n - invalid) / n, 1)::DOUBLE AS success_rate, {', '.join(f"round(100.0::DOUBLE * (n - hit_{r}) / n, 1)::DOUBLE AS {r}_pass_rate" for r in ('phone', 'date', 'time'))}, * EXCLUDE (completeness) FROM m),
s AS (SELECT *, round_even(0.3::DOUBLE * completeness + 0.5::DOUBLE * validity + 0.2::DOUBLE * uniqueness, 1)::DOUBLE AS overall_score FROM q)
SELECT completeness, validity, uniqueness, overall_score, CASE WHEN overall_score >= 95 THEN 'Excellent' WHEN overall_score >= 85 THEN 'Good' WHEN overall_score >= 70 THEN 'Average' ELSE 'Poor' END AS quality_rating,
  success_rate, phone_pass_rate, date_pass_rate, time_pass_rate,
  CASE WHEN completeness >= 99 AND validity >= 99 AND uniqueness >= 99 AND success_rate >= 99 AND {_FAILED} = 0 THEN 'No major issues' WHEN completeness < 95 OR hit_mandatory > 0 THEN 'Missing required values'
    WHEN uniqueness < 80 OR hit_duplicates > 0 THEN 'High duplicate rate detected' WHEN phone_pass_rate < 90 OR hit_phone > 0 THEN 'Phone validation failures' WHEN date_pass_rate < 90 OR hit_date > 0 THEN 'Date validation failures'
    WHEN time_pass_rate < 90 OR hit_time > 0 THEN 'Time validation failures' WHEN success_rate < 80 THEN 'Large number of invalid records' ELSE 'Data format inconsistencies' END AS main_issue FROM s"""


@Q.query("quality_scores", _SCORES)
def quality_scores(spark, sf_dir):
    return score.quality_scores(Q.checked(spark, sf_dir))


_WORST = f"{Q._LOG}, s AS (SELECT _row_id, max(CASE WHEN severity IN ('ERROR', 'CRITICAL') THEN 2 WHEN severity IS NOT NULL THEN 1 ELSE 0 END) AS worst FROM d LEFT JOIN log ON row_no = _row_id + 1 GROUP BY 1)"


@Q.query("validation_result", f"""SELECT * FROM (SELECT * EXCLUDE (phone_pass_rate, date_pass_rate, time_pass_rate) FROM ({_SCORES})), (SELECT count(*) AS total_records, count(*) FILTER (worst < 2) AS valid_records, count(*) FILTER (worst = 2) AS invalid_records, count(*) FILTER (worst = 1) AS warning_records FROM ({_WORST} SELECT * FROM s)),
(SELECT string_agg(rule || ' ' || affected_rows || ' ' || status, '; ' ORDER BY rule) AS rules FROM ({Q.ORACLE_SQL["rule_summary"]}))""")
def validation_result(spark, sf_dir):
    """The result of validating the dirty orders as one row."""
    found = score.validate_table(Q.nullified(spark, sf_dir), Q.AS_OF)
    rules = "; ".join(f"{r} {n} {status}" for r, (n, status) in sorted(found.rules.items()))
    kinds = {"completeness": "double", "validity": "double", "uniqueness": "double", "overall_score": "double", "quality_rating": "string", "success_rate": "double", "main_issue": "string"} | {k: "long" for k in ("total_records", "valid_records", "invalid_records", "warning_records")}
    return spark.createDataFrame([(*(found.summary[k] for k in kinds), rules)], ", ".join(f"{k} {t}" for k, t in kinds.items()) + ", rules string")


_EXAMPLES = " UNION ALL ".join(f"SELECT * FROM (SELECT '{x}' AS rule, {r} AS value, min(_row_id) AS first_row FROM d JOIN log ON row_no = _row_id + 1 AND rule = '{x}' WHERE {r} IS NOT NULL GROUP BY 2 ORDER BY 3 LIMIT 5)" for r, x in score.RULE_OF.items() if r not in ("currency", "payment_mode"))


@Q.query("invalid_examples", f"{Q._LOG} {_EXAMPLES}")
def invalid_examples(spark, sf_dir):
    return score.invalid_examples(Q.checked(spark, sf_dir))


_PROFILES = " UNION ALL ".join(
    f"SELECT '{r}' AS role, (SELECT count(DISTINCT row_no) FROM log WHERE rule = '{x}') AS invalid_count, (SELECT count(*) FROM d WHERE {r} IS NULL) AS missing_count, "
    + {"transaction_date": f"(SELECT strftime(min({Q.s_date(r)}), '%Y-%m-%d') FROM d) AS min_value, (SELECT strftime(max({Q.s_date(r)}), '%Y-%m-%d') FROM d) AS max_value, (SELECT form FROM o) AS detected_format, (SELECT sure FROM o) AS confidence",
       "transaction_time": f"(SELECT min({Q.s_time(r)}) FROM d) AS min_value, (SELECT max({Q.s_time(r)}) FROM d) AS max_value, NULL AS detected_format, NULL AS confidence"}.get(r, "NULL AS min_value, NULL AS max_value, NULL AS detected_format, NULL AS confidence")
    + f", coalesce(array_to_string((SELECT list(value ORDER BY first_row) FROM e WHERE e.rule = '{x}'), ' | '), '') AS examples"
    for r, x in score.RULE_OF.items() if r not in ("currency", "payment_mode")
)


@Q.query("role_profiles", f"{Q._LOG}, {Q.ORDER}, e AS ({_EXAMPLES}) {_PROFILES}")
def role_profiles(spark, sf_dir):
    return score.role_profiles(Q.checked(spark, sf_dir), decide=Q.order).withColumn("examples", F.array_join("examples", " | "))


@Q.query("transaction_rules", f"""{Q._LOG}, a AS (SELECT CASE WHEN contains(message, 'Missing') THEN 'm' WHEN contains(message, 'Negative') THEN 'n' ELSE 'i' END AS r, count(*) AS n, min(row_no) AS place FROM log WHERE column_name = 'amount' GROUP BY 1),
t AS (SELECT (SELECT count(DISTINCT row_no) FROM log WHERE rule = 'currency') AS currency_rows, (SELECT count(DISTINCT row_no) FROM log WHERE rule = 'payment_mode') AS payment_rows, (SELECT n FROM a ORDER BY place LIMIT 1) AS amount_rows)
SELECT CASE WHEN currency_rows > 0 OR payment_rows > 0 THEN 'FAILED' ELSE 'PASSED' END AS status, *, currency_rows + payment_rows + amount_rows AS affected FROM t""")
def transaction_rules(spark, sf_dir):
    return score.transaction_rules(Q.checked(spark, sf_dir))


_FIRST = "(SELECT coalesce(array_to_string(list(v ORDER BY place), ' | '), '') FROM (SELECT {c} AS v, min(_row_id) AS place FROM r GROUP BY 1 ORDER BY 2 LIMIT 5))"


def _repeated(name: str, column: str, key: str) -> str:
    rows = f"r AS (SELECT _row_id, {column} FROM d WHERE {column} IS NOT NULL AND {key} <> '' QUALIFY count(*) OVER (PARTITION BY {key}) > 1)"
    return f"SELECT '{name}' AS metric, rows, examples FROM (WITH {rows} SELECT (SELECT count(*) FROM r) AS rows, {_FIRST.format(c=column)} AS examples)"


@Q.query("duplicate_profile", f"""{Q._CTE} {_repeated('duplicate_ids', 'transaction_id', Q.s_strip('transaction_id'))} UNION ALL {_repeated('duplicate_emails', 'email', Q.s_strip('email'))}
UNION ALL {_repeated('duplicate_phones', 'phone_number', "regexp_replace(phone_number, '[^0-9]', '', 'g')")}
UNION ALL SELECT 'duplicate_business', count(*), '' FROM (SELECT _row_id FROM ({Q.keyed('d')}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY _row_id) > 1)""")
def duplicate_profile(spark, sf_dir):
    return dedupe.duplicate_profile(Q.nullified(spark, sf_dir)).withColumn("examples", F.array_join("examples", " | "))
