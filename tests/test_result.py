"""The validation result as one object from one pass."""

import shutil

from pyspark.sql import functions as F

from veracity.operators import profile, score, validate
from veracity.plans import queries as Q
from veracity.sources.tables import ROW


def test_result_equals_its_parts(spark, sf_dir, tmp_path):
    path = str(tmp_path / "t")
    Q.nullified(spark, sf_dir).limit(400).write.parquet(path)
    df = spark.read.parquet(path)
    checked = validate.with_issues(df, Q.AS_OF)
    want = {
        "rules": {r.rule: (r.affected_rows, r.status) for r in validate.rule_summary(checked).collect()},
        "scores": score.quality_scores(checked).first().asDict(), "classes": validate.row_classification(checked).first().asDict(),
        "columns": {r.column_name: (r.non_empty, r.empty, r.completeness) for r in profile.completeness(df, [c for c in df.columns if c != ROW]).collect()},
        "log": sorted(map(str, validate.issue_log(checked).collect())), "summary": sorted(map(str, validate.issue_summary(validate.issue_log(checked)).collect())), "failed": validate.failed_rows(checked).collect(),
    }
    found = score.validate_table(df, Q.AS_OF)
    shutil.rmtree(path)  # nothing below reads the source again
    assert found.rules == want["rules"] and found.columns == want["columns"]
    assert {k: found.summary[k] for k in want["scores"]} == want["scores"]
    assert {k: found.summary[k] for k in ("total_records", "valid_records", "invalid_records", "warning_records")} == {k: v for k, v in want["classes"].items() if k != "success_rate"}
    assert sorted(map(str, found.issues.collect())) == want["log"] and sorted(map(str, found.issue_summary.collect())) == want["summary"] and found.failed_rows.collect() == want["failed"]
    assert found.mapping["transaction_id"] == "transaction_id" and found.summary["schema_confidence"] == 100


def test_result_of_few_columns_and_no_rows(spark):
    df = spark.createDataFrame([(0, "1", "An")], f"{ROW} long, `Goal ID` string, `First. Name` string")
    for rows, n in ((df, 1), (df.where("false"), 0)):
        found = score.validate_table(rows, "2026-01-01")
        assert found.summary["total_records"] == found.summary["valid_records"] == n and found.summary["overall_score"] == 100.0
        assert found.columns == {c: (n, 0, 100.0 * n) for c in ("Goal ID", "First. Name")}
        assert found.rules["email"] == (0, "SKIPPED") and found.issues.count() == 0


def test_confidence_bands(spark):
    df = spark.createDataFrame([(95.0,), (90.0,), (89.9,), (70.0,), (69.9,), (0.0,)], "c double")
    assert [r[0] for r in df.select(score.confidence_band(F.col("c"))).collect()] == ["High certainty", "High certainty", "Moderate certainty", "Moderate certainty", "Low certainty", "Low certainty"]
