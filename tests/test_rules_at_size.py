"""Cell rules that are compiled, and worked out once a row."""

from pyspark.sql import functions as F

from veracity.functions import cells as C
from veracity.functions import phone as P
from veracity.functions import temporal as D


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_cell_rules_are_compiled(spark):
    df = spark.createDataFrame([("a", "b")], "c string, d string").repartition(2)
    c, d = F.col("c"), F.col("d")
    for rule in (D.parse_time(c), D.date_vote(c), D.date_separator(c), C.is_empty_row(c, d), D.parse_date(c), P.national_number(c, d)):
        assert "lambda" not in _plan(df.select(rule.alias("x")))


def test_a_stage_is_worked_out_once_in_a_projection(spark):
    df = spark.createDataFrame([("1", "x")], "c string, d string").repartition(2)
    staged = C.listed(C.stage(df, {"n": F.regexp_replace("c", "1", "2")}), {"both": [F.col("n"), F.when(F.col("d") == "y", F.col("d"))]}, "string")
    plan = _plan(staged.where("n <> 'z'").select("both"))
    assert plan.count("regexp_replace") == 1 and "Generate inline(array(struct" not in plan
    assert staged.first().both == ["2"] and staged.columns == ["c", "d", "n", "both"]


def test_numbers_of_a_region_take_one_pattern(spark):
    rows = [("07911 123456", "GB", "07911123456"), ("+44 7911 123456", "GB", "07911123456"), ("0044 7911123456", "GB", "07911123456"), ("7911123456", "GB", None), ("+91 7911123456", "GB", None), ("07700 900123", "GB", None), ("+447700900123 ext 5", "GB", None), ("98765 43210 x12", "IN", "987654321012"), ("+0 98765 43210", "IN", None), ("9876543210", None, None)]
    df = spark.createDataFrame(rows, "p string, r string, want string")
    for found in df.select("p", "want", P.national_number(F.col("p"), F.col("r")).alias("n")).collect():
        assert found.n == found.want, found.p
    # the number stands in the plan once: it had been worked out up to eight times a row
    assert _plan(df.repartition(2).select(P.subscriber_number(F.col("p"), F.col("r")).alias("x"))).count("regexp_extract_all") == 1
