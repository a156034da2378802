"""Regions, kinds and groups of phone numbers by the numbering plan."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from veracity.functions import numbering as N
from veracity.functions import phone as P
from veracity.plans import phones, queries as Q

# Known international forms and kinds.
FORMS = [
    ("9876543210", "India", "+91 98765 43210", "MOBILE"), ("+1 415 555 2671", "US", "+1 415-555-2671", "FIXED_LINE_OR_MOBILE"), ("8005552671", "ca", "+1 800-555-2671", "TOLL_FREE"),
    ("07911123456", "UK", "+44 7911 123456", "MOBILE"), ("02079460958", "GB", "+44 20 7946 0958", "FIXED_LINE"), ("81234567", "Singapore", "+65 8123 4567", "MOBILE"),
    ("0412345678", "AU", "+61 412 345 678", "MOBILE"), ("0501234567", "UAE", "+971 50 123 4567", "MOBILE"), ("0612345678", "FR", "+33 6 12 34 56 78", "MOBILE"),
    ("15123456789", "DE", "", "UNKNOWN"), ("015123456789", "DE", "+49 1512 3456789", "MOBILE"), ("11912345678", "BR", "+55 11 91234-5678", "MOBILE"), ("1131234567", "BR", "+55 11 3123-4567", "FIXED_LINE"),
    ("+81 90 1234 5678", "JP", "+81 90-1234-5678", "MOBILE"), ("89123456789", "RU", "+7 912 345-67-89", "MOBILE"), ("612345678", "ES", "+34 612 34 56 78", "MOBILE"), ("51234567", "HK", "+852 5123 4567", "MOBILE"),
    ("8764567890", "JM", "+1 876-456-7890", "FIXED_LINE_OR_MOBILE"), ("+254712345678", "ke", "+254 712 345678", "MOBILE"), ("+2217012345678", "SN", "", "UNKNOWN"), ("+221701234567", "SN", "+221 701234567", "UNKNOWN"),
]


@pytest.mark.parametrize("name", ["phone_details", "phone_types"])
def test_matches_sql(spark, sf_dir, name):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from '{os.path.join(sf_dir, 'orders.parquet')}'")
    df, rel = Q.QUERIES[name](spark, sf_dir), con.sql(Q.ORACLE_SQL[name])
    at = [rel.columns.index(c) for c in df.columns]
    got = df.collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert len({r.region for r in got}) == len(P.RULES) if name == "phone_details" else True


def details(spark, rows, **more):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, c string")
    return [r[1] for r in df.select("i", P.phone_details(F.col("v"), F.col("c"), **more)).orderBy("i").collect()]


def test_known_forms(spark):
    got = details(spark, [f[:2] for f in FORMS])
    assert [(g.international, g.type) for g in got] == [f[2:] for f in FORMS]


def test_defined_results_of_odd_cells(spark):
    got = details(spark, [(None, "IN"), ("", "IN"), ("9" * 100_000, "IN"), ("9876543210", None), ("9876543210", "ZZ"), ("9876543210", "")])
    assert [(g.is_valid, g.e164, g.national, g.international, g.type) for g in got[:3]] == [(False, "", "", "", "UNKNOWN")] * 3 and got[3:] == [None] * 3


def test_every_region_has_a_code():
    assert all(code.isdigit() and len(region) == 2 for region, (code, _, _) in P.RULES.items())
    assert {r for r, *_ in N.PLAN} <= set(P.RULES)


def test_longest_prefix_of_nested_plans():
    """Random nested prefixes: the intervals give what trying the prefixes from the longest on gives."""
    draw = random.Random(7)
    digits = lambda n: "".join(draw.choice("0123") for _ in range(n))
    plan = [("AA", digits(draw.randint(1, 5)), f"K{i}", draw.choice(["3 3", "2-4", "*", "3 3 1"])) for i in range(120)]
    rows = {(n, p): (k, a, b) for _, n, p, k, a, b in N.expand(plan)}
    entries = [e.split("~") for e in N.intervals(plan)["AA"]]
    assert all(a[1] < b[0] for a, b in zip(entries, entries[1:]))
    for _ in range(3000):
        number = digits(draw.choice([6, 7, 8]))
        want = next((rows[len(number), number[:k]] for k in range(len(number), 0, -1) if (len(number), number[:k]) in rows), None)
        key = f"{len(number):02}{number}"
        got = next((tuple(e[2:]) for e in entries if e[0] <= key <= e[1]), None)
        assert got == want, number


def test_plan_from_a_table(spark):
    rows = [("IN", "98:99", "PAGER", "2 8"), ("IN", "987", "VOICEMAIL", "3-7"), ("SG", "8", "MOBILE", "8")]
    plan = N.read_plan(spark.createDataFrame(rows + rows, "region string, begins string, kind string, shapes string").withColumn("more", F.lit(1)))
    assert sorted(plan) == sorted(rows)
    got = details(spark, [("9876543210", "IN"), ("9976543210", "IN"), ("7976543210", "IN"), ("81234567", "SG")], plan=plan)
    assert [(g.international, g.type) for g in got] == [("+91 987-6543210", "VOICEMAIL"), ("+91 99 76543210", "PAGER"), ("+91 7976543210", "UNKNOWN"), ("+65 81234567", "MOBILE")]
    empty = spark.createDataFrame([], "region string, begins string, kind string, shapes string")
    assert details(spark, [("9876543210", "IN")], plan=N.read_plan(empty))[0].type == "UNKNOWN"
    with pytest.raises(ValueError, match="more than 2 rows"):
        N.read_plan(spark.createDataFrame(rows, "region string, begins string, kind string, shapes string"), most=2)
    with pytest.raises(ValueError, match="nulls"):
        N.read_plan(spark.createDataFrame([("IN", None, "MOBILE", "5 5")], "region string, begins string, kind string, shapes string"))
    with pytest.raises(ValueError, match="same number of digits"):
        N.prefixes("8:10")


def test_registered():
    assert phones.phone_details is Q.QUERIES["phone_details"]
