"""Quantiles and frequent values of all columns together."""

import random
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracity.operators import frequent
from veracity.operators.quantiles import exact_quantiles, number, sortable
from veracity.sources.tables import ROW


def test_sortable_bits():
    values = [float("-inf"), -1e300, -2.5, -1.0, -5e-324, 0.0, 5e-324, 1e-310, 1.0, 1.0000000000000002, 7e22, float("inf")]
    keys = [int(k) for k in sortable(np.array(values))]
    assert keys == sorted(keys) and len(set(keys)) == len(keys)
    assert [struct.pack("d", number(k)) for k in keys] == [struct.pack("d", v) for v in values]
    assert sortable(np.array([-0.0]))[0] == sortable(np.array([0.0]))[0]


def test_quantiles_of_all_columns(spark):
    rng = random.Random(7)
    cols = {
        "small": [rng.randrange(5) / 2 for _ in range(1001)], "wide": [rng.uniform(-1e12, 1e12) for _ in range(1001)], "near": [1 + i * 2**-52 for i in range(1001)], "one": [3.5] + [None] * 1000,
        "two": [1.0, -2.0] + [float("nan")] * 999, "none": [None] * 1001, "ends": [float("inf"), float("-inf"), 0.0] * 333 + [None] * 2, "even": [float(i * i % 997) for i in range(1000)] + [None],
    }
    df = spark.createDataFrame(list(zip(*cols.values())), ", ".join(f"{c} double" for c in cols)).repartition(6)
    got = exact_quantiles(df, list(cols), (0.0, 0.25, 0.5, 0.9, 1.0))
    for c, values in cols.items():
        found = [v for v in values if v is not None and v == v]
        if c == "ends":
            assert got[c][0] == float("-inf") and got[c][2] == 0.0 and got[c][4] == float("inf")
        else:
            assert got[c] == ([pytest.approx(np.quantile(found, s), rel=1e-15) for s in (0.0, 0.25, 0.5, 0.9, 1.0)] if found else [None] * 5)
    assert exact_quantiles(df.where("false"), ["wide"]) == {"wide": [None]} and exact_quantiles(df, []) == {}


@pytest.mark.parametrize("counters", [4, 40, 5000])
def test_top_values_of_all_columns(spark, counters):
    """Columns with many ties, with few frequent values among many rare ones, with nothing frequent, and without values."""
    rng = random.Random(counters)
    rows = [(i, rng.choice("abc"), f"rare{i}" if rng.random() < 0.5 else f"often{rng.randrange(6)}", f"own{i}", None, f"pair{i // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, f"{ROW} long, few string, mixed string, own string, none string, pair string").repartition(5)
    cols = ["few", "mixed", "own", "none", "pair"]
    want = set()
    for at, c in enumerate(cols, 1):
        counts, first = Counter(r[at] for r in rows if r[at] is not None), {}
        for r in rows:
            first.setdefault(r[at], r[0])
        for rank, (v, n) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], first[x[0]]))[:7], 1):
            want.add((c, rank, v, n, first[v]))
    assert {tuple(r) for r in frequent.top_values(df, cols, 7, counters).collect()} == want
    assert frequent.top_values(df.where("false"), cols).count() == 0 and frequent.top_values(df, []).count() == 0


def test_top_values_of_numbers(spark):
    df = spark.range(100).select(F.col("id").alias(ROW), (F.col("id") % 3).alias("k"))
    assert [tuple(r) for r in frequent.top_values(df, ["k"], 2).orderBy("rank").collect()] == [("k", 1, "0", 34, 0), ("k", 2, "1", 33, 1)]
