"""Exact quantiles of many columns together, by radix selection.

A double is mapped to 64 bits that sort like it.  Four passes count 16 bits each: the first the
leading ones of every value, each further one the next ones of the values that share what was selected so far.
A task counts in arrays and hands on a row for each digit met; the digit that holds a wanted place is
found from the sums.  So the number of passes depends neither on the number of columns nor on
their values, nothing is sorted, and the driver gets a row for each column and place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS = 16
_SIGN = np.uint64(1 << 63)


def sortable(values: np.ndarray) -> np.ndarray:
    """Doubles (no NaN) as unsigned integers of the same order; 0 and -0 are one."""
    bits = (values + 0.0).view(np.uint64)
    return np.where(bits & _SIGN, ~bits, bits | _SIGN)


def number(bits: int) -> float:
    """The double behind ``sortable``."""
    b = np.uint64(bits)
    return float(np.array([b & ~_SIGN if b & _SIGN else ~b], np.uint64).view(np.float64)[0])


def _digits(wanted: list[list[int]], done: int):
    """Counts of the next digit behind each of a column's prefixes of ``done`` bits."""

    def run(batches):
        counts = {(c, i): np.zeros(1 << BITS, np.int64) for c, prefixes in enumerate(wanted) for i in range(len(prefixes))}
        for batch in batches:
            for c, prefixes in enumerate(wanted):
                values = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                keys = sortable(values[~np.isnan(values)])
                for i, prefix in enumerate(prefixes):
                    rest = keys[keys >> np.uint64(64 - done) == np.uint64(prefix)] if done else keys
                    counts[c, i] += np.bincount((rest >> np.uint64(64 - BITS - done) & np.uint64((1 << BITS) - 1)).astype(np.int64), minlength=1 << BITS)
        for (c, i), n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), c, np.int32)), pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["c", "i", "digit", "n"])

    return run


def exact_quantiles(df: DataFrame, cols: list[str], shares: tuple[float, ...] = (0.5,)) -> dict[str, list[float | None]]:
    """The quantiles of each column of doubles, between two values the mean weighted by place; null without a value.

    Nulls and NaN are no values; infinities are.  ``df`` is read five times: pass a written table.
    """
    if not cols:
        return {}
    rows = df.select(*[F.col(f"`{c}`").cast("double") for c in cols])
    sizes = rows.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & ~F.isnan(F.col(f"`{c}`"))) for c in cols]).first()
    # places wanted in each sorted column: the two around each quantile
    places = [sorted({p for s in shares for at in [s * (n - 1)] for p in (int(at), min(int(at) + 1, n - 1))}) if n else [] for n in sizes]
    found = [[(p, 0, p) for p in ps] for ps in places]  # place, bits selected so far, place among values that share them
    for done in range(0, 64, BITS):
        prefixes = [sorted({bits for _, bits, _ in fs}) for fs in found]
        counts = rows.mapInArrow(_digits(prefixes, done), "c int, i int, digit int, n long").groupBy("c", "i", "digit").agg(F.sum("n").alias("n"))
        upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("c", "i").orderBy("digit")))
        targets = [(c, prefixes[c].index(bits), place, rest) for c, fs in enumerate(found) for place, bits, rest in fs]
        if not targets:
            break
        want = df.sparkSession.createDataFrame(targets, "c int, i int, place long, rest long")
        hit = upto.join(F.broadcast(want), ["c", "i"]).where("upto > rest and upto - n <= rest").select("c", "i", "place", "digit", (F.col("rest") - F.col("upto") + F.col("n")).alias("rest")).collect()
        found = [[] for _ in cols]
        for r in hit:
            found[r.c].append((r.place, prefixes[r.c][r.i] << BITS | r.digit, r.rest))
    out = {}
    for c, n, fs in zip(cols, sizes, found):
        at = {place: number(bits) for place, bits, _ in fs}
        out[c] = []
        for s in shares:
            lo = int(s * (n - 1)) if n else 0
            part = s * (n - 1) - lo
            low, high = at.get(lo), at.get(min(lo + 1, n - 1))
            out[c].append(None if not n else low if part == 0 or low == high else low + (high - low) * part)
    return out
