"""The most frequent values of many columns in one pass, by summaries that are then counted exactly.

Each task keeps a Misra-Gries summary of every column: at most ``COUNTERS`` values with a count that is
never too high, and how much it may be too low.  Summaries add up.  From the sums follows which values can
be among the first; these are counted exactly in a second pass, with the row where each appears
first.  A column whose summary leaves room for a value it has not seen (too many values, none of
them frequent) is counted in full instead, so the result is exact always.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.sources.tables import ROW

COUNTERS = 1024
#: candidates that are broadcast; more are joined by a shuffle
MOST = 100_000


def _summaries(columns: int, counters: int):
    """(c, value, low) of each column's summary, and (c, null, error)."""

    def run(batches):
        kept, error = [Counter() for _ in range(columns)], [0] * columns
        for batch in batches:
            for c in range(columns):
                counts = pc.value_counts(batch.column(c).drop_null())
                for value, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist()):
                    kept[c][value] += n
                if len(kept[c]) > counters:
                    # the largest count that goes with those left out is taken from all
                    cut = sorted(kept[c].values(), reverse=True)[counters]
                    kept[c] = Counter({v: n - cut for v, n in kept[c].items() if n > cut})
                    error[c] += cut
        for c in range(columns):
            rows = [*kept[c].items(), (None, error[c])]
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["c", "value", "low"])

    return run


def _counted(df: DataFrame, which: list[tuple[int, str]]) -> DataFrame:
    """c, value and row id of every cell of the columns."""
    cells = [F.when(F.col(f"`{c}`").isNotNull(), F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("string").alias("value"))) for i, c in which]
    return df.select(ROW, F.inline(F.array_compact(F.array(*cells))))


def top_values(df: DataFrame, cols: list[str], n: int = 10, counters: int = COUNTERS) -> DataFrame:
    """column_name, rank (from 1), value, n, first_row: the ``n`` most frequent values of each column, equal counts in order of first appearance.

    ``df`` has row ids.  Nulls do not count; a column without values has no rows; values are compared as text.
    A task holds ``counters`` values a column, and those of a batch.
    """
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, rank int, value string, n long, first_row long")
    found = df.select(*[F.col(f"`{c}`").cast("string") for c in cols]).mapInArrow(_summaries(len(cols), counters), "c int, value string, low long")
    sums = found.groupBy("c", "value").agg(F.sum("low").alias("low"))
    errors = dict(sums.where("value is null").select("c", "low").collect())
    seen = sums.where("value is not null")
    place = F.row_number().over(Window.partitionBy("c").orderBy(F.desc("low")))
    least = dict(seen.withColumn("place", place).where(F.col("place") == n).select("c", "low").collect())
    # a value that no summary holds has at most ``error`` cells
    open_ = [c for c in range(len(cols)) if errors.get(c, 0) and errors[c] >= least.get(c, 0)]
    sure = [c for c in range(len(cols)) if c not in open_]
    bound = F.coalesce(*[F.when(F.col("c") == c, F.lit(max(least.get(c, 0) - errors.get(c, 0), 0))) for c in range(len(cols))])
    candidates = seen.where(F.col("c").isin(sure) & (F.col("low") >= bound)).select("c", "value")
    counts = lambda cells: cells.groupBy("c", "value").agg(F.count(F.lit(1)).alias("n"), F.min(ROW).alias("first_row"))
    parts = []
    if sure:
        few = candidates.count() <= MOST
        parts.append(counts(_counted(df, [(c, cols[c]) for c in sure]).join(F.broadcast(candidates) if few else candidates.hint("merge"), ["c", "value"], "left_semi")))
    if open_:
        parts.append(counts(_counted(df, [(c, cols[c]) for c in open_])))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("c").orderBy(F.desc("n"), "first_row"))).where(F.col("rank") <= n)
    name = F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("c") + 1)
    return ranked.select(name.alias("column_name"), "rank", "value", "n", "first_row")
