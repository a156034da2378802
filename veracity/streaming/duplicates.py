"""Repeated ids on a stream, with retractions: whatever the batches, the sum of all changes is the batch result.

A row whose id stands alone so far is given out as unique.  When a copy comes, that first row is
taken back and given out as a duplicate, like the copy; further copies follow as duplicates.  State is one row an
id (the first, until it is taken back) and is dropped when the watermark passes ``late`` behind the id's
last row; a copy that comes later than that counts as a first row again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veracity.functions.cells import is_missing, strip

CHANGES = "change int, duplicate boolean"


def read_files(spark: SparkSession, path: str, headers: list[str], files_per_batch: int = 1) -> DataFrame:
    """A folder of CSV files as a stream of string columns, at most so many files a batch: the chunked scan."""
    schema = T.StructType([T.StructField(h, T.StringType()) for h in headers])
    return spark.readStream.schema(schema).option("header", True).option("escape", '"').option("maxFilesPerTrigger", files_per_batch).csv(path)


def id_changes(stream: DataFrame, id_col: str, ts: str | None = None, late: str = "1 day") -> DataFrame:
    """The stream's columns, ``change`` (1: the row is given out, -1: it is taken back) and ``duplicate``.

    Rows without an id are unique and keep no state.  With ``ts`` state is dropped ``late`` behind the
    id's last row, without it never.  Ids are compared without white space around them.
    """
    ident = F.col(f"`{id_col}`")
    fields = stream.schema
    out = T.StructType([*fields, T.StructField("change", T.IntegerType()), T.StructField("duplicate", T.BooleanType())])
    state = T.StructType([T.StructField("taken", T.BooleanType()), *fields])
    names = fields.names

    def follow(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        kept = group.get if group.exists else None
        first, taken, last = (list(kept[1:]), kept[0], None) if kept else (None, False, None)
        for pdf in batches:
            pdf = pdf[names].astype(object).where(pdf[names].notna(), None)
            rows = pdf.values.tolist()
            if ts is not None and rows:
                last = max([x for x in (last, *(r[names.index(ts)] for r in rows)) if x is not None], default=None)
            given = []
            if rows and first is None:
                first = rows.pop(0)
                if not rows:
                    given.append([*first, 1, False])
                else:  # a copy is here already: nothing to take back
                    given.append([*first, 1, True])
                    taken = True
            if rows:
                if not taken:
                    given += [[*first, -1, False], [*first, 1, True]]
                    taken = True
                given += [[*r, 1, True] for r in rows]
            if given:
                yield pd.DataFrame(given, columns=[*names, "change", "duplicate"])
        if first is not None:
            group.update((taken, *first))
        if last is not None:
            group.setTimeoutTimestamp(int(max(pd.Timestamp(last).timestamp() * 1000 + pd.Timedelta(late).total_seconds() * 1000, group.getCurrentWatermarkMs() + 1)))

    marked = stream if ts is None else stream.withWatermark(ts, late)
    alone = marked.where(is_missing(ident)).select("*", F.lit(1).alias("change"), F.lit(False).alias("duplicate"))
    timeout = GroupStateTimeout.NoTimeout if ts is None else GroupStateTimeout.EventTimeTimeout
    keyed = marked.where(~is_missing(ident)).withColumn("_id", strip(ident)).groupBy("_id").applyInPandasWithState(follow, out, state, "append", timeout)
    return keyed.unionByName(alone)


def settled(changes: DataFrame) -> DataFrame:
    """The rows that stand after all changes, with ``duplicate``: rows given out and not taken back."""
    cols = [F.col(f"`{c}`") for c in changes.columns if c != "change"]
    net = changes.groupBy(*cols).agg(F.sum("change").alias("_n")).where("_n > 0")
    return net.select("*", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("col", "_n")
