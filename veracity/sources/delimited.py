"""Reading CSV files with line breaks inside quotes in parallel, and a channel for faulty records.

Whether a line break ends a record depends on all quotes before it, which is why Spark's ``multiLine``
reader makes a file one task.  Here every split of a file is scanned under both assumptions, that it
begins outside and that it begins inside a quoted field.  Each split is thus a map of two states; the
maps of a file's splits are composed by a prefix scan over one row a split, and what was found under
the right assumption is kept.  Byte offsets and record numbers are prefix sums of the same kind, so
they belong to the file and not to the way in which it was split.

Lines that are a record by themselves never travel; only those of records over several lines meet,
by record.  The scanned lines are written once to the checkpoint folder.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veracity.sources.tables import ROW, cut, renumber

#: bytes of a record up to which its lines are put together
MOST_BYTES = 16 << 20
_BOM = "﻿"


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a line that begins inside or outside a quoted field ends inside one.

    A field is quoted if its first character is a quote; two quotes inside stand for one; what follows
    the closing quote up to the comma belongs to the field.
    """
    at = 0
    while True:
        if not inside:
            if line[at : at + 1] != b'"':
                at = line.find(b",", at) + 1
                if not at:
                    return False
                continue
            at += 1
        inside = False
        quote = line.find(b'"', at)
        while quote >= 0 and line[quote + 1 : quote + 2] == b'"':
            quote = line.find(b'"', quote + 2)
        if quote < 0:
            return True
        at = line.find(b",", quote + 1) + 1
        if not at:
            return False


_SCAN = "file string, split long, seq long, at long, bytes long, in0 boolean, in1 boolean, out0 boolean, out1 boolean, n0 long, n1 long, value string"


def _scan(batches):
    """For every line: its place in the split (number and bytes), and under both assumptions whether it begins and ends inside quotes and how many records began so far."""
    where, seq, at, state, count = None, 0, 0, [False, True], [0, 0]
    for batch in batches:
        files, splits, values = batch.column(0), batch.column(1), batch.column(2)
        if not batch.num_rows:
            continue
        names = pc.run_end_encode(files)
        change = {0, *(int(e) for e in names.run_ends[:-1].to_pylist()), *(np.flatnonzero(np.diff(splits.to_numpy())) + 1).tolist()}
        bounds = [*sorted(change), batch.num_rows]
        for lo, hi in zip(bounds, bounds[1:]):
            here = (files[lo].as_py(), splits[lo].as_py())
            if here != where:
                where, seq, at, state, count = here, 0, 0, [False, True], [0, 0]
            part = values.slice(lo, hi - lo)
            size = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64) + 1
            before, after, begun = (np.empty((2, hi - lo), bool) for _ in range(3))
            quoted = np.flatnonzero(pc.match_substring(part, '"').to_numpy(zero_copy_only=False))
            for s in (0, 1):
                last = 0
                for i in quoted:
                    before[s, last : i + 1] = after[s, last:i] = state[s]
                    after[s, i] = state[s] = ends_inside(part[int(i)].as_py().encode("utf-8", "surrogatepass"), state[s])
                    last = i + 1
                before[s, last:] = after[s, last:] = state[s]
            blank = pc.is_in(part, pa.array(["", "\r"])).to_numpy(zero_copy_only=False)
            begun = np.cumsum(~before & ~blank, axis=1) + np.array(count)[:, None]
            offset = at + np.cumsum(size) - size
            yield pa.RecordBatch.from_arrays(
                [files.slice(lo, hi - lo), splits.slice(lo, hi - lo), pa.array(np.arange(seq, seq + hi - lo)), pa.array(offset), pa.array(size), *(pa.array(x) for x in (before[0], before[1], after[0], after[1], begun[0], begun[1])), part],
                names=["file", "split", "seq", "at", "bytes", "in0", "in1", "out0", "out1", "n0", "n1", "value"],
            )
            seq, at, count = seq + hi - lo, int(offset[-1] + size[-1]), [int(begun[0, -1]), int(begun[1, -1])]


def _states(splits: DataFrame) -> DataFrame:
    """``splits`` (file, split, out0, out1, ...) with ``inside``, the state in which each begins.

    A split's map sets the state, turns it over or keeps it.  The state before a split is the last one
    set, turned over as often as there are turning splits since.
    """
    order = Window.partitionBy("file").orderBy("split")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    t = splits.withColumn("_turns", F.sum((F.col("out0") & ~F.col("out1")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    t = t.withColumn("_set", F.when(F.col("out0") == F.col("out1"), F.struct(F.col("out0").cast("int").alias("to"), F.col("_turns").alias("turns"))))
    t = t.withColumn("_last", F.last("_set", ignorenulls=True).over(before)).withColumn("_now", F.coalesce(F.lag("_turns").over(order), F.lit(0)))
    odd = (F.coalesce(F.col("_last.to"), F.lit(0)) + F.col("_now") - F.coalesce(F.col("_last.turns"), F.lit(0))) % 2
    return t.withColumn("inside", odd == 1).drop("_turns", "_set", "_last", "_now")


def records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, record (from 0 in each file), offset (its first byte in the file), text, closed of every record that is not blank.

    ``closed`` is false for a record whose quoted field does not end, and for one of more than
    ``MOST_BYTES``; the text of such a record is its first line.  Lines end with a line feed; a
    carriage return before it, and a byte order mark at the file's beginning, are left out.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    raw = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), "value")
    scanned = cut(raw.mapInArrow(_scan, _SCAN))
    ends = scanned.groupBy("file", "split").agg(F.max_by(F.struct("out0", "out1", "n0", "n1"), "seq").alias("e"), F.sum("bytes").alias("bytes")).select("file", "split", "e.*", "bytes")
    known = _states(ends).withColumn("n", F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0")))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    known = cut(known.select("file", "split", "inside", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base")))
    known = F.broadcast(known) if known.count() <= 100_000 else known.hint("merge")
    pick = lambda name: F.when(F.col("inside"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    placed = scanned.join(known, ["file", "split"]).select("file", "split", "seq", "value", "bytes", pick("in").alias("from_inside"), pick("out").alias("to_inside"), (F.col("first") + pick("n") - 1).alias("record"), (F.col("base") + F.col("at")).alias("offset"))
    alone = placed.where(~F.col("from_inside") & ~F.col("to_inside") & ~F.col("value").isin("", "\r")).select("file", "record", "offset", F.col("value").alias("text"), F.lit(True).alias("closed"))
    parts = placed.where(F.col("from_inside") | F.col("to_inside"))
    place = F.struct("split", "seq")
    whole = parts.groupBy("file", "record").agg(F.sum("bytes").alias("size"), F.min("offset").alias("offset"), F.min_by("value", place).alias("head"), F.max_by("to_inside", place).alias("open"))
    fits = ~F.col("open") & (F.col("size") <= MOST_BYTES)
    held = parts.join(whole.where(fits).select("file", "record").hint("merge"), ["file", "record"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "value"))), lambda x: x["value"]), "\n")
    several = held.groupBy("file", "record").agg(F.min("offset").alias("offset"), text.alias("text")).withColumn("closed", F.lit(True))
    broken = whole.where(~fits).select("file", "record", "offset", F.col("head").alias("text"), F.lit(False).alias("closed"))
    out = alone.unionByName(several.select("file", "record", "offset", "text", "closed")).unionByName(broken)
    bare = F.regexp_replace("text", "\r$", "")
    return out.withColumn("text", F.when((F.col("record") == 0) & bare.startswith(_BOM), F.substring(bare, 2, 2**31 - 1)).otherwise(bare))


def split_fields(text: Column) -> Column:
    """The fields of a record; quoted ones without their quotes, empty ones null."""
    quoted = r',("[^"]*+(?:""[^"]*+)*+"[^,]*+|[^,]*+)'
    bare = lambda f: F.when(f.rlike(r'(?s)^".*"$') & (F.length(f) > 1), F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    found = F.when(text.contains('"'), F.transform(F.regexp_extract_all(F.concat(F.lit(","), text), F.lit(quoted), F.lit(1)), bare)).otherwise(F.split(text, ",", -1))
    return F.transform(found, lambda f: F.nullif(f, F.lit("")))


def unique_headers(names: list[str | None]) -> list[str]:
    """Names that repeat get ``.1``, ``.2`` and so on, the first free one; nameless columns are ``Unnamed: i``."""
    plain = [n if n else f"Unnamed: {i}" for i, n in enumerate(names)]
    taken, used, out = set(plain), {}, []
    for n in plain:
        if n not in used:
            used[n] = 0
            out.append(n)
            continue
        while f"{n}.{used[n] + 1}" in taken:
            used[n] += 1
        used[n] += 1
        out.append(f"{n}.{used[n]}")
        taken.add(out[-1])
    return out


@dataclass(frozen=True)
class Table:
    """``rows``: row number and all columns as strings; ``faults``: file, record, offset, kind, fields, text; ``headers``."""

    rows: DataFrame
    faults: DataFrame
    headers: list[str]


def read_table(spark: SparkSession, path: str | list[str]) -> Table:
    """A CSV file, or files of one header, with contiguous row numbers in the order of file names and records.

    * a record with too few fields is filled up with nulls, and is a fault of kind ``short`` too;
    * one with more fields than the header is no row: kind ``long``;
    * one whose quoted field does not end, or that is too long, is no row: kind ``unclosed``;
    * a header that names a column twice is a fault of kind ``duplicate header``; the columns get names
      of their own (``a``, ``a.1``); a file whose header differs from the first file's is a fault of
      kind ``other header``, its rows are read by position;
    * empty fields are null; blank lines are skipped; files without any record give nothing, and a
      path with nothing but such files a table without columns.
    """
    found = cut(records(spark, path))
    head = found.where("record = 0").select("file", "offset", "text", "closed", split_fields(F.col("text")).alias("f"))
    first = head.orderBy("file").limit(1).collect()
    if not first:
        empty = spark.createDataFrame([], "file string, record long, offset long, kind string, fields long, text string")
        return Table(spark.createDataFrame([], f"{ROW} long"), empty, [])
    headers, width = unique_headers(list(first[0].f)), len(first[0].f)
    # one number a file: how many records stand in the files before
    sizes = found.where("record > 0").groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    base = sizes.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    base = F.broadcast(base) if base.count() <= 100_000 else base.hint("merge")
    body = found.where("record > 0").join(base, "file").select("file", "record", "offset", "text", "closed", (F.col("base") + F.col("record") - 1).alias(ROW), split_fields(F.col("text")).alias("f"))
    n = F.size("f").cast("long")
    kind = F.when(~F.col("closed"), "unclosed").when(n > width, "long").when(n < width, "short")
    faults = body.select("file", "record", "offset", kind.alias("kind"), n.alias("fields"), "text").where("kind is not null")
    names = head.select("file", F.lit(0).cast("long").alias("record"), "offset", F.size("f").cast("long").alias("fields"), "text", "f")
    twice = names.where(F.size(F.array_distinct("f")) < F.size("f")).withColumn("kind", F.lit("duplicate header"))
    other = names.where(~F.col("f").eqNullSafe(F.lit(first[0].f).cast("array<string>"))).withColumn("kind", F.lit("other header"))
    for t in (twice, other):
        faults = faults.unionByName(t.drop("f"))
    good = body.where(F.col("closed") & (n <= width))
    rows = good.select(ROW, *[F.get("f", F.lit(i)).alias(h) for i, h in enumerate(headers)])
    # numbers without gaps where records are left out
    left_out = body.where(~(F.col("closed") & (n <= width)))
    if not left_out.isEmpty():
        rows = renumber(rows)
    return Table(rows, faults, headers)
