"""Cutting a table into chunks of consecutive rows."""

from __future__ import annotations

import io
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.sources.runs import store_of
from veracity.sources.tables import ROW, cut

#: what 16 and 32 bits of a ZIP archive can say; beyond, its 64-bit fields are used
_SHORT, _LONG = 0xFFFF, 0xFFFFFFFF
#: members whose places are summed up together
AREA = 4096


def assign_chunks(df: DataFrame, size: int = 1000) -> DataFrame:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    return df.withColumn("chunk_id", (F.floor(F.col(ROW) / size) + 1).cast("long"))


def write_chunks(df: DataFrame, path: str, size: int = 1000) -> None:
    """One folder a chunk, ``chunk_id=N``, each with its header, in row order."""
    assign_chunks(df, size).repartition("chunk_id").sortWithinPartitions("chunk_id", ROW).drop(ROW).write.mode("overwrite").partitionBy("chunk_id").option("header", True).csv(path)


def chunk_archives(df: DataFrame, size: int = 1000) -> DataFrame:
    """(chunk_id, name, n, archive): each chunk as a ZIP of one CSV file with header, rows in order.

    A group holds at most ``size`` rows.  Missing cells are empty, as in the CSV sink; an empty table has no chunks.
    """

    def pack(key, rows: pd.DataFrame) -> pd.DataFrame:
        name, out = f"chunk_{key[0]:03d}.csv", io.BytesIO()
        text = rows.sort_values(ROW).drop(columns=[ROW, "chunk_id"]).to_csv(index=False)
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo(name), text, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"chunk_id": [key[0]], "name": [name], "n": [len(rows)], "archive": [out.getvalue()]})

    return assign_chunks(df, size).groupBy("chunk_id").applyInPandas(pack, "chunk_id long, name string, n long, archive binary")


def chunk_name(chunk_id: int) -> str:
    return f"chunk_{chunk_id:03d}.csv"


def _each_chunk(df: DataFrame, size: int, make: Callable[[str, bytes], dict], schema: str) -> DataFrame:
    """chunk_id, name, n and what ``make`` gives for the CSV file (header and rows in order) of each chunk; a task holds one chunk."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        text = rows.sort_values(ROW).drop(columns=[ROW, "chunk_id"]).to_csv(index=False).encode("utf-8", "surrogatepass")
        return pd.DataFrame([{"chunk_id": key[0], "name": chunk_name(key[0]), "n": len(rows), **make(chunk_name(key[0]), text)}])

    return assign_chunks(df, size).groupBy("chunk_id").applyInPandas(pack, f"chunk_id long, name string, n long, {schema}")


def write_chunk_files(df: DataFrame, path: str, size: int = 1000) -> DataFrame:
    """``chunk_001.csv`` and so on under ``path``, each with its header and ``size`` rows in order; (chunk_id, name, n, bytes) of each.

    A file appears whole: it is written under another name and moved.  Missing cells are empty; an empty
    table has no chunks.  Files of the same names are replaced, others stay.
    """

    def write(name: str, text: bytes) -> dict:
        store, folder = store_of(path)
        store.create_dir(folder, recursive=True)
        made = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with store.open_output_stream(made) as out:
            out.write(text)
        store.move(made, f"{folder}/{name}")
        return {"bytes": len(text)}

    return cut(_each_chunk(df, size, write, "bytes long"))


def _local(name: bytes, crc: int, packed: int, plain: int) -> bytes:
    return struct.pack("<4sHHHHHIIIHH", b"PK\3\4", 20, 0, 8, 0, 33, crc, packed, plain, len(name), 0) + name


def _central(name: bytes, crc: int, packed: int, plain: int, offset: int, wide: bool) -> bytes:
    extra = struct.pack("<HHQ", 1, 8, offset) if wide else b""
    return struct.pack("<4sHHHHHHIIIHHHHHII", b"PK\1\2", 45, 45 if wide else 20, 0, 8, 0, 33, crc, packed, plain, len(name), len(extra), 0, 0, 0, 0, _LONG if wide else offset) + name + extra


def _end(n: int, size: int, offset: int, wide: bool) -> bytes:
    """The end of an archive of ``n`` members whose directory of ``size`` bytes begins at ``offset``."""
    out = b""
    if wide:
        out = struct.pack("<4sQHHIIQQQQ", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, offset) + struct.pack("<4sIQI", b"PK\6\7", 0, offset + size, 1)
    cap = lambda x, most: most if wide else x
    return out + struct.pack("<4sHHHHIIH", b"PK\5\6", 0, 0, cap(n, _SHORT), cap(n, _SHORT), cap(size, _LONG), cap(offset, _LONG), 0)


def write_archive(df: DataFrame, path: str, size: int = 1000, wide: bool | None = None) -> DataFrame:
    """One ZIP archive of all chunks at ``path``; (chunk_id, name, n, offset, packed) of each member.

    Tasks deflate one chunk each, and a prefix sum of the members' lengths, within areas of ``AREA`` chunks
    and over these, gives every member and its entry in the directory their places.  Then tasks write both
    where they belong, in parallel into one file: the same bytes at the same places if a task runs
    twice.  The archive gets its name when it is whole.  ``path`` is on a file system that all executors
    have mounted and that can write at a position.  ``wide`` forces 64-bit fields, which are used anyway
    beyond 65,535 members or 4 GiB.  An empty table gives an empty archive.
    """

    def deflate(name: str, text: bytes) -> dict:
        z = zlib.compressobj(9, zlib.DEFLATED, -15)
        data = z.compress(text) + z.flush()
        return {"crc": zlib.crc32(text), "plain": len(text), "packed": len(data), "data": data}

    members = cut(_each_chunk(df, size, deflate, "crc long, plain long, packed long, data binary"))
    local = F.octet_length("name") + 30 + F.col("packed")
    area = F.floor((F.col("chunk_id") - 1) / AREA)
    inside = Window.partitionBy("area").orderBy("chunk_id").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("area").rowsBetween(Window.unboundedPreceding, -1)

    def placed(t: DataFrame, length, out: str) -> DataFrame:
        """``t`` (chunk_id, area, ...) with the sum of ``length`` over the chunks before."""
        sums = t.groupBy("area").agg(F.sum(length).alias("_n"))
        base = sums.select("area", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
        return t.withColumn("_in", F.coalesce(F.sum(length).over(inside), F.lit(0))).join(base.hint("merge"), "area").withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in")

    slim = members.select("chunk_id", "name", "n", "packed", area.alias("area"))
    total = slim.agg(F.count(F.lit(1)), F.coalesce(F.sum(local), F.lit(0))).first()
    whole = wide if wide is not None else total[0] > _SHORT or total[1] > _LONG
    entry = F.octet_length("name") + 46 + F.when(F.lit(bool(wide)) | (F.col("offset") >= _LONG), 12).otherwise(0)
    spots = cut(placed(placed(slim, local, "offset"), entry, "directory"))
    length = spots.agg(F.coalesce(F.sum(entry), F.lit(0))).first()[0]
    start = total[1]
    made = f"{path}.{uuid.uuid4().hex}"
    with open(made, "wb") as out:
        out.truncate(start + length)
        out.seek(start + length)
        out.write(_end(total[0], length, start, whole or start + length > _LONG))

    def put(batches):
        with open(made, "r+b") as out:
            for batch in batches:
                for r in batch.to_pylist():
                    name = r["name"].encode()
                    out.seek(r["offset"])
                    out.write(_local(name, r["crc"], r["packed"], r["plain"]) + r["data"])
                    out.seek(start + r["directory"])
                    out.write(_central(name, r["crc"], r["packed"], r["plain"], r["offset"], bool(wide) or r["offset"] >= _LONG))
                yield pa.RecordBatch.from_arrays([batch.column(0)], names=["chunk_id"])

    full = members.join(spots.select("chunk_id", "offset", "directory").hint("merge"), "chunk_id")
    written = full.select("chunk_id", "name", "crc", "plain", "packed", "offset", "directory", "data").mapInArrow(put, "chunk_id long").count()
    if written != total[0]:
        os.remove(made)
        raise RuntimeError(f"{written} of {total[0]} chunks were written")
    os.replace(made, path)
    return spots.select("chunk_id", "name", "n", "offset", "packed")
