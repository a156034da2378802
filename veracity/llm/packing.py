"""Variable-capacity best-fit packing of documents into training sequences.

Documents are dealt to shards of bounded size by a hash of their id; only ids and lengths travel.
In a shard, bins are filled one after the other: the longest piece left opens a bin, every permitted
size is filled best-fit from the lengths still to come, and the size and contents that cost least per
token placed are taken.  Plain best fit is worked out beside it, and the cheaper packing of the two
is kept.  Every bin has the smallest permitted size that holds its contents.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZES = (512, 1024, 2048, 4096, 8192)
#: numbers of longest pieces tried for one bin, from the most that fit downwards
TRIES = 6


def cost(size: int) -> float:
    """Relative cost of a training sequence: linear layers and, from long contexts on, attention."""
    return size * (1 + size / 32768)


def _total(final: dict[int, int], cost) -> float:
    return sum(cost(s) for s in final.values())


def best_fit(lengths: list[int], sizes: list[int]) -> tuple[list[int], list[int], dict[int, int]]:
    """Each piece into the open bin it fills best; one that fits nowhere opens a bin of the smallest size that holds it."""
    free: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    open_ = 0  # bit r: some bin has r tokens free
    used, bins, offsets = [], [], []
    for n in lengths:
        fits = open_ >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = free[room].pop()
            if not free[room]:
                open_ ^= 1 << room
        else:
            b = len(used)
            used.append(0)
            room = next(s for s in sizes if s >= n)
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        if room > n:
            free[room - n].append(b)
            open_ |= 1 << (room - n)
    return bins, offsets, {b: next(s for s in sizes if s >= u) for b, u in enumerate(used)}


def fill_bins(lengths: list[int], sizes: list[int], cost) -> tuple[list[int], list[int], dict[int, int]]:
    """Bin after bin from the longest piece left, in the size and with the pieces that cost least per token placed."""
    where: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        where.setdefault(lengths[i], []).append(i)
    there = sum(1 << n for n in where)  # bit n: a piece of n tokens is left

    def filled(size: int, n: int, k: int) -> tuple[int, list[tuple[int, int]]]:
        """Tokens and (length, number): k pieces of n, then always the longest shorter one that fits."""
        room, chosen, left = size - n * k, [(n, k)], there & ((1 << n) - 1)
        while room and (left := left & ((1 << (room + 1)) - 1)):
            m = left.bit_length() - 1
            j = min(len(where[m]), room // m)
            chosen.append((m, j))
            room -= m * j
            left ^= 1 << m
        return size - room, chosen

    bins, offsets, final = [0] * len(lengths), [0] * len(lengths), {}
    while there:
        n = there.bit_length() - 1
        best = None
        for size in sizes:
            if size < n:
                continue
            most = min(len(where[n]), size // n)
            for k in range(most, max(0, most - TRIES), -1):
                used, chosen = filled(size, n, k)
                least = next(s for s in sizes if s >= used)
                if best is None or cost(least) * best[1] < cost(best[0]) * used:
                    best = least, used, chosen
                if used == size:
                    break
        b, at = len(final), 0
        final[b] = best[0]
        for m, k in best[2]:
            for _ in range(k):
                i = where[m].pop()
                bins[i], offsets[i] = b, at
                at += m
            if not where[m]:
                there ^= 1 << m
    return bins, offsets, final


def pack(lengths: list[int], sizes: tuple = SIZES, cost=cost) -> tuple[list[int], list[int], dict[int, int]]:
    """(bin, offset) of each piece, and the size of each bin; lengths are sorted downwards, none over the largest size.

    The cheaper of two packings: bins filled jointly over all sizes, and best fit with the smallest size for each first piece.
    """
    sizes = sorted(sizes)
    return min((fill_bins(lengths, sizes, cost), best_fit(lengths, sizes)), key=lambda x: _total(x[2], cost))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", length_col: str = "n_tokens", sizes: tuple = SIZES, shard_rows: int = 50_000) -> DataFrame:
    """One row per piece: id, piece, piece_start, n_tokens, bin_id, bin_size, bin_offset.

    * a document longer than the largest size is cut into pieces of that size and a rest;
    * a document of no tokens (null, zero or negative length) is one piece of 0 tokens without a bin
      (null bin_id, bin_size and bin_offset);
    * null and repeated ids are packed like any other row; ties in length go by id, then piece;
    * an empty table gives an empty result; columns other than the two named are not read.
    """
    most = max(sizes)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.greatest(F.coalesce(F.col(length_col).cast("long"), F.lit(0)), F.lit(0)).alias("total"))
    shards = max(1, -(-docs.count() // shard_rows))
    last = F.floor((F.greatest("total", F.lit(1)) - 1) / most)
    rows = rows.select("id", "total", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * most
    pieces = rows.select("id", "piece", start.alias("piece_start"), F.least(F.col("total") - start, F.lit(most)).alias("n_tokens"))
    # repeated ids would meet in one shard: pieces are dealt by their place in the input too
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", F.monotonically_increasing_id()), F.lit(shards)))

    def task(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "id", "piece"], ascending=[False, True, True], kind="stable")
        full = pdf[pdf["n_tokens"] > 0]
        bins, offsets, final = pack(full["n_tokens"].tolist(), sizes)
        full = full.assign(bin_id=[f"{key[0]}-{b}" for b in bins], bin_size=[final[b] for b in bins], bin_offset=np.array(offsets, np.int64))
        return pd.concat([full, pdf[pdf["n_tokens"] == 0].assign(bin_id=None, bin_size=None, bin_offset=None)] if len(full) < len(pdf) else [full]).drop(columns="shard")

    schema = "id long, piece long, piece_start long, n_tokens long, bin_id string, bin_size long, bin_offset long"
    return dealt.groupBy("shard").applyInPandas(task, schema).withColumnRenamed("id", id_col)


def word_tokens(docs: DataFrame, text_col: str = "text", out_col: str = "n_tokens") -> DataFrame:
    """``docs`` with ``out_col``: words (split at white space) and one end token; null text has 0."""

    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return pd.Series([0 if t is None else len(t.encode("utf-8", "surrogatepass").split()) + 1 for t in texts], dtype="int64")

    return docs.withColumn(out_col, size(F.col(text_col)))


def op3_best_fit_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack_documents(word_tokens(docs).drop("text"))
