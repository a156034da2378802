"""Near-duplicates by min-max hashing, confirmed on full shingle sets.

Each of ``bands * rows / 2`` hash functions is evaluated once per shingle and gives two signature
values, the minimum and the maximum, so a signature needs half the evaluations of plain MinHash and
its estimate has lower variance.  A band is ``rows`` values (pairs of minimum and maximum).  There are
as many bands as keep the probability that two sets of the least similarity share none under 1e-6,
short sets included: 32 bands of 6 values at 0.85, 57 at 0.8.

Documents with equal sets form a class; only one of each class is banded.  A bucket's hub is its
least id.  Pairs are confirmed in three rounds, each followed by connected components: every member
with the least of its hubs (one pair a document), with hubs that are still in another component, and
with members of its buckets that still are and whose set size and signature allow the similarity.  So no link
that a band proposes and that could join two components goes unconfirmed, while a large group of
near copies costs a pair a member.
"""

from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.llm.components import components
from veracity.llm.storage import materialize
from veracity.llm.words import mix, shingle_sets


def bands_for(percent: int, rows: int, miss: float = 1e-6, least: int = 32) -> int:
    """Bands with which a pair of at least the similarity, whatever its sizes, shares none with probability under ``miss``."""
    # minimum and maximum of a union of u agree if both are among the k shingles shared
    agree = min(k * (k - 1) / (u * (u - 1)) for u in range(2, 2001) for k in [-(-percent * u // 100)] if k > 1)
    return max(least, math.ceil(math.log(miss) / math.log1p(-(agree ** (rows // 2)))) if agree < 1 else 1)


def _sketcher(width: int, bands: int, rows: int, seed: int):
    per_band = rows // 2
    rng = np.random.default_rng(seed)
    mul = rng.integers(0, 2**63, bands * per_band, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, bands * per_band, dtype=np.uint64) * np.uint64(2)

    def banded(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(sets)
        starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
        keys, low = np.empty((len(sets), bands), np.uint64), np.zeros((len(sets), -(-bands * rows // 16)), np.uint64)
        at = 0
        for b in range(bands):
            key = np.full(len(sets), b + 1, np.uint64)
            for i in range(b * per_band, (b + 1) * per_band):
                v = flat * mul[i] + add[i]
                for end in (np.minimum, np.maximum):
                    value = end.reduceat(v, starts)
                    low[:, at // 16] |= (mix(value) & np.uint64(15)) << np.uint64(at % 16 * 4)
                    key, at = mix(key ^ value) * np.uint64(0x9E3779B97F4A7C15), at + 1
            keys[:, b] = key
        return keys.view(np.int64), low.view(np.int64)

    def sketch(batches):
        for pdf in batches:
            for at in range(0, len(pdf), 1000):
                part = pdf.iloc[at : at + 1000]
                sets = shingle_sets(part["text"].tolist(), width)
                full = [i for i, s in enumerate(sets) if len(s)]
                keys, low = [None] * len(sets), [None] * len(sets)
                if full:
                    for i, *row in zip(full, *banded([sets[i] for i in full])):
                        keys[i], low[i] = row
                yield pd.DataFrame({"id": part["id"].to_numpy(), "n": [len(s) for s in sets], "class": [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], "keys": keys, "low": low})

    return sketch


def _short_set(width: int):
    @F.pandas_udf("array<int>")
    def short(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32) for at in range(0, len(texts), 500) for s in shingle_sets(texts[at : at + 500].tolist(), width)])

    return short


def _may(x: str, y: str, percent: int, values: int) -> Column:
    """Whether signatures cut to four bits a value leave room for the similarity.

    A value that differs changes two of its four bits on average.  Six standard deviations are
    allowed, so a pair of just the least similarity is lost with probability 1e-9.
    """
    off = 1 - percent / 100
    most = values * 2 * off + 6 * (values * (5 * off - 4 * off * off)) ** 0.5
    differ = reduce(Column.__add__, [F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(-(-values // 16))])
    return differ <= most


def _confirm(pairs: DataFrame, texts: DataFrame, width: int, percent: int, values: int) -> DataFrame:
    """The pairs (a, b) whose full sets have ``100 * |A n B| >= percent * |A u B|``."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(x), 500):
            left, right = shingle_sets(x[at : at + 500].tolist(), width), shingle_sets(y[at : at + 500].tolist(), width)
            for s, t in zip(left, right):
                both = len(np.intersect1d(s, t, assume_unique=True))
                out.append(len(s) > 0 and 100 * both >= percent * (len(s) + len(t) - both))
        return pd.Series(out)

    pairs = pairs.hint("merge")  # the same plan at every size
    met = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x"), F.col("low").alias("lx")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y"), F.col("low").alias("ly")), "b").where(_may("lx", "ly", percent, values))
    return met.where(linked("x", "y")).select("a", "b")


def _round(pairs: DataFrame, tried: DataFrame | None, so_far: tuple | None, texts: DataFrame, width: int, percent: int, values: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Confirm the pairs not tried before; (pairs tried, links, components) with them."""
    pairs = pairs.distinct()
    pairs = materialize(pairs.join(tried, ["a", "b"], "left_anti") if tried is not None else pairs, "pairs")
    links = materialize(_confirm(pairs, texts, width, percent, values), "links")
    if so_far is None:
        return pairs, links, components(links)
    if links.isEmpty():
        return tried.unionByName(pairs), *so_far
    links = so_far[0].unionByName(links)
    return tried.unionByName(pairs), links, components(links)


def _placed(slots: DataFrame, joined: DataFrame) -> DataFrame:
    """Bucket members with their component so far."""
    return slots.join(joined, "id", "left").select("key", "hub", "id", "n", F.coalesce("component", "id").alias("c"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, bands: int | None = None, rows: int = 6, seed: int = 7) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    * texts without words (null and empty ones too) have no shingles, ``component_id`` is their own id;
    * a row with a null id takes no part: ``component_id`` is null and it is kept;
    * an id stands for one text: rows that repeat an id with its text get equal rows;
    * shingles are told apart by 64-bit fingerprints, classes by 128-bit ones; other columns are not read.
    """
    bands = bands_for(percent, rows) if bands is None else bands
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = materialize(plain.mapInPandas(_sketcher(width, bands, rows, seed), "id long, n long, class binary, keys array<long>, low array<long>"), "sketch")
    sets = base.where("id is not null and n > 0")
    classes = sets.groupBy("class").agg(F.min("id").alias("rep"))
    reps = base.join(classes.select("class", F.col("rep").alias("id")), ["class", "id"], "left_semi").where("n > 0").dropDuplicates(["class"])
    slots = reps.select("id", "n", F.explode("keys").alias("key"))
    hubs = slots.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("top")).where("hub < top").select("key", "hub")
    shared = materialize(slots.join(hubs, "key"), "buckets")
    need = reps.select("id", "low", "keys").join(shared.select("id"), "id", "left_semi")
    texts = materialize(plain.join(need.hint("merge"), "id").dropDuplicates(["id"]), "texts")

    # first each member with one hub, the least of all its buckets'
    first = shared.where("id <> hub").groupBy("id").agg(F.min("hub").alias("a")).select("a", F.col("id").alias("b"))
    tried, links, joined = _round(first, None, None, texts, width, percent, bands * rows)
    # then with the hubs of its buckets that are still in another component
    placed = _placed(shared, joined)
    apart = placed.join(joined.select(F.col("id").alias("hub"), F.col("component").alias("hc")), "hub", "left").where(F.col("c") != F.coalesce("hc", "hub"))
    tried, links, joined = _round(apart.select(F.col("hub").alias("a"), F.col("id").alias("b")), tried, (links, joined), texts, width, percent, bands * rows)
    # last with every member of its buckets that still is
    placed = _placed(shared, joined)
    mixed = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    open_ = materialize(placed.join(mixed, "key", "left_semi"), "mixed")
    sets32 = texts.join(open_.select("id"), "id", "left_semi").select("id", "low", "keys", _short_set(width)("text").alias("set"))
    open_ = materialize(open_.join(sets32.hint("merge"), "id"), "mixed-sets")
    x = open_.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"), F.col("low").alias("lx"), F.col("set").alias("sx"), F.col("keys").alias("kx"))
    y = open_.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"), F.col("low").alias("ly"), F.col("set").alias("sy"), F.col("keys").alias("ky"))
    fits = (F.col("ca") < F.col("cb")) & (100 * F.col("na") >= percent * F.col("nb")) & (100 * F.col("nb") >= percent * F.col("na")) & _may("lx", "ly", percent, bands * rows)
    # inside the join, so that pairs of a large group that fall short are never rows; one percent is
    # left for fingerprints cut to 32 bits, and what passes is confirmed on full sets like any pair
    fits &= F.col("key") == F.array_min(F.array_intersect("kx", "ky"))  # in one of the buckets they share
    both = F.size(F.array_intersect("sx", "sy"))
    fits &= 100 * both >= (percent - 1) * (F.size("sx") + F.size("sy") - both)
    rest = x.join(y, "key").where(fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    tried, links, joined = _round(rest, tried, (links, joined), texts, width, percent, bands * rows)
    whole = classes.join(joined.select(F.col("id").alias("rep"), "component"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
    out = base.join(whole, "class", "left").select("id", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")).alias("component"))
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(comp == F.col("id"), F.lit(True)).alias("kept"))


def op2_near_duplicates(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
