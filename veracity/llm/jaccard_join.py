"""N-gram Jaccard join: the product of the document by n-gram incidence matrix with itself, in blocks.

An entry of the product is the number of n-grams two documents share, and two documents link when it
reaches ``need``, the least overlap their sizes allow.  Only the part of the product is worked out
that decides this and that the classes of linked documents depend on:

* Documents with equal sets are one row of the matrix.
* Columns are ordered by rarity.  A set of n n-grams that shares at least ``ceil(p n)`` of them with
  another shares one of its first ``n - ceil(p n) + 1`` (its prefix), so only prefix columns propose
  pairs.  Rarity is that of an n-gram's rarest word, counted over all texts into ``BUCKETS`` counters;
  any order all documents agree on is right, this one keeps frequent passages out of prefixes.
* The product of what is held of two rows (the prefix, and at least ``HELD`` n-grams of it that has as many) bounds
  the whole entry: what is not held adds ``n - held`` at most, so for small sets it is the entry itself.
  Pairs whose sizes differ too much, or whose bound is under ``need``, are discarded.
* Each column is first multiplied with one row, its least id (linear in the column).  Entries that
  pass are worked out on full sets, and connected components are taken.  What is left are columns
  whose other rows still lie in several components.  These are cut by size class (sizes of linked
  sets lie in one class or two neighbours) and into tiles of bounded size; a task multiplies two
  tiles, accumulates overlap counts over blocks of columns and emits only pairs of different
  components that pass the bound, each in the first column the two share.

So a group of equal or similar documents costs work in proportion to its size, and no link between
different sets is lost: every pair that shares a prefix column and could join two components is
decided on full sets.  Columns of m rows of which no two are alike still cost m * m comparisons
inside tiles, none of them a row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.llm.components import components
from veracity.llm.storage import materialize
from veracity.llm.words import mix, word_hashes, words

#: counters of word frequencies
BUCKETS = 1 << 18
#: rows of a tile, and prefix entries of one
TILE, TILE_ENTRIES = 1024, 1 << 18
#: n-grams of a set, the rarest first, that bound its overlaps (its prefix, if that is longer)
HELD = 48
#: rows up to which those of a column are paired with each other
FEW = 12
#: columns multiplied at a time
COLUMNS = 4096

_STEP = np.uint64(0x9E3779B97F4A7C15)


def need(a, b, percent: int):
    """The least overlap of linked sets of ``a`` and ``b`` n-grams (integers, arrays or Columns)."""
    if isinstance(a, Column):
        return F.ceil(percent * (a + b) / (100 + percent))
    return -(-percent * (a + b) // (100 + percent))


def prefix_size(n: int, percent: int) -> int:
    return n + percent * n // -100 + 1


def _prefix(n: Column, percent: int) -> Column:
    return (n - F.ceil(percent * n / 100) + 1).cast("int")


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(65 - BUCKETS.bit_length())).astype(np.int64)


def word_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """How often the words of each of ``BUCKETS`` hash buckets occur in all texts: one number a bucket, whatever the input."""

    def count(batches):
        found = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = [_slots(word_hashes(words(t))) for t in batch.column(0).slice(at, 500).to_pylist()]
                found += np.bincount(np.concatenate(part), minlength=BUCKETS)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], names=["bucket", "n"])

    sums = docs.select(text_col).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[sums.column("bucket").to_numpy()] = sums.column("n").to_numpy()
    return out


def ngram_sets(texts: list, width: int, counts: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray | None]]:
    """For each text its distinct 64-bit n-gram fingerprints, sorted, and how rare each is (count of its rarest word's bucket)."""
    out = []
    for text in texts:
        h = word_hashes(words(text))
        if len(h) >= width:
            rolled = np.zeros(len(h) - width + 1, np.uint64)
            for i in range(width):
                rolled = rolled * _STEP + h[i : i + len(rolled)]
            rolled = mix(rolled)
        elif len(h):
            whole = np.uint64(len(h))
            with np.errstate(over="ignore"):
                for x in h:
                    whole = whole * _STEP + x
            rolled = mix(np.array([whole], np.uint64))
        else:
            rolled = np.empty(0, np.uint64)
        if counts is None:
            out.append((np.unique(rolled), None))
            continue
        found, first = np.unique(rolled, return_index=True)
        if len(h) >= width:
            c = counts[_slots(h)]
            rare = np.minimum.reduce([c[i : i + len(rolled)] for i in range(width)])[first]
        else:
            rare = counts[_slots(h)].min(initial=np.iinfo(np.int64).max) * np.ones(len(found), np.int64)
        out.append((found, rare))
    return out


def _incidence(width: int, percent: int, counts):
    def run(batches):
        order = counts.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n, digest, held = [], [], []
                for found, rare in ngram_sets(part.column(1).to_pylist(), width, order):
                    n.append(len(found))
                    digest.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    most = max(prefix_size(len(found), percent), min(len(found), HELD))
                    held.append(found[np.lexsort((found, rare))[:most]].view(np.int64) if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(held, pa.list_(pa.int64()))], names=["id", "n", "class", "held"])

    return run


def _passes(na: Column, nb: Column, pa_: Column, pb: Column, percent: int) -> Column:
    """Whether the product of what is held of two rows, and what is not, allows a link."""
    shared = F.size(F.array_intersect(pa_, pb))
    return shared + F.greatest(na - F.size(pa_), nb - F.size(pb)) >= need(na, nb, percent)


def _like(na: Column, nb: Column, percent: int) -> Column:
    return (100 * na >= percent * nb) & (100 * nb >= percent * na)


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share as many n-grams as their sizes need."""

    @F.pandas_udf("boolean")
    def linked(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for at in range(0, len(x), 200):
            for (s, _), (t, _) in zip(ngram_sets(x[at : at + 200].tolist(), width), ngram_sets(y[at : at + 200].tolist(), width)):
                out.append(len(s) > 0 and len(np.intersect1d(s, t, assume_unique=True)) >= need(len(s), len(t), percent))
        return pd.Series(out, dtype=bool)

    met = pairs.hint("merge").join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return met.where(linked("x", "y")).select("a", "b")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared entries of every set of ``left`` with every set of ``right``: products of blocks of columns, added up."""
    x, y = np.concatenate(left), np.concatenate(right)
    columns = np.intersect1d(x, y)
    total = np.zeros((len(left), len(right)), np.float32)
    rows_x, rows_y = np.repeat(np.arange(len(left)), [len(s) for s in left]), np.repeat(np.arange(len(right)), [len(s) for s in right])
    at_x, at_y = np.searchsorted(columns, x), np.searchsorted(columns, y)
    in_x, in_y = (np.take(columns, at_x, mode="clip") == x, np.take(columns, at_y, mode="clip") == y) if len(columns) else (np.zeros(len(x), bool), np.zeros(len(y), bool))
    for lo in range(0, len(columns), COLUMNS):
        hi = min(lo + COLUMNS, len(columns))
        a, b = np.zeros((len(left), hi - lo), np.float32), np.zeros((len(right), hi - lo), np.float32)
        for m, rows, at, here in ((a, rows_x, at_x, in_x), (b, rows_y, at_y, in_y)):
            now = here & (at >= lo) & (at < hi)
            m[rows[now], at[now] - lo] = 1
        total += a @ b.T
    return total.astype(np.int64)


_LAID = "key long, grade int, i int, j int, id long, n long, component long, own long, side int"


def _blocks(batches):
    """(key and size class, rows) of each block of two tiles; a row: id, n, component, own size class, side (0: left, 1: right, 2: both), last column.

    Rows come sorted by block; a block holds two tiles at most.
    """
    now, rows = None, []
    for batch in batches:
        names = zip(*(batch.column(c).to_pylist() for c in range(4)))
        facts = zip(*(batch.column(c).to_pylist() for c in range(4, 9)))
        for name, fact, last in zip(names, facts, batch.column(9)):
            if name != now:
                if len(rows) > 1:
                    yield now, rows
                now, rows = name, []
            rows.append((*fact, last.as_py() if isinstance(last, pa.StringScalar) else last.values.to_numpy()))
    if len(rows) > 1:
        yield now, rows


def _open(grade: int, rows: list, percent: int):
    """Left and right rows of a block, their sizes, and which pairs may link different components."""
    left, right = [r for r in rows if r[4] != 1], [r for r in rows if r[4] != 0]
    (ia, na, ca, ga), (ib, nb, cb, gb) = (tuple(np.array([r[i] for r in rs], np.int64) for i in range(4)) for rs in (left, right))
    sizes = (100 * na[:, None] >= percent * nb[None]) & (100 * nb[None] >= percent * na[:, None])
    open_ = sizes & (ca[:, None] != cb[None]) & (np.maximum(ga[:, None], gb[None]) == grade) & ((ia[:, None] < ib[None]) | (rows[0][4] != 2))
    a, b = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
    return [left[i] for i in a], [right[i] for i in b], na[a][:, None], nb[b][None], open_[np.ix_(a, b)]


def _bounded(percent: int):
    """Of each block the rows that have a pair within the bound whose first shared column is the block's."""

    def run(batches):
        for name, rows in _blocks(batches):
            left, right, na, nb, open_ = _open(name[1], rows, percent)
            if not left:
                continue
            held = [np.array([len(r[5]) for r in rs]) for rs in (left, right)]
            bound = overlaps([r[5] for r in left], [r[5] for r in right]) + np.maximum(na - held[0][:, None], nb - held[1][None])
            wanted = {}
            columns = [np.sort(r[5][: prefix_size(r[1], percent)]) for r in left], [np.sort(r[5][: prefix_size(r[1], percent)]) for r in right]
            for i, j in zip(*np.nonzero(open_ & (bound >= need(na, nb, percent)))):
                if left[i][0] in wanted and right[j][0] in wanted:
                    continue
                # a pair meets in every column it shares: once is enough
                if np.intersect1d(columns[0][i], columns[1][j], assume_unique=True)[0] == name[0]:
                    wanted[left[i][0]], wanted[right[j][0]] = left[i], right[j]
            if wanted:
                found = [(*name, *r[:5]) for r in wanted.values()]
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int32() if c in (1, 2, 3, 8) else pa.int64()) for c in range(9)], names=["key", "grade", "i", "j", "id", "n", "component", "own", "side"])

    return run


def _linked(width: int, percent: int):
    """Of each block links (a, b) that join the components of its rows, decided on full sets."""

    def run(batches):
        for name, rows in _blocks(batches):
            left, right, na, nb, open_ = _open(name[1], rows, percent)
            if not left:
                continue
            sets = {r[0]: None for r in (*left, *right)}
            for r in (*left, *right):
                if sets[r[0]] is None:
                    sets[r[0]] = ngram_sets([r[5]], width)[0][0]
            shared = overlaps([sets[r[0]] for r in left], [sets[r[0]] for r in right])
            top, found = {}, []

            def root(c):
                while top.get(c, c) != c:
                    c = top[c]
                return c

            for i, j in zip(*np.nonzero(open_ & (shared >= need(na, nb, percent)))):
                x, y = root(left[i][2]), root(right[j][2])
                if x != y:
                    top[x] = y
                    found.append(sorted((left[i][0], right[j][0])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], names=["a", "b"])

    return run


def _tiles(open_: DataFrame, reps: DataFrame, plain: DataFrame, width: int, percent: int) -> DataFrame:
    """Rows (key, id, n, component) of open columns laid out as blocks of two tiles, multiplied; links that join components."""
    # a little wider than the sizes of linked sets can differ, so that rounding puts none two classes apart
    grade = F.floor(F.log(F.col("n").cast("double")) / max(float(np.log(100 / percent)) * (1 + 1e-6), 1e-3)).cast("int")
    rows = open_.withColumn("own", grade)
    # into the column of its own size class and, as the smaller set, of the class above
    rows = rows.select("*", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("grade"))
    room = F.greatest(F.lit(1), F.least(F.lit(TILE), F.floor(F.lit(TILE_ENTRIES) / _prefix(F.col("n"), percent))))
    rows = rows.withColumn("weight", 1.0 / room)
    tiles = rows.groupBy("key", "grade").agg(F.ceil(F.sum("weight")).cast("int").alias("tiles"), F.count_if(F.col("own") == F.col("grade")).alias("owners"), F.min("component").alias("lo"), F.max("component").alias("hi"))
    tiles = tiles.where("owners > 0 and lo < hi").select("key", "grade", "tiles")
    rows = rows.join(tiles.hint("merge"), ["key", "grade"]).withColumn("tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda o: F.struct(F.least("tile", o).alias("i"), F.greatest("tile", o).alias("j"), F.when(F.col("tile") == o, 2).when(F.col("tile") < o, 0).otherwise(1).alias("side")))
    laid = rows.select("key", "grade", F.inline(pairs), "id", "n", "component", F.col("own").cast("long").alias("own"))
    block, facts = ["key", "grade", "i", "j"], ["id", "n", "component", "own", "side"]

    def dealt(df: DataFrame, last: str) -> DataFrame:
        return df.select(*block, *facts, last).repartition(*block).sortWithinPartitions(*block)

    bounded = dealt(laid.join(reps.select("id", "held").hint("merge"), "id"), "held").mapInArrow(_bounded(percent), _LAID)
    bounded = materialize(bounded, "bounded")
    texts = plain.join(bounded.select("id").distinct().hint("merge"), "id").dropDuplicates(["id"])
    return dealt(bounded.join(texts.hint("merge"), "id"), "text").mapInArrow(_linked(width, percent), "a long, b long")


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (the least id reachable by links, itself included).

    Two documents link when ``100 * |A n B| >= percent * |A u B|`` for their sets of distinct n-grams of
    ``width`` words (A-Z in lower case, split at white space); a text with fewer words is one n-gram.

    * texts without words (null and empty ones too) have no n-grams and are their own component;
    * a row with a null id takes no part: its component_id is null;
    * an id stands for one text: rows that repeat an id with its text get equal rows;
    * a text of any length is one row of the matrix; an empty table gives an empty result;
    * n-grams are told apart by 64-bit fingerprints, equal sets by 128-bit ones; other columns are not read.
    """
    spark = docs.sparkSession
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    counts = spark.sparkContext.broadcast(word_counts(plain))
    base = materialize(plain.mapInArrow(_incidence(width, percent, counts), "id long, n long, class binary, held array<long>"), "incidence")
    classes = base.where("id is not null and n > 0").groupBy("class").agg(F.min("id").alias("rep"))
    reps = base.join(classes.select("class", F.col("rep").alias("id")).hint("merge"), ["class", "id"], "left_semi").where("n > 0").dropDuplicates(["class"]).select("id", "n", "held")
    reps = materialize(reps, "incidence-rows")
    slots = reps.select(F.explode(F.slice("held", F.lit(1), _prefix(F.col("n"), percent))).alias("key"), "id", "n")
    columns = slots.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    shared = materialize(slots.join(columns.hint("merge"), "key"), "columns")
    hubs = shared.groupBy("key").agg(F.min("id").alias("hub"))

    def rows_of(name: str) -> DataFrame:
        return reps.select(F.col("id").alias(name), F.col("n").alias(f"n{name}"), F.col("held").alias(f"p{name}"))

    def passed(pairs: DataFrame) -> DataFrame:
        """The distinct pairs whose prefixes share enough."""
        met = pairs.distinct().hint("merge").join(rows_of("b"), "b").join(rows_of("a").hint("merge"), "a")
        return met.where(_passes(F.col("na"), F.col("nb"), F.col("pa"), F.col("pb"), percent)).select("a", "b")

    # each column by the row of its least id
    members = shared.join(hubs.hint("merge"), "key").where(F.col("id") != F.col("hub"))
    hub_sizes = reps.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"))
    pairs = members.select("hub", "id", "n").distinct().join(hub_sizes.hint("merge"), "hub").where(_like(F.col("n"), F.col("hub_n"), percent)).select(F.col("hub").alias("a"), F.col("id").alias("b"))
    pairs = materialize(passed(pairs), "passed")
    wanted = lambda p: plain.join(p.select(F.explode(F.array("a", "b")).alias("id")).distinct().hint("merge"), "id").dropDuplicates(["id"])
    texts = materialize(wanted(pairs), "texts")
    first = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    links = materialize(_confirmed(first, texts, width, percent), "links")
    joined = components(links)

    def apart(p: DataFrame, joined: DataFrame) -> DataFrame:
        label = lambda c: joined.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")).hint("merge")
        met = p.join(label("a"), "a", "left").join(label("b"), "b", "left")
        return met.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")

    rest = apart(pairs.join(first.hint("merge"), ["a", "b"], "left_anti"), joined)
    more = materialize(_confirmed(rest, texts, width, percent), "links")
    links = links.unionByName(more)
    joined = components(links)
    # columns whose rows besides the first still lie in several components: a few rows each with each, many in tiles
    others = members.where("rows > 2").join(joined.hint("merge"), "id", "left").select("key", "rows", "id", "n", F.coalesce("component", "id").alias("component"))
    mixed = others.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
    open_ = materialize(others.join(mixed.hint("merge"), "key", "left_semi"), "open-columns")
    few, many = open_.where(F.col("rows") <= FEW), open_.where(F.col("rows") > FEW).drop("rows")
    x, y = few.select("key", F.col("id").alias("a"), F.col("n").alias("na"), F.col("component").alias("ca")), few.select("key", F.col("id").alias("b"), F.col("n").alias("nb"), F.col("component").alias("cb"))
    met = x.hint("merge").join(y, "key").where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & _like(F.col("na"), F.col("nb"), percent)).select("a", "b")
    last = materialize(passed(met), "passed")
    more = _confirmed(last, materialize(wanted(last), "texts"), width, percent)
    more = materialize(more.unionByName(_tiles(many, reps, plain, width, percent)), "links")
    if not more.isEmpty():
        joined = components(links.unionByName(more))
    whole = classes.join(joined.select(F.col("id").alias("rep"), "component").hint("merge"), "rep", "left").select("class", F.coalesce("component", "rep").alias("component"))
    out = base.select("id", "n", "class").join(whole.hint("merge"), "class", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.when(F.col("id").isNotNull(), F.col("component"))).otherwise(F.col("id")).alias("component_id"))


def op11_ngram_join(spark, sf_dir):
    return ngram_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
