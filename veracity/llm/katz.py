"""Katz back-off scoring of texts with a word bigram model.

Counts come from the training documents as pre-aggregated group-bys, in slices of the words; the
model is three tables in the shared folder: words with their probabilities and the weights they have
as histories, and the counts of the bigrams that stand more than once (any other bigram of a training
text has the count 1, any other of a held-out text was never seen).  A text's score is a sum over its
bigrams of the discounted count's logarithm, over its words of the history's normaliser, and over its
unseen bigrams of the back-off weight and the unigram; the first meets the bigram table in one
equi-join, in slices of the documents, the others the word table in another.

Counts up to ``k`` are discounted by Good-Turing in Katz' form; where the counts of counts do not
allow it, by one absolute discount.  Back-off weights are normalised exactly: for every history the
probabilities of all words and of the unknown word sum to 1.  A history that no discount leaves any
mass gives up one count.  Words are told apart by 64-bit fingerprints, and so are the bigrams that
texts are scored by.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracity.llm.storage import discard, materialize
from veracity.llm.words import mix, word_codes
from veracity.sources.tables import stable_keys

START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start", b" end"))
#: slices of the words for counting, of the histories, and of the documents for scoring: each is shuffled by itself
COUNTING, HISTORIES, SCORING = 2, 2, 3
#: the most frequent words, whose values go to every task
FREQUENT = 1 << 17
#: bytes of text that a task holds as arrays at a time
TAKE = 1 << 24


def _takes(batches):
    """Arrow batches cut to about ``TAKE`` bytes of text, with the words of each.

    (batch, hashes of the distinct words and of START and END behind them, end of each text in the
    tokens, tokens as places in the hashes); each text's tokens are its words and END.
    """
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(sizes):
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TAKE, "right")))
            part = batch.slice(at, to - at)
            n, codes, known = word_codes(part.column("text"))
            ends = np.cumsum(n + 1)
            w = np.full(ends[-1], len(known) + 1, np.int64)
            inner = np.ones(len(w), bool)
            inner[ends - 1] = False
            w[inner] = codes
            yield part, np.append(known, (START, END)), ends, w
            at = to


def _histories(w: np.ndarray, ends: np.ndarray, start: int) -> np.ndarray:
    h = np.empty_like(w)
    h[1:] = w[:-1]
    h[0] = start
    h[ends[:-1]] = start
    return h


def training_bigrams(docs: DataFrame, of: int, k: int) -> DataFrame:
    """docs: (held, text) -> (h, w, c, e): distinct bigrams of some texts, with their number in training and in other texts.

    Of ``of`` slices by the second word, the ``k``th.
    """

    def cut(batches):
        for part, known, ends, w in _takes(batches):
            held = np.repeat(part.column("held").to_numpy(zero_copy_only=False).astype(np.int64), np.diff(ends, prepend=0))
            mine, bits = (mix(known) % np.uint64(of) == k)[w], len(known).bit_length()
            keys, n = np.unique(((_histories(w, ends, len(known) - 2)[mine] << bits | w[mine]) << 1) | held[mine], return_counts=True)
            e, pairs = np.where(keys & 1, n, 0), keys >> 1
            hashes = known.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(hashes[pairs >> bits]), pa.array(hashes[pairs & ((1 << bits) - 1)]), pa.array(n - e), pa.array(e)], names=["h", "w", "c", "e"])

    return docs.select("held", "text").mapInArrow(cut, "h long, w long, c long, e long")


def document_bigrams(docs: DataFrame) -> DataFrame:
    """docs: (row, held, text) -> (row, held, h, w, n): the distinct bigrams of each text and their number."""

    def cut(batches):
        for part, known, ends, w in _takes(batches):
            h, texts = _histories(w, ends, len(known) - 2), np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            order = np.lexsort((w, h, texts)) if len(ends) * len(known) ** 2 >= 1 << 63 else None
            if order is None:
                keys, n = np.unique((texts * len(known) + h) * len(known) + w, return_counts=True)
                w, rest = keys % len(known), keys // len(known)
                h, texts = rest % len(known), rest // len(known)
            else:
                w, h, texts = w[order], h[order], texts[order]
                first = np.flatnonzero(np.append(True, (np.diff(w) != 0) | (np.diff(h) != 0) | (np.diff(texts) != 0)))
                w, h, texts, n = w[first], h[first], texts[first], np.diff(first, append=len(w))
            texts = pa.array(texts)
            yield pa.RecordBatch.from_arrays([part.column("row").take(texts), part.column("held").take(texts), pa.array(known[h].view(np.int64)), pa.array(known[w].view(np.int64)), pa.array(n.astype(np.int32))], names=["row", "held", "h", "w", "n"])

    return docs.select("row", "held", "text").mapInArrow(cut, "row long, held boolean, h long, w long, n int")


def document_words(docs: DataFrame, frequent: tuple[np.ndarray, ...]) -> DataFrame:
    """docs: (row, id, held, text) -> for each text (row, id, held, w null, n_tokens, known, base, score), the sums over its frequent words, and for each other word (row, w).

    frequent: fingerprints in order, and the values known, base and hist of each.
    """
    names = ["row", "id", "held", "w", "n", "known", "base", "score"]

    def cut(batches):
        at, *values = frequent
        for part, known, ends, w in _takes(batches):
            k = known.view(np.int64)
            place = np.minimum(np.searchsorted(at, k), max(len(at) - 1, 0))
            met = at[place] == k if len(at) else np.zeros(len(k), bool)
            texts = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
            seen, base, hist = (np.bincount(texts, np.where(met, x[place], 0)[w] if len(at) else np.zeros(len(w)), len(ends)) for x in values)
            # every text has START as a history once
            hist = hist + (values[2][place[-2]] if met[-2] else 0)
            yield pa.RecordBatch.from_arrays([part.column("row"), part.column("id"), part.column("held"), pa.nulls(len(ends), pa.int64()), pa.array(np.diff(ends, prepend=0).astype(np.int64)), pa.array(seen.astype(np.int64)), pa.array(base), pa.array(hist)], names=names)
            rare = np.flatnonzero(~met[w])
            rows, ws = part.column("row").take(pa.array(texts[rare])), k[w[rare]]
            if not met[-2]:
                rows, ws = pa.concat_arrays([rows, part.column("row")]), np.append(ws, np.full(len(ends), START.view(np.int64)))
            none = lambda t: pa.nulls(len(ws), t)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([rows, none(pa.int64()), none(pa.bool_()), pa.array(ws), none(pa.int64()), none(pa.int64()), none(pa.float64()), none(pa.float64())], names=names)

    return docs.select("row", "id", "held", "text").mapInArrow(cut, "row long, id long, held boolean, w long, n long, known long, base double, score double")


def discounts(of: dict[int, int], k: int) -> dict[int, float]:
    """Factor for counts 1 to k (and, under key 0, none above) from the numbers of n-grams seen r times."""
    n = lambda r: of.get(r, 0)
    if n(1) and all(n(r) for r in range(1, k + 2)):
        a = (k + 1) * n(k + 1) / n(1)
        d = {r: ((r + 1) * n(r + 1) / (r * n(r)) - a) / (1 - a) for r in range(1, k + 1)} if a != 1 else {}
        if d and all(0 < x < 1 for x in d.values()):
            return d
    flat = n(1) / (n(1) + 2 * n(2)) if n(1) and n(2) else 0.5
    return {r: (r - flat) / r for r in range(1, k + 1)}


def _factor(c: str, d: dict[int, float]) -> Column:
    out = F.when(F.col(c) > max(d), 1.0)
    for r, x in d.items():
        out = out.when(F.col(c) == r, x)
    return out


def _counts_of_counts(t: DataFrame, most: int) -> dict[int, int]:
    return {r["c"]: r["m"] for r in t.where(F.col("c").between(1, most)).groupBy("c").agg(F.count(F.lit(1)).alias("m")).collect()}


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def fit_and_score(docs: DataFrame, held: Column, id_col: str = "doc_id", text_col: str = "text", k: int = 5) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    The model learns from rows where ``held`` is false.  Null and empty texts are the end token alone;
    repeated rows count and are scored as often as they stand; without training rows every word is
    unknown, with probability 1; an empty table gives no rows.  Other columns are not read.
    """
    rows = stable_keys(docs.select(F.col(id_col).cast("long").alias("id"), held.alias("held"), F.col(text_col).cast("string").alias("text")), "row")
    counted = [
        materialize(training_bigrams(rows, COUNTING, i).groupBy("h", "w").agg(F.sum("c").alias("c"), F.sum("e").alias("e")).where("c > 0"), "katz-counts", free=True) for i in range(COUNTING)
    ]
    bigrams = _union(counted)
    words_ = materialize(bigrams.groupBy("w").agg(F.sum("c").alias("c")), "katz-words", free=True)
    total, distinct = words_.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    d1, d2 = discounts(_counts_of_counts(words_, k + 1), k), discounts(_counts_of_counts(bigrams, k + 1), k)
    size = float(max(total, 1))
    p = _factor("c", d1) * F.col("c") / size
    mass = words_.agg(F.sum(p)).first()[0] or 0.0
    rest = 1.0 - mass
    if rest <= 1e-12 and total:
        p, rest = (F.col("c") + 1) / float(total + distinct + 1), 1.0 / (total + distinct + 1)
    unigrams = words_.select("w", p.alias("p"))
    often = F.broadcast(words_.orderBy(F.desc("c"), "w").limit(FREQUENT).select("w", p.alias("_p")))

    def histories(i: int) -> DataFrame:
        """(h, ch, given, ps): a history's count, what the discounts take of it, and the probability of the words seen after it."""
        own = bigrams.where(F.pmod(F.xxhash64("h"), F.lit(HISTORIES)) == i).select("h", "w", "c", ((1 - _factor("c", d2)) * F.col("c")).alias("given"))
        tried = own.join(often, "w", "left")
        met = tried.where("_p is not null").select("h", "c", "given", F.col("_p").alias("p"))
        other = tried.where("_p is null").drop("_p").join(unigrams.hint("merge"), "w").select("h", "c", "given", "p")
        return met.unionByName(other).groupBy("h").agg(F.sum("c").alias("ch"), F.sum("given").alias("given"), F.sum("p").alias("ps"))

    found = [materialize(histories(i), "katz-histories", free=True) for i in range(HISTORIES)]
    kept = F.when(F.col("given") <= 1e-9, F.col("ch") / (F.col("ch") + 1.0)).otherwise(1.0)
    left = 1 - kept * (F.col("ch") - F.col("given")) / F.col("ch")
    as_history = _union(found).select(F.col("h").alias("w"), F.log10(kept / F.col("ch")).alias("hist"), F.log10(left / F.greatest(1 - F.col("ps"), F.lit(1e-300))).alias("alpha"), "ch")
    # START is no word, END no history
    none = F.log10(F.lit(1 / float(total + distinct + 1)))
    model = words_.select("w", F.col("c").alias("cw"), F.log10((F.col("c") + 1) / float(total + distinct + 1)).alias("base"), F.log10(p).alias("logp")).join(as_history.hint("merge"), "w", "full")
    is_start = F.col("w") == F.lit(int(START.view(np.int64)))
    model = materialize(
        model.select(
            "w", F.coalesce("cw", "ch").alias("cw"), F.col("cw").isNotNull().cast("long").alias("known"), F.when(is_start, 0.0).otherwise(F.coalesce("base", none)).alias("base"),
            F.coalesce("logp", F.log10(F.lit(rest))).alias("logp"), F.coalesce("hist", F.lit(0.0)).alias("hist"), (F.coalesce("alpha", F.lit(0.0)) - F.coalesce("hist", F.lit(0.0))).alias("alpha"),
        ), "katz-model", free=True,
    )
    often_met = bigrams.where("c + e > 1").select(F.xxhash64("h", "w").alias("f"), "c")
    again = materialize(often_met, "katz-bigrams")
    discard(*counted, words_, *found)
    top = model.orderBy(F.desc("cw"), "w").limit(FREQUENT).select("w", "known", "base", "hist").toArrow().sort_by("w")
    frequent = tuple(top.column(c).to_numpy() for c in ("w", "known", "base", "hist"))

    def scored(i: int) -> DataFrame:
        """(row, h, w, n, score): the sum over a text's seen bigrams, with h and w null, and its unseen bigrams."""
        own = document_bigrams(rows.where(F.pmod(F.xxhash64("row"), F.lit(SCORING)) == i))
        own = own.select("row", "n", F.xxhash64("h", "w").alias("f"), F.when(F.col("held"), F.col("h")).alias("h"), F.when(F.col("held"), F.col("w")).alias("w"))
        # of a text that was learnt from, a bigram that is not in the table stands nowhere else
        c = own.join(again.hint("shuffle_hash"), "f", "left").withColumn("c", F.coalesce("c", F.when(F.col("h").isNull(), 1).otherwise(0)))
        seen = F.col("c") > 0
        out = c.select("row", F.when(~seen, F.col("h")).alias("h"), F.when(~seen, F.col("w")).alias("w"), "n", F.when(seen, F.col("n") * F.log10(_factor("c", d2) * F.col("c"))).alias("score"))
        return out.groupBy("row", "h", "w").agg(F.sum("n").alias("n"), F.sum("score").alias("score"))

    bigram_sums = _union([materialize(scored(i), "katz-scored", free=True) for i in range(SCORING)])
    word_sums = materialize(document_words(rows, frequent), "katz-texts")
    unseen = bigram_sums.where("h is not null")
    zero = F.lit(0).cast("long")
    asked = (
        word_sums.where("w is not null").select("row", "w", F.lit(1).cast("long").alias("own"), zero.alias("uh"), zero.alias("uw"))
        .unionByName(unseen.select("row", F.col("h").alias("w"), zero.alias("own"), F.col("n").alias("uh"), zero.alias("uw")))
        .unionByName(unseen.select("row", "w", zero.alias("own"), zero.alias("uh"), F.col("n").alias("uw")))
    )
    met = asked.join(model.hint("shuffle_hash"), "w", "left")
    by_word = F.col("own") * F.coalesce("hist", F.lit(0.0)) + F.col("uh") * F.coalesce("alpha", F.lit(0.0)) + F.col("uw") * F.coalesce("logp", F.log10(F.lit(rest)))
    nothing = F.lit(None)
    parts = _union([
        word_sums.where("w is null").select("row", "id", "held", "n", "known", "base", "score"),
        bigram_sums.where("h is null").select("row", nothing.cast("long").alias("id"), nothing.cast("boolean").alias("held"), zero.alias("n"), zero.alias("known"), F.lit(0.0).alias("base"), "score"),
        met.select("row", nothing.cast("long").alias("id"), nothing.cast("boolean").alias("held"), zero.alias("n"), (F.col("own") * F.coalesce("known", zero)).alias("known"), (F.col("own") * F.coalesce("base", none)).alias("base"), by_word.alias("score")),
    ])
    out = parts.groupBy("row").agg(F.max("id").alias("id"), F.max("held").alias("held"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("score").alias("score"))
    return out.select(F.col("id").alias(id_col), F.col("held").alias("held_out"), "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(id_col: str = "doc_id") -> Column:
    """crc32(id as text) mod 7 is 2; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % 7 == 2


def op5_katz_score(spark, sf_dir):
    return fit_and_score(spark.read.parquet(f"{sf_dir}/documents.parquet"), held_out())
