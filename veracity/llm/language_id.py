"""Language identification by interpolated Kneser-Ney character models.

One model per language is estimated from a bounded sample of labelled rows: about
``docs_per_lang`` documents of each language, chosen by a hash of the id (the bound is a parameter;
the sample does not grow with the table).  All models share sorted arrays of n-gram keys, one per
order: an n-gram of up to four characters packs into 64 bits, and a binary search gives the row of
log-probabilities, one per language.  Every position of a whole text is scored; the language with
the lowest length-normalised cross-entropy wins.

Rejection is calibrated on the part of the sample the models did not learn from.  For each language and
length class the quantiles of its own texts' cross-entropies are kept: the 90 % point and the mean
excess behind it, by which the tail is carried on (exponentially).  They give a text's ``p``, the share
of texts of that language and length which fit no better.  ``score`` is the winner's posterior (from
the margin in nats over the text) times ``p / (p + RARE)``: it falls below a half where fewer than one
in a million such texts would fit as badly.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNSEEN = 1.0 / 65536
#: length classes (symbols), and the share of fitting texts at which the score is a half
CLASSES, RARE = (4, 16, 64, 256, 1024, 4096), 1e-6


@cache
def _folding() -> np.ndarray:
    """Symbol of each code point: the lower-case letter (BMP), or 0 for all that are no letters."""
    table = np.zeros(sys.maxunicode + 1, np.uint16)
    for c in range(sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            o = ord(low[0])
            table[c] = o if 0 < o < 65535 else 65535
    return table


def symbols(text: str | None) -> np.ndarray:
    """Lower-case letters with runs of anything else as one 0, one 0 at either end; no letters: empty."""
    if not text:
        return np.empty(0, np.uint16)
    s = _folding()[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
    if not s.any():
        return np.empty(0, np.uint16)
    s = np.concatenate([np.zeros(1, np.uint16), s, np.zeros(1, np.uint16)])
    return s[(s != 0) | np.concatenate([[True], s[:-1] != 0])]


def grams(s: np.ndarray, order: int) -> np.ndarray:
    """Keys of the n-grams that end at each position from ``order - 1`` on."""
    x, n = s.astype(np.uint64), len(s) - order + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    key = np.zeros(n, np.uint64)
    for i in range(order):
        key = (key << np.uint64(16)) | x[i : i + n]
    return key


class CharModels:
    """Interpolated Kneser-Ney models of all languages in sorted arrays."""

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int):
        """counts: by language the keys and counts of its full-order n-grams."""
        self.langs, self.order = sorted(counts), order
        self.keys, self.logp, self.ctx, self.lam = {}, {}, {}, {}
        tables = {}
        for lang in self.langs:
            k, c = counts[lang]
            for m in range(order, 0, -1):
                tables[lang, m] = (k, c.astype(float))
                # continuation counts: in how many contexts the shorter n-gram was seen
                k, c = np.unique(k & np.uint64((1 << (16 * (m - 1))) - 1), return_counts=True)
        width = len(self.langs)
        for m in range(1, order + 1):
            keys = np.unique(np.concatenate([tables[x, m][0] for x in self.langs]))
            heads = np.unique(keys >> np.uint64(16))
            p, lam = np.zeros((len(keys), width)), np.ones((len(heads), width))
            for j, lang in enumerate(self.langs):
                k, c = tables[lang, m]
                n1, n2 = (c == 1).sum(), (c == 2).sum()
                d = min(0.95, n1 / (n1 + 2 * n2)) if n1 else 0.5
                at, inverse = np.unique(k >> np.uint64(16), return_inverse=True)
                total = np.bincount(inverse, c)
                lam[np.searchsorted(heads, at), j] = d * np.bincount(inverse) / total
                p[np.searchsorted(keys, k), j] = np.maximum(c - d, 0) / total[inverse]
            self.keys[m], self.ctx[m], self.lam[m] = keys, heads, np.log(lam).astype(np.float32)
            below = np.full((len(keys), width), UNSEEN) if m == 1 else np.exp(self._find(keys & np.uint64((1 << (16 * (m - 1))) - 1), m - 1))
            self.logp[m] = np.log(p + lam[np.searchsorted(heads, keys >> np.uint64(16))] * below).astype(np.float32)
        self.limits = {}

    def _find(self, key: np.ndarray, m: int) -> np.ndarray:
        """Log-probabilities (n-gram by language) at order m, backing off where the n-gram is unseen."""
        if m == 0:
            return np.full((len(key), len(self.langs)), np.log(UNSEEN), np.float32)
        at = np.minimum(np.searchsorted(self.keys[m], key), len(self.keys[m]) - 1)
        out = self.logp[m][at]
        miss = np.flatnonzero(self.keys[m][at] != key)
        if len(miss):
            k = key[miss]
            low = self._find(k & np.uint64((1 << (16 * (m - 1))) - 1), m - 1)
            head = k >> np.uint64(16)
            h = np.minimum(np.searchsorted(self.ctx[m], head), len(self.ctx[m]) - 1)
            out[miss] = low + np.where((self.ctx[m][h] == head)[:, None], self.lam[m][h], np.float32(0))
        return out

    def entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy in nats per symbol (text by language) and symbols scored; 0 for no letters.

        A text with fewer symbols than the order is scored on its longest n-gram.
        """
        syms = [symbols(t) for t in texts]
        out, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64)
        long = [i for i, s in enumerate(syms) if len(s) >= self.order]
        for i, s in enumerate(syms):
            if 0 < len(s) < self.order:
                sizes[i] = 1
                out[i] = -self._find(grams(s, len(s)), len(s))[0]
        if long:
            out[long] = self._score([syms[i] for i in long])
            sizes[long] = [len(syms[i]) - self.order + 1 for i in long]
        return out, sizes

    def _score(self, syms: list[np.ndarray]) -> np.ndarray:
        """Cross-entropy in nats per symbol (sequence by language) of sequences no shorter than the order."""
        out = np.zeros((len(syms), len(self.langs)))
        for at in range(0, len(syms), 200):
            keys = [grams(s, self.order) for s in syms[at : at + 200]]
            n = np.array([len(k) for k in keys])
            sums = np.add.reduceat(self._find(np.concatenate(keys), self.order), np.cumsum([0, *n[:-1]]), axis=0, dtype=np.float64)
            out[at : at + 200] = -sums / n[:, None]
        return out

    def calibrate(self, texts: list, langs: list, windows: int = 4) -> None:
        """Per language and length class the 90 % point and the mean excess behind it.

        Every calibration text counts with up to ``windows`` stretches of each length it has, spread
        evenly over it.  A class with under 20 stretches takes the next shorter one's limits.
        """
        own: dict[tuple[str, int], list] = {}
        for s, lang in zip(map(symbols, texts), langs):
            for c, size in enumerate(CLASSES):
                size = max(size, self.order)
                if lang in self.langs and len(s) >= size:
                    starts = {round(i * (len(s) - size) / max(1, windows - 1)) for i in range(windows)}
                    own.setdefault((lang, c), []).extend(s[i : i + size] for i in starts)
        for j, lang in enumerate(self.langs):
            last = (float(np.log(65536)), 1.0)
            for c in range(len(CLASSES)):
                parts = own.get((lang, c), [])
                if len(parts) >= 20:
                    h = self._score(parts)[:, j]
                    high = float(np.quantile(h, 0.9))
                    last = high, max(float((h[h > high] - high).mean()) if (h > high).any() else 0.0, 0.01 * high)
                self.limits[lang, c] = last

    def predict(self, texts: list) -> tuple[list[str], np.ndarray]:
        h, n = self.entropies(texts)
        best = h.argmin(axis=1)
        posterior = 1 / np.exp(-(h - h.min(axis=1, keepdims=True)) * n[:, None]).sum(axis=1)
        # symbols of the text: n-grams and what stands before the first
        of = np.clip(np.searchsorted(CLASSES, n + self.order - 1, side="right") - 1, 0, len(CLASSES) - 1)
        limits = np.array([[self.limits[x, c] for c in range(len(CLASSES))] for x in self.langs])[best, of]
        p = np.minimum(1.0, 0.1 * np.exp(np.minimum(3.0, (limits[:, 0] - h.min(axis=1)) / limits[:, 1])))
        return [self.langs[b] if k else "und" for b, k in zip(best, n)], np.where(n > 0, posterior * p / (p + RARE), 0.0)


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 1000, order: int = 4) -> CharModels:
    """Models from about ``docs_per_lang`` rows of each language, a fifth of them for calibration.

    The rows are chosen by a hash of their id against ``docs_per_lang / rows of the language``, so
    the choice is repeatable and needs only a count.  n-grams are counted by Spark; what comes to
    the driver is bounded by the sample.  Rows with null text or language teach nothing.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["n"] for r in labelled.where(F.col(lang_col).isNotNull()).groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    point = F.pmod(F.xxhash64("id", F.lit("language-id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(docs_per_lang / n)) for lang, n in sizes.items()])
    sample = rows.where(point < share).select("text", "lang", (F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(5)) == 0).alias("held"))

    def count(batches):
        for pdf in batches:
            for lang, part in pdf[~pdf["held"]].groupby("lang"):
                keys, n = np.unique(np.concatenate([grams(symbols(t), order) for t in part["text"]]), return_counts=True)
                if len(keys):
                    yield pd.DataFrame({"lang": lang, "key": keys.view(np.int64), "n": n})

    found = sample.mapInPandas(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toPandas()
    if found.empty:
        return None
    models = CharModels({lang: tuple(x.to_numpy() for x in (p.sort_values("key")["key"], p.sort_values("key")["n"])) for lang, p in found.assign(key=found["key"].to_numpy().view(np.uint64)).groupby("lang")}, order)
    held = sample.where("held").select("text", "lang").toPandas()
    models.calibrate(held["text"].tolist(), held["lang"].tolist())
    return models


def identify(docs: DataFrame, models: CharModels | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1) added.

    Null texts and texts without a letter get ``und`` and score 0, as does every text when there is
    nothing to learn from.  The text alone decides; columns named lang_pred or score are replaced.
    """
    share = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("lang_pred string, score double")
    def guess(texts: pd.Series) -> pd.DataFrame:
        if share.value is None:
            return pd.DataFrame({"lang_pred": ["und"] * len(texts), "score": [0.0] * len(texts)})
        lang, score = share.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": lang, "score": score})

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.select(*[F.col(f"`{c}`") for c in kept], guess(F.col(text_col)).alias("_g")).select(*[F.col(f"`{c}`") for c in kept], "_g.lang_pred", "_g.score")


def fold(id_col: str = "doc_id"):
    """crc32(id as text) mod 5; a null id counts as the text 'null'."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")) % 5


def op10_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    models = fit(docs.where(fold() != 0))
    return identify(docs.select("doc_id", "text", (fold() == 0).alias("held_out")), models).drop("text")
