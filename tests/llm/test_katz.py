import math
import zlib
from collections import Counter

from pyspark.sql import functions as F

from veracity.llm.katz import fit_and_score, op5_katz_score
from veracity.llm.words import words


def good_turing(counts, k):
    """Katz' factors d_r = (r*/r - a) / (1 - a), r* = (r + 1) N_(r+1) / N_r, a = (k + 1) N_(k+1) / N_1; None where they are no shares."""
    n = Counter(counts)
    if not all(n[r] for r in range(1, k + 2)):
        return None
    a = (k + 1) * n[k + 1] / n[1]
    d = {r: ((r + 1) * n[r + 1] / (n[r] * r) - a) / (1 - a) for r in range(1, k + 1)} if a != 1 else {0: 2}
    return d if all(0 < x < 1 for x in d.values()) else None


def discounts(counts, k):
    n = Counter(counts)
    flat = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
    return good_turing(counts, k) or {r: 1 - flat / r for r in range(1, k + 1)}


def brute(rows, held, k=5):
    """The same model by dictionaries: rows (id, text) -> id: (n_tokens, n_known, base, score)."""
    toks = {i: [*words(t), "</s>"] for i, t in rows}
    uni, bi = Counter(), Counter()
    for i, ts in toks.items():
        if i not in held:
            uni.update(ts)
            bi.update(zip(["<s>", *ts], ts))
    n, v = sum(uni.values()), len(uni)
    d1, d2 = discounts(uni.values(), k), discounts(bi.values(), k)
    p = {w: d1.get(c, 1.0) * c / n for w, c in uni.items()}
    rest = 1 - sum(p.values())
    by_h = {}
    for (h, w), c in bi.items():
        by_h.setdefault(h, {})[w] = c

    def prob(h, w):
        low = p.get(w, rest)
        if h not in by_h:
            return low
        ws = by_h[h]
        ch, dc = sum(ws.values()), sum(d2.get(c, 1.0) * c for c in ws.values())
        kept = ch / (ch + 1) if dc >= ch - 1e-9 else 1.0
        if w in ws:
            return kept * d2.get(ws[w], 1.0) * ws[w] / ch
        return (1 - kept * dc / ch) / (1 - sum(p[x] for x in ws)) * low

    out = {i: (len(ts), sum(t in uni for t in ts), sum(math.log10((uni[t] + 1) / (n + v + 1)) for t in ts), sum(math.log10(prob(h, t)) for h, t in zip(["<s>", *ts], ts))) for i, ts in toks.items()}
    return out, prob, list(uni), by_h


def test_matches_brute_force_and_is_normalised(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    want, prob, vocabulary, by_h = brute(rows, held)
    got = op5_katz_score(spark, sf_dir).collect()
    assert len(got) == len(rows) and {r.doc_id for r in got if r.held_out} == held
    for r in got:
        n, known, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known) == (n, known)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-6)
    for h in list(by_h)[:20]:
        assert math.isclose(sum(prob(h, w) for w in vocabulary) + prob(h, "no such word"), 1, abs_tol=1e-9)
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_good_turing_factors(spark):
    """Counts of counts that allow the Good-Turing factors: they, and not the flat discount, are taken."""
    from veracity.llm import katz

    n = {r: round(6000 / (r * (r + 1))) for r in range(1, 7)}
    counts = [r for r, m in n.items() for _ in range(m)]
    want = good_turing(counts, 5)
    got = katz.discounts(n, 5)
    assert want and got.keys() == want.keys() and all(math.isclose(got[r], want[r]) for r in want)


def test_edge_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b A", "x"), (3, "a b A", "x"), (None, "b", "x")], "doc_id long, text string, n string")
    got = fit_and_score(df, F.lit(False)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens) for r in got) == [(False, 1, 1, 1, 12), (False, 2, 1, 1, 12), (False, 3, 4, 4, 12), (False, 3, 4, 4, 12), (True, 0, 2, 2, 12)]
    assert fit_and_score(df.limit(0), F.lit(False)).count() == 0


def test_words_of_many_texts():
    """Arrow's words of a column are those of ``words``, text by text."""
    import random

    import pyarrow as pa

    from veracity.llm.words import word_codes, word_hashes

    draw = random.Random(3)
    texts = [None, "", " ", "\x1c", *("".join(draw.choice("aBÄ \t\n\x0b\x0c\r\x1c\x85\xa0\u2003世") for _ in range(draw.randrange(30))) for _ in range(500))]
    n, codes, known = word_codes(pa.array(texts))
    assert list(n) == [len(words(t)) for t in texts]
    assert list(known[codes]) == list(word_hashes([w for t in texts for w in words(t)])) and len(set(known)) == len(known)


def test_tables_and_shuffles_are_removed(spark, tmp_path):
    """Of op5's tables only those that the result reads stay, and they hold no bigram that stands once."""
    import os

    from veracity.llm import storage

    seen, kept = [], storage.new_path
    try:
        storage.new_path = lambda _, name: seen.append(f"{tmp_path}/{name}-{len(seen)}") or seen[-1]
        df = spark.createDataFrame([(1, "a b a b"), (2, "a b c"), (3, "x y z")], "doc_id long, text string")
        fit_and_score(df, F.lit(False)).collect()
    finally:
        storage.new_path = kept
    left = {p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in seen if os.path.exists(p)}
    assert not left & {"katz-counts", "katz-words", "katz-histories"} and "katz-bigrams" in left
    assert spark.read.parquet(*[p for p in seen if "katz-bigrams" in p]).count() == 2  # START a, a b
