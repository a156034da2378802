"""Brute-force comparisons and edge rows of the corpus operators."""

import functools
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from veracity.llm import chat_format, exact_dedup, language_id, minhash, packing, sentencepiece_lattice, token_counts, vector_search, warc
from veracity.llm.storage import new_path
from veracity.llm.words import shingle_sets


def oracle(df, sql, **tables):
    cols = sorted(df.columns)
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"create view {name} as select * from '{path}'")
    rel = con.sql(sql)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())


TEXTS = [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (5, "x"), (6, "X"), (7, "w" * 5000 + " end"), (8, "w" * 5000 + " end"), (9, "w" * 5000 + " enD"), (None, "x"), (5, "x")]
SCHEMA = "doc_id long, text string, id string, n string, keep_id string, lang string"


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, "id", "n", "keep", None) for i, t in TEXTS], SCHEMA)


@pytest.mark.parametrize("module, query, table", [(exact_dedup, "op4_exact_dedup", "documents"), (vector_search, "op6_exact_top_k", "embeddings"), (chat_format, "op9_chat_format", "conversations"), (warc, "op1_warc", "pages")])
def test_sql(spark, sf_dir, module, query, table):
    oracle(getattr(module, query)(spark, sf_dir), module.ORACLE_SQL, **{table: f"{sf_dir}/{table}.parquet"})


def test_exact_dedup_edges(spark, odd):
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd, first=2, growth=2).collect())
    assert got == Counter([(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 3, True), (5, 5, 3, True), (None, 5, 3, False), (6, 6, 1, True), (7, 8, 2, False), (8, 8, 2, True), (9, 9, 1, True)])
    assert exact_dedup.exact_groups(odd.limit(0)).count() == 0


def components_by_hand(rows, percent):
    sets, root = {i: s for (i, _), s in zip(rows, shingle_sets([t for _, t in rows]))}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in sets.items():
        for h in s.tolist():
            where.setdefault(h, []).append(i)
    for i, s in sets.items():
        for j, both in Counter(j for h in s.tolist() for j in where[h] if j < i).items():
            if 100 * both >= percent * (len(s) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = components_by_hand(rows, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.op2_near_duplicates(spark, sf_dir).collect()} == want


def test_near_duplicates_chain_and_edges(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: 200 - 3 * i], *[f"v{i}-{j}" for j in range(3 * i)]])) for i in range(8)] + [(50, None), (51, " \t"), (52, "one two"), (53, "ONE two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("x"))
    want = components_by_hand(rows, 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(df).collect()} == want
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_token_counts(spark, sf_dir):
    import public_tokenizers
    import sentencepiece

    model = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert {r.doc_id: r.n_tokens for r in token_counts.op7_token_counts(spark, sf_dir).collect()} == {r.doc_id: len(lib.encode(r.text)) for r in docs.collect()}
    rng = random.Random(3)
    odd = ["", " a  b", "xx▁y zz " * 30, "n" * 100, "  " * 30, "\n a <s> </s> " * 9, "<0x41> \x00", None, "".join(rng.choice("aeinorst世") for _ in range(4000)), " a  b"]
    df = spark.createDataFrame([*enumerate(odd), (0, "the same id")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("n_tokens", "row", "rest", "_")})
    want = Counter((i, len(lib.encode(t or "")), "x") for i, t in [*enumerate(odd), (0, "the same id")])
    for chunk in (1, 3, 50, 1 << 16):
        assert Counter((r.doc_id, r.n_tokens, r.row) for r in token_counts.count_tokens(df, model, chunk=chunk).collect()) == want
    assert token_counts.count_tokens(df.limit(0), model).count() == 0
    big = df.where("doc_id = 8").withColumn("text", F.repeat("text", 300))
    assert token_counts.count_tokens(big, model).first().n_tokens == len(lib.encode(odd[8] * 300))


def test_transducer_equals_merging(spark):
    """The automaton against plain merging, on a made-up vocabulary with overlapping tokens."""

    def merged(ranks, text):
        parts = list(text)
        while True:
            r, i = min(((ranks.get(a + b, 999), i) for i, (a, b) in enumerate(itertools.pairwise(parts))), default=(999, 0))
            if r == 999:
                return sum(1 if x in ranks else len(x.encode()) for x in parts)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(5)
    for _ in range(20):
        tokens, names = list("abc▁"), set("abc▁")
        while len(tokens) < 40:
            new = rng.choice(tokens) + rng.choice(tokens)
            if new not in names and len(new) < 9:
                tokens.append(new)
                names.add(new)
        ranks = {t: r for r, t in enumerate(tokens)}
        t = token_counts.Transducer(ranks)
        for _ in range(200):
            text = "".join(rng.choice("aabbc ▁é") for _ in range(rng.randint(1, 40)))
            assert t.count(text) == merged(ranks, "▁" + text.replace(" ", "▁"))


def test_sentencepiece_round_trip_and_best_sum(spark):
    import public_tokenizers

    model = sentencepiece_lattice.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    scores = {r.piece: r.score for r in model[0].where("piece is not null").collect()}
    names = {r.id: r.piece for r in model[0].where("piece is not null").collect()}
    df = spark.createDataFrame([(1, "the tokens of a text\n and 世\U0001f600x"), (2, None), (3, "")], "doc_id long, text string")
    coded = sentencepiece_lattice.encode_words(sentencepiece_lattice.distinct_words(df), model)
    for r in sentencepiece_lattice.decode_words(coded, model).collect():
        assert r.decoded == r.word.replace("▁", " ")
        if all(c in scores for c in r.word):
            best = [0.0] + [float("-inf")] * len(r.word)
            for e in range(1, len(r.word) + 1):
                best[e] = max(best[s] + scores[r.word[s:e]] for s in range(max(0, e - model[1]), e) if r.word[s:e] in scores)
            assert sum(scores[names[i]] for i in r.ids) == best[-1]
    assert {r.doc_id for r in sentencepiece_lattice.encode(df, model).collect()} == {1}


def test_sentencepiece_documents(spark, tmp_path):
    import hashlib

    import public_tokenizers

    texts = [(1, "the tokens of a text\n and 世\U0001f600x"), (1, "the tokens  the the "), (2, None), (3, ""), (4, " a"), (5, "the " * 300), (6, "a▁b"), (None, "of a text"), (None, "of a text")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    model = sentencepiece_lattice.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    ids = {r.word: list(r.ids) for r in sentencepiece_lattice.encode_words(sentencepiece_lattice.distinct_words(df), model).collect()}
    want = Counter()
    for i, t in texts:
        coded = [x for w in re.split(sentencepiece_lattice.WORD, "▁" + t.replace(" ", "▁")) for x in ids[w]] if t else []
        want[i, len(coded), hashlib.sha256(" ".join(map(str, coded)).encode()).hexdigest(), None if t is None else "▁" not in t] += 1
    assert Counter(tuple(r) for r in sentencepiece_lattice.op8_sentencepiece(spark, str(tmp_path)).collect()) == want
    for hot in (1, 3):
        rows = sentencepiece_lattice.encode(df.where("doc_id = 5"), model, hot_words=hot).orderBy("word_no").collect()
        assert [list(r.ids) for r in rows] == [ids[w] for w in re.split(sentencepiece_lattice.WORD, "▁" + texts[5][1].replace(" ", "▁"))]


def test_language_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.op10_language_id(spark, sf_dir).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got) and all(0 <= r.score <= 1 for r in got)
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)


def test_language_rejection(spark):
    rng = random.Random(2)
    parts = {"aa": ["the", "ing", "of", "an", "wh"], "bb": ["ij", "oo", "va", "de", "sch"], "cc": ["zi", "co", "gna", "lle", "tu"]}
    text = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows = [(i, text(lang, 40), lang) for i, lang in enumerate(["aa", "bb"] * 200)]
    models = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = [(i, text(lang, n), lang) for i, (lang, n) in enumerate([("aa", 30), ("bb", 30), ("aa", 8), ("bb", 200), ("cc", 30), ("cc", 200)] * 20)]
    tests += [(1000 + i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz  ") for _ in range(200)), "no") for i in range(20)]
    got = language_id.identify(spark.createDataFrame(tests, "doc_id long, text string, want string"), models).collect()
    for r in got:
        assert (r.lang_pred == r.want and r.score >= 0.5) if r.want in ("aa", "bb") else r.score < 0.5


def test_kneser_ney_brute_force():
    import numpy as np

    corpus = {"x": ["abab aba", "bab", "abc"], "y": ["cab cab", "ccc"]}
    syms = {lang: [language_id.symbols(t).tolist() for t in ts] for lang, ts in corpus.items()}
    counts = {lang: np.unique(np.concatenate([language_id.grams(np.array(q, np.uint16), 3) for q in qs]), return_counts=True) for lang, qs in syms.items()}
    models = language_id.CharModels(counts, 3)

    def prob(lang, gram):
        """Interpolated Kneser-Ney: raw counts at the full order, numbers of contexts below, one discount an order."""
        tables = {3: Counter(tuple(q[i : i + 3]) for q in syms[lang] for i in range(len(q) - 2))}
        for m in (2, 1):
            tables[m] = Counter(g[1:] for g in tables[m + 1])
        if not gram:
            return language_id.UNSEEN
        t = tables[len(gram)]
        ones, twos = sum(c == 1 for c in t.values()), sum(c == 2 for c in t.values())
        d = min(0.95, ones / (ones + 2 * twos)) if ones else 0.5
        own = {g: c for g, c in t.items() if g[:-1] == gram[:-1]}
        if not own:
            return prob(lang, gram[1:])
        return max(own.get(gram, 0) - d, 0) / sum(own.values()) + d * len(own) / sum(own.values()) * prob(lang, gram[1:])

    letters = [0, *map(ord, "abcz")]
    for gram in itertools.product(letters, repeat=3):
        key = language_id.grams(np.array(gram, np.uint16), 3)
        assert np.allclose(np.exp(models._find(key, 3)[0]), [prob(lang, gram) for lang in models.langs], rtol=1e-4)


def test_language_edges(spark, odd):
    assert {(r.lang_pred, r.score) for r in language_id.identify(odd, language_id.fit(odd)).collect()} == {("und", 0.0)}
    rows = [(i, "the quick brown fox and the dog", "en") for i in range(20)] + [(i, "der schnelle braune fuchs und der hund", "de") for i in range(20, 40)]
    models = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert language_id.identify(odd.limit(0), models).count() == 0
    tests = spark.createDataFrame([(1, "the dog"), (2, "der hund"), (3, None), (4, "12 !"), (5, "a")], "doc_id long, text string")
    assert [r.lang_pred for r in language_id.identify(tests, models).orderBy("doc_id").collect()][:4] == ["en", "de", "und", "und"]


def test_warc_rejects_magic_in_payloads(spark):
    inner = "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:99>\r\nContent-Length: 4\r\n\r\n0123\r\n\r\n"
    rows = [(i, f"u{i}", "é" * (i % 90) + inner * (i % 4) + ("WARC/1." if i % 7 == 0 else "") + "x" * (i % 97 * 20)) for i in range(300)]
    rows += [(500, None, None), (501, "a\nb", ""), (502, "u", "z" * 40000 + inner), (503, "v", "z" * 40000 + inner)]
    path, plain = new_path(spark, "warc"), new_path(spark, "pages")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string")
        df.write.parquet(plain)
        warc.write_warc(df.coalesce(2), path, compression="none")
        got = warc.page_records(warc.read_warc(spark, path, lambda p: F.struct(F.octet_length(p).cast("long").alias("bytes"), F.sha1(p).alias("sha1"))))
        oracle(got, warc.ORACLE_SQL, pages=f"{plain}/*.parquet")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_magic_in_headers(spark, compression):
    rows = [(i, f"https://host/{'specs/WARC/1.1/' * (i % 4)}{i}", "x" * (i % 53) + "WARC/1.0\r\nA: b" * (i % 2)) for i in range(120)]
    rows += [(200, "WARC/1.", "WARC/1."), (201, "WARC/1.0", None), (202, "a WARC/1.0 WARC/1.1\r\nX: WARC/1.", "y" * 3000), (202, "u", "z"), (None, "WARC/1.", "q"), (203, "WARC/1.", "y" * 3000)]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_bytes", F.lit("x"))
        path, plain = new_path(spark, "warc"), new_path(spark, "pages")
        df.write.parquet(plain)
        warc.write_warc(df.coalesce(2), path, compression=compression)
        records = warc.read_warc(spark, path, lambda p: F.struct(F.octet_length(p).cast("long").alias("bytes"), F.sha1(p).alias("sha1")))
        oracle(warc.page_records(records), warc.ORACLE_SQL, pages=f"{plain}/*.parquet")
        urls = Counter(r.u for r in records.select(F.regexp_extract("head", "WARC-Target-URI: ([^\r]*)", 1).alias("u")).collect())
        assert urls == Counter(re.sub("[\r\n]", "%20", u) for _, u, _ in rows)
        warc.write_warc(df.limit(0), empty := new_path(spark, "warc"))
        assert warc.page_records(warc.read_warc(spark, empty, lambda p: F.struct(F.octet_length(p).cast("long").alias("bytes"), F.sha1(p).alias("sha1")))).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_warc_broken_chain_is_an_error(spark):
    good = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    for text in (good + "stray" + good, good + good.replace(": 2", ": 5"), good.replace(": 2", ": x") + good):
        path = new_path(spark, "warc")
        spark.createDataFrame([(text[:-4],)], "value string").coalesce(1).write.option("lineSep", "\r\n\r\n").text(path)
        with pytest.raises(ValueError, match="breaks off"):
            warc.read_warc(spark, path)


def test_top_k_edges(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, []), (7, [1.0]), (8, [-1.0, 0.5]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = [tuple(r) for r in vector_search.top_k(df, df, k=2, shard_rows=2).orderBy("query_id", "rank").collect()]
    assert got == [(1, 1, 2, 4096), (1, 2, 3, 4096), (2, 1, 1, 4096), (2, 2, 3, 4096), (3, 1, 1, 4096), (3, 2, 2, 4096), (8, 1, 1, -4096), (8, 2, 2, -4096)]
    assert vector_search.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_tree(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 3) for _ in range(6)] for _ in range(8)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in centres[i % 8]]) for i in range(600)] + [(1000 + i, centres[0]) for i in range(300)] + [(2000 + i, [1.0, float(i)]) for i in range(5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(64 * c) for c in v] for i, v in rows}
    queries = df.where("vec_id % 20 = 0")
    want = []
    for r in queries.collect():
        scored = sorted((-sum(a * b for a, b in zip(whole[r.vec_id], v)), i) for i, v in whole.items() if i != r.vec_id and len(v) == len(whole[r.vec_id]))
        want += [(r.vec_id, n, i, -s) for n, (s, i) in enumerate(scored[:7], 1)]
    got = vector_search.top_k(queries, df, k=7, shard_rows=64, sample=200)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_chat_edges(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bo b", None), (1, 2, None, "who"), (2, 0, "system", "alone"), (None, 0, "ann", "x")]
    got = chat_format.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    text = "".join(r.segment for r in sorted((r for r in got if r.conv_id == 1 and r.perspective == "ann"), key=lambda r: r.seg_start))
    assert text == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi <\\|im_end|><|im_end|>\n<|im_start|>user name=unknown\nwho<|im_end|>\n<|im_start|>user name=bo_b\n<|im_end|>\n"
    spans = [text[r.train_start : r.train_end] for r in got if r.conv_id == 1 and r.perspective == "ann" and r.train]
    assert spans == ["hi <\\|im_end|><|im_end|>"]
    assert [(r.perspective, r.train) for r in got if r.conv_id == 2] == [(None, False)] and len(got) == 4 * 2 + 1 + 1


def test_chat_repeats_and_names(spark):
    rows = [(1, 0, "ann", "hi"), (1, 0, "ann", "hi"), (1, 1, "bob", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("segment", "perspective", "part", "head", "size")})
    got = chat_format.rotate(df)
    assert got.count() == 6 and {r.perspective for r in got.collect()} == {"ann", "bob"}
    spans = sorted((r.seg_start, r.seg_end) for r in got.where("perspective = 'bob'").collect())
    assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in itertools.pairwise(spans))
    assert chat_format.rotate(df.limit(0)).count() == 0


def test_sentencepiece_edges(spark):
    import public_tokenizers

    model = sentencepiece_lattice.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    by_byte = model[3]
    df = spark.createDataFrame([(1, "\U0001f9ff"), (2, "ab" * 150), (None, "the the")], "doc_id long, text string").withColumns({c: F.lit("x") for c in ("word", "n", "ids")})
    got = {r.doc_id: list(r.ids) for r in sentencepiece_lattice.encode_documents(df, model).collect()}
    assert got[1][-4:] == [by_byte[b] for b in "\U0001f9ff".encode()]
    back = {r.doc_id: r.decoded for r in sentencepiece_lattice.decode(sentencepiece_lattice.encode_documents(df, model), model).collect()}
    assert back == {1: "\U0001f9ff", 2: "ab" * 150, None: "the the"}
    assert sentencepiece_lattice.encode_documents(df.limit(0), model).count() == 0


def test_pipeline_edges(spark):
    import corpus_pipeline

    rows = [(1, None, None), (2, "", "en"), (None, "the one and the other of them", "en"), (4, "the one and the other of them", "en"), (5, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("id", "n", "component_id")})
    for table in (docs, docs.limit(0)):
        kept = table
        for _, stage in corpus_pipeline.STAGES[1:3]:
            kept = stage(spark, kept, None)
            assert kept.columns == docs.columns
        packed = corpus_pipeline.STAGES[3][1](spark, kept, None)
        assert packed.count() == kept.count()
    assert kept.count() == 0 and corpus_pipeline.STAGES[0][1](spark, docs.limit(0), None).count() == 0


def test_packing(spark):
    rows = [(i, (i * 37) % 900) for i in range(400)] + [(1000, 20000), (1001, None), (1001, None), (None, 5)]
    got = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, n_tokens long"), shard_rows=200).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got if r.doc_id is not None and r.doc_id < 1000) == Counter((i, n) for i, n in rows[:400])
    assert sorted(r.n_tokens for r in got if r.doc_id == 1000) == [3616, 8192, 8192]
    bins = {}
    for r in got:
        if r.bin_id:
            bins.setdefault((r.bin_id, r.bin_size), []).append((r.bin_offset, r.n_tokens))
    for (_, size), parts in bins.items():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= size and (size == 512 or at > size / 2)
    assert all((r.bin_id is None) == (r.n_tokens == 0) for r in got)


def test_packing_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    want = {r.doc_id: len(r.text.encode().split()) + 1 for r in docs.collect()}
    rows = packing.op3_best_fit_packing(spark, sf_dir).collect()
    total, ends, sizes = Counter(), {}, {}
    for r in sorted(rows, key=lambda r: (r.bin_id, r.bin_offset)):
        total[r.doc_id] += r.n_tokens
        assert ends.get(r.bin_id, 0) == r.bin_offset
        ends[r.bin_id] = r.bin_offset + r.n_tokens
        sizes[r.bin_id] = r.bin_size
    assert total == want and all(sizes[b] == min(s for s in packing.SIZES if s >= n) for b, n in ends.items())
    # no dearer than all pieces in bins of one size, filled best-fit
    pieces = sorted((r.n_tokens for r in rows), reverse=True)
    spent = sum(map(packing.cost, sizes.values()))
    assert all(spent <= packing.cost(s) * len(packing.best_fit(pieces, [s])[2]) for s in packing.SIZES if s >= pieces[0])
    assert packing.pack_documents(packing.word_tokens(docs.limit(0)).drop("text")).count() == 0


def least_cost(counts, lengths):
    """Least cost of bins for so many pieces of each length, by trying every content of every bin."""

    @functools.cache
    def best(left):
        if not any(left):
            return 0.0
        some = itertools.product(*[range(k + 1) for k in left])
        sums = [(c, sum(k * n for k, n in zip(c, lengths))) for c in some if any(c)]
        lead = next(i for i, k in enumerate(left) if k)
        return min(packing.cost(next(s for s in packing.SIZES if s >= u)) + best(tuple(a - b for a, b in zip(left, c))) for c, u in sums if c[lead] and u <= packing.SIZES[-1])

    return best(counts)


@pytest.mark.parametrize("counts, lengths", [((14,), (520,)), ((8,), (600,)), ((4, 9), (600, 520)), ((5, 5), (600, 520)), ((2, 3, 6), (2100, 600, 520))])
def test_packing_costs_least(counts, lengths):
    pieces = [n for k, n in zip(counts, lengths) for _ in range(k)]
    bins, offsets, final = packing.pack(pieces)
    assert sum(map(packing.cost, final.values())) == least_cost(counts, lengths)
    ends = Counter()
    for n, b, at in sorted(zip(pieces, bins, offsets), key=lambda x: x[2]):
        assert ends[b] == at
        ends[b] += n
    assert all(n <= final[b] for b, n in ends.items())


def test_bands_keep_the_miss_rate():
    for percent in (80, 85, 90):
        bands = minhash.bands_for(percent, 6)
        for u in range(2, 200):
            k = -(-percent * u // 100)
            assert (1 - (k * (k - 1) / (u * (u - 1))) ** 3) ** bands < 1e-6
    assert minhash.bands_for(85, 6) == 32


def test_pipeline_drops_rows_not_ids(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(5, "x"), (5, "a unique text"), (9, "x"), (7, "again"), (7, "again"), (None, "lost"), (None, "lost"), (None, "x")], "doc_id long, text string").repartition(3)
    assert Counter(tuple(r) for r in corpus_pipeline.exact(spark, docs, None).collect()) == Counter([(5, "a unique text"), (9, "x"), (7, "again"), (None, "lost")])
    words = [f"w{i}" for i in range(100)]
    copy, other = " ".join(words), " ".join(f"v{i}" for i in range(100))
    docs = spark.createDataFrame([(5, copy + " end"), (5, other), (3, copy), (None, copy + " last")], "doc_id long, text string")
    assert Counter(tuple(r) for r in corpus_pipeline.near(spark, docs, None).collect()) == Counter([(3, copy), (5, other)])


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, sf_dir)
        assert out.columns == docs.columns
        path = new_path(spark, "stage")
        out.write.parquet(path)
        kept = spark.read.parquet(path)
    texts = [r.text for r in kept.collect()]
    assert len(set(texts)) == len(texts) and 0.8 * docs.count() < len(texts) < docs.count()
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert all(c == i for i, (_, c) in components_by_hand(rows, 80).items())
    packed = corpus_pipeline.run(spark, sf_dir)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {i for i, _ in rows}
