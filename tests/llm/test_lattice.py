"""Piece lattices against a Viterbi pass in plain Python, with words of any length."""

import random
import re

import pytest

from veracity.llm import sentencepiece_lattice as L


@pytest.fixture(scope="module")
def model(spark):
    import public_tokenizers

    return L.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))


def plain(word, pieces, model):
    """Ids of the path of the highest sum, of equal sums the one whose last piece starts first."""
    _, longest, unknown, by_byte = model
    best, back = [0.0], [None]
    for end in range(1, len(word) + 1):
        top = None
        for start in range(max(0, end - longest), end):
            found = pieces.get(word[start:end])
            if found is None and start < end - 1:
                continue
            score = best[start] + (found[1] if found else unknown)
            if top is None or score > top[0]:
                top = score, (start, found)
        best.append(top[0])
        back.append(top[1])
    out, at = [], len(word)
    while at:
        start, found = back[at]
        out[:0] = [found[0]] if found else [by_byte[b] for b in word[start:at].encode()]
        at = start
    return out


def known(model):
    return {r.piece: (r.id, r.score) for r in model[0].where("piece is not null").collect()}


def coded(spark, words, model, **more):
    df = spark.createDataFrame([(w,) for w in words], "word string")
    return {r.word: list(r.ids) for r in L.encode_words(df, model, **more).collect()}


def test_all_words_of_the_documents(spark, sf_dir, model):
    pieces, rows = known(model), L.encode_words(L.distinct_words(spark.read.parquet(f"{sf_dir}/documents.parquet")), model).collect()
    assert len(rows) > 1000 and len({r.word for r in rows}) == len(rows)
    for r in rows:
        assert list(r.ids) == plain(r.word, pieces, model), r.word


def test_blocks_of_any_size(spark, model):
    draw = random.Random(5)
    words = {"▁" + "".join(draw.choice("theraining世é\U0001f600") for _ in range(n)) for n in (1, 2, 7, 8, 9, 15, 16, 17, 40, 63, 64, 65, 200)} | {"▁" + "a" * 129, "世" * 50}
    pieces = known(model)
    want = {w: plain(w, pieces, model) for w in words}
    for block in (1, 8, 64):
        assert coded(spark, words, model, block=block) == want, block


def test_words_of_100_000_characters(spark, model):
    draw = random.Random(6)
    letters = "".join(draw.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000))
    df = spark.createDataFrame([(1, letters), (2, "世界" * 50_000), (3, "an " + letters), (4, "a")], "doc_id long, text string")
    pieces = known(model)
    want = {i: [x for w in re.split(L.WORD, "▁" + t.replace(" ", "▁")) for x in plain(w, pieces, model)] for i, t in df.collect()}
    got = L.decode(L.encode_documents(df, model), model).collect()
    assert {r.doc_id: list(r.ids) for r in got} == want
    assert {r.doc_id: r.decoded for r in got} == dict(df.collect())


def test_slices_leave_no_document_out(spark, model, tmp_path):
    """Repeated and null ids, null and empty texts: a row each in the digests, and only those stay on disk."""
    import hashlib
    import os

    from veracity.llm import storage

    texts = [(1, "the cat"), (1, "the cat sat"), (None, "a  b"), (2, None), (3, ""), (4, "世界 the"), *((i, f"word{i} the") for i in range(5, 40))]
    seen, kept = [], storage.new_path
    try:
        storage.new_path = lambda _, name: seen.append(f"{tmp_path}/{name}-{len(seen)}") or seen[-1]
        got = L.document_digests(spark.createDataFrame(texts, "doc_id long, text string"), model, slices=3).collect()
    finally:
        storage.new_path = kept
    pieces = known(model)
    want = []
    for i, t in texts:
        ids = [x for w in re.split(L.WORD, "▁" + t.replace(" ", "▁")) for x in plain(w, pieces, model)] if t else []
        want.append((str(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), t))
    assert sorted((str(r.doc_id), r.n_pieces, r.ids_sha256) for r in got) == sorted(x[:3] for x in want)
    assert all(r.decoded_equal for r in got if r.doc_id not in (2, 3)) and len(got) == len(texts)
    assert all(("digests" in p) == os.path.exists(p) for p in seen)
