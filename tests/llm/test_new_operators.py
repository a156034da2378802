"""Operators 11 to 13 against brute force written apart from them, and their edge rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veracity.llm import fill_in_middle, jaccard_join, prefix_trie, sentencepiece_lattice, warc
from veracity.llm.storage import new_path

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
DOCS = "doc_id long, text string"


# --- n-gram join -----------------------------------------------------------------------------------


def joined(rows, width=3, percent=90):
    """id -> (set size, least id reachable), by counting the overlap of every pair."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(LOWER).split()
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}


def run_join(df, **k):
    return {r[0]: (r[1], r[2]) for r in jaccard_join.ngram_join(df, **k).collect()}


def words_of(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def changed(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def test_join_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert run_join(docs) == joined([tuple(r) for r in docs.collect()])


def test_join_chains_and_misses(spark):
    """Groups in which not every two are alike: chains, copies just under the bound, and a passage all share."""
    rng = random.Random(3)
    passage, texts = words_of(rng, 40), []
    for g in range(12):
        text = words_of(rng, rng.choice([20, 60, 150, 400]))
        for step in range(8):
            texts.append(" ".join(text))
            if g % 2:  # a chain: each like the one before
                text = changed(rng, text, max(1, len(text) // 100))
            else:  # all from one, the further the less alike
                texts.append(" ".join(changed(rng, text, 1 + step)))
    texts += [" ".join(passage + words_of(rng, 30)) for _ in range(60)] + [" ".join(passage[:k]) for k in range(30, 41)]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run_join(spark.createDataFrame(rows, DOCS).repartition(7)) == joined(rows)


def test_join_groups_that_only_tiles_can_link(spark, monkeypatch):
    """The least id of a column is like none of the others, which are alike among themselves; tiles hold few rows."""
    monkeypatch.setattr(jaccard_join, "TILE", 4)
    rng = random.Random(5)
    base = words_of(rng, 300)
    first = base[:150] + words_of(rng, 150)  # shares half of all n-grams with each
    rows = [(0, " ".join(first))] + [(i, " ".join(changed(rng, base, 2))) for i in range(1, 40)]
    got = run_join(spark.createDataFrame(rows, DOCS))
    assert got == joined(rows) and got[39][1] == 1


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_join_other_bounds(spark, percent):
    rng = random.Random(percent)
    base = words_of(rng, 50)
    rows = [(i, " ".join(changed(rng, base, i % 9))) for i in range(40)]
    assert run_join(spark.createDataFrame(rows, DOCS), width=2, percent=percent) == joined(rows, 2, percent)


def test_join_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "ONE  Two"), (6, "one"), (7, "É two three"), (8, "é two three"), (9, "x " * 200_000), (10, "x x x"), (11, "x" * 300_000)]
    want = joined(rows)
    df = spark.createDataFrame([(*r, "a", 0) for r in [*rows, (None, "one two"), (4, "one two")]], DOCS + ", prefix string, key int")
    got = jaccard_join.ngram_join(df).collect()
    assert len(got) == len(rows) + 2
    assert {r[0]: (r[1], r[2]) for r in got if r[0] is not None} == want
    assert [tuple(r) for r in got if r[0] is None] == [(None, 1, None)]
    assert jaccard_join.ngram_join(df.where("false")).collect() == []


def test_need_is_the_least_overlap():
    for percent in (50, 85, 90, 100):
        for a in range(1, 60):
            for b in range(1, 60):
                least = next((o for o in range(a + b + 1) if 100 * o >= percent * (a + b - o)))
                assert jaccard_join.need(a, b, percent) == least
            assert jaccard_join.prefix_size(a, percent) == a - -(-percent * a // 100) + 1


def test_overlaps_of_blocks(monkeypatch):
    monkeypatch.setattr(jaccard_join, "COLUMNS", 7)
    rng = np.random.default_rng(1)
    left, right = ([np.unique(rng.integers(0, 90, n)) for n in rng.integers(1, 40, k)] for k in (9, 14))
    assert jaccard_join.overlaps(left, right).tolist() == [[len(set(x) & set(y)) for y in right] for x in left]


# --- prefix trie -----------------------------------------------------------------------------------


def trie(rows):
    """All nodes as tuples, from a dictionary of prefixes."""
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    whole = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    again = {}
    for c, own in whole.items():
        h = zlib.crc32(str(c).encode()) % 9
        again[c] = tuple(whole.get(c - c % 5, [])[:h] + own[h:])
    members = collections.defaultdict(list)
    for c, t in again.items():
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    digest = lambda p, m: hashlib.sha256(",".join(str(c) for c in sorted(m) if again[c] == p).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children[p], leaves[p], saved[p], digest(p, m)) for p, m in members.items())


def run_trie(df):
    out = prefix_trie.prefix_trie(df).collect()
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in out)


CONV = "conv_id long, turn long, role string, text string"


def test_trie_all_conversations(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert run_trie(df) == trie([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_trie_shared_turns(spark, monkeypatch):
    """Few different turns, lengths up to 40, many equal conversations; pieces and runs of a few rows."""
    monkeypatch.setattr(prefix_trie, "PIECE", 3)
    monkeypatch.setattr(prefix_trie, "RUN", 4)
    rng = random.Random(2)
    rows = []
    for c in range(120):
        for t in range(rng.choice([1, 2, 3, 9, 17, 40])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["yes", "no"]) if t % 3 == 0 else "ok é"))
    rng.shuffle(rows)
    assert run_trie(spark.createDataFrame(rows, CONV).repartition(5)) == trie(rows)


def test_trie_edge_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", "x" * 300_000), (1, 2, "a", "b"), (1, 2, "a", "b"), (7, 0, "us", "er"), (7, 1, "u", "ser"), (11, 5, None, ""), (-3, 0, "user", "hi"), (10, 0, "user", "hi"), (10, 1, "", None), (None, 0, "user", "hi")]
    want = trie(rows[:7] + rows[8:])
    df = spark.createDataFrame([(*r, "n", 1) for r in rows[:7] + rows[8:]], CONV + ", name string, node int")
    assert run_trie(df) == want
    assert prefix_trie.prefix_trie(df.where("false")).collect() == []
    assert prefix_trie.prefix_trie(df.where("conv_id is null")).collect() == []


def test_trie_turnless_conversation(spark):
    """A conversation whose own turns are all left out and whose source is absent is a member of the root only."""
    c = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "a"), (c, 1, "assistant", "b")]
    assert run_trie(spark.createDataFrame(rows, CONV)) == trie(rows) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_trie_one_long_conversation(spark):
    rows = [(5, t, "user", f"t{t % 3}") for t in range(700)]
    assert run_trie(spark.createDataFrame(rows, CONV)) == trie(rows)


# --- fill in the middle ------------------------------------------------------------------------------


def moved(doc_id, text, percent=50, suffix_first=80):
    t = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return doc_id, len(units), "plain", None, None, t
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < suffix_first:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[-1]))


def test_fim_all_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = sorted(moved(r.doc_id, r.text) for r in docs.collect())
    assert rows_of(fill_in_middle.fill_in_middle(docs)) == want
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    assert dict(fill_in_middle.restore(fill_in_middle.fill_in_middle(docs)).collect()) == texts
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows_of(fill_in_middle.digests(docs)) == [(*w[:5], sha(w[5]), sha(texts[w[0]])) for w in want]


def test_fim_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(fill_in_middle, "MOST_BYTES", 1000)
    texts = [None, "", " ", "\n\t x", "a", "a<P>b", "<S>", "<M", "P> <", "é 漢字 x y 😀é", "x" * 200_000, "word " * 40_000, "a\x0bb\x0c c\r\n", "nul\x00byte here", "<<S>>", "a < P > b", "'quoted' \"text\" $1 \\1"]
    rows = [(i, t) for i in range(0, 60, 3) for t in texts] + [(None, "no id here at all"), (7, "same same"), (7, "same same"), (-5, "below zero is an id")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], DOCS + ", form string, n int").repartition(3)
    every = fill_in_middle.Plan(percent=100, suffix_first=50)
    want = sorted((moved(i, t, 100, 50) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[-1]))
    made = fill_in_middle.fill_in_middle(df, plan=every)
    assert rows_of(made) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted((tuple(r) for r in fill_in_middle.restore(made, plan=every).collect()), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert fill_in_middle.fill_in_middle(df.where("false")).collect() == []


def test_fim_marks(spark):
    with pytest.raises(ValueError):
        fill_in_middle.Plan(prefix="<A", suffix="A>", middle="<M>")
    own = fill_in_middle.Plan(percent=100, prefix="[[pre]]", suffix="[[suf]]", middle="[[mid]]")
    df = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("<P> is no mark here "), F.col("id").cast("string"), F.lit(" it's")).alias("text"))
    made = fill_in_middle.fill_in_middle(df, plan=own)
    assert made.where("form = 'plain'").count() == 0
    assert sorted(fill_in_middle.restore(made, plan=own).collect()) == sorted(df.collect())


# --- scans planned anew -------------------------------------------------------------------------------


@pytest.fixture
def cores(spark):
    """Sets how many cores files are packed for, as executors come and go between jobs."""
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield lambda n: spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_warc_scan_planned_anew(spark, cores):
    rows = [(i, f"u{i}", f"<p>{i} WARC/1.0\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n</p>" + "y" * i) for i in range(60)]
    path = new_path(spark, "warc")
    warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(12), path, compression="none")
    cores(8)
    records = warc.read_warc(spark, path)
    for n in (8, 1, 50):
        cores(n)
        assert sorted(bytes(r.payload).decode() for r in records.collect()) == sorted(r[2] for r in rows)


def test_near_stage_scan_planned_anew(spark, cores):
    import corpus_pipeline

    rng = random.Random(9)
    texts = [" ".join(words_of(rng, 120)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i] + " end") for i in range(10)]
    path = new_path(spark, "docs")
    spark.createDataFrame(rows, DOCS).repartition(20, "doc_id").write.parquet(path)
    cores(8)
    kept = corpus_pipeline.near(spark, spark.read.parquet(path), None)
    for n in (8, 1, 50):
        cores(n)
        assert sorted(r.doc_id for r in kept.collect()) == list(range(40))


def test_encoded_documents_scan_planned_anew(spark, cores):
    import public_tokenizers

    rows = [(i % 17, f"word number {i} " * (i % 3)) for i in range(60)]
    path = new_path(spark, "docs")
    spark.createDataFrame(rows, DOCS).repartition(20).write.parquet(path)
    model = sentencepiece_lattice.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    cores(8)
    coded = sentencepiece_lattice.decode(sentencepiece_lattice.encode_documents(spark.read.parquet(path), model), model)
    for n in (1, 50):
        cores(n)
        assert sorted((r.doc_id, r.decoded or "") for r in coded.collect()) == sorted(rows)
