"""SentencePiece encoding and decoding as relational operations.

Texts are cut into words (runs that begin with the word mark), and each distinct word is encoded
once: its substrings up to the longest piece are exploded and equi-joined to the piece table, the
matches are the edges of the word's lattice, edges are grouped by word, and a Viterbi pass over them
runs as Spark's higher-order ``aggregate``.  The piece table is a model's vocabulary, of fixed size.
Distinct words and their pieces are written once; words are dealt by themselves before they are
exploded, so that matching and grouping need no further exchange.

The path is the one with the highest sum of piece scores, SentencePiece's unigram rule; among equal
sums the one whose last piece starts first.  A character that is no piece costs the lowest score
less ten and becomes its bytes.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veracity.llm.storage import discard, materialize
from veracity.sources.tables import stable_keys

MARK = "▁"
WORD = f"(?<=[^{MARK}])(?={MARK})"


def piece_table(spark: SparkSession, model_file: str) -> tuple[DataFrame, int, float, list[int]]:
    """(piece, id, score, bytes) of the model, its longest piece, the cost of an unknown character, the ids of the 256 bytes."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rows, by_byte = [], [0] * 256
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            by_byte[int(p[3:5], 16)] = i
            rows.append((None, i, m.get_score(i), bytearray([int(p[3:5], 16)])))
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            rows.append((p, i, m.get_score(i), bytearray(p.replace(MARK, " ").encode())))
    table = spark.createDataFrame(rows, "piece string, id int, score double, bytes binary")
    return table, max(len(r[0]) for r in rows if r[0]), min(r[2] for r in rows if r[0]) - 10.0, by_byte


def distinct_words(docs: DataFrame, text_col: str = "text", most: int = 1 << 19) -> DataFrame:
    """(word, n): every word with its number of occurrences; null and empty texts have none.

    Words are counted in each task first (in tables of at most ``most`` words), then by Spark.
    """
    import re

    cut = re.compile(WORD)

    def count(batches):
        seen: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                if t:
                    seen.update(cut.split(MARK + t.replace(" ", MARK)))
                if len(seen) > most:
                    yield pd.DataFrame(list(seen.items()), columns=["word", "n"])
                    seen.clear()
        yield pd.DataFrame(list(seen.items()), columns=["word", "n"]).astype({"word": object, "n": "int64"})

    return docs.select(F.col(text_col).alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _edges(cut: DataFrame, model: tuple) -> tuple[DataFrame, Column]:
    """The spans that are pieces, or single characters, and the edge each is; ``c`` is a character that is no piece."""
    table, _, unknown, _ = model
    pieces = F.broadcast(table.where("piece is not null").select("piece", "id", "score"))
    edge = F.struct((F.col("from") + F.col("len")).alias("to"), F.col("from"), F.coalesce("id", F.lit(-1)).alias("id"), F.coalesce("score", F.lit(unknown)).alias("score"), F.when(F.col("id").isNull(), F.col("piece")).alias("c"))
    return cut.join(pieces, "piece", "left").where("id is not null or len = 1"), edge


def _short_paths(words: DataFrame, model: tuple) -> DataFrame:
    """(word, path) of words whose lattice is folded at once."""
    longest, size = model[1], F.length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), size), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), size - i + 1)), lambda k: F.struct(i.alias("from"), k.alias("len")))))
    cut = words.select("word", F.explode(spans).alias("s")).select("word", F.col("s.from").alias("from"), F.col("s.len").alias("len"), F.expr("substring(word, s.from, s.len)").alias("piece"))
    edges, edge = _edges(cut, model)
    lattice = edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    # state: best sum and best edge of every place up to the last, place 1 being the word's start
    zero = "named_struct('sum', array(0D), 'edge', array(cast(null as struct<`from`:int,id:int,c:string>)))"
    step = """
    (st, e) -> if(size(st.sum) = e.to,
        if(element_at(st.sum, e.`from`) + e.score > element_at(st.sum, -1),
           named_struct('sum', concat(slice(st.sum, 1, e.to - 1), array(element_at(st.sum, e.`from`) + e.score)),
                        'edge', concat(slice(st.edge, 1, e.to - 1), array(named_struct('from', e.`from`, 'id', e.id, 'c', e.c)))),
           st),
        named_struct('sum', concat(st.sum, array(element_at(st.sum, e.`from`) + e.score)),
                     'edge', concat(st.edge, array(named_struct('from', e.`from`, 'id', e.id, 'c', e.c)))))
    """
    best = lattice.select("word", F.expr(f"aggregate(edges, {zero}, {step}, st -> st.edge)").alias("best"))
    # the path backwards from the word's end: a place is kept if the path stands on it
    back = """
    aggregate(reverse(sequence(2, size(best))), named_struct('at', size(best), 'path', cast(array() as array<struct<`from`:int,id:int,c:string>>)),
        (st, i) -> if(i = st.at, named_struct('at', element_at(best, i).`from`, 'path', concat(array(element_at(best, i)), st.path)), st),
        st -> st.path)
    """
    return best.select("word", F.expr(back).alias("path"))


def _long_paths(words: DataFrame, model: tuple, block: int) -> DataFrame:
    """(word, path) of long words, in time linear in their length.

    A word's places are cut into blocks, each of which owns the edges that end in it and is matched in
    a row of its own, so a row holds no more spans than a block has.  The fold over the blocks carries
    the sums that a piece can still reach back to, and the best edges as one array a block.
    """
    longest = model[1]
    keyed = words.select(F.sha2("word", 256).alias("key"), "word")
    parts = keyed.select("key", F.length("word").alias("size"), "word", F.explode(F.sequence(F.lit(0), F.floor((F.length("word") - 1) / block).cast("int"))).alias("block"))
    begin = F.greatest(F.col("block") * block - longest + 1, F.lit(0))
    parts = parts.select("key", "block", begin.alias("before"), F.substring(F.col("word"), begin + 1, F.lit(block + longest)).alias("text"), F.least(F.lit(block), F.col("size") - F.col("block") * block).alias("own"))
    # ``end`` counts the characters of the word up to a span's end
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.col("own")), lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("block") * block + i)), lambda k: F.struct((F.col("block") * block + i).alias("end"), k.alias("len")))))
    cut = parts.repartition("key", "block").select("key", "block", "before", "text", F.explode(spans).alias("s"))
    cut = cut.select("key", "block", (F.col("s.end") - F.col("s.len") + 1).alias("from"), F.col("s.len").alias("len"), F.expr("substring(text, s.end - s.len - before + 1, s.len)").alias("piece"))
    edges, edge = _edges(cut, model)
    lattice = edges.groupBy("key", "block").agg(F.array_sort(F.collect_list(edge)).alias("edges")).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("block", "edges"))).alias("blocks"))
    none = "cast(array() as array<struct<`from`:int,id:int,c:string>>)"
    # ``b.block * block + 1`` places are behind when block b begins; the last of them have their sums in ``st.sum``
    value = f"element_at(x.sum, e.`from` - (b.block * {block} + 1 - size(st.sum))) + e.score"
    taken = "array(named_struct('from', e.`from`, 'id', e.id, 'c', e.c))"
    inner = f"""
    aggregate(b.edges, named_struct('sum', st.sum, 'edge', {none}),
        (x, e) -> if(size(x.edge) = e.to - (b.block * {block} + 1),
            if({value} > element_at(x.sum, -1),
               named_struct('sum', concat(slice(x.sum, 1, size(x.sum) - 1), array({value})), 'edge', concat(slice(x.edge, 1, size(x.edge) - 1), {taken})), x),
            named_struct('sum', concat(x.sum, array({value})), 'edge', concat(x.edge, {taken}))),
        x -> named_struct('sum', slice(x.sum, -least({longest}, size(x.sum)), {longest}), 'out', concat(st.out, array(x.edge))))
    """
    best = lattice.select("key", F.expr(f"aggregate(blocks, named_struct('sum', array(0D), 'out', cast(array() as array<array<struct<`from`:int,id:int,c:string>>>)), (st, b) -> {inner}, st -> st.out)").alias("best"))
    back = f"""
    aggregate(reverse(sequence(1, size(best))), named_struct('at', (size(best) - 1) * {block} + 1 + size(element_at(best, -1)), 'paths', cast(array() as array<array<struct<`from`:int,id:int,c:string>>>)),
        (st, k) -> aggregate(reverse(sequence(1, size(element_at(best, k)))), named_struct('at', st.at, 'path', {none}),
            (x, i) -> if((k - 1) * {block} + 1 + i = x.at, named_struct('at', element_at(element_at(best, k), i).`from`, 'path', concat(array(element_at(element_at(best, k), i)), x.path)), x),
            x -> named_struct('at', x.at, 'paths', concat(array(x.path), st.paths))),
        st -> flatten(st.paths))
    """
    return keyed.join(best.select("key", F.expr(back).alias("path")), "key").select("word", "path")


def encode_words(words: DataFrame, model: tuple, block: int = 128, per_task: int = 1 << 15) -> DataFrame:
    """(word, ids) of ``words`` (distinct in ``word``): the best path's piece ids.

    Words of more than ``block`` characters are folded in blocks of that many; a word's lattice is one
    row in either case, so memory grows with the longest word, linearly.  Words are dealt to tasks of
    about ``per_task`` (more where that made over 20,000 tasks): their edges take many times their own
    room, by which Spark would size the tasks, and are sorted in memory if there are few.
    """
    words = words.select("word")
    tasks = min(max(words.count() // per_task, 1), 20_000)
    path = _short_paths(words.where(F.length("word") <= block).repartition(tasks, "word"), model).unionByName(_long_paths(words.where(F.length("word") > block), model, block))
    ids = F.array(*[F.lit(i) for i in model[3]])
    as_bytes = lambda c: F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.encode(c, "utf-8")), "(..)", "$1 "), " "), lambda h: h != ""), lambda h: F.element_at(ids, F.conv(h, 16, 10).cast("int") + 1))
    whole = F.flatten(F.transform("path", lambda x: F.when(x["id"] >= 0, F.array(x["id"])).otherwise(as_bytes(x["c"]))))
    plain = F.transform("path", lambda x: x["id"])
    return path.select("word", F.when(F.exists("path", lambda x: x["id"] < 0), whole).otherwise(plain).alias("ids"))


def word_table(docs: DataFrame, model: tuple, text_col: str = "text", hot_words: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(word, ids) of every distinct word of ``docs``, and of its ``hot_words`` most frequent ones, both written once."""
    words = materialize(distinct_words(docs, text_col), "words", free=True)
    coded = materialize(encode_words(words, model), "coded-words", free=True)
    hot = materialize(words.orderBy(F.desc("n"), "word").limit(hot_words).select("word").join(coded, "word"), "hot-words", free=True)
    discard(words)
    return coded, hot


def encode(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", hot_words: int = 4096, table: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, word_no, ids): the piece ids of every word of every text, in order of word_no.

    A text's encoding is its words' ids one after the other.  Null and empty texts have no rows;
    texts that repeat an id have rows each; other columns are not read.  The ``hot_words`` most
    frequent words are joined by broadcast, so that none of them gathers its occurrences in a task.
    ``table``: the ``word_table`` of these texts, or of more, where it is already there.
    """
    marked = F.concat(F.lit(MARK), F.replace(F.col(text_col), F.lit(" "), F.lit(MARK)))
    rows = docs.where(F.length(text_col) > 0).select(F.col(id_col), F.posexplode(F.split(marked, WORD)).alias("word_no", "word"))
    coded, hot = table or word_table(docs, model, text_col, hot_words)
    tried = rows.join(F.broadcast(hot.select("word", F.col("ids").alias("_hot"))), "word", "left")
    found = tried.where("_hot is not null").select(id_col, "word_no", F.col("_hot").alias("ids"))
    return found.unionByName(tried.where("_hot is null").join(coded.hint("merge"), "word").select(id_col, "word_no", "ids"))


def encode_documents(docs: DataFrame, model: tuple, id_col: str = "doc_id", text_col: str = "text", table: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(id, text_sha256, ids): one row per row of ``docs``, with the piece ids of its text in order.

    A null or empty text has no ids; texts that repeat an id stay apart.
    """
    rows = stable_keys(docs, "_text").select("_text", F.col(id_col), F.col(text_col))
    coded = encode(rows, model, "_text", text_col, table=table).groupBy("_text").agg(F.array_sort(F.collect_list(F.struct("word_no", "ids"))).alias("_words"))
    coded = coded.select("_text", F.flatten(F.transform("_words", lambda w: w["ids"])).alias("ids"))
    texts = rows.select("_text", id_col, F.sha2(F.col(text_col).cast("binary"), 256).alias("text_sha256"))
    none = F.array().cast("array<int>")
    return texts.join(coded.hint("merge"), "_text", "left").select(id_col, "text_sha256", F.coalesce("ids", none).alias("ids"))


def decode(coded: DataFrame, model: tuple) -> DataFrame:
    """``coded`` with decoded: the bytes of each row's ids put together, without the mark before the first word."""
    by_id = {r["id"]: bytes(r["bytes"]).hex() for r in model[0].select("id", "bytes").collect()}
    table = F.split(F.lit(",".join(by_id.get(i, "") for i in range(max(by_id) + 1))), ",")
    whole = F.unhex(F.array_join(F.transform("ids", lambda i: F.element_at(table, i + 1)), "")).cast("string")
    return coded.withColumn("decoded", F.substr(whole, F.lit(2)))


def decode_words(coded: DataFrame, model: tuple) -> DataFrame:
    """``coded`` (distinct in ``word``) with decoded: its ids' bytes put together, the word mark as a space."""
    table = F.broadcast(model[0].select("id", "bytes"))
    parts = coded.select("word", F.posexplode("ids").alias("at", "id")).join(table, "id").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "bytes"))).alias("parts"))
    text = F.aggregate("parts", F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["bytes"])).cast("string")
    return coded.join(parts.select("word", text.alias("decoded")), "word")


def document_digests(docs: DataFrame, model: tuple, slices: int = 8) -> DataFrame:
    """docs: (doc_id, text) -> (doc_id, n_pieces, ids_sha256, decoded_equal), through ``encode_documents`` and ``decode``.

    The words of all texts are encoded once; texts meet their words in ``slices`` by their id, and only
    the digests of a slice are kept, so the shuffle files of one slice lie on disk at a time.
    """
    table = word_table(docs, model)
    digest = F.sha2(F.array_join(F.transform("ids", lambda i: i.cast("string")), " "), 256)
    same = F.sha2(F.col("decoded").cast("binary"), 256) == F.col("text_sha256")

    def part(i: int) -> DataFrame:
        coded = decode(encode_documents(docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(slices)) == i), model, table=table), model)
        return coded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), digest.alias("ids_sha256"), same.alias("decoded_equal"))

    done = [materialize(part(i), "digests", free=True) for i in range(slices)]
    discard(*table)
    return reduce(DataFrame.unionByName, done)


def op8_sentencepiece(spark, sf_dir):
    """Every document: the number of its pieces, a digest of their ids in order, and whether they decode to its text (null for a null text)."""
    import public_tokenizers

    return document_digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), piece_table(spark, public_tokenizers.path("piece_bpe_32k.model")))
