"""Token counts from a byte-pair tokenizer compiled to a deterministic transducer.

The greedy merges of byte-pair encoding have a finite-state form: two tokens stand beside each other
in an encoding just if no merge across their border would come before the merges that build them, and
every prefix of a text has exactly one encoding whose neighbours all fit.  So the encoding of a prefix
is its last token behind the encoding of what precedes that token, and only so much of the past counts
as a token can still reach back over.

A state is the longest end of the text read that a token may still grow from, and for it and each
shorter such end the last token of the encoding before it and its number of tokens relative to the
end.  A character leads to the next state and emits tokens (less than none where it lets tokens merge).
States and transitions are made when first met and kept, each transition with its emitted tokens.  A character that no token holds becomes its UTF-8 bytes, and nothing merges across it.

Texts are cut into chunks, and a chunk's map takes the state at its start to the state at its end and
the tokens emitted.  A chunk that begins where a run of word marks begins starts in the start state if
no token holds a mark behind other characters.  Any other chunk is first mapped from the state that the
``AHEAD`` characters before it lead to; each chunk's first state is then compared with the last state of
the chunk before, chunks where they differ are mapped again from the right one, and so on until all
agree.  This is speculation with repair and no prefix scan of whole maps: a map is known for the states
that were tried, and a text on which every guess fails takes a round for each chunk.  The counts are
those of one pass over the text in any case.
"""

from __future__ import annotations

import re
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.llm.storage import materialize

CHUNK, AHEAD = 1 << 16, 64
MARK = "▁"


class Transducer:
    """Deterministic transducer of one byte-pair model: ranks are the model's merge order, the best first."""

    #: a word begins at a mark behind another character
    WORD = re.compile(f"(?<=[^{MARK}])(?={MARK})")

    def __init__(self, ranks: dict[str, int], most: int = 1 << 18):
        self.rank, self.most = ranks, most
        self.resets = not any(MARK in p.lstrip(MARK) for p in ranks)
        #: begins of tokens, each with the longest shorter end of it that is one too, and the tokens that end it
        begins = {p[:i] for p in ranks for i in range(1, len(p) + 1)}
        grows = {x[:-1] for x in begins}
        self.fail, self.ends = {"": ""}, {"": ()}
        #: the longest end of each that grows on, and the lengths of all its ends that do
        self.live, self.places = {"": ""}, {"": (0,)}
        for node in sorted(begins, key=len):
            fail = next(node[i:] for i in range(1, len(node) + 1) if i == len(node) or node[i:] in begins)
            self.fail[node] = fail
            self.ends[node] = ((node,) if node in ranks else ()) + self.ends[fail]
            self.live[node] = node if node in grows else self.live[fail]
            self.places[node] = (len(node), *self.places[fail]) if node in grows else self.places[fail]
        self.letters = {c for p in ranks for c in p}
        self.edges: dict[str, tuple] = {}
        self.fits: dict[tuple[str, str], bool] = {}
        self.arcs: dict[str, tuple] = {}
        self.paths: dict[str, int] = {}
        self.clear()

    @classmethod
    def from_sentencepiece(cls, model_file: str, most: int = 1 << 18) -> "Transducer":
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=model_file)
        plain = [i for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        best = sorted(plain, key=lambda i: -m.get_score(i))
        return cls({m.id_to_piece(i): r for r, i in enumerate(best)}, most)

    def clear(self) -> None:
        """Forget states and transitions; word counts stay."""
        self.states: dict[tuple, dict] = {}
        self.start = self._state("", {0: (None, 0)})

    def _state(self, node: str, at: dict) -> dict:
        """The transitions known from a state, by character, and under None the state itself."""
        key = (node, *at.values())
        s = self.states.get(key)
        if s is None:
            s = self.states[key] = {None: (node, at)}
        return s

    def _edge(self, token: str) -> tuple:
        """(left, right): the tokens at either edge of ``token`` as it is built, with the rank of each but the first."""
        found = self.edges.get(token)
        if found is None:
            parts, left, right = list(token), [(token[0], -1)], [(token[-1], -1)]
            while len(parts) > 1:
                r, i = min((self.rank.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                if r == 1 << 60:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                if i == 0:
                    left.append((parts[0], r))
                if i == len(parts) - 1:
                    right.append((parts[-1], r))
            found = self.edges[token] = (left, right) if len(parts) == 1 else ()
        return found

    def _fit(self, first: str, second: str) -> bool:
        """Whether both tokens stay as they are beside each other."""
        key = (first, second)
        ok = self.fits.get(key)
        if ok is None:
            if len(self.fits) > 2 * self.most:
                self.fits.clear()
            ok = self.fits[key] = self._grow(self._edge(first)[1], self._edge(second)[0])
        return ok

    def _grow(self, a: list, b: list) -> bool:
        """Whether the right edge ``a`` and the left edge ``b`` grow to their ends before a merge joins them.

        The best merge comes first, of equal ones the leftmost; a token's parts come before it.
        """
        i = j = 0
        while True:
            cross = self.rank.get(a[i][0] + b[j][0], 1 << 60)
            left = a[i + 1][1] if i + 1 < len(a) else 1 << 61
            right = b[j + 1][1] if j + 1 < len(b) else 1 << 61
            if cross < left and cross <= right and cross < 1 << 60:
                return False
            if left == right == 1 << 61:
                return True
            if left <= right:
                i += 1
            else:
                j += 1

    def _arc(self, node: str, c: str) -> tuple:
        """(tokens that may end at c, each with its length less one; places behind c; the end that grows on)."""
        key = node + c
        while node + c not in self.fail:
            node = self.fail[node]
        longer = node + c
        found = self.arcs[key] = [(t, len(t) - 1) for t in self.ends[longer] if self._edge(t)], self.places[longer], self.live[longer]
        return found

    def step(self, state: dict, c: str) -> tuple[dict, int]:
        """(next state, tokens emitted) on the character ``c``."""
        node, at = state[None]
        if c not in self.letters:
            found = state[c] = self.start, len(c.encode("utf-8", "surrogatepass"))
            return found
        tokens, places, live = self.arcs.get(node + c) or self._arc(node, c)
        for token, back in tokens:
            last, n = at[back]
            if last is None or self._fit(last, token):
                break
        else:
            raise AssertionError(f"no token ends {node + c!r}")
        emitted = n + 1
        kept = {k: (at[k - 1][0], at[k - 1][1] - emitted) if k else (token, 0) for k in places}
        found = state[c] = self._state(live, kept), emitted
        return found

    def run(self, state: dict, text: str) -> tuple[dict, int]:
        """(state, tokens) behind ``text`` entered in ``state``."""
        total = 0
        for c in text:
            found = state.get(c) or self.step(state, c)
            state = found[0]
            total += found[1]
        return state, total

    def portable(self, state: dict) -> tuple[str, list, list]:
        """The state as its end of text, and the last token and relative number of each place."""
        node, at = state[None]
        return node, [t for t, _ in at.values()], [n for _, n in at.values()]

    def entered(self, node: str, tokens: list, numbers: list) -> dict:
        return self._state(node, dict(zip(self.places[node], zip(tokens, map(int, numbers)))))

    def _tidy(self) -> None:
        if len(self.states) > self.most:
            self.clear()
        if len(self.paths) > 4 * self.most:
            self.paths.clear()

    def words(self, text: str) -> int:
        """Tokens of a text that begins and ends with a word's border, each word from the start state."""
        paths, total = self.paths, 0
        for word in self.WORD.split(text):
            n = paths.get(word)
            if n is None:
                n = paths[word] = self.run(self.start, word)[1]
            total += n
        return total

    def count(self, text: str | None) -> int:
        """Tokens of a whole text; null and empty texts have none."""
        self._tidy()
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        return self.words(marked) if self.resets else self.run(self.start, marked)[1]

    def chunk(self, before: str, text: str, entry: tuple | None) -> dict:
        """Map of one chunk of marked text: its first state (``entry``, or what ``before`` leads to), its last, its tokens."""
        self._tidy()
        sure = entry is not None or not before or (self.resets and text.startswith(MARK) and not before.endswith(MARK))
        state = self.entered(*entry) if entry is not None else self.start if sure else self.run(self.start, before)[0]
        first = self.portable(state)
        total, rest = 0, text
        # whole words from the first border on are known paths; the last one is left open
        if self.resets and len(borders := self.WORD.split(text)) > 1:
            total = self.run(state, borders[0])[1] + self.words("".join(borders[1:-1])) if len(borders) > 2 else self.run(state, borders[0])[1]
            state, rest = self.start, borders[-1]
        last, n = self.run(state, rest)
        return {"first": first, "last": self.portable(last), "n": total + n}


@cache
def transducer(model_file: str) -> Transducer:
    return Transducer.from_sentencepiece(model_file)


STATE = "struct<node:string,tokens:array<string>,numbers:array<int>>"


def count_tokens(docs: DataFrame, model_file: str, text_col: str = "text", out_col: str = "n_tokens", chunk: int = CHUNK) -> DataFrame:
    """``docs`` without its text, with ``out_col`` (long): tokens as the model's library gives them.

    No begin, end or added special tokens; null and empty texts have 0.  Repeated rows and ids are
    counted each for itself; an empty table gives no rows.  Texts longer than ``chunk`` characters are
    cut, and chunks whose guessed first state was wrong are mapped again (see above).
    A column that is already named ``out_col`` is replaced, other columns are kept whatever their
    names.  ``model_file`` must be readable on executors.
    """

    @F.pandas_udf("long")
    def whole(texts: pd.Series) -> pd.Series:
        return pd.Series(map(transducer(model_file).count, texts), dtype="int64")

    @F.pandas_udf(f"first {STATE}, last {STATE}, n long")
    def mapped(before: pd.Series, texts: pd.Series, entry: pd.DataFrame) -> pd.DataFrame:
        t = transducer(model_file)
        entries = ((e.node, e.tokens, e.numbers) if e.node is not None else None for e in entry.itertuples())
        maps = [t.chunk(b, x, e) for b, x, e in zip(before, texts, entries)]
        as_row = lambda s: dict(zip(("node", "tokens", "numbers"), s))
        return pd.DataFrame({"first": [as_row(m["first"]) for m in maps], "last": [as_row(m["last"]) for m in maps], "n": [m["n"] for m in maps]})

    rest = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, out_col)]
    text = F.col(f"`{text_col}`")
    is_long = F.coalesce(F.length(text) > chunk, F.lit(False))
    short = docs.where(~is_long).select(*rest, whole(text).alias(out_col))
    # marked texts of more than a chunk, and their chunks with what stands before each
    rows = materialize(docs.where(is_long).select(F.monotonically_increasing_id().alias("row"), F.struct(*(rest or [F.lit(0)])).alias("rest"), F.concat(F.lit(MARK), F.replace(text, F.lit(" "), F.lit(MARK))).alias("text")), "long-texts")
    at = F.col("at") * chunk
    cut = rows.select("row", "text", F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / chunk).cast("int"))).alias("at"))
    ahead = F.least(at, F.lit(AHEAD))
    cut = cut.select("row", "at", F.substring("text", at - ahead + 1, ahead).alias("before"), F.substring(F.col("text"), at + 1, F.lit(chunk)).alias("chunk"))
    maps = materialize(cut.withColumn("m", mapped("before", "chunk", F.struct(F.lit(None).cast("string").alias("node"), F.lit(None).cast("array<string>").alias("tokens"), F.lit(None).cast("array<int>").alias("numbers")))).select("row", "at", "m.*"), "chunk-maps")
    scan = Window.partitionBy("row").orderBy("at")
    while True:
        scanned = maps.withColumn("entry", F.lag("last").over(scan))
        wrong = scanned.where(F.col("entry").isNotNull() & (F.col("entry") != F.col("first"))).select("row", "at", "entry")
        if wrong.isEmpty():
            break
        again = cut.join(wrong, ["row", "at"]).withColumn("m", mapped("before", "chunk", "entry")).select("row", "at", "m.*")
        maps = materialize(maps.join(wrong, ["row", "at"], "left_anti").unionByName(again), "chunk-maps")
    long = rows.select("row", "rest").join(maps.groupBy("row").agg(F.sum("n").alias("n")), "row")
    return short.unionByName(long.select(*[F.col("rest")[c].alias(c) for c in docs.columns if c not in (text_col, out_col)], F.col("n").alias(out_col)))


def op7_token_counts(spark, sf_dir, limit: int = 4096):
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"))
    counted = count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
