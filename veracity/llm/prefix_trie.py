"""The trie of conversation prefixes, named by prefix doubling.

Turns get dense integer names, then blocks of two turns, of four, and so on: a block's name is the
name of the pair of its halves' names, so two blocks have one name exactly if their turns are equal.
Only blocks that begin at a multiple of their length are named, twice as many as there are turns.
A prefix of d turns is the blocks of d's binary digits, the largest first, and its name is that of
the pair (prefix without the last of these blocks, that block).  Both ladders have as many rounds as
the longest conversation's length has binary digits.  Prefixes of one name are one node.

Sums over subtrees need no walk: a node belongs to its least member's path, so the subtree of a node
is made of what its members own below its depth, and that is a suffix sum along each conversation.

Names come back to their rows by equi-joins whose skewed partitions Spark splits, counts are made
before shuffles, and places inside a conversation are two-level prefix sums, so that neither a turn
that begins a third of all conversations nor a conversation with a third of all turns meets in one
task.  Each round is a table in the shared folder.  Only the digest over a node's members is one
fold by nature: its ids pass one task as pieces of ``PIECE`` ids, in order and in bounded memory.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracity.llm.storage import materialize

PIECE = 4096
#: turns whose suffix sums one task adds up
RUN = 4096


def dealt(rows: DataFrame, order: list, name: str) -> DataFrame:
    """``rows`` written in ranges of ``order``, with the number ``part`` of their range; equal rows may lie in several ranges."""
    tagged = rows.withColumn("_seq", F.monotonically_increasing_id()).repartitionByRange(*order, "_seq")
    return materialize(tagged.drop("_seq").withColumn("part", F.spark_partition_id()), name)


def ranked(rows: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """``place`` (from 0) of each row of ``dealt`` rows in its group, and ``size`` of the group, by a two-level sum."""
    sizes = rows.groupBy("part", *group).agg(F.count(F.lit(1)).alias("n"))
    up_to = Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", *group, F.coalesce(F.sum("n").over(up_to), F.lit(0)).alias("base"), F.sum("n").over(Window.partitionBy(*group)).alias("size"))
    here = rows.withColumn("_at", F.row_number().over(Window.partitionBy("part", *group).orderBy(*order)))
    return here.join(base.hint("merge"), ["part", *group]).withColumn("place", (F.col("base") + F.col("_at") - 1).cast("long")).drop("base", "_at", "part")


def dense_names(rows: DataFrame, keys: list[str], start: int, name: str) -> tuple[DataFrame, int]:
    """(keys, name): the distinct keys numbered from ``start`` without gaps, and the next free number.

    Their counts, one number a partition, are added up on the driver.
    """
    found = materialize(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).select(*keys, F.monotonically_increasing_id().alias("_id")), name)
    part = F.shiftrightunsigned("_id", 33)
    sizes = sorted(tuple(r) for r in found.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    base, at = [], start
    for p, n in sizes:
        base.append((p, at))
        at += n
    bases = found.sparkSession.createDataFrame(base or [(0, start)], "_p long, _base long")
    numbered = found.join(F.broadcast(bases), part == F.col("_p"))
    return numbered.select(*keys, (F.col("_base") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).alias("name")), at


def _named(rows: DataFrame, keys: list[str], start: int, name: str) -> tuple[DataFrame, int]:
    """``rows`` (written) with the dense name of their keys in place of these."""
    names, at = dense_names(rows, keys, start, f"{name}-names")
    return materialize(rows.join(names.hint("merge"), keys).drop(*keys), name), at


def rebuilt(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, pos, key, bytes) and lengths (conv, size) of conversations whose first h turns come from conversation ``c - c % every``.

    h is the unsigned crc32 of the decimal id modulo ``heads``; the key is a SHA-256 of role and text.
    """
    one = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = dealt(one, ["conv", "turn", "role", "text"], "trie-turns")
    # the role's length first, so that no two pairs of role and text read alike
    key = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = ranked(ordered, ["conv"], [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")])
    rows = materialize(rows.select("conv", "place", "size", key.alias("key"), F.octet_length("text").cast("long").alias("bytes")), "trie-places")
    sizes = rows.where("place = 0").select("conv", "size", (F.crc32(F.col("conv").cast("string")) % heads).alias("h"), (F.col("conv") - F.col("conv") % every).alias("source"))
    have = rows.where("place = 0").select(F.col("conv").alias("source"), F.col("size").alias("source_size"))
    plan = sizes.join(have.hint("merge"), "source", "left").select("conv", "source", "h", F.least("h", F.coalesce("source_size", F.lit(0))).alias("taken"), "size")
    plan = materialize(plan.withColumn("size", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "trie-plan")
    # a source's first turns meet the few conversations that take them; they are fewer than ``heads`` a source
    first = rows.where(F.col("place") < heads - 1).select(F.col("conv").alias("source"), F.col("place").alias("pos"), "key", "bytes")
    taken = first.join(plan.select("conv", "source", "taken").hint("merge"), "source").where("pos < taken").select("conv", "pos", "key", "bytes")
    kept = rows.drop("size").join(plan.select("conv", "h", "taken").hint("merge"), "conv").where("place >= h").select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("pos"), "key", "bytes")
    return materialize(taken.unionByName(kept), "trie-rebuilt"), plan.select("conv", "size")


def prefix_names(turns: DataFrame, sizes: DataFrame) -> DataFrame:
    """(conv, depth, node) for every prefix of every conversation, the root (depth 0, node 0) too.

    ``turns`` has conv, pos and key, ``sizes`` conv and size of every conversation.
    """
    longest = sizes.agg(F.max("size")).first()[0] or 0
    blocks, _ = _named(turns.select("conv", F.col("pos").alias("block"), "key"), ["key"], 0, "trie-block")
    ladder = [blocks]  # blocks of 2**k turns: conv, block (its number from 0), name
    while 2 << (len(ladder) - 1) <= longest:
        half = ladder[-1].select("conv", F.shiftright("block", 1).alias("block"), F.when(F.col("block") % 2 == 0, F.col("name")).alias("a"), F.when(F.col("block") % 2 == 1, F.col("name")).alias("b"))
        pairs = half.groupBy("conv", "block").agg(F.max("a").alias("left"), F.max("b").alias("right")).where("left is not null and right is not null")
        ladder.append(_named(materialize(pairs, "trie-pairs"), ["left", "right"], 0, "trie-block")[0])
    done = sizes.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("node"))
    free = 1
    for k in range(len(ladder) - 1, -1, -1):
        # prefixes whose last block is one of 2**k turns: the one before is a prefix already named
        last = ladder[k].where("block % 2 = 0").select("conv", (F.col("block") * (1 << k)).alias("depth"), F.col("name").alias("last"))
        pairs = materialize(done.join(last.hint("merge"), ["conv", "depth"]).select("conv", (F.col("depth") + (1 << k)).alias("depth"), F.col("node").alias("before"), "last"), "trie-prefix-pairs")
        more, free = _named(pairs, ["before", "last"], free, "trie-prefix")
        done = done.unionByName(more.withColumnRenamed("name", "node"))
    return done


def _fold(batches):
    """SHA-256 of each node's pieces, joined by commas; pieces come sorted by node and place."""
    out = pa.schema([("node", pa.int64()), ("ends_sha256", pa.string())])
    node, state = None, None
    for batch in batches:
        nodes, hashes = [], []
        for n, piece in zip(batch.column(0).to_pylist(), batch.column(2)):
            if n != node:
                if state is not None:
                    nodes.append(node)
                    hashes.append(state.hexdigest())
                node, state = n, hashlib.sha256()
            else:
                state.update(b",")
            state.update(piece.as_py().encode())
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(hashes)], schema=out)
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([state.hexdigest()])], schema=out)


def ends_digest(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv): SHA-256 of the ascending decimal ids of each node, joined by commas."""
    rows = ranked(dealt(ends, ["node", "conv"], "trie-ends"), ["node"], [F.col("conv")])
    piece = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = rows.groupBy("node", F.floor(F.col("place") / PIECE).alias("piece")).agg(piece.alias("ids"))
    return pieces.repartition("node").sortWithinPartitions("node", "piece").mapInArrow(_fold, "node long, ends_sha256 string")


def prefix_trie(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", every: int = 5, heads: int = 9) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    * null roles and texts are empty; a null turn comes first; turns of equal number are ordered by
      role and text, repeated rows are repeated turns;
    * a row without conv_id belongs to no conversation and is left out;
    * an empty table (or one without any conv_id) has no conversations and so no root: no rows;
    * turns are told apart by SHA-256, whatever their length; other columns are not read.
    """
    rows, sizes = rebuilt(turns, conv_col, turn_col, role_col, text_col, every, heads)
    members = materialize(prefix_names(rows, sizes), "trie-members")
    nodes = materialize(members.groupBy("node").agg(F.min("conv").alias("conv"), F.first("depth").alias("depth"), F.count(F.lit(1)).alias("n_convs")), "trie-nodes")
    up = nodes.where("depth > 0").select("node", "conv", (F.col("depth") - 1).alias("depth"))
    parents = materialize(up.join(members.withColumnRenamed("node", "parent").hint("merge"), ["conv", "depth"]).select("node", "parent"), "trie-parents")
    children = parents.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))

    # what each conversation owns: the nodes whose least member it is, each with its own saving and whether it is a leaf
    last = rows.select("conv", (F.col("pos") + 1).alias("depth"), "bytes")
    owned = nodes.join(children.hint("merge"), "node", "left").join(last.hint("merge"), ["conv", "depth"], "left")
    owned = materialize(owned.select("node", "conv", "depth", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), ((F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))).alias("saved")), "trie-owned")
    down = members.join(owned.select("node", "conv", "saved", F.col("n_children").alias("below")).hint("merge"), ["node", "conv"], "left")
    down = down.select("conv", "depth", "node", F.coalesce("saved", F.lit(0)).alias("saved"), F.coalesce((F.col("below") == 0).cast("long"), F.lit(0)).alias("leaf"), F.floor(F.col("depth") / RUN).alias("run"))
    down = materialize(down, "trie-down")
    totals = down.groupBy("conv", "run").agg(F.sum("saved").alias("s"), F.sum("leaf").alias("l"))
    after = Window.partitionBy("conv").orderBy("run").rowsBetween(1, Window.unboundedFollowing)
    totals = totals.select("conv", "run", F.coalesce(F.sum("s").over(after), F.lit(0)).alias("s_after"), F.coalesce(F.sum("l").over(after), F.lit(0)).alias("l_after"))
    rest = Window.partitionBy("conv", "run").orderBy("depth").rowsBetween(0, Window.unboundedFollowing)
    sums = down.select("conv", "run", "node", F.sum("saved").over(rest).alias("s"), F.sum("leaf").over(rest).alias("l")).join(totals.hint("merge"), ["conv", "run"])
    subtree = sums.groupBy("node").agg(F.sum(F.col("s") + F.col("s_after")).alias("saved_tokens"), F.sum(F.col("l") + F.col("l_after")).alias("n_leaves"))

    ended = members.join(sizes.withColumnRenamed("size", "depth").hint("merge"), ["conv", "depth"]).select("node", "conv")
    by_parent = parents.join(nodes.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv_id")).hint("merge"), "parent").select("node", "parent_conv_id")
    out = owned.join(subtree.hint("merge"), "node").join(ends_digest(ended).hint("merge"), "node", "left").join(by_parent.hint("merge"), "node", "left")
    return out.select(F.col("conv").alias(conv_col), "depth", F.col("parent_conv_id").alias(f"parent_{conv_col}"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))


#: prefixes as lists of turns, subtrees by joining nodes with their prefixes; crc32 bit by bit
ORACLE_SQL = """
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, sha256(octet_length(encode(role)) || ':' || role || text) AS k, octet_length(encode(text)) AS b
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 5 AS src, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(8 * strlen(conv_id::VARCHAR)), lambda i: CASE WHEN i % 8 = 0 THEN ascii((conv_id::VARCHAR)[(i // 8 + 1)::BIGINT])::BIGINT ELSE 0 END)),
    lambda a, x: xor(xor(a, x) >> 1, 3988292384 * (xor(a, x) & 1)))) % 9 AS h FROM t),
r AS (SELECT c.conv_id, t.p, 0 AS own, t.k, t.b FROM c JOIN t ON t.conv_id = c.src AND t.p <= c.h UNION ALL SELECT c.conv_id, t.p, 1, t.k, t.b FROM c JOIN t USING (conv_id) WHERE t.p > c.h),
w AS (SELECT conv_id, list(k ORDER BY own, p) AS ks, list(b ORDER BY own, p) AS bs FROM r GROUP BY conv_id),
a AS (SELECT conv_id, coalesce(ks, []) AS ks, coalesce(bs, []) AS bs FROM c LEFT JOIN w USING (conv_id)),
m AS (SELECT conv_id, d AS depth, ks[1:d] AS pre, CASE WHEN d > 0 THEN bs[d] ELSE 0 END AS b, len(ks) = d AS ends FROM (SELECT *, unnest(range(len(ks) + 1)) AS d FROM a)),
n AS (SELECT depth, pre, min(conv_id) AS conv_id, count(*) AS n_convs, max(b) AS b, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '') AS ends FROM m GROUP BY depth, pre),
k AS (SELECT depth - 1 AS depth, pre[1:depth - 1] AS pre, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k USING (depth, pre)),
s AS (SELECT d AS depth, pre[1:d] AS pre, sum((n_convs - 1) * b) AS saved_tokens, sum((n_children = 0)::INT) AS n_leaves FROM (SELECT *, unnest(range(depth + 1)) AS d FROM x) GROUP BY 1, 2)
SELECT x.conv_id, x.depth, q.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(x.ends) AS ends_sha256
FROM x JOIN s ON s.depth = x.depth AND s.pre = x.pre LEFT JOIN n AS q ON q.depth = x.depth - 1 AND q.pre = x.pre[1:x.depth - 1]
"""


def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
