"""Chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered once with that speaker as the
assistant and all others as named users.  A rendered dialogue is a sequence of segments, one per
turn, so no dialogue is gathered in one place: the result has a row per (dialogue, perspective,
turn) with the segment and its place in the rendered text.

Places are a two-level prefix sum: rows are dealt by range over (dialogue, perspective, turn), so a
dialogue with a third of all rows covers many partitions; sums run inside each partition, and the
totals of the partitions before it (one row per dialogue, perspective and partition) are added.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veracity.llm.storage import materialize

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shared_roles: tuple = ("system",)) -> DataFrame:
    """conv_id, perspective, turn, speaker, segment, seg_start, seg_end, train, train_start, train_end.

    ``seg_start`` and ``seg_end`` are character offsets in the rendered dialogue; ``train`` marks the
    perspective's own turns, and ``train_start``/``train_end`` the part that is learnt: its text and
    the closing token (null elsewhere).

    * roles in ``shared_roles`` are no participants; their turns stand in every rendering as they are;
    * a dialogue without participants is rendered once, with a null perspective and nothing to learn;
    * null text is empty; a null role is the named user ``unknown`` and no participant; a null turn
      comes first; rows with a null conv_id form one dialogue;
    * turns with equal numbers are ordered by role and text, repeated rows are repeated turns;
    * ``<|`` in a text or name is written ``<\\|`` so that no text can end a turn; white space in a
      name becomes ``_``; other columns are not read.
    """
    t = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = F.coalesce(F.col("speaker").isin(*shared_roles), F.lit(False))
    people = t.groupBy("conv_id", F.when(~shared, F.col("speaker")).alias("perspective")).agg(F.lit(1).alias("_"))
    some = people.groupBy(F.col("conv_id").alias("own")).agg(F.count("perspective").alias("n"))
    people = people.join(some, F.col("conv_id").eqNullSafe(F.col("own"))).where("perspective is not null or n = 0").select(F.col("conv_id").alias("c"), "perspective")
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    train = F.coalesce(F.col("speaker") == F.col("perspective"), F.lit(False))
    name = F.regexp_replace(safe(F.coalesce("speaker", F.lit("unknown"))), "[ \\t\\n\\r]", "_")
    head = F.concat(F.lit(OPEN), F.when(train, "assistant").when(shared, name).otherwise(F.concat(F.lit("user name="), name)), F.lit("\n"))
    body = F.concat(safe(F.col("text")), F.lit(CLOSE))
    rows = t.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).select("conv_id", "perspective", "turn", "speaker", train.alias("train"), head.alias("head"), body.alias("body"))
    order = ["conv_id", "perspective", "turn", "speaker", "body"]
    dealt = rows.withColumn("seq", F.monotonically_increasing_id()).repartitionByRange(*order, "seq")
    dealt = materialize(dealt.select("*", F.spark_partition_id().alias("part"), (F.length("head") + F.length("body") + 1).cast("long").alias("size")), "turns")
    here = Window.partitionBy("part", "conv_id", "perspective").orderBy("turn", F.col("speaker").asc_nulls_first(), "body", "seq").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("before", F.coalesce(F.sum("size").over(here), F.lit(0)))
    totals = dealt.groupBy("part", "conv_id", "perspective").agg(F.sum("size").alias("total"))
    parts = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("part").alias("p"), F.col("conv_id").alias("c"), F.col("perspective").alias("v"), F.coalesce(F.sum("total").over(parts), F.lit(0)).alias("base")).where("base > 0")
    placed = local.join(base, (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c")) & F.col("perspective").eqNullSafe(F.col("v")), "left")
    start = F.col("before") + F.coalesce("base", F.lit(0))
    return placed.select(
        "conv_id", "perspective", "turn", "speaker", F.concat("head", "body", F.lit("\n")).alias("segment"), start.alias("seg_start"), (start + F.col("size")).alias("seg_end"), "train",
        F.when(F.col("train"), start + F.length("head")).alias("train_start"), F.when(F.col("train"), start + F.col("size") - 1).alias("train_end"),
    )


ORACLE_SQL = r"""
WITH t AS (SELECT conv_id, turn, role AS speaker, coalesce(text, '') AS text, coalesce(role = 'system', FALSE) AS shared FROM conversations),
p0 AS (SELECT DISTINCT conv_id, CASE WHEN NOT shared THEN speaker END AS perspective FROM t),
p AS (SELECT * FROM (SELECT *, count(perspective) OVER (PARTITION BY conv_id) AS n FROM p0) WHERE perspective IS NOT NULL OR n = 0),
r AS (
  SELECT t.conv_id, p.perspective, t.turn, t.speaker, coalesce(t.speaker = p.perspective, FALSE) AS train, t.shared,
         regexp_replace(replace(coalesce(t.speaker, 'unknown'), '<|', '<\|'), '[ \t\n\r]', '_', 'g') AS name,
         replace(t.text, '<|', '<\|') || '<|im_end|>' AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
h AS (
  SELECT *, '<|im_start|>' || CASE WHEN train THEN 'assistant' WHEN shared THEN name ELSE 'user name=' || name END || chr(10) AS head FROM r),
s AS (
  SELECT *, length(head) + length(body) + 1 AS size,
         coalesce(sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker NULLS FIRST, body
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS seg_start FROM h)
SELECT conv_id, perspective, turn, speaker, head || body || chr(10) AS segment, seg_start, seg_start + size AS seg_end, train,
       CASE WHEN train THEN seg_start + length(head) END AS train_start, CASE WHEN train THEN seg_start + size - 1 END AS train_end
FROM s
"""


def op9_chat_format(spark, sf_dir):
    return rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
