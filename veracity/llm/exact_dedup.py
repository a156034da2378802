"""Exact de-duplication by distributed most-significant-digit radix partitioning.

A text is read as its byte length followed by its bytes.  Each level takes the next run of bytes as
the digit, counts every (group, digit) and lets go of rows that are alone; a group whose bytes are
used up holds equal texts.  Digits are the bytes themselves, so equality rests on no digest.  They
get wider level by level (32, 256, 2048, ... bytes), hence a text of n bytes takes O(log n) levels.

Counting pre-aggregates before the shuffle, so a group with a third of all rows travels as one row
per task; the join that hands each row its group is an ordinary equi-join whose skewed partitions
Spark splits.  Each level is a table in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracity.llm.storage import materialize


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", first: int = 32, growth: int = 8) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    * null text counts as empty; empty texts are equal to each other;
    * the row with the largest id stays; a null id is smaller than every other, and a group with no
      other id has a null ``keep_id``; ``kept`` is null-safe equality of id and ``keep_id``;
    * rows that repeat an id with the same text are all kept: they are the same document;
    * an empty table gives an empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), text.alias("rest"))
    rows = rows.select("id", F.sha2("rest", 256).alias("sha"), F.octet_length("rest").cast("long").alias("left"), "rest")
    done, keys, width = [], ["left"], first
    while True:
        digit = F.substring("rest", 1, width).alias("digit")
        groups = rows.select("id", *keys, digit).groupBy(*keys, "digit").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top")).where("n > 1")
        groups = materialize(groups.withColumn("next", F.monotonically_increasing_id()), "radix-groups")
        # a merge join at every size: a table that is broadcast while small would change the plan as it grows
        met = rows.withColumn("digit", digit).join(groups.hint("merge"), [*keys, "digit"], "left")
        over = F.col("n").isNull() | (F.col("left") <= width)
        met = materialize(
            met.select("id", "sha", "n", "top", over.alias("over"), F.when(~over, F.col("next")).alias("gid"), F.when(~over, F.col("left") - width).alias("left"), F.when(~over, F.substring("rest", width + 1, 2**31 - 1)).alias("rest")),
            "radix-level",
        )
        alone = F.col("n").isNull()
        done.append(met.where("over").select("id", F.when(alone, F.col("id")).otherwise(F.col("top")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), "sha"))
        rows, keys, width = met.where(~F.col("over")).select("id", "sha", "gid", "left", "rest"), ["gid"], width * growth
        if rows.isEmpty():
            break
    found = reduce(DataFrame.unionByName, done)
    return found.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       coalesce(doc_id = max(doc_id) OVER (PARTITION BY t), FALSE) AS kept, sha256(t) AS text_sha256
FROM d
"""


def op4_exact_dedup(spark, sf_dir):
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
