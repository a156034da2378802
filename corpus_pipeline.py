"""A corpus pipeline of four stages; each reads what its predecessor wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from veracity.llm.exact_dedup import exact_groups
from veracity.llm.language_id import fit, identify
from veracity.llm.minhash import near_duplicates
from veracity.llm.packing import pack_documents, word_tokens
from veracity.llm.storage import new_path
from veracity.sources.tables import stable_keys

#: documents whose language score is below this are rejected
LEAST_SCORE = 0.5


def language(spark, docs, sf_dir):
    """Documents whose language is recognised; without any labelled document all stay."""
    models = fit(docs)
    if models is None:
        return docs
    return identify(docs, models).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*docs.columns)


def exact(spark, docs, sf_dir):
    """One document of each group of equal texts; of rows that repeat an id with its text, a null one too, one stays."""
    # a null id is left out of the key, so that it names its row by the text alone
    key = lambda sha: F.concat_ws(" ", F.col("doc_id").cast("string"), sha).alias("_key")
    gone = exact_groups(docs).where("not kept").select(key(F.col("text_sha256"))).distinct()
    rows = docs.select("*", key(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    return rows.join(gone.hint("merge"), "_key", "left_anti").dropDuplicates(["_key"]).select(*docs.columns)


def near(spark, docs, sf_dir):
    """One document of each component of near-duplicates (five words, similarity 0.8 or more), the least id, null last.

    Rows are told apart by file and place in it, as an id may stand at two texts or be null; every scan gives the same.
    """
    rows = stable_keys(docs, "_row")
    found = near_duplicates(rows, "_row", percent=80).select("_row", "component_id")
    many = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("component_id")
    alike = found.join(many.hint("merge"), "component_id").join(rows.select("_row", "doc_id").hint("merge"), "_row")
    first = alike.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("_row"))
    gone = alike.select("_row").join(first.select("_row").hint("merge"), "_row", "left_anti")
    return rows.join(gone.hint("merge"), "_row", "left_anti").select(*docs.columns)


def packing(spark, docs, sf_dir):
    """The remaining documents as pieces placed in training sequences."""
    return pack_documents(word_tokens(docs.select("doc_id", "text")).drop("text"))


STAGES = [("language_id", language), ("exact_dedup", exact), ("near_dedup", near), ("packing", packing)]

#: not expressible: character models, banding and best-fit placement have no SQL form
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
