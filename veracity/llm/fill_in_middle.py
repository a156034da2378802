"""Fill-in-middle transformation by DuckDB inside Arrow batches.

A document is cut into units (a word with the white space before it, or white space at the end) and
two cuts among them, drawn from a hash of its id, part it into prefix, middle and suffix, which are
put together again with the middle last.  Every Arrow batch is registered with an in-memory DuckDB
of the task and transformed by SQL; no value passes through Python row by row.

The draw depends on seed and id alone, so a lost task gives the same rows again.  Batches are cut by
bytes before DuckDB sees them: a task holds the units of about ``MOST_BYTES`` of text, or of one
document if that is longer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MOST_BYTES = 4 << 20


@dataclass(frozen=True)
class Plan:
    """How texts are transformed: percent of documents, percent of those in suffix-first form, and the marks."""

    seed: int = 42
    percent: int = 50
    suffix_first: int = 80
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        # no end of a mark may begin a mark: then a mark is found only where it was put
        if "" in marks or len(set(marks)) < 3 or any(a != b and a in b or any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)))) for a in marks for b in marks):
            raise ValueError("marks must differ, not be empty and not overlap each other")


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def transform_sql(p: Plan, source: str) -> str:
    """SQL over ``source`` (id, text): id, n, form, prefix_chars, middle_chars, output."""
    part = lambda i: f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)"
    marks = " OR ".join(f"contains(t, {_text(m)})" for m in (p.prefix, p.suffix, p.middle))
    join = lambda lo, hi: f"array_to_string(list_slice(u, {lo}, {hi}), '')"
    return f"""
WITH d AS (SELECT id, coalesce(text, '') AS t, sha256('{p.seed}:' || coalesce(CAST(id AS VARCHAR), '')) AS h FROM {source}),
u AS (SELECT id, t, h, regexp_extract_all(t, '{UNITS}') AS u FROM d),
c AS (SELECT id, t, u, len(u) AS n, {part(0)} % (len(u) + 1) AS x, {part(1)} % (len(u) + 1) AS y,
        CASE WHEN t = '' OR {marks} OR {part(2)} % 100 >= {p.percent} THEN 'plain' WHEN {part(3)} % 100 < {p.suffix_first} THEN 'spm' ELSE 'psm' END AS form FROM u),
s AS (SELECT id, t, n, form, CASE WHEN form <> 'plain' THEN {join(1, 'least(x, y)')} END AS p, CASE WHEN form <> 'plain' THEN {join('least(x, y) + 1', 'greatest(x, y)')} END AS m,
        CASE WHEN form <> 'plain' THEN {join('greatest(x, y) + 1', 'n')} END AS s FROM c)
SELECT id, CAST(n AS BIGINT) AS n, form, CAST(length(p) AS BIGINT) AS prefix_chars, CAST(length(m) AS BIGINT) AS middle_chars,
  CASE form WHEN 'plain' THEN t WHEN 'psm' THEN {_text(p.prefix)} || p || {_text(p.suffix)} || s || {_text(p.middle)} || m
    ELSE {_text(p.suffix)} || s || {_text(p.prefix)} || p || {_text(p.middle)} || m END AS output FROM s"""


def restore_sql(p: Plan) -> str:
    """SQL expression of the text behind ``output`` in ``form``, from these two alone."""
    first = lambda s, mark: f"string_split({s}, {_text(mark)})[1]"
    last = lambda s, mark: f"string_split({s}, {_text(mark)})[2]"
    body = lambda mark: f"substr(output, {len(mark) + 1})"
    psm = f"{first(body(p.prefix), p.suffix)} || {last('output', p.middle)} || {first(last('output', p.suffix), p.middle)}"
    spm = f"{first(last('output', p.prefix), p.middle)} || {last('output', p.middle)} || {first(body(p.suffix), p.prefix)}"
    return f"CASE form WHEN 'plain' THEN output WHEN 'psm' THEN {psm} ELSE {spm} END"


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.Table]:
    """The rows of a batch in tables of about MOST_BYTES."""
    sizes, at, held = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_pylist() if batch.num_rows else [], 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > MOST_BYTES:
            yield pa.Table.from_batches([batch.slice(at, i - at)])
            at, held = i, 0
        held += n
    if at < len(sizes):
        yield pa.Table.from_batches([batch.slice(at)])


def _through_duckdb(rows: DataFrame, sql: str, schema: str) -> DataFrame:
    """``sql`` over the table ``batch`` for every Arrow batch of ``rows``."""

    def run(batches):
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1}) as con:
            for batch in batches:
                for piece in _pieces(batch):
                    con.register("batch", piece)
                    yield from con.sql(sql).to_arrow_reader(2048)
                    con.unregister("batch")

    return rows.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """One row per input row: id, n (units), form, prefix_chars, middle_chars, output (the transformed text).

    * null text counts as empty; empty texts, texts that hold a mark and those not drawn are ``plain``,
      their output is the text and the lengths are null;
    * an id is read as a decimal long; a null id draws like an empty string; repeated rows give equal rows;
    * cuts may fall together, so any part may be empty; an empty table gives an empty result;
    * lengths count code points; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    out = _through_duckdb(rows, transform_sql(plan, "batch"), "id long, n long, form string, prefix_chars long, middle_chars long, output string")
    return out.withColumnRenamed("id", id_col)


def restore(made: DataFrame, id_col: str = "doc_id", plan: Plan = Plan()) -> DataFrame:
    """id and text of rows made by ``fill_in_middle``, from output and form alone."""
    rows = made.select(F.col(id_col).alias("id"), F.col("output").alias("text"), "form")
    return _through_duckdb(rows, f"SELECT id, {restore_sql(plan)} AS text FROM (SELECT id, form, text AS output FROM batch)", "id long, text string").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plan: Plan = Plan()) -> DataFrame:
    """Like ``fill_in_middle`` with SHA-256 of output and of the text restored from it instead of the texts, all in one pass."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sql = f"SELECT id, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256, sha256({restore_sql(plan)}) AS restored_sha256 FROM ({transform_sql(plan, 'batch')})"
    return _through_duckdb(rows, sql, "id long, n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string").withColumnRenamed("id", id_col)


#: written apart from the operator's SQL: units are numbered rows put together by an ordered aggregate
ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h FROM documents),
k AS (SELECT *, regexp_extract_all(t, '{UNITS}') AS u FROM d),
c AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y, ('0x' || h[17:24])::BIGINT % 100 AS z, ('0x' || h[25:32])::BIGINT % 100 AS w FROM k),
f AS (SELECT *, CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR z >= 50 THEN 'plain' WHEN w < 80 THEN 'spm' ELSE 'psm' END AS form, least(x, y) AS lo, greatest(x, y) AS hi FROM c),
p AS (SELECT doc_id, t, n, form, list_sum(list_transform(u[1:lo], lambda e: length(e))) AS a, list_sum(list_transform(u[1:hi], lambda e: length(e))) AS b FROM f),
q AS (SELECT doc_id, t, n, form, coalesce(a, 0)::BIGINT AS a, coalesce(b, 0)::BIGINT AS b FROM p)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || left(t, a) || '<S>' || substr(t, b + 1) || '<M>' || substr(t, a + 1, b - a)
    ELSE '<S>' || substr(t, b + 1) || '<P>' || left(t, a) || '<M>' || substr(t, a + 1, b - a) END) AS output_sha256, sha256(t) AS restored_sha256
FROM q
"""


def op13_fill_in_middle(spark, sf_dir):
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
