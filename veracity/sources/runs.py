"""Outputs of a run: rows routed in one pass, every route one file with one header, and all of it visible at once or not at all.

``RunSource`` is a data source writer.  Each task writes a part of each route it meets into a folder
of the run, under a name of its own, and reports file, rows and bytes in its commit message; so
retried and speculative tasks do no harm.  Once all tasks have reported, the driver writes a manifest
of the reported files and moves it over the one before: readers follow the manifest, and a run that
is killed at any point leaves the outputs before it whole.  Files of replaced runs go afterwards.

A route's header is a part of its own, the first: its parts one behind the other are one file with
one header.  Lines are made by Spark (``to_csv``, ``to_json``); tasks only sort them to their files.
They reach the folder through pyarrow's file systems (local or mounted folders, HDFS, S3, GCS, ABFS).
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from veracity.sources.tables import ROW

MANIFEST = "manifest.json"
_CSV = {"escape": '"', "emptyValue": "", "nullValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def store_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path or URI, and the path inside it."""
    system, inside = pyarrow.fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    return system, inside.rstrip("/")


def csv_line(columns: list[Column]) -> Column:
    """The cells as one line of a CSV file; missing cells are empty."""
    return F.to_csv(F.struct(*columns), _CSV)


def csv_header(names: list[str]) -> str:
    return ",".join('"' + n.replace('"', '""') + '"' if any(x in n for x in ',"\r\n') else n for n in names)


@dataclass
class Parts(WriterCommitMessage):
    """What a task has written: its number, route, file, rows and bytes of each part."""

    parts: list


class RunWriter(DataSourceArrowWriter):
    """Writes (_route, _line); ``heads`` maps each route to its columns and header line (null: none)."""

    def __init__(self, path: str, heads: dict[str, dict], replace: bool):
        self.path, self.heads, self.replace, self.run = path, heads, replace, uuid.uuid4().hex

    def _open(self, store, folder: str, name: str):
        store.create_dir(f"{folder}/{name}".rpartition("/")[0], recursive=True)
        return store.open_output_stream(f"{folder}/{name}")

    def write(self, batches) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, folder = store_of(self.path)
        part = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        out, rows, sizes = {}, {}, {}
        try:
            for batch in batches:
                text = {}
                for route, line in zip(batch.column("_route").to_pylist(), batch.column("_line").to_pylist()):
                    if route is not None:
                        text.setdefault(route, []).append(line)
                for route, found in text.items():
                    if route not in out:
                        out[route] = self._open(store, folder, f"run-{self.run}/{route}/{part}")
                    data = ("\n".join(found) + "\n").encode("utf-8", "surrogatepass")
                    out[route].write(data)
                    rows[route], sizes[route] = rows.get(route, 0) + len(found), sizes.get(route, 0) + len(data)
        finally:
            for stream in out.values():
                stream.close()
        return Parts([(context.partitionId(), route, f"run-{self.run}/{route}/{part}", rows[route], sizes[route]) for route in out])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = store_of(self.path)
        before = read_manifest(self.path)
        if not self.replace and before is not None:
            for route, head in self.heads.items():
                if route in before["routes"] and before["routes"][route]["columns"] != head["columns"]:
                    self.abort(messages)
                    raise ValueError(f"{route} has the columns {before['routes'][route]['columns']}")
        routes = {} if self.replace or before is None else before["routes"]
        for route, head in self.heads.items():
            if route not in routes:
                routes[route] = {"columns": head["columns"], "rows": 0, "bytes": 0, "files": []}
                if head["line"] is not None:
                    data = (head["line"] + "\n").encode()
                    with self._open(store, folder, f"run-{self.run}/{route}/head") as out:
                        out.write(data)
                    routes[route] |= {"bytes": len(data), "files": [f"run-{self.run}/{route}/head"]}
        for _, route, name, rows, size in sorted(p for m in messages if m is not None for p in m.parts):
            r = routes[route]
            r["rows"], r["bytes"] = r["rows"] + rows, r["bytes"] + size
            r["files"].append(name)
        with self._open(store, folder, f"{MANIFEST}.{self.run}") as out:
            out.write(json.dumps({"run": self.run, "routes": routes}, indent=1).encode())
        store.move(f"{folder}/{MANIFEST}.{self.run}", f"{folder}/{MANIFEST}")  # from here on the new outputs hold
        if self.replace and before is not None:
            for run in {f.split("/")[0] for r in before["routes"].values() for f in r["files"]}:
                store.delete_dir(f"{folder}/{run}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, folder = store_of(self.path)
        if store.get_file_info(f"{folder}/run-{self.run}").type != pyarrow.fs.FileType.NotFound:
            store.delete_dir(f"{folder}/run-{self.run}")


class RunSource(DataSource):
    """The format ``routed_run`` behind ``write_lines``."""

    @classmethod
    def name(cls) -> str:
        return "routed_run"

    def writer(self, schema, overwrite: bool) -> RunWriter:
        return RunWriter(self.options["path"], json.loads(self.options["heads"]), overwrite)


def read_manifest(path: str) -> dict | None:
    """The manifest of the last run that ended; None before the first."""
    store, folder = store_of(path)
    if store.get_file_info(f"{folder}/{MANIFEST}").type == pyarrow.fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{folder}/{MANIFEST}") as f:
        return json.loads(f.read())


def write_lines(lines: DataFrame, path: str, heads: dict[str, dict], mode: str = "overwrite") -> dict:
    """Write (_route, _line) in one pass and return the manifest.

    * every route in ``heads`` has its file, without rows too; a row without a route goes nowhere, one
      of another route fails the run;
    * ``overwrite`` replaces what earlier runs wrote as a whole, ``append`` puts the rows behind it, of
      the same columns and under the same header; either holds for all routes at once when this run is
      complete.  Of two runs that overwrite at a time one stays, whole.
    """
    lines.sparkSession.dataSource.register(RunSource)
    known = F.when(F.col("_route").isNull() | F.col("_route").isin(*heads), F.col("_route")).otherwise(F.raise_error(F.concat(F.lit("no such route: "), F.col("_route"))))
    lines.select(known.alias("_route"), "_line").write.format("routed_run").option("heads", json.dumps(heads)).mode(mode).save(path)
    return read_manifest(path)


def csv_head(columns: list[str]) -> dict:
    return {"columns": list(columns), "line": csv_header(columns)}


def write_routed(df: DataFrame, path: str, route: str, columns: list[str], routes: list[str], mode: str = "overwrite") -> dict:
    """Every row to the CSV of its route, in one pass.

    ``columns`` is the fixed list: missing ones are empty, others are left out.
    """
    cells = [F.col(f"`{c}`").cast("string").alias(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns]
    return write_lines(df.select(F.col(f"`{route}`").cast("string").alias("_route"), csv_line(cells).alias("_line")), path, {r: csv_head(columns) for r in routes}, mode)


def append_rows(df: DataFrame, path: str, columns: list[str]) -> dict:
    """Rows behind those that stand there: one header however often this is called, all rows of a call or none.

    The columns stay those of the first call; other ones are left out and missing ones empty.
    """
    before = read_manifest(path)
    columns = columns if before is None else before["routes"]["rows"]["columns"]
    return write_routed(df.withColumn("_to", F.lit("rows")), path, "_to", columns, ["rows"], "append")


def read_routed(spark: SparkSession, path: str, route: str) -> DataFrame:
    """The rows of a route as the last run that ended left it, all columns as strings; empty cells are null."""
    found = read_manifest(path)["routes"][route]
    schema = ", ".join(f"`{c}` string" for c in found["columns"])
    files = [f"{path.rstrip('/')}/{f}" for f in found["files"] if not f.endswith("/head")]
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("escape", '"').option("multiLine", True).csv(files)


def write_clean_run(result, path: str, mode: str = "SMART") -> dict:
    """All outputs of a cleaning run (``operators.clean.clean_table``) in one pass over its rows.

    Routes ``cleaned``, ``errors``, ``warnings``, ``duplicates`` and ``removed`` (CSV; a row goes to each
    that holds it), ``audit_report`` (a JSON object a line), ``stats`` and ``removed_columns``.
    """
    headers = [c for c in result.errors.columns if c != ROW]
    status = ["status"] if "status" in result.cleaned.columns else []
    plain = csv_line([F.col(f"`{c}`").alias(c) for c in headers])
    failed, warned = F.col("row_status") == "ERROR", F.col("has_warning") & (F.col("row_status") == "WARNING")
    to = {
        "cleaned": (F.col("route") == "cleaned", csv_line([F.col(f"`{c}`").alias(c) for c in headers] + ([F.col("row_status").alias("status")] if status else []))),
        "errors": (failed, plain), "warnings": (warned, plain), "duplicates": (F.col("copy") | (F.col("row_status") == "CRITICAL"), plain), "removed": (failed | warned if mode == "STRICT" else failed, plain),
    }
    lines = [F.when(when, F.struct(F.lit(r).alias("_route"), line.alias("_line"))) for r, (when, line) in to.items()]
    names = {"row_no": F.col(ROW) + 1}
    said = F.transform("audit", lambda a: F.struct(F.lit("audit_report").alias("_route"), F.to_json(F.struct(names["row_no"].alias("row"), a["column"].alias("column"), a["original"].alias("original"), a["cleaned"].alias("cleaned"), a["action"].alias("action"), a["severity"].alias("severity"))).alias("_line")))
    rows = result.rows.select(F.inline(F.concat(F.array_compact(F.array(*lines)), said)))
    gone = result.rows.sparkSession.createDataFrame([("removed_columns", json.dumps({"removed_columns": list(result.removed_columns)}))], "_route string, _line string")
    stats = result.stats.select(F.lit("stats").alias("_route"), F.to_json(F.struct("*")).alias("_line"))
    heads = {r: csv_head(headers + status if r == "cleaned" else headers) for r in to} | {r: {"columns": [], "line": None} for r in ("audit_report", "stats", "removed_columns")}
    return write_lines(rows.unionByName(stats).unionByName(gone), path, heads)
