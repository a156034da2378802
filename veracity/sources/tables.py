"""Reading and writing loosely typed tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "_row_id"


def read_csv(spark: SparkSession, path: str, headers: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """All columns as strings under their file headers; doubled quotes are understood.

    ``multi_line`` reads line breaks inside quotes; a file is then one task, whatever its size.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"').option("inferSchema", False)
    if headers:
        reader = reader.schema(T.StructType([T.StructField(h, T.StringType()) for h in headers]))
    return reader.csv(path)


#: files whose names are broadcast; more are joined by a shuffle
MOST_FILES = 100_000
#: rows of a file that are numbered together
AREA = 1 << 20


def _ranked(df: DataFrame, facts: DataFrame) -> DataFrame:
    """``df`` with the columns of ``facts``, one row for each file (``_file``) of its scan."""
    small = facts.count() <= MOST_FILES
    return df.join(F.broadcast(facts) if small else facts.hint("merge"), "_file")


def _places(df: DataFrame) -> DataFrame | None:
    """``df`` with ``_file`` and ``_at``, a row's file and its place there; None where it is no scan of Parquet files."""
    try:
        return df.withColumns({"_file": F.col("_metadata.file_path"), "_at": F.col("_metadata.row_index")})
    except AnalysisException:
        return None


def _before(rows: DataFrame, order: list[str], n: str = "n") -> DataFrame:
    """``rows`` (few: files or areas of files) with ``_base``, the sum of ``n`` over the rows before."""
    return rows.withColumn("_base", F.coalesce(F.sum(n).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def stable_keys(df: DataFrame, out: str) -> DataFrame:
    """``df`` with a long key of each row that is the same in every scan, however files are packed into tasks.

    Rows of Parquet files are known by file (its rank by name) and place in it, and nothing is written.
    Rows of anything else are written once to the checkpoint folder with their key.
    """
    placed = _places(df)
    if placed is None:
        return cut(df.withColumn(out, F.monotonically_increasing_id()))
    files = _before(placed.select("_file").distinct().withColumn("n", F.lit(1)), ["_file"])
    # 2**40 rows a file
    return _ranked(placed, files.drop("n")).withColumn(out, F.shiftleft(F.col("_base").cast("long"), 40) + F.col("_at")).drop("_file", "_at", "_base")


def with_row_ids(df: DataFrame, out: str = ROW) -> DataFrame:
    """Contiguous row numbers from 0, in the order of file names and rows in a file; without sorting the rows.

    A scan of whole Parquet files is numbered by each row's place in its file and the rows of the files
    before: one count a file, nothing is shuffled, and every later scan gives the same numbers at any
    parallelism.  Where rows were left out, they are numbered in areas of ``AREA`` places of a file.
    Rows of anything else have no place of their own: they are written once to the checkpoint folder
    and numbered as they lie there.  An empty table gives none.
    """
    placed = _places(df)
    if placed is None:
        kept = cut(df.withColumn("_at", F.monotonically_increasing_id())).withColumn("_file", F.shiftright("_at", 33))
        sizes = kept.groupBy("_file").agg(F.count(F.lit(1)).alias("n"))
        return _ranked(kept, _before(sizes, ["_file"]).drop("n")).withColumn(out, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_file", "_at", "_base")
    sizes = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("n"), F.max("_at").alias("top"))
    if sizes.where("n <> top + 1").isEmpty():
        return _ranked(placed, _before(sizes, ["_file"]).drop("n", "top")).withColumn(out, F.col("_base") + F.col("_at")).drop("_file", "_at", "_base")
    area = F.floor(F.col("_at") / AREA).alias("_area")
    areas = _before(placed.groupBy("_file", area).agg(F.count(F.lit(1)).alias("n")), ["_file", "_area"]).drop("n")
    place = F.row_number().over(Window.partitionBy("_file", "_area").orderBy("_at")) - 1
    numbered = placed.withColumn("_area", area).withColumn("_place", place).join(areas.hint("merge"), ["_file", "_area"])
    return numbered.withColumn(out, F.col("_base") + F.col("_place")).drop("_file", "_at", "_area", "_place", "_base")


def renumber(df: DataFrame, out: str = ROW) -> DataFrame:
    """``df`` with its row numbers, unique and ascending but with gaps, made contiguous in areas of ``AREA`` numbers."""
    area = F.floor(F.col(out) / AREA).alias("_area")
    areas = _before(df.groupBy(area).agg(F.count(F.lit(1)).alias("n")), ["_area"]).drop("n")
    place = F.row_number().over(Window.partitionBy("_area").orderBy(out)) - 1
    return df.withColumn("_area", area).withColumn("_place", place).join(areas.hint("merge"), "_area").withColumn(out, F.col("_base") + F.col("_place")).drop("_area", "_place", "_base")


def spread(scan: DataFrame) -> DataFrame:
    """A scan that is read in fewer tasks than there are cores (one small file, say), dealt over all of them; any other as it is.

    For scans in front of costly expressions: only inputs too small to keep the cores busy are shuffled.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; only a local session without one gets a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set")
    return folder or f"{tempfile.gettempdir()}/veracity-{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that driver and executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the checkpoint folder, for results that are read several times.

    The folder is ``spark.checkpoint.dir``; only a local session without one gets a temporary folder.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder, for results whose columns are read by themselves and several times."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class TableInfo:
    rows: int
    columns: int
    column_names: list[str]
    preview: DataFrame


def table_info(df: DataFrame, n: int = 10) -> TableInfo:
    return TableInfo(df.count(), len(df.columns), df.columns, df.limit(n))


def file_sizes(spark: SparkSession, path: str, places: int = 1) -> DataFrame:
    """path, size_kb of every file under ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.select("path", F.round(F.col("length") / 1024, places).alias("size_kb"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_csv(df: DataFrame, path: str) -> None:
    """Further rows of the same columns; every part file has its header, so the folder reads as one table."""
    df.write.mode("append").option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_run(result, path: str) -> None:
    """All outputs of a cleaning run: cleaned, errors, warnings, duplicates, removed (CSV), audit_report, stats and removed_columns (JSON)."""
    for name in ("cleaned", "errors", "warnings", "duplicates", "removed"):
        write_csv(getattr(result, name).drop(ROW), f"{path}/{name}")
    write_json(result.audit, f"{path}/audit_report")
    write_json(result.stats, f"{path}/stats")
    gone = result.cleaned.sparkSession.createDataFrame([(list(result.removed_columns),)], "removed_columns array<string>")
    write_json(gone.coalesce(1), f"{path}/removed_columns")


def write_routes(routed: DataFrame, path: str, route: str = "route") -> None:
    """One folder for each route, in a single pass over the classified rows."""
    routed.write.mode("overwrite").partitionBy(route).option("header", True).csv(path)
