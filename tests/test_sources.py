"""Row numbers, files and run outputs."""

import csv
import io
import json
import os
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from veracity.operators import chunk, clean
from veracity.sources import delimited, runs
from veracity.sources.tables import ROW, file_sizes, stable_keys, with_row_ids


def packed(spark, cores, f):
    """``f()`` with files packed as a cluster of so many cores would pack them."""
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        return f()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def files(spark, path, rows=1000, parts=12):
    spark.range(0, rows, 1, parts).select("id", F.concat(F.lit("v"), "id").alias("v")).write.parquet(path)
    return spark.read.parquet(path)


def test_row_ids_do_not_depend_on_packing(spark, tmp_path):
    df = files(spark, str(tmp_path / "t"))
    for change in (lambda d: d, lambda d: d.where("id % 7 <> 3"), lambda d: d.select("v", (F.col("id") * 2).alias("id"))):
        made = packed(spark, 1, lambda: with_row_ids(change(df)))
        seen = [packed(spark, cores, lambda: sorted((r[ROW], r["v"]) for r in made.collect())) for cores in (1, 6, 50)]
        assert seen[0] == seen[1] == seen[2]
        assert [r[0] for r in seen[0]] == list(range(change(df).count()))
        again = packed(spark, 50, lambda: sorted((r[ROW], r["v"]) for r in with_row_ids(change(df)).collect()))
        assert again == seen[0]


def test_row_ids_follow_files(spark, tmp_path):
    df = files(spark, str(tmp_path / "t"), 600, 5)
    got = [r.id for r in with_row_ids(df).orderBy(ROW).collect()]
    assert got == [r.id for r in df.select("id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i")).orderBy("f", "i").collect()]


def test_row_ids_of_other_sources(spark, tmp_path):
    files(spark, str(tmp_path / "t")).write.csv(str(tmp_path / "csv"))
    csv = spark.read.schema("id long, v string").csv(str(tmp_path / "csv"))
    for df in (csv, spark.range(0, 1000, 1, 7).withColumn("v", F.col("id").cast("string")), csv.groupBy("v").agg(F.max("id").alias("id"))):
        made = packed(spark, 1, lambda: with_row_ids(df))
        seen = [packed(spark, cores, lambda: sorted((r[ROW], r["id"]) for r in made.collect())) for cores in (1, 50)]
        assert seen[0] == seen[1] and [r[0] for r in seen[0]] == list(range(1000)) and sorted(r[1] for r in seen[0]) == list(range(1000))
    assert with_row_ids(csv.where("false")).count() == 0


def test_stable_keys(spark, tmp_path):
    df = files(spark, str(tmp_path / "t")).where("id <> 5")
    for source in (df, df.repartition(3)):
        made = packed(spark, 1, lambda: stable_keys(source, "key"))
        seen = [packed(spark, cores, lambda: sorted((r["key"], r["id"]) for r in made.collect())) for cores in (1, 50)]
        assert seen[0] == seen[1] and len({k for k, _ in seen[0]}) == 999


# --- CSV in parallel -----------------------------------------------------------------------------------


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def wild_csv(rng, rows, newline="\n"):
    """A CSV text with line breaks, quotes and commas in its fields; some fields are long."""
    pieces = ["a", "b ", ",", '"', "\n", "\n\n", "é漢", " ", "1,2", '""', 'x"y', "\n,\n"]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator=newline)
    writer.writerow(["id", "name", "note"])
    for i in range(rows):
        note = "".join(rng.choice(pieces) for _ in range(rng.choice([0, 1, 3, 8, 40]))) * (30 if rng.random() < 0.02 else 1)
        writer.writerow([i, rng.choice(["plain", 'quo"ted', "com,ma", ""]), note])
        if rng.random() < 0.1:
            out.write(newline)
    return out.getvalue()


@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_quoted_lines_in_small_splits(spark, tmp_path, small_splits, newline):
    text = wild_csv(random.Random(4), 900, newline)
    (tmp_path / "t.csv").write_bytes(text.encode())
    want = list(csv.reader(io.StringIO(text, newline="")))
    want = [tuple(f or None for f in r) for r in want if r]
    table = delimited.read_table(spark, str(tmp_path / "t.csv"))
    assert spark.read.option("lineSep", "\n").text(str(tmp_path / "t.csv")).rdd.getNumPartitions() > 20
    got = sorted(tuple(r) for r in table.rows.collect())
    assert [r[1:] for r in got] == want[1:] and [r[0] for r in got] == list(range(len(want) - 1))
    assert table.faults.count() == 0
    # the same as the reader that takes a file as one task
    one_task = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "t.csv"))
    plain = lambda rows: sorted(tuple((f or "").replace("\r\n", "\n") for f in r) for r in rows)
    assert plain(r[1:] for r in got) == plain(one_task.collect())


def test_records_have_byte_offsets(spark, tmp_path, small_splits):
    text = wild_csv(random.Random(8), 200).encode()
    (tmp_path / "t.csv").write_bytes(text)
    got = delimited.records(spark, str(tmp_path / "t.csv")).orderBy("record").collect()
    for r in got:
        assert text[r.offset : r.offset + len(r.text.encode())] == r.text.encode()
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    assert got == delimited.records(spark, str(tmp_path / "t.csv")).orderBy("record").collect()


def test_faulty_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufeffa,b,a,\n1,2,3,4\n5,6\n7,8,9,10,11\n\n"x\ny",,"q ""r""",z\n')
    (tmp_path / "b.csv").write_text('a,b\n1,"never closed\nand on\n')
    table = delimited.read_table(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert table.headers == ["a", "b", "a.1", "Unnamed: 3"]
    assert sorted(tuple(r) for r in table.rows.collect()) == [(0, "1", "2", "3", "4"), (1, "5", "6", None, None), (2, "x\ny", None, 'q "r"', "z")]
    by_kind = {r.kind: (r.file.rsplit("/", 1)[1], r.record, r.fields, r.text) for r in table.faults.collect()}
    assert by_kind == {
        "short": ("a.csv", 2, 2, "5,6"), "long": ("a.csv", 3, 5, "7,8,9,10,11"), "unclosed": ("b.csv", 1, 2, '1,"never closed'),
        "duplicate header": ("a.csv", 0, 4, "a,b,a,"), "other header": ("b.csv", 0, 2, "a,b"),
    }


def test_unique_headers():
    assert delimited.unique_headers(["a", "a", "a.1", "a", None]) == ["a", "a.2", "a.1", "a.3", "Unnamed: 4"]


def test_no_records(spark, tmp_path):
    (tmp_path / "e.csv").write_text("\n\n")
    table = delimited.read_table(spark, str(tmp_path / "e.csv"))
    assert table.rows.count() == 0 and table.headers == [] and table.faults.count() == 0
    (tmp_path / "h.csv").write_text("a,b\n")
    table = delimited.read_table(spark, str(tmp_path / "h.csv"))
    assert table.rows.count() == 0 and table.headers == ["a", "b"]


@pytest.mark.parametrize("line, inside, want", [(b"a,b", False, False), (b"a,b", True, True), (b'a,"b', False, True), (b'a,"b', True, False), (b'""', False, False), (b'"""', False, True), (b'a"b,c', False, False), (b'x"",y', True, True), (b'x",y', True, False), (b'x","y', True, True), (b'"a"b",c', False, False), (b"", True, True), (b'a"",b"', True, False)])
def test_ends_inside(line, inside, want):
    assert delimited.ends_inside(line, inside) is want


# --- outputs of a run --------------------------------------------------------------------------------------


def routed(spark, n=1000):
    return spark.range(0, n, 1, 6).select(F.when(F.col("id") % 10 == 9, None).when(F.col("id") % 3 == 0, "errors").otherwise("cleaned").alias("route"), F.col("id").cast("string").alias("id"), F.when(F.col("id") % 2 == 0, 'a "b",\nc ').alias("note"), F.lit("x").alias("extra"))


def whole(path, route):
    """A route's parts one behind the other."""
    return "".join(open(os.path.join(path, f), newline="").read() for f in runs.read_manifest(path)["routes"][route]["files"])


def test_routes_have_one_header_each(spark, tmp_path):
    path = str(tmp_path / "run")
    manifest = runs.write_routed(routed(spark), path, "route", ["id", "note", "gone"], ["cleaned", "errors", "empty"])
    assert {r: m["rows"] for r, m in manifest["routes"].items()} == {"cleaned": 600, "errors": 300, "empty": 0}
    for route in ("cleaned", "errors", "empty"):
        rows = list(csv.reader(io.StringIO(whole(path, route), newline="")))
        assert rows[0] == ["id", "note", "gone"] and len(rows) - 1 == manifest["routes"][route]["rows"]
        assert len(whole(path, route)) == manifest["routes"][route]["bytes"]
        want = {(r.id, r.note or "", "") for r in routed(spark).where(F.col("route") == route).collect()}
        assert {tuple(r) for r in rows[1:]} == want
        assert {(r.id, r.note or "", r.gone or "") for r in runs.read_routed(spark, path, route).collect()} == want


def test_a_run_that_fails_leaves_the_one_before(spark, tmp_path):
    path = str(tmp_path / "run")
    runs.write_routed(routed(spark, 50), path, "route", ["id"], ["cleaned", "errors"])
    before, files = whole(path, "cleaned"), sorted(os.listdir(path))
    broken = routed(spark).withColumn("id", F.when(F.col("id") == "777", F.raise_error(F.lit("no"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="no"):
        runs.write_routed(broken, path, "route", ["id"], ["cleaned", "errors"])
    with pytest.raises(Exception, match="no such route"):
        runs.write_routed(routed(spark), path, "route", ["id"], ["cleaned"])
    assert whole(path, "cleaned") == before and sorted(os.listdir(path)) == files
    # a driver killed before its commit: parts are there, the manifest does not name them
    writer = runs.RunWriter(path, {"cleaned": runs.csv_head(["id"])}, True)
    with writer._open(*runs.store_of(path), f"run-{writer.run}/cleaned/part-00000-1") as out:
        out.write(b"1\n")
    assert whole(path, "cleaned") == before
    runs.write_routed(routed(spark, 20), path, "route", ["id"], ["cleaned", "errors"])
    assert len(whole(path, "cleaned").split()) - 1 == 12


def test_append_keeps_columns_and_header(spark, tmp_path):
    path = str(tmp_path / "t")
    runs.append_rows(spark.createDataFrame([("1", "a")], "id string, v string"), path, ["id", "v"])
    runs.append_rows(spark.createDataFrame([("x", "2")], "w string, id string"), path, ["w"])
    runs.append_rows(spark.createDataFrame([], "id string"), path, ["id"])
    assert whole(path, "rows").splitlines() == ["id,v", "1,a", "2,"]
    assert sorted(tuple(r) for r in runs.read_routed(spark, path, "rows").collect()) == [("1", "a"), ("2", None)]


def test_outputs_of_cleaning(spark, tmp_path):
    rows = [(i, f"T{i}", "India", "9876543210" if i % 4 else "12", "2024-01-05" if i % 5 else "not a date", f"1{i % 10}:05:09", None) for i in range(40)]
    out = clean.clean_table(spark.createDataFrame(rows, f"{ROW} long, Test_ID string, Country string, Phone_Number string, Transaction_Date string, Transaction_Time string, Notes string"), "STRICT")
    path = str(tmp_path / "run")
    runs.write_clean_run(out, path, "STRICT")
    for name in ("cleaned", "errors", "warnings", "duplicates", "removed"):
        got = list(csv.reader(io.StringIO(whole(path, name))))
        want = getattr(out, name).drop(ROW)
        assert got[0] == want.columns == ["Test_ID", "Country", "Phone_Number", "Transaction_Date", "Transaction_Time"]
        assert sorted(map(tuple, got[1:])) == sorted(tuple(r) for r in want.collect()), name
    audit = [json.loads(x) for x in whole(path, "audit_report").splitlines()]
    assert len(audit) == out.audit.count() and {a["row"] for a in audit} == {r.row_no for r in out.audit.collect()}
    assert json.loads(whole(path, "stats"))["total_processed"] == 40 and json.loads(whole(path, "removed_columns")) == {"removed_columns": ["Notes"]}


# --- chunks ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("wide", [None, True])
def test_archive_of_all_chunks(spark, tmp_path, wide):
    df = spark.range(0, 1003, 1, 7).select(F.col("id").alias(ROW), F.concat(F.lit("v,"), "id").alias("v"), F.when(F.col("id") % 2 == 0, "é").alias("w"))
    path = str(tmp_path / "all.zip")
    members = {r.chunk_id: r for r in chunk.write_archive(df, path, 10, wide).collect()}
    assert len(members) == 101 and members[101].n == 3 and os.listdir(tmp_path) == ["all.zip"]
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and z.namelist() == [f"chunk_{i:03d}.csv" for i in range(1, 102)]
        rows = [r for name in z.namelist() for r in list(csv.reader(io.StringIO(z.read(name).decode())))[1:]]
        assert rows == [[f"v,{i}", "é" if i % 2 == 0 else ""] for i in range(1003)]
        assert [z.getinfo(members[i].name).header_offset for i in (1, 50, 101)] == [members[i].offset for i in (1, 50, 101)]
    chunk.write_archive(df.where("false"), path, 10, wide)
    assert zipfile.ZipFile(path).namelist() == []


def test_directory_entries_beyond_four_gigabytes():
    entry = chunk._central(b"chunk_001.csv", 1, 2, 3, 5 << 32, True)
    end = chunk._end(1, len(entry), 0, True)
    assert zipfile.ZipFile(io.BytesIO(entry + end)).infolist()[0].header_offset == 5 << 32


def test_chunk_files(spark, tmp_path):
    df = spark.range(0, 25, 1, 4).select(F.col("id").alias(ROW), F.concat(F.lit("v"), "id").alias("v"))
    path = str(tmp_path / "chunks")
    made = sorted(tuple(r) for r in chunk.write_chunk_files(df, path, 10).select("chunk_id", "name", "n").collect())
    assert made == [(1, "chunk_001.csv", 10), (2, "chunk_002.csv", 10), (3, "chunk_003.csv", 5)]
    assert sorted(os.listdir(path)) == [m[1] for m in made]
    assert open(os.path.join(path, "chunk_003.csv")).read().split() == ["v", *(f"v{i}" for i in range(20, 25))]
    assert {r.path.rsplit("/", 1)[1]: r.size_kb for r in file_sizes(spark, path, 2).collect()} == {n: round(os.path.getsize(os.path.join(path, n)) / 1024, 2) for n in os.listdir(path)}
