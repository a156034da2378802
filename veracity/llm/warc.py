"""WARC archives: writing with revisit records, reading by boundary-chain verification.

Records are written by Spark's text writer with the record terminator as line separator, so they go
to any store Spark can write to.  Reading splits archives at the magic ``WARC/1.``: every split of a
file yields candidates with their byte offset and the offset of the successor their Content-Length
announces.  The magic may stand inside a payload too; so the chain of successors is followed from
each file's start by pointer jumping, and only candidates on it are records.  Candidates that follow
each other without a gap form a run, which one pointer crosses; the number of rounds is the
logarithm of the number of runs.  Texts that the magic cut in two are put together again, headers
(a URL may hold the magic) before the chain is followed, payloads after it.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veracity.llm.storage import materialize, new_path

MAGIC, END, BLANK = "WARC/1.", "\r\n\r\n", "\r\n\r\n"
#: a header is no longer than this, and the magic stands in it no oftener than ``INNER`` times
MOST_HEADER, INNER = 1 << 16, 30


def _safe(c: Column) -> Column:
    """A header value on one line: control characters are percent-encoded away."""
    return F.regexp_replace(c, "[\\x00-\\x1f\\x7f]", "%20")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 1000, compression: str = "gzip", records_per_file: int = 200_000) -> None:
    """One record per row; of equal payloads of ``least`` bytes or more all but one are revisits.

    The response is the row with the largest id; a null id is smaller than any other and such a row
    is a response unless its payload also stands under an id.  Rows repeating that id stay
    responses.  A null payload is empty, a null url has no header; other columns are not written.
    Equality of payloads is that of SHA-1, xxHash64 and length together.
    """
    p = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), p.alias("payload")).select("*", F.sha1(F.col("payload").cast("binary")).alias("sha"), F.octet_length("payload").alias("bytes"), F.xxhash64("payload").alias("xx"))
    slim = rows.where(F.col("bytes") >= least).select("sha", "bytes", "xx", "id")
    first = slim.groupBy("sha", "bytes", "xx").agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "bytes", "xx", "first")
    met = rows.join(first, ["sha", "bytes", "xx"], "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    body = F.when(revisit, "").otherwise(F.col("payload"))
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    record = F.concat(
        F.lit("WARC/1.0\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", _safe(F.col("url"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha"))), line("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">")))),
        F.lit("Content-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit(BLANK), body,
    )
    met.select(record.alias("value")).write.option("lineSep", END).option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def _header(head: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(head, f"(?i)\r\n{name}:[ \t]*([^\r\n]*)", 1), F.lit(""))


def _mended_headers(placed: DataFrame) -> DataFrame | None:
    """file, split, at, head, start, length of the records whose header holds the magic; None if there are none.

    An open header, which ends inside a value, is joined to the chunk that begins where it stops, and so
    on until one holds the blank line.
    """
    n = len(MAGIC)
    parts = placed.where("part is not null").select("file", "offset", (F.col("offset") + n + F.col("size")).alias("next"), "part", "closes")
    left = placed.where(F.col("part").rlike("^[01]\r\n") & ~F.col("closes")).select("file", "split", "at", (F.col("offset") + n + F.col("size")).alias("next"), F.col("part").alias("text"))
    done = []
    for _ in range(INNER):
        if left.isEmpty():
            break
        met = left.join(parts.withColumnsRenamed({"offset": "o", "next": "after"}), [left["file"] == parts["file"], left["next"] == F.col("o")])
        met = materialize(met.select(left["file"], "split", "at", F.col("after").alias("next"), F.concat("text", F.lit(MAGIC), "part").alias("text"), "closes").where(F.octet_length("text") <= MOST_HEADER), "warc-headers")
        done.append(met.where("closes"))
        left = met.where("not closes").drop("closes")
    if not done:
        return None
    whole = reduce(DataFrame.unionByName, done)
    return materialize(whole.select("file", "split", "at", F.col("text").alias("head"), (F.octet_length("text") + len(BLANK)).cast("long").alias("start"), _header(F.col("text"), "Content-Length").try_cast("long").alias("length")), "warc-headers")


def _chunks(lines: DataFrame) -> DataFrame:
    """file, split, at, bin: what lies between two magics; ``split`` and ``at`` tell the order in this scan alone."""
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("bin"))


def _offsets(chunks: DataFrame) -> DataFrame:
    """``chunks`` (written, with size) with the byte offset of each in its file, where the magic before it begins.

    Prefix sums inside each split, then over the splits of a file.
    """
    n = len(MAGIC)
    total = chunks.groupBy("file", "split").agg(F.sum(F.col("size") + n).alias("total"))
    before = total.select("file", "split", F.coalesce(F.sum("total").over(Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("file", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    local = chunks.withColumn("local", F.coalesce(F.sum(F.col("size") + n).over(inside), F.lit(0)))
    return local.join(before, ["file", "split"]).withColumn("offset", F.col("base") + F.col("local") - n).drop("base", "local")


def read_warc(spark: SparkSession, path: str, payload: Callable[[Column], Column] = lambda p: p, max_rounds: int = 40) -> DataFrame:
    """file, offset, head (the header lines), content_length and payload of every record.

    ``payload`` is applied to the payload (binary) where it is read, so that with a digest or a length
    for instance only that travels.  Candidates off the chain are no records.  A file whose chain
    breaks off before its end (bytes between records, a record cut short, a wrong length) raises a
    ``ValueError`` that names it: no record is left out silently.  Offsets are those of the
    decompressed file.  An empty folder gives no rows; records that stand twice are returned twice.
    """
    lines = spark.read.option("lineSep", MAGIC).text(path)
    raw = _chunks(lines)
    # the header ends at the first blank line
    text = F.col("bin").cast("string")
    head_size = F.instr(text, BLANK)
    head = F.when(head_size > 0, F.substring_index(text, BLANK, 1))
    chunks = raw.select("file", "split", "at", "bin", F.octet_length("bin").cast("long").alias("size"), F.when(head.rlike("^[01]\r\n"), head).alias("head"))
    length = _header(F.col("head"), "Content-Length").try_cast("long")
    start = F.octet_length("head").cast("long") + len(BLANK)
    body = F.substring("bin", (start + 1).cast("int"), length.cast("int"))
    whole = start + length <= F.col("size")
    # a chunk of header lines behind the rest of a line may belong to a header that holds the magic
    closes = F.instr(text, BLANK) > 0
    rest = F.when(closes, F.substring_index(text, BLANK, 1)).when(F.col("size") <= MOST_HEADER, text)
    fields = F.forall(F.slice(F.split(rest, "\r\n"), 2, 1 << 20), lambda x: x.rlike("^[A-Za-z0-9-]+:"))
    part = F.coalesce("head", F.when(fields, rest))
    slim = chunks.select("file", "split", "at", "size", "head", start.alias("start"), length.alias("length"), F.coalesce(whole, F.lit(False)).alias("whole"), F.when(whole, payload(body)).alias("payload"), part.alias("part"), closes.alias("closes"))
    slim = materialize(slim, "warc-chunks")

    inside, n = Window.partitionBy("file", "split").orderBy("at"), len(MAGIC)
    sums = slim.groupBy("file", "split").agg(F.sum(F.col("size") + n).alias("total"))
    placed = _offsets(slim.select("file", "split", "at", "size", "start", "length", "part", "closes"))
    mended_heads = _mended_headers(placed)
    placed = placed.drop("part", "closes")
    if mended_heads is not None:
        slim, placed = (df.join(mended_heads.withColumnsRenamed({c: f"_{c}" for c in ("head", "start", "length")}), ["file", "split", "at"], "left").withColumns({c: F.coalesce(f"_{c}", c) for c in ("head", "start", "length") if c in df.columns}).select(df.columns) for df in (slim, placed))
    cand = placed.where("length is not null and length >= 0 and offset >= 0").select("file", "split", "at", "offset", (F.col("offset") + n + F.col("start") + F.col("length") + len(END)).alias("next"))
    # runs of candidates that follow each other: one pointer from each member to the offset behind the run
    new_run = F.coalesce(F.lag("next").over(inside) != F.col("offset"), F.lit(True)).cast("int")
    cand = cand.withColumn("run", F.sum(new_run).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    cand = materialize(cand.withColumn("exit", F.max("next").over(Window.partitionBy("file", "split", "run"))), "warc-candidates")

    jump = cand.select("file", "offset", F.col("exit").alias("to"))
    # every file's chain starts at offset 0; an exit that is no candidate ends a chain
    reached = cand.where("offset = 0").select("file", "offset")
    entries = jump.select("file", "to").distinct()
    jump = materialize(jump.join(entries.select("file", F.col("to").alias("offset")).unionByName(reached).distinct(), ["file", "offset"], "left_semi"), "warc-jumps")
    reached = materialize(reached, "warc-reached")
    count = reached.count()
    for turn in range(max_rounds + 1):
        if turn == max_rounds:
            raise RuntimeError(f"the chains did not end in {max_rounds} rounds")
        ahead = reached.join(jump, ["file", "offset"]).select("file", F.col("to").alias("offset")).join(jump.select("file", "offset"), ["file", "offset"], "left_semi")
        reached = materialize(reached.unionByName(ahead).distinct(), "warc-reached")
        now = reached.count()
        if now == count:
            break
        count = now
        double = jump.join(jump.select("file", F.col("offset").alias("to"), F.col("to").alias("to2")), ["file", "to"], "left")
        jump = materialize(double.select("file", "offset", F.coalesce("to2", "to").alias("to")), "warc-jumps")
    # a run is entered at most at one place that matters: its first reached member
    enter = reached.join(cand, ["file", "offset"]).groupBy("file", "split", "run").agg(F.min("offset").alias("enter"))
    true = cand.join(enter, ["file", "split", "run"]).where("offset >= enter").select("file", "split", "at", "offset", "next")
    ends = sums.groupBy("file").agg((F.sum("total") - n).alias("end")).join(true.groupBy("file").agg(F.max("next").alias("last")), "file", "left")
    # the last record may lack its terminator
    short = [r["file"] for r in ends.where(F.col("end") > 0).where(~F.coalesce((F.col("last") - F.col("end")).isin(0, len(END)), F.lit(False))).select("file").limit(5).collect()]
    if short:
        raise ValueError(f"the chain of records breaks off before the end of {', '.join(short)}")
    records = slim.join(true, ["file", "split", "at"])
    ready = records.where("whole").select("file", "offset", "head", F.col("length").alias("content_length"), "payload")

    # payloads with the magic inside: the chunks of their files are read again, placed by byte offset as a
    # split may be another this time, and joined up
    broken = materialize(records.where("not whole").select("file", "offset", "next", "head", "start", "length"), "warc-broken")
    missing = broken.count()
    if not missing:
        return ready
    files = [r["file"] for r in broken.select("file").distinct().collect()]  # no more than the scan lists
    again = materialize(_chunks(lines.where(F.col("_metadata.file_path").isin(files))).withColumn("size", F.octet_length("bin").cast("long")), "warc-again")
    area = 1 << 20  # records and chunks meet by file and MiB, never by file alone
    bounds = broken.select("file", F.col("offset").alias("from"), "next", F.explode(F.sequence(F.floor(F.col("offset") / area), F.floor((F.col("next") - 1) / area))).alias("area"))
    spots = _offsets(again).select("file", "offset", "bin", F.floor(F.col("offset") / area).alias("area"))
    covered = spots.join(bounds, ["file", "area"]).where("offset >= from and offset < next")
    pieces = covered.groupBy("file", "from").agg(F.sort_array(F.collect_list(F.struct("offset", F.concat(F.lit(MAGIC).cast("binary"), F.col("bin")).alias("b")))).alias("parts"))
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["b"]))
    mended = pieces.select("file", F.col("from").alias("offset"), joined.alias("all")).join(broken, ["file", "offset"])
    inner = F.substring("all", (F.col("start") + n + 1).cast("int"), F.col("length").cast("int"))
    complete = F.octet_length("all") >= F.col("start") + n + F.col("length")
    mended = materialize(mended.where(complete).select("file", "offset", "head", F.col("length").alias("content_length"), payload(inner).alias("payload")), "warc-mended")
    found = mended.count()
    if found != missing:
        raise ValueError(f"of {missing} records whose payload holds the magic only {found} could be put together")
    return ready.unionByName(mended)


def page_records(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of records read with length and SHA-1.

    A revisit takes length and digest from the response it refers to; where that is missing they are null.
    """
    urn = lambda name: F.nullif(F.regexp_extract(_header(F.concat(F.lit("\r\n"), "head"), name), "^<urn:page:(-?[0-9]+)>", 1), F.lit("")).cast("long")
    r = records.select(urn("WARC-Record-ID").alias("page_id"), _header("head", "WARC-Type").alias("record_type"), urn("WARC-Refers-To").alias("refers_to"), "payload")
    own = r.where("record_type = 'response'").select("page_id", F.col("payload.bytes").alias("payload_bytes"), F.col("payload.sha1").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    again = r.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to")
    wanted = again.select(F.col("refers_to").alias("page_id")).distinct()
    full = own.join(wanted, "page_id", "left_semi").select(F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to"])
    return own.unionByName(again.join(full, "refers_to", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest, max(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM d
"""


def op1_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    measured = lambda p: F.struct(F.octet_length(p).cast("long").alias("bytes"), F.sha1(p).alias("sha1"))
    return page_records(read_warc(spark, path, measured))
