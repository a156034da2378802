"""Streams replayed from files, however these are cut, against the batch result."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veracity.streaming import duplicates


@pytest.mark.parametrize("cut, per_batch", [(1, 1), (7, 1), (7, 3), (40, 5)])
def test_replayed_files_equal_the_batch(spark, tmp_path, cut, per_batch):
    rng = random.Random(cut)
    ids = [f"T{i}" for i in range(60)] + ["hot"] * 40 + [" T3 ", "T3", "", None, "null", None]
    rows = [(rng.choice(ids), f"v{n % 9}") for n in range(160)]
    for i in range(cut):
        part = rows[i::cut]
        (tmp_path / f"in{i:02d}.csv").write_text("id,v\n" + "".join(f"{a or ''},{b}\n" for a, b in part))
    stream = duplicates.id_changes(duplicates.read_files(spark, str(tmp_path / "in*.csv"), ["id", "v"], per_batch), "id")
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert query.exception() is None and len([p for p in query.recentProgress if p["numInputRows"]]) == -(-cut // per_batch)
    changes = spark.read.parquet(str(tmp_path / "out"))
    missing = lambda i: i is None or i.strip().lower() in ("", "null", "nan", "undefined")
    copies = Counter(i.strip() for i, _ in rows if not missing(i))
    want = Counter((i or None, v, not missing(i) and copies[i.strip()] > 1) for i, v in rows)
    assert Counter(tuple(r) for r in duplicates.settled(changes).select("id", "v", "duplicate").collect()) == want
    if per_batch < cut:
        assert changes.where("change = -1").count() > 0


def test_state_is_dropped_behind_the_watermark(spark, tmp_path):
    days = [("a", "2024-01-01"), ("b", "2024-01-02"), ("b", "2024-01-02"), ("c", "2024-02-01"), ("d", "2024-02-02"), ("a", "2024-02-03")]
    for i, (k, day) in enumerate(days):
        spark.createDataFrame([(k, day)], "id string, day string").withColumn("ts", F.col("day").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / f"in/d{i}"))
    stream = spark.readStream.schema("id string, day string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    query = duplicates.id_changes(stream, "id", "ts", "2 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(300)
    got = Counter((r.id, r.duplicate) for r in duplicates.settled(spark.read.parquet(str(tmp_path / "out"))).collect())
    # the second a comes a month later: a first row again
    assert got == Counter({("a", False): 2, ("b", True): 2, ("c", False): 1, ("d", False): 1})
