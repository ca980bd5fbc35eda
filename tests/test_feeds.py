"""Recorded feeds in batch and as a stream, with broken pulls and broken sources."""

import json

from pyspark.sql import functions as F

from playsight.sources import feeds, tables


def _write(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content))


def test_batch_and_stream_read_the_same_and_a_broken_pull_is_one_problem(spark, tmp_path):
    feeds.register(spark)
    folder = tmp_path / "odds"
    _write(folder, "0001.json", {"pulled": "2024-09-01", "records": [{"game": 1, "price": -110}, {"game": 2, "price": 50}, 7]})
    _write(folder, "0002.json", "{ broken")
    stream = spark.readStream.format("recorded_feed").option("folder", str(folder)).load()

    def drain():
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)

    drain()
    _write(folder, "0003.json", {"pulled": "2024-09-02", "records": [{"game": 3, "price": 120}, {"price": 130}]})
    _write(folder, "0004.json", {"records": {}})
    drain()  # goes on behind the last pull
    batch = spark.read.format("recorded_feed").option("folder", str(folder)).load()
    rows = sorted(map(str, batch.collect()))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == rows and len(rows) == 7
    good, bad = feeds.validated(batch, "game long, price double", {"game": F.col("game").isNotNull(), "price": F.abs("price") >= 100})
    assert sorted((r["game"], r["price"], r["pulled"]) for r in good.collect()) == [(1, -110.0, "2024-09-01"), (3, 120.0, "2024-09-02")]
    problems = {(r["file"], r["position"]): r["problem"] for r in bad.collect()}
    assert problems["0001.json", 1] == "price" and problems["0003.json", 1] == "game" and problems["0001.json", 2] == "record is no object"
    assert problems["0002.json", -1].startswith("JSONDecodeError") and problems["0004.json", -1].startswith("TypeError") and len(problems) == 5
    assert spark.read.format("recorded_feed").option("folder", str(tmp_path / "none")).load().count() == 0


def test_a_broken_source_leaves_the_others_whole(spark, tmp_path):
    def sink(name, frame):
        tables.write_atomic(frame, str(tmp_path / name))

    ok = lambda: spark.range(3).toDF("x")
    sink("third", spark.range(5).toDF("x"))
    problems = feeds.ingested({"first": ok, "second": lambda: spark.read.parquet(str(tmp_path / "missing")), "third": lambda: spark.range(2).select(F.raise_error("bad row").alias("x")), "fourth": ok}, sink)
    assert set(problems) == {"second", "third"}
    assert [spark.read.parquet(str(tmp_path / n)).count() for n in ("first", "fourth", "third")] == [3, 3, 5]


def test_a_crash_between_the_renames_is_mended(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_atomic(spark.range(4), path)
    (tmp_path / "t").rename(tmp_path / "t.old")  # the moment after the old table was set aside
    tables.restore_atomic(spark, path)
    assert spark.read.parquet(path).count() == 4
    tables.write_atomic(spark.range(6), path)
    assert spark.read.parquet(path).count() == 6 and not (tmp_path / "t.old").exists() and not (tmp_path / "t.tmp").exists()


def test_announcements_last_until_retracted(spark):
    rows = [("a", 1, "q1", False), ("a", 2, "q2", False), ("b", 1, "q3", False), ("b", 3, "q3", True), ("c", 1, "q4", True), ("c", 2, "q5", False)]
    got = feeds.latest_announcement(spark.createDataFrame(rows, "team string, at int, who string, off boolean"), "team", "at", "who", "off")
    assert {r["team"]: r["who"] for r in got.collect()} == {"a": "q2", "c": "q5"}
