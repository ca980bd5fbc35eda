"""Season scans, probes, atomic and versioned sinks; game states as a stream and in batch."""

import datetime as dt
import random

import pytest

from playsight.sources import tables as T
from playsight.streaming import games


def test_seasons_probe_and_listing(spark, tmp_path):
    for s in (2020, 2022):
        spark.createDataFrame([(s, 2, 1.5)], "season int, version int, x double").write.parquet(f"{tmp_path}/team_{s}.parquet")
    spark.createDataFrame([(2023, 1.5)], "season int, x double").write.parquet(f"{tmp_path}/team_2023.parquet")
    got = T.seasons(spark, str(tmp_path), "team", [2020, 2021, 2022, 2023])
    assert sorted((r["season"], r["version"]) for r in got.collect()) == [(2020, 2), (2022, 2), (2023, None)]
    assert [p.rsplit("/", 1)[1] for p in T.listing(spark, f"{tmp_path}/team_*")] == [f"team_{s}.parquet" for s in (2020, 2022, 2023)]
    with pytest.raises(FileNotFoundError):
        T.seasons(spark, str(tmp_path), "team", [2001])
    one = f"{tmp_path}/team_2020.parquet"
    assert T.probe(spark, one, ["x"], ("version", 2)) and not T.probe(spark, one, ["x"], ("version", 3)) and not T.probe(spark, one, ["y"])
    assert not T.probe(spark, f"{tmp_path}/team_2023.parquet", ["x"], ("version", 2))


def test_sinks(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "game int, v string")
    path = f"{tmp_path}/t"
    T.write_atomic(frame([(1, "a"), (2, "b")]), path)
    T.write_atomic(frame([(1, "a"), (2, "b"), (3, "c")]), path)
    T.replace_rows(frame([(2, "B"), (9, "z")]), path, f"{path}2", ["game"], ["game"])
    assert [tuple(r) for r in spark.read.parquet(f"{path}2").orderBy("game").collect()] == [(1, "a"), (2, "B"), (3, "c"), (9, "z")]
    assert sorted(map(tuple, T.replace_version(frame([(1, "old"), (1, "old2"), (2, "x")]), frame([(1, "new")]), "game").collect())) == [(1, "new"), (2, "x")]
    (tmp_path / "in").mkdir()
    for name, text in (("a", "one"), ("b", "one"), ("c", "two")):
        (tmp_path / "in" / name).write_text(text)
    first = T.archive(spark, str(tmp_path / "in"), f"{tmp_path}/kept")
    assert first.select("sha256").distinct().count() == 2 and spark.read.parquet(f"{tmp_path}/kept").count() == 2
    T.archive(spark, str(tmp_path / "in"), f"{tmp_path}/kept")
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 2
    log = spark.createDataFrame([(1, 1, 5, "early"), (1, 4, 5, "last"), (1, 6, 5, "late"), (2, 9, 5, "late")], "game int, at int, start int, v string")
    assert [tuple(r) for r in T.frozen_at(log, ["game"], "at", "start").collect()] == [(1, 4, 5, "last")]


def _polls():
    rng = random.Random(5)
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)
    rows = []
    for game in range(12):
        status, score = "scheduled", "0-0"
        for k in range(30):
            if game % 4 != 3 and k > 4:
                status = "live"
            if rng.random() < 0.2 and status == "live":
                score = f"{k}-0"
            if game % 3 == 0 and k > 20:
                status = "final"
            rows.append((game, at(k * 600 + game), at(2000), status, score, rng.random()))
    return rows


def test_game_states_stream_as_in_batch(spark, tmp_path):
    schema = "game long, ts timestamp, kickoff timestamp, status string, score string, p double"
    rows = _polls()
    for k, part in enumerate((rows[::1],)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*")
    q = games.game_states(stream).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(str, spark.table("states").collect()))
    want = games.game_states_batch(spark.createDataFrame(rows, schema))
    assert got == sorted(map(str, want.collect())) and got
    ends = {r["status"] for r in want.collect()}
    assert {"abandoned", "final", "live", "scheduled"} <= ends


def test_heartbeats_and_late_writes(spark):
    at = lambda s: dt.datetime(2024, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=s)
    rows = [(1, at(s), v) for s, v in ((0, "a"), (60, "a"), (130, "a"), (200, "a"), (250, "a"), (260, "b"), (300, "b"))]
    got = games.heartbeats(spark.createDataFrame(rows, "k int, ts timestamp, v string"), "k", "ts", ["v"])
    assert [int((r["ts"].astimezone(dt.UTC) - at(0)).total_seconds()) for r in got.orderBy("ts").collect()] == [0, 130, 250, 260]
    rows = [(1, at(0), at(100), at(50)), (2, at(0), at(100), at(100)), (3, at(0), at(5000), at(700)), (4, at(120), at(100), at(90))]
    kept = games.in_time(spark.createDataFrame(rows, "k int, f timestamp, s timestamp, r timestamp"), "f", "s", "r").collect()
    assert [r["k"] for r in kept] == [1]
