"""Recorded feeds (odds, scoreboards, injuries) as a data source, in batch and as a stream, and ingestion that isolates its sources.

A feed is a folder of JSON files, one a pull, named so that later pulls sort later.  Folders are reached by
URI (pyarrow.fs), so drivers and executors need share no disk of their own.  A pull becomes one row a record:
(file, position, pulled, record as JSON text, problem); what is wrong with a pull is a row with a problem, not a failed
task, so one broken pull leaves the others whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, position int, pulled string, record string, problem string"


@dataclass
class _Pull(InputPartition):
    path: str


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def _pulls(folder: str) -> list[str]:
    """Names of a feed's pulls, in order."""
    from pyarrow import fs

    system, path = _filesystem(folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.File and f.base_name.endswith(".json"))


def _records(folder: str, name: str) -> Iterator[tuple]:
    system, path = _filesystem(folder)
    try:
        with system.open_input_stream(f"{path}/{name}") as stream:
            pull = json.loads(stream.read())
        records = pull["records"]
        if not isinstance(records, list):
            raise TypeError("records is no list")
    except (OSError, ValueError, TypeError, KeyError) as e:
        yield name, -1, None, None, f"{type(e).__name__}: {e}"[:200]
        return
    for k, record in enumerate(records):
        problem = None if isinstance(record, dict) else "record is no object"
        yield name, k, pull.get("pulled"), json.dumps(record, sort_keys=True), problem


class RecordedFeed(DataSource):
    """spark.read.format("recorded_feed").option("folder", uri), or readStream with the same."""

    @classmethod
    def name(cls) -> str:
        return "recorded_feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options["folder"])

    def streamReader(self, schema):
        return _Stream(self.options["folder"], int(self.options.get("pulls_per_batch", "100")))


class _Batch(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self):
        return [_Pull(name) for name in _pulls(self.folder)]

    def read(self, partition):
        if partition is not None and getattr(partition, "path", None):
            yield from _records(self.folder, partition.path)


class _Stream(DataSourceStreamReader):
    """The offset is the name of the last pull read: names sort by time, so a restart goes on behind it."""

    def __init__(self, folder: str, most: int):
        self.folder, self.most, self.at = folder, most, ""

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max([*_pulls(self.folder), self.at])}

    def partitions(self, start: dict, end: dict):
        return [_Pull(name) for name in _pulls(self.folder) if start["after"] < name <= end["after"]]

    def read(self, partition):
        yield from _records(self.folder, partition.path)

    def commit(self, end: dict) -> None:
        self.at = end["after"]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedFeed)


def validated(records: DataFrame, schema: str, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(good rows, problems): records of a feed parsed by schema; a row that breaks a rule, or didn't parse, is a problem by the first rule's name.

    rules: name -> what must hold, over the columns of schema and pulled.
    """
    parsed = records.withColumn("_r", F.from_json("record", schema))
    names = [f.name for f in parsed.schema["_r"].dataType.fields]
    flat = parsed.select("file", "position", "pulled", F.col("problem").alias("_problem"), *[F.col(f"_r.{n}").alias(n) for n in names])
    broken = F.coalesce("_problem", *[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    judged = flat.withColumn("problem", broken)
    return judged.where("problem is null").drop("_problem", "problem"), judged.where("problem is not null").select("file", "position", "problem")


def ingested(sources: dict[str, Callable[[], DataFrame]], sink: Callable[[str, DataFrame], None]) -> dict[str, str]:
    """Runs every source into the sink on its own; gives the problems by name.  A source that fails leaves what it had before and the others whole."""
    problems: dict[str, str] = {}
    for name, load in sources.items():
        try:
            sink(name, load())
        except Exception as e:  # whatever a source raises is its own problem, and is reported
            problems[name] = f"{type(e).__name__}: {e}"[:500]
    return problems


def latest_announcement(records: DataFrame, key: str, at: str, value: str, retracted: str) -> DataFrame:
    """(key, at, value): the latest announcement of each key that wasn't retracted after it; one missing from a later pull is kept."""
    last = records.groupBy(key).agg(F.max(F.struct(at, F.col(retracted).cast("int").alias("_r"), value)).alias("x"))
    return last.where("x._r = 0").select(key, F.col(f"x.{at}").alias(at), F.col(f"x.{value}").alias(value))
