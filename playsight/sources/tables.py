"""Sources and sinks: explicit schemas, partitioned scans, strict CSV, incremental and append-only writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet, with only the columns asked for read."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def contract(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Reorders and casts to a schema; absent columns are typed NULLs, NaN becomes NULL."""
    out = []
    for f in schema.fields:
        c = F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType)
        if f.name in df.columns and isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        out.append(c.alias(f.name))
    return df.select(*out)


def strict_csv(spark: SparkSession, path: str, patterns: dict[str, str], keys: list[str]) -> DataFrame:
    """All-string CSV whose columns must match their patterns and whose keys must be unique, else it is refused."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in patterns])
    df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    bad = df.where(~F.forall(F.array(*[F.coalesce(F.col(c).rlike(f"^(?:{p})$"), F.lit(False)) for c, p in patterns.items()]), lambda x: x))
    if not bad.isEmpty():
        raise ValueError(f"rows of {path} do not match their patterns")
    if not df.groupBy(*keys).count().where("count > 1").isEmpty():
        raise ValueError(f"{path} repeats a key {keys}")
    return df


def upsert(spark: SparkSession, fresh: DataFrame, path: str, target: str, key: str) -> None:
    """Writes to `target` the rows of `path` without the keys rebuilt, and the fresh rows."""
    kept = spark.read.parquet(path).join(fresh.select(key).distinct(), key, "left_anti")
    kept.unionByName(fresh, allowMissingColumns=True).write.mode("overwrite").parquet(target)


def newer_only(current: DataFrame, incoming: DataFrame, keys: list[str], updated: str) -> DataFrame:
    """A monotone merge: of rows with a key, the one updated last; what is there already wins ties."""
    both = current.withColumn("_old", F.lit(1)).unionByName(incoming.withColumn("_old", F.lit(0)))
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*current.columns), F.struct(updated, "_old")).alias("_r"))
    return best.select("_r.*")


def append_checked(log: DataFrame, fresh: DataFrame, identity: list[str], recorded: str, start: str) -> DataFrame:
    """The fresh rows that may be appended to an immutable log: recorded before the start, and not there yet."""
    return fresh.where(F.col(recorded) < F.col(start)).join(log.select(*identity), identity, "left_anti")


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256) of every file of a folder: a write-once manifest of inputs."""
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def listing(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob, sorted; through Hadoop's file system, so any store that Spark reads will do."""
    fs, where = _files(spark, pattern)
    return sorted(str(s.getPath().toString()) for s in fs.globStatus(where) or [])


def seasons(spark: SparkSession, folder: str, name: str, wanted: list[int], columns: list[str] | None = None) -> DataFrame:
    """The union of the season files `name`_<season>.parquet that exist; columns that a season lacks are NULL."""
    have = {p.rsplit("_", 1)[-1].removesuffix(".parquet"): p for p in listing(spark, f"{folder}/{name}_*.parquet")}
    parts = [scan(spark, have[str(s)], columns) for s in wanted if str(s) in have]
    if not parts:
        raise FileNotFoundError(f"no season of {name} in {folder}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def probe(spark: SparkSession, path: str, required: list[str], version: tuple[str, int] | None = None) -> bool:
    """Whether a table is fresh: its footers have the columns, and no row another version (a pushed-down filter that stops at the first)."""
    df = spark.read.parquet(path)
    if not set(required) <= set(df.columns):
        return False
    if version is None:
        return True
    column, value = version
    return column in df.columns and df.where(~F.col(column).eqNullSafe(F.lit(value))).isEmpty()


def write_atomic(df: DataFrame, path: str) -> None:
    """Writes beside `path`, sets the old table aside, and renames the new one into place.

    A failed job leaves the old table as it is; a crash between the two renames leaves both, whole, at `path`.old and `path`.tmp,
    and the next call (or restore_atomic) puts one back.  A reader never sees half of one.
    """
    spark = df.sparkSession
    restore_atomic(spark, path)
    df.write.mode("overwrite").parquet(f"{path}.tmp")
    fs, target = _files(spark, path)
    (_, staged), (_, aside) = _files(spark, f"{path}.tmp"), _files(spark, f"{path}.old")
    if fs.exists(target) and not fs.rename(target, aside):
        raise OSError(f"{path} could not be set aside")
    if not fs.rename(staged, target):
        fs.rename(aside, target)
        raise OSError(f"{path} could not be put in place")
    fs.delete(aside, True)


def restore_atomic(spark: SparkSession, path: str) -> None:
    """After a crash in write_atomic: the table set aside comes back where none is in place, and is removed otherwise."""
    fs, target = _files(spark, path)
    _, aside = _files(spark, f"{path}.old")
    if fs.exists(aside):
        if fs.exists(target):
            fs.delete(aside, True)
        elif not fs.rename(aside, target):
            raise OSError(f"{path} could not be restored")


def replace_rows(df: DataFrame, path: str, target: str, keys: list[str], order: list[str]) -> None:
    """Writes to `target` the table at `path` with all rows of the keys in df replaced, ranged and sorted by `order`."""
    spark = df.sparkSession
    kept = spark.read.parquet(path).join(df.select(*keys).distinct(), keys, "left_anti")
    kept.unionByName(df, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(target)


def archive(spark: SparkSession, folder: str, into: str) -> DataFrame:
    """Copies a folder's files under the SHA-256 of their bytes, each once, and returns their receipts (path, bytes, sha256).

    Files are read and hashed in tasks; what is archived already is never written again.
    """
    files = spark.read.format("binaryFile").load(folder).withColumn("sha256", F.sha2("content", 256))
    fs, where = _files(spark, into)
    if fs.exists(where):
        there = spark.read.parquet(into).select("sha256")
        fresh = files.join(there, "sha256", "left_anti")
    else:
        fresh = files
    fresh.dropDuplicates(["sha256"]).select("sha256", "content").write.mode("append").parquet(into)
    return files.select("path", F.col("length").alias("bytes"), "sha256")


def replace_version(old: DataFrame, fresh: DataFrame, version: str) -> DataFrame:
    """Evaluation rows with each model version that `fresh` has replaced as a whole."""
    return old.join(fresh.select(version).distinct(), version, "left_anti").unionByName(fresh)


def frozen_at(log: DataFrame, identity: list[str], recorded: str, start: str) -> DataFrame:
    """The last row of each identity of an append log that was recorded before its start: what was said before the game."""
    return log.where(F.col(recorded) < F.col(start)).groupBy(*identity).agg(F.max_by(F.struct(*log.columns), F.struct(recorded, *[c for c in log.columns if c != recorded])).alias("_r")).select("_r.*")
