"""Stored tables as lists of live files, so that an update rewrites few of them.

A version of a table is a manifest: its files with the range of keys and the number of rows
in each. Files are range-partitioned by the key when they are written. An update reads the
files that hold an updated key, writes their rows anew and lists the new files beside the
untouched ones; nothing is changed in place, so readers of an older version keep it.

Versions are numbered. Whoever lists version n + 1 first claims the number with a file that
only one can create; another writer that started from version n is refused, its files stay
unlisted, and it has to start over from the newer version.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_SKEW, SkewPolicy
from tallyboard.operators.updates import apply_updates
from tallyboard.session import materialise
from tallyboard.sources.snapshots import Conflict, claim, new_version

#: Updated keys up to which files are chosen by their ranges; of more keys, by the key column.
RANGED_KEYS = 10_000


def _write(df: DataFrame, folder: str, key: str, files: int | None) -> DataFrame:
    """Write rows in ranges of the key; the entries of the new files."""
    wanted = [files] if files else []
    df.repartitionByRange(*wanted, key).sortWithinPartitions(key).write.mode("error").parquet(folder)
    written = df.sparkSession.read.schema(df.schema).parquet(folder)
    return written.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count("*").alias("rows"), F.min(key).alias("low"), F.max(key).alias("high")
    )


def _list(entries: DataFrame, root: str, number: int) -> None:
    if not claim(entries.sparkSession, root, number):
        raise Conflict(f"version {number} of {root} is another writer's")
    entries.coalesce(1).write.mode("error").parquet(f"{root}/manifests/{number}")


def create(df: DataFrame, root: str, key: str = "id", files: int | None = None) -> int:
    """Write the first version of a table; returns its number."""
    _list(_write(df, f"{root}/data/{new_version()}", key, files), root, 1)
    return 1


def manifest(spark: SparkSession, root: str, number: int) -> DataFrame:
    """path, rows, low, high: a row per live file."""
    return spark.read.parquet(f"{root}/manifests/{number}")


def _paths(entries: DataFrame) -> list[str]:
    # names of files, as Spark lists them itself when it reads a folder
    return [row.path for row in entries.select("path").collect()]


def read(spark: SparkSession, root: str, number: int, schema) -> DataFrame:
    """The rows of one version."""
    paths = _paths(manifest(spark, root, number))
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*paths)


def touched_files(
    table: DataFrame, entries: DataFrame, updates: DataFrame, key: str, policy: SkewPolicy = DEFAULT_SKEW
) -> DataFrame:
    """The entries whose files may hold an updated key.

    Few keys are held against the ranges in the manifest. More keys are looked up in the
    key column of the files, which names those that really hold one.
    """
    keys = materialise(updates.select(F.col(key).alias("_key")).distinct(), "updated-keys")
    if keys.count() <= min(RANGED_KEYS, policy.broadcast_rows):
        ranged = F.col("_key").between(F.col("low"), F.col("high"))
        return entries.join(F.broadcast(keys), ranged, "left_semi")
    held = table.select(F.col(key), F.col("_metadata.file_path").alias("path"))
    paths = held.join(keys, F.col(key) == F.col("_key"), "left_semi").select("path").distinct()
    return entries.join(paths, "path", "left_semi")


def update(
    spark: SparkSession,
    root: str,
    base: int,
    schema,
    updates: DataFrame,
    columns: Sequence[str],
    key: str = "id",
    policy: SkewPolicy = DEFAULT_SKEW,
) -> int:
    """``apply_updates`` on version ``base``; returns the number of the version made.

    Only files that may hold an updated key are read whole and written again.
    """
    entries = manifest(spark, root, base)
    if entries.isEmpty():
        _list(entries, root, base + 1)
        return base + 1
    chosen = touched_files(read(spark, root, base, schema), entries, updates, key, policy)
    chosen = materialise(chosen, "touched-files")
    paths = _paths(chosen)
    kept = entries.join(chosen, "path", "left_anti").select(*entries.columns)
    if paths:
        rows = apply_updates(spark.read.schema(schema).parquet(*paths), updates, columns, key)
        new = _write(rows, f"{root}/data/{new_version()}", key, len(paths))
        kept = kept.unionByName(new)
    _list(kept, root, base + 1)
    return base + 1
