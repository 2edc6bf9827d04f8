"""Published versions of the whole database.

A snapshot is a folder of Parquet tables. It is entered in a catalogue after all
tables are written, so a reader never sees half a snapshot, and a publisher that dies
leaves only an unlisted folder behind. Every entry has a folder of its own, so
publishers do not meet in one, and holds the schemas of its tables. Versions are
ordered by a number one above the highest listed, then by the time of publishing;
names play no part.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyboard.session import passing_shuffles, stored_options

_CATALOGUE = (
    "version string, number long, published_at long, tables array<struct<name: string, schema: string>>"
)

# Column to sort a stored table by, so that a lookup skips row groups by their
# minimum and maximum, and columns to keep Bloom filters for.
_LAYOUT = {
    "players": (["rank", "id"], ["id"]),
    "scores": (["leaderboard_id", "rank", "id"], ["player_id", "id"]),
    "leaderboards": (["id"], []),
}


def append_table(df: DataFrame, path: str) -> None:
    """Add rows to a stored table."""
    df.write.mode("append").parquet(path)


def write_table(df: DataFrame, path: str, table: str) -> None:
    """Write a stored table in its lookup order.

    Range partitioning splits a large board among files instead of giving all of
    it to one task; every file ends up sorted.
    """
    order, looked_up = _LAYOUT.get(table, ([], []))
    order = [c for c in order if c in df.columns]
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    writer = df.write.mode("error").options(**stored_options(df))
    for column in looked_up:
        writer = writer.option(f"parquet.bloom.filter.enabled#{column}", "true")
    with passing_shuffles(df.sparkSession):
        writer.parquet(path)


def new_version() -> str:
    """UTC time to the microsecond plus a suffix."""
    return f"{datetime.now(timezone.utc):%Y%m%d%H%M%S%f}-{uuid.uuid4().hex[:8]}"


def _catalogue(spark: SparkSession, root: str) -> DataFrame | None:
    """All entries, or None before the first one."""
    try:
        return spark.read.schema(_CATALOGUE).parquet(f"{root}/catalogue/*")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _latest(spark: SparkSession, root: str):
    listed = _catalogue(spark, root)
    if listed is None:
        return None
    # one row of a few words per version, of which the last is taken
    return listed.agg(
        F.max(F.struct("number", "published_at", "version", "tables")).alias("last")
    ).first()["last"]


class Conflict(Exception):
    """Another writer has published first."""


def claim(spark: SparkSession, root: str, number: int) -> bool:
    """Take a version number by a file that only one writer can create."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/claims/{number}")
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(path.getParent())
    return system.createNewFile(path)


def _next_number(spark: SparkSession, root: str, base: str | None) -> int:
    """A number above all listed ones that no other writer has."""
    last = _latest(spark, root)
    number = (last["number"] if last else 0) + 1
    if base is None:
        while not claim(spark, root, number):
            number += 1
    elif last is None or last["version"] != base or not claim(spark, root, number):
        raise Conflict(f"{base} is not the newest version of {root} any more")
    return number


def publish_snapshot(
    tables: Mapping[str, DataFrame],
    root: str,
    version: str | None = None,
    base: str | None = None,
) -> str:
    """Write every table under ``<root>/snapshot=<version>/`` and list the version.

    With ``base``, the version that the tables were made from, ``Conflict`` is raised if
    another one was published meanwhile; nothing is listed then. Without it the last
    publisher wins. Of two that end at the same time one is refused or takes the next
    number: a number belongs to who creates its file in ``<root>/claims``.
    """
    spark = next(iter(tables.values())).sparkSession
    if base is not None and latest_version(spark, root) != base:
        raise Conflict(f"{base} is not the newest version of {root}")
    version = version or new_version()
    for name, df in tables.items():
        write_table(df, f"{root}/snapshot={version}/{name}", name)
    number = _next_number(spark, root, base)
    schemas = [(name, df.schema.json()) for name, df in tables.items()]
    entry = [(version, number, time.time_ns() // 1000, schemas)]
    spark.createDataFrame(entry, _CATALOGUE).coalesce(1).write.mode("error").parquet(
        f"{root}/catalogue/{version}"
    )
    return version


def latest_version(spark: SparkSession, root: str) -> str | None:
    """The newest listed version, or None."""
    last = _latest(spark, root)
    return last["version"] if last else None


def _open(spark: SparkSession, root: str, entry) -> dict[str, DataFrame]:
    return {
        name: spark.read.schema(StructType.fromJson(json.loads(schema))).parquet(
            f"{root}/snapshot={entry['version']}/{name}"
        )
        for name, schema in entry["tables"]
    }


def read_snapshot(spark: SparkSession, root: str, version: str) -> dict[str, DataFrame]:
    """The tables of one listed version."""
    listed = _catalogue(spark, root)
    entry = listed.where(F.col("version") == version).first() if listed is not None else None
    if entry is None:
        raise ValueError(f"no snapshot {version} under {root}")
    return _open(spark, root, entry)


def read_latest(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the newest version."""
    entry = _latest(spark, root)
    if entry is None:
        raise ValueError(f"no snapshot under {root}")
    return _open(spark, root, entry)
