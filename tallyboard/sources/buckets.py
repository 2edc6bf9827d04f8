"""Stored tables dealt into buckets by a key: joins and groupings by the key move no rows.

The rows of ordinary keys are a bucketed table with one file per bucket, so two tables
with as many buckets join bucket by bucket. A join of buckets cannot be split, so the rows
of keys above ``SkewPolicy.hot_rows`` are kept beside them, in ranges of (key, id): what
they are joined with, one row per hot key, is broadcast behind a count. Nothing is left out.

The catalogue of a session knows a bucketed table by its definition only. ``open_table``
writes that definition again from the stored one, so a folder outlives the session.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyboard.config import DEFAULT_SKEW, SkewPolicy
from tallyboard.operators.ranking import HotGroups, find_hot_groups
from tallyboard.session import shuffle_partitions

# Spark refuses more than 100,000 buckets; beyond this they grow instead.
MAX_BUCKETS = 2**16

_SPEC = "key string, buckets long, schema string, hot_rows long, hot_groups long"


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets of about one shuffle partition, a power of two, so that tables which grow
    apart still have numbers that divide each other."""
    wanted = shuffle_partitions(rows, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(1 << (wanted - 1).bit_length(), MAX_BUCKETS)


@dataclass(frozen=True)
class Bucketed:
    """A stored table: its bucketed rows, and those of its hot keys or None."""

    key: str
    buckets: int
    usual: DataFrame
    hot: DataFrame | None
    hot_keys: HotGroups

    def all_rows(self) -> DataFrame:
        return self.usual if self.hot is None else self.usual.unionByName(self.hot)


def _hot_keys(keys: HotGroups, key: str, policy: SkewPolicy) -> DataFrame:
    named = keys.keys.select(F.col(key).alias("_hot_key"))
    return F.broadcast(named) if keys.groups <= policy.broadcast_rows else named


def write_table(
    df: DataFrame,
    path: str,
    key: str,
    buckets: int,
    policy: SkewPolicy = DEFAULT_SKEW,
    rows: int | None = None,
) -> Bucketed:
    """Store ``df``, which has an ``id``, by ``key`` under ``path``: one shuffle.

    ``df`` is read for the sizes of its keys, unless ``rows`` shows that none can be hot, and
    once for the buckets and once for hot rows, so it should be a stored table.
    """
    spark = df.sparkSession
    keys = find_hot_groups(df, [key], policy, rows)
    usual = df
    if keys.groups:
        hot = _hot_keys(keys, key, policy)
        is_hot = F.col(key).eqNullSafe(F.col("_hot_key"))
        usual = df.join(hot, is_hot, "left_anti")
        keys.keys.write.mode("error").parquet(f"{path}/hot_keys")
        df.join(hot, is_hot, "left_semi").repartitionByRange(key, "id").sortWithinPartitions(
            key, "id"
        ).write.mode("error").parquet(f"{path}/hot")
    dealt = usual.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    dealt.mode("error").format("parquet").option("path", f"{path}/usual").saveAsTable(_name(path))
    spec = [(key, buckets, df.schema.json(), keys.rows, keys.groups)]
    spark.createDataFrame(spec, _SPEC).coalesce(1).write.mode("error").parquet(f"{path}/spec")
    return open_table(spark, path)


def open_table(spark: SparkSession, path: str) -> Bucketed:
    """A table that this or another session stored under ``path``."""
    spec = spark.read.schema(_SPEC).parquet(f"{path}/spec").first()
    schema = StructType.fromJson(json.loads(spec["schema"]))
    key, name = spec["key"], _name(path)
    if not spark.catalog.tableExists(name):
        location = f"{path}/usual".replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({schema.toDDL()}) USING parquet CLUSTERED BY (`{key}`) "
            f"SORTED BY (`{key}`) INTO {spec['buckets']} BUCKETS LOCATION '{location}'"
        )
    hot, keys = None, HotGroups()
    if spec["hot_groups"]:
        hot = spark.read.schema(schema).parquet(f"{path}/hot")
        held = spark.read.schema(StructType([schema[key]])).parquet(f"{path}/hot_keys")
        keys = HotGroups(spec["hot_rows"], spec["hot_groups"], held)
    return Bucketed(key, spec["buckets"], spark.table(name), hot, keys)


def _name(path: str) -> str:
    return f"bucketed_{hashlib.sha256(path.encode()).hexdigest()[:32]}"


def join_parts(
    many: Bucketed,
    one: Bucketed,
    join: Callable[[DataFrame, DataFrame], DataFrame],
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """``join`` of the rows of two tables whose keys can be equal.

    ``one`` has each key once. Buckets meet buckets; the hot rows of ``many`` stay where they
    are and meet the rows of ``one`` that hold a hot key.
    """
    met = join(many.usual, one.all_rows())
    if many.hot is None:
        return met
    keys = _hot_keys(many.hot_keys, many.key, policy)
    few = one.all_rows().join(keys, F.col(one.key) == F.col("_hot_key"), "left_semi")
    if many.hot_keys.groups <= policy.broadcast_rows:
        few = F.broadcast(few)
    return met.unionByName(join(many.hot, few))
