"""Positions inside groups, also when one group holds a large part of all rows.

A window over a group sorts the whole group in one task. That is the right plan
for the usual group, and the wrong one for a board or player with a third of all
scores. So the group sizes are looked at first (one aggregate over the key
columns, combined before the shuffle), and only the groups above
``SkewPolicy.hot_rows`` take a second way:

1. their rows are range-partitioned and sorted by (group, order), and written to
   the scratch folder together with their range and their place in it;
2. the rows of earlier ranges of the same group are added to the place, from a
   table with one row per (group, range). The rows are not shuffled again, unless
   running counts are asked for, which take a window per range.

Both ways give the same numbers. The order must be total (end it with an id):
then ties cannot pile up in one range either.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_SKEW, SkewPolicy
from tallyboard.session import SORTED, materialise, shuffle_partitions

RANGE, PLACE = "_range", "_place_in_range"


@dataclass(frozen=True)
class HotGroups:
    """The groups too large for one task. ``keys`` is None when there are none."""

    rows: int = 0
    groups: int = 0
    keys: DataFrame | None = None


def find_hot_groups(
    df: DataFrame,
    by: Sequence[str],
    policy: SkewPolicy = DEFAULT_SKEW,
    rows: int | None = None,
) -> HotGroups:
    """Groups of ``df`` with more than ``policy.hot_rows`` rows.

    Reads the key columns only, and brings back one row. The result also serves
    any subset of ``df``, whose groups can only be smaller. ``rows`` is the size
    of ``df`` where the caller knows it: a table that small has no hot group.
    """
    if rows is None and not by:
        rows = df.count()
    if rows is not None and rows <= policy.hot_rows:
        return HotGroups()
    if not by:
        return HotGroups(rows, 1)
    sizes = df.groupBy(*by).agg(F.count("*").alias("_rows"))
    hot = sizes.where(F.col("_rows") > policy.hot_rows)
    if rows is not None:
        # known to be large: store the finding, so the table is read only once
        hot = materialise(hot, "hot-groups")
    found = hot.agg(F.count("*").alias("groups"), F.sum("_rows").alias("rows")).first()
    if found["groups"] == 0:
        return HotGroups()
    if rows is None:
        hot = materialise(hot, "hot-groups")
    return HotGroups(found["rows"], found["groups"], hot.select(*by))


def with_position(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    position: str,
    running: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    highest: Mapping[str, str] | None = None,
    hot: HotGroups | None = None,
    policy: SkewPolicy = DEFAULT_SKEW,
    all_hot: bool = False,
) -> DataFrame:
    """Number the rows of each group from 1 in a total ``order``.

    ``running`` names conditions counted up to and including the row, ``totals``
    names conditions counted over the whole group, ``highest`` names columns whose
    maximum in the group is added. An empty ``by`` is one group.

    With hot groups ``df`` is read once for them and once for the others; store it
    first where computing it takes more than a scan. ``all_hot`` says that there are no
    others, because ``split_hot`` took them apart already.
    """
    extra = (dict(running or {}), dict(totals or {}), dict(highest or {}))
    if hot is None:
        hot = find_hot_groups(df, by, policy)
    if hot.groups == 0:
        return _in_one_window(df, by, order, position, *extra)
    if all_hot or not by:
        return _in_ranges(df, by, order, position, *extra, hot, policy)
    usual, large = split_hot(df, by, hot, policy)
    return _in_one_window(usual, by, order, position, *extra).unionByName(
        _in_ranges(large, by, order, position, *extra, hot, policy)
    )


def split_hot(
    df: DataFrame, by: Sequence[str], hot: HotGroups, policy: SkewPolicy = DEFAULT_SKEW
) -> tuple[DataFrame, DataFrame]:
    """The rows of usual groups and those of hot ones."""
    keys = hot.keys.select(*[F.col(c).alias(f"_key_{c}") for c in by])
    if hot.groups <= policy.broadcast_rows:
        keys = F.broadcast(keys)
    return df.join(keys, _same(by), "left_anti"), df.join(keys, _same(by), "left_semi")


def _same(columns: Sequence[str]) -> Column:
    """Join condition on the copies of ``columns`` named ``_key_``; null equals null."""
    return reduce(
        lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in columns]
    )


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0))


def _in_one_window(df, by, order, position, running, totals, highest) -> DataFrame:
    ordered = Window.partitionBy(*by).orderBy(*order)
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # in the same order, so that one operator holds the rows of a group for all of these
    group = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.select(
        "*",
        F.row_number().over(ordered).cast("bigint").alias(position),
        *[_count(c).over(so_far).alias(n) for n, c in running.items()],
        *[_count(c).over(group).alias(n) for n, c in totals.items()],
        *[F.max(c).over(group).alias(n) for n, c in highest.items()],
    )


def range_count(spark: SparkSession, rows: int, policy: SkewPolicy = DEFAULT_SKEW) -> int:
    """Ranges of about ``chunk_rows`` rows, but no more than a shuffle of so many rows needs.

    Every range is sampled on the driver, and every task reports the size of each to it.
    Beyond that number the ranges grow instead, and are still sorted in memory.
    """
    wanted = math.ceil(rows / policy.chunk_rows)
    most = shuffle_partitions(rows * SORTED, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(2, min(wanted, most))


def _in_ranges(df, by, order, position, running, totals, highest, hot, policy) -> DataFrame:
    ranges = range_count(df.sparkSession, hot.rows, policy)
    spread = (
        df.repartitionByRange(ranges, *by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn(RANGE, F.spark_partition_id())
        # rows of a partition are numbered in the lower 33 bits
        .withColumn(PLACE, F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)))
    )
    # once written, range and place are plain values that no retry can change
    spread = materialise(spread, "ranges")

    # at most one row per range and one more per group
    sizes = spread.groupBy(*by, RANGE).agg(
        F.count("*").alias("_rows"),
        F.min(PLACE).alias("_first"),
        *[_count(c).alias(f"_run_{n}") for n, c in running.items()],
        *[_count(c).alias(f"_all_{n}") for n, c in totals.items()],
        *[F.max(c).alias(f"_max_{n}") for n, c in highest.items()],
    )
    group = Window.partitionBy(*by)
    earlier = group.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)

    def before(column: str) -> Column:
        return F.coalesce(F.sum(column).over(earlier), F.lit(0))

    offsets = sizes.select(
        *[F.col(c).alias(f"_key_{c}") for c in [*by, RANGE]],
        (before("_rows") - F.col("_first") + 1).alias("_shift"),
        *[before(f"_run_{n}").alias(f"_run_{n}") for n in running],
        *[F.sum(f"_all_{n}").over(group).alias(f"_all_{n}") for n in totals],
        *[F.max(f"_max_{n}").over(group).alias(f"_max_{n}") for n in highest],
    )
    if ranges + hot.groups <= policy.broadcast_rows:
        offsets = F.broadcast(offsets)

    if running:
        # the place needs no further work, a running count does: a window per range
        so_far = Window.partitionBy(*by, RANGE).orderBy(PLACE)
        so_far = so_far.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        spread = spread.select("*", *[_count(c).over(so_far).alias(n) for n, c in running.items()])
    joined = spread.join(offsets, _same([*by, RANGE]))
    return joined.select(
        *df.columns,
        (F.col(PLACE) + F.col("_shift")).alias(position),
        *[(F.col(n) + F.col(f"_run_{n}")).alias(n) for n in running],
        *[F.col(f"_all_{n}").alias(n) for n in totals],
        *[F.col(f"_max_{n}").alias(n) for n in highest],
    )
