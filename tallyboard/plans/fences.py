"""Pages far down a listing, read between two fences.

A fence is the first row of a page: its sort key and id. The fences of a listing are made
once per sort order, next to the published tables, and are a fiftieth of its rows or fewer.
A page is then the rows from its fence up to the next one, a filter on the sort column that
goes down to the scan; no task keeps more than a page, however far down it lies.

Orders end in the id. As in ``orderBy``, nulls come first when ascending and last when
descending.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_SKEW, SkewPolicy
from tallyboard.operators.ranking import with_position


def _order(column: str, descending: bool) -> list[Column]:
    return [F.desc(column) if descending else F.asc(column), F.asc("id")]


def fences(
    df: DataFrame,
    column: str,
    descending: bool,
    size: int,
    by: Sequence[str] = (),
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """(by, page, key, id): the first row of every page, of one listing or of one per ``by``."""
    narrow = df.select(*by, F.col(column).alias("key"), "id")
    placed = with_position(narrow, by, _order("key", descending), "place", policy=policy)
    before = F.col("place") - 1
    return placed.where(before % size == 0).select(
        *by, (F.floor(before / size) + 1).alias("page"), "key", "id"
    )


def _from(column: str, descending: bool, key, identity, inclusive: bool) -> Column:
    """Rows at (if inclusive) or after a key and id."""
    value = F.col(column)
    later = F.col("id") >= F.lit(identity) if inclusive else F.col("id") > F.lit(identity)
    tied = value.eqNullSafe(F.lit(key)) & later
    if key is None:
        return tied if descending else tied | value.isNotNull()
    if descending:
        return (value < F.lit(key)) | value.isNull() | tied
    return (value > F.lit(key)) | tied


def rows_after(df: DataFrame, column: str, descending: bool, key, identity, size: int) -> DataFrame:
    """The next rows of a listing after one that was shown."""
    rows = df.where(_from(column, descending, key, identity, False))
    return rows.orderBy(*_order(column, descending)).limit(size)


def fenced_page(
    df: DataFrame, marks: DataFrame, column: str, descending: bool, number: int, size: int
) -> DataFrame:
    """Page ``number`` (from 1) of ``df``; ``marks`` are its fences. No such page is empty."""
    number = max(number, 1)
    # two rows at most
    found = {r.page: r for r in marks.where(F.col("page").isin(number, number + 1)).collect()}
    if number not in found:
        return df.limit(0)
    start, end = found[number], found.get(number + 1)
    rows = df.where(_from(column, descending, start.key, start.id, True))
    if end is not None:
        rows = rows.where(~F.coalesce(_from(column, descending, end.key, end.id, True), F.lit(False)))
    return rows.orderBy(*_order(column, descending)).limit(size)


def last_page(marks: DataFrame) -> int:
    """The number of pages of one listing."""
    return marks.agg(F.max("page")).first()[0] or 0
