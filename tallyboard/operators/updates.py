"""Keyed updates of stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def apply_updates(
    target: DataFrame, updates: DataFrame, columns: Sequence[str], key: str = "id"
) -> DataFrame:
    """Replace ``columns`` of the target rows whose key is in ``updates``.

    Target rows without an update stay as they are, updates without a target row
    are ignored. The key must be unique in ``updates``.
    """
    changes = updates.select(
        key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_updated")
    )
    joined = target.join(changes, key, "left")
    return joined.select(
        *[
            F.when(F.col("_updated"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c)
            if c in columns
            else F.col(c)
            for c in target.columns
        ]
    )


def changed_values(
    stored: DataFrame, fresh: DataFrame, column: str, key: str = "id", tolerance: float = 1e-9
) -> DataFrame:
    """(key, new value) of the rows whose value differs from the stored one.

    A missing value, or a row that is not stored, differs from any number; two
    numbers differ beyond ``tolerance``.
    """
    old, new = F.col("_old"), F.col(column)
    pairs = fresh.select(key, column).join(
        stored.select(key, F.col(column).alias("_old")), key, "left"
    )
    # Spark takes NaN for equal to itself and larger than any number
    differs = (old.isNull() != new.isNull()) | F.coalesce(
        ~old.eqNullSafe(new) & (F.abs(old - new) > tolerance), F.lit(False)
    )
    return pairs.where(differs).drop("_old")


def changed_weights(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Scores whose weight must be written again."""
    return changed_values(stored, fresh, "weight")
