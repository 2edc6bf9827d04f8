"""What would change under other constants."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_SKEW, RatingConfig, SkewPolicy
from tallyboard.plans.refresh import refresh_all


# columns that are compared
COMPARED = {
    "scores": ("pp", "rank", "weight"),
    "players": ("pp", "rank", "country_rank"),
    "leaderboards": ("total_pp", "percentile"),
}


def _change(column: str) -> Column:
    return (F.col(f"new_{column}") - F.col(f"old_{column}")).alias(f"{column}_delta")


def _compare(old: DataFrame, new: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    before = old.select("id", *[F.col(c).alias(f"old_{c}") for c in columns])
    after = new.select("id", *[F.col(c).alias(f"new_{c}") for c in columns])
    return before.join(after, "id").select("*", *[_change(c) for c in columns])


def what_if_rescore(
    tables: Mapping[str, DataFrame],
    current: Mapping[str, DataFrame],
    config: RatingConfig,
    policy: SkewPolicy = DEFAULT_SKEW,
    only: Sequence[str] = tuple(COMPARED),
    stored: bool = False,
) -> dict[str, DataFrame]:
    """Old value, new value and difference per score, player and leaderboard.

    ``tables`` are the imported tables, ``current`` their refresh under the
    constants in force, ``config`` the constants to try. Tables that ``only`` does
    not name, nor need, are not computed. ``stored`` as in ``refresh_all``.
    """
    trial = refresh_all(tables, config, policy, only, stored=stored)
    return {t: _compare(current[t], trial[t], COMPARED[t]) for t in only}
