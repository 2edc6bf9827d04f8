"""Podium points: five, three and one for the first three places of a board."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.functions.points import score_for_rank


def podium_points(ranked: DataFrame) -> DataFrame:
    """Podium points and places per player, over all boards."""
    return ranked.groupBy("player_id").agg(
        F.sum(score_for_rank(F.col("rank"))).cast("bigint").alias("points"),
        F.count_if(F.col("rank").between(1, 3)).alias("podiums"),
    )


def podium_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Points each player won or lost between two rankings of the scores.

    A score missing from one side adds nothing there. Each side gives its points to
    its own player, so no join is needed, and both are combined before the shuffle.
    """
    before = old.select("player_id", (-score_for_rank(F.col("rank"))).alias("change"))
    after = new.select("player_id", score_for_rank(F.col("rank")).alias("change"))
    return (
        before.unionByName(after)
        .groupBy("player_id")
        .agg(F.sum("change").cast("bigint").alias("delta"))
    )
