"""Series and board statistics from tables stored by player and by board.

Scores and players in equal buckets by player make series without moving a score. What
the statistics need of them, stored by board, makes all thirteen without moving one either:
the shuffles are paid once, when the tables are stored. Hot boards move counts and sums.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_RATING, DEFAULT_SKEW, RatingConfig, SkewPolicy
from tallyboard.operators.boards import basic_statistics, board_statistics, held_scores
from tallyboard.operators.ranking import HotGroups
from tallyboard.plans.series import score_series
from tallyboard.sources.buckets import Bucketed, bucket_count, join_parts, open_table, write_table


@dataclass(frozen=True)
class Layout:
    """Scores and players by player, and the held scores by board."""

    scores: Bucketed
    players: Bucketed
    held: Bucketed


def store(
    tables: Mapping[str, DataFrame],
    root: str,
    config: RatingConfig = DEFAULT_RATING,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> Layout:
    """Store refreshed tables, which are themselves stored, under ``root``.

    One shuffle of the scores by player, and one of seven narrow columns by board.
    """
    scores, players = tables["scores"], tables["players"]
    rows = scores.count()
    buckets = bucket_count(scores.sparkSession, rows)
    by_player = write_table(scores, f"{root}/scores", "player_id", buckets, policy, rows)
    people = write_table(players, f"{root}/players", "id", buckets, policy, rows=0)
    held = join_parts(by_player, people, lambda s, p: held_scores(s, p, config), policy)
    held = held.withColumn("top_player", F.coalesce("top_player", F.lit(False)))
    boards = write_table(held, f"{root}/held", "leaderboard_id", buckets, policy, rows)
    return Layout(by_player, people, boards)


def open_layout(spark: SparkSession, root: str) -> Layout:
    return Layout(*[open_table(spark, f"{root}/{name}") for name in ("scores", "players", "held")])


def stored_series(layout: Layout, policy: SkewPolicy = DEFAULT_SKEW) -> DataFrame:
    """``series.score_series`` of all boards."""
    return join_parts(layout.scores, layout.players, score_series, policy)


def stored_board_stats(
    layout: Layout, config: RatingConfig = DEFAULT_RATING, literal: bool = False
) -> DataFrame:
    """``boards.board_stats``."""
    usual = basic_statistics(layout.held.usual, config, literal)
    if layout.held.hot is None:
        return usual
    return usual.unionByName(basic_statistics(layout.held.hot, config, literal))


def stored_board_statistics(
    layout: Layout,
    config: RatingConfig = DEFAULT_RATING,
    policy: SkewPolicy = DEFAULT_SKEW,
    literal: bool = False,
) -> DataFrame:
    """``boards.board_statistics``, all thirteen."""
    held = layout.held
    usual = board_statistics(held.usual, config, HotGroups(), policy, literal)
    if held.hot is None:
        return usual
    hot = board_statistics(held.hot, config, held.hot_keys, policy, literal, all_hot=True)
    return usual.unionByName(hot)
