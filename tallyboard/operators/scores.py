"""Points, ranks and weights of single scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_RATING, DEFAULT_SKEW, RatingConfig, SkewPolicy
from tallyboard.functions.numbers import tie_key
from tallyboard.functions.points import decay_weight
from tallyboard.functions.rating import with_points
from tallyboard.operators.ranking import HotGroups, with_position

POINT_COLUMNS = ("pp", "bonus_pp", "pass_pp", "acc_pp", "tech_pp")
HOLDER_COLUMNS = ("top_pp", "ranked_play_count")
RATING_COLUMNS = ("acc_rating", "pass_rating", "tech_rating", "modifiers_rating")


def score_pp(
    scores: DataFrame,
    boards: DataFrame,
    config: RatingConfig = DEFAULT_RATING,
    few_boards: bool = False,
) -> DataFrame:
    """Scores with freshly computed points, from the ratings of their board.

    Only the rating columns of the boards take part in the join. ``few_boards``
    says that their number was checked, and broadcasts them; otherwise Catalyst
    and AQE choose. A score whose board does not exist stays, without points;
    ``orphan_scores`` reports it.
    """
    joined = with_ratings(scores.drop(*POINT_COLUMNS), boards, few_boards)
    return with_points(joined, config).drop(*RATING_COLUMNS)


def with_ratings(scores: DataFrame, boards: DataFrame, few_boards: bool = False) -> DataFrame:
    """Scores with the rating columns of their board."""
    ratings = boards.select(F.col("id").alias("leaderboard_id"), *RATING_COLUMNS)
    if few_boards:
        ratings = F.broadcast(ratings)
    return scores.join(ratings, "leaderboard_id", "left")


def score_ranks(
    scored: DataFrame,
    config: RatingConfig = DEFAULT_RATING,
    hot: HotGroups | None = None,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Rank inside the board: rounded points, then rounded accuracy, then id."""
    return with_position(
        scored.drop("rank"), ["leaderboard_id"], rank_order(config), "rank", hot=hot, policy=policy
    )


def rank_order(config: RatingConfig = DEFAULT_RATING, points: str = "pp") -> list[Column]:
    """How the scores of a board are ordered."""
    return [
        tie_key(F.col(points), config.rank_pp_decimals).desc(),
        tie_key(F.col("accuracy"), config.rank_accuracy_decimals).desc(),
        F.col("id").asc(),
    ]


def weight_order(
    config: RatingConfig = DEFAULT_RATING, points: str = "pp", key: str = "id"
) -> list[Column]:
    """How a player's scores are ordered, and players themselves by ``key``."""
    return [tie_key(F.col(points), config.tie_decimals).desc(), F.col(key).asc()]


def score_weights(
    scored: DataFrame,
    config: RatingConfig = DEFAULT_RATING,
    hot: HotGroups | None = None,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Weight by place among the player's own scores: the best one counts fully."""
    return score_weights_and_holders(scored, config, hot, policy).drop(*HOLDER_COLUMNS)


def score_weights_and_holders(
    scored: DataFrame,
    config: RatingConfig = DEFAULT_RATING,
    hot: HotGroups | None = None,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """``score_weights`` plus the player's best points and number of plays.

    Both come from the window that places the scores, so board statistics need no
    join of all scores with all players for them.
    """
    placed = with_position(
        scored.drop("weight"),
        ["player_id"],
        weight_order(config),
        "_place",
        totals={"ranked_play_count": F.lit(True)},
        highest={"top_pp": "pp"},
        hot=hot,
        policy=policy,
    )
    weight = decay_weight(F.col("_place") - 1, config.decay)
    return placed.withColumn("weight", weight).drop("_place")


def modifier_usage(scored: DataFrame) -> DataFrame:
    """Scores and mean points per modifier code.

    The texts are few, so they are grouped before they are split into codes.
    """
    texts = scored.groupBy("modifiers").agg(F.count("*").alias("n"), F.sum("pp").alias("points"))
    codes = texts.where(F.length("modifiers") > 0).select(
        F.explode(F.split("modifiers", ",")).alias("code"), "n", "points"
    )
    return codes.groupBy("code").agg(
        F.sum("n").alias("scores"), (F.sum("points") / F.sum("n")).alias("avg_pp")
    )


def modifier_table_diff(
    scores: DataFrame, old: Mapping[str, float], new: Mapping[str, float]
) -> DataFrame:
    """Two multiplier tables side by side, with the scores each code applies to.

    (code, old_value, new_value, same, scores); a code missing from a table has a
    null value there and is not the same. Codes are looked for in the few distinct
    texts, which are counted first.
    """
    codes = list(dict.fromkeys([*old, *new]))
    entries = F.array(
        *[
            F.struct(
                F.lit(code).alias("code"),
                F.lit(old.get(code)).cast("double").alias("old_value"),
                F.lit(new.get(code)).cast("double").alias("new_value"),
            )
            for code in codes
        ]
    )
    texts = scores.groupBy("modifiers").agg(F.count("*").alias("n"))
    applied = F.when(F.col("modifiers").contains(F.col("code")), F.col("n")).otherwise(F.lit(0))
    return (
        texts.select("modifiers", "n", F.inline(entries))
        .groupBy("code", "old_value", "new_value")
        .agg(F.sum(applied).alias("scores"))
        .withColumn(
            "same", F.coalesce(F.col("old_value") == F.col("new_value"), F.lit(False))
        )
    )
