"""Dump tables to stored tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_RATING, RatingConfig
from tallyboard.functions.rating import to_stars
from tallyboard.schema import (
    BOARD_COMPUTED,
    PLAYER_COMPUTED,
    RATING_FIELDS,
    SCORE_COMPUTED,
    STORED_FAMILIES,
)


def _zeros(columns: Mapping[str, str]) -> list[Column]:
    return [F.lit(0).cast(kind).alias(name) for name, kind in columns.items()]


def stored_families(ratings: Column) -> Column:
    """Only the families that are stored; null stays null."""
    families = [ratings[code].alias(code) for code in STORED_FAMILIES]
    return F.when(ratings.isNotNull(), F.struct(*families))


def import_leaderboards(maps: DataFrame, config: RatingConfig = DEFAULT_RATING) -> DataFrame:
    """Maps become leaderboards: missing ratings are 0, stars are computed."""

    def rating(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0))

    stars = to_stars(rating("acc_rating"), rating("pass_rating"), rating("tech_rating"), config)
    return maps.select(
        "id",
        "name",
        "hash",
        "song_id",
        "mode_name",
        "difficulty_name",
        F.col("cover_image").alias("cover"),
        "mapper",
        stars.alias("stars"),
        *[
            rating(c).alias(c)
            for c in ("pass_rating", "acc_rating", "tech_rating", "predicted_acc")
        ],
        stored_families(F.col("modifiers_rating")).alias("modifiers_rating"),
        *_zeros(BOARD_COMPUTED),
    )


def import_players(players: DataFrame) -> DataFrame:
    return players.select("id", "name", "country", "avatar", *_zeros(PLAYER_COMPUTED))


def import_scores(scores: DataFrame) -> DataFrame:
    return scores.select(
        "id",
        "timepost",
        "player_id",
        "leaderboard_id",
        "accuracy",
        "modifiers",
        "fc",
        "fc_acc",
        *_zeros(SCORE_COMPUTED),
    )


def import_dump(
    dump: Mapping[str, DataFrame], config: RatingConfig = DEFAULT_RATING
) -> dict[str, DataFrame]:
    """All three stored tables of a dump."""
    return {
        "players": import_players(dump["players"]),
        "scores": import_scores(dump["scores"]),
        "leaderboards": import_leaderboards(dump["maps"], config),
    }


def modifier_ratings_long(boards: DataFrame) -> DataFrame:
    """(leaderboard_id, code, five ratings): one row per board and speed code."""
    rows = [
        F.struct(
            F.lit(code).alias("code"),
            *[F.col("modifiers_rating")[code][field].alias(field) for field in RATING_FIELDS],
        )
        for code in STORED_FAMILIES
    ]
    return boards.where("modifiers_rating is not null").select(
        F.col("id").alias("leaderboard_id"), F.inline(F.array(*rows))
    )
