"""Weighted totals and ranks of players."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_RATING, DEFAULT_SKEW, RatingConfig, SkewPolicy
from tallyboard.functions.numbers import tie_key
from tallyboard.operators.ranking import HotGroups, find_hot_groups, with_position
from tallyboard.session import materialise

# Rows without a country are not ranked; they are spread over this many groups so
# that they do not all meet in one.
_UNRANKED_GROUPS = 4096


def player_totals(weighted: DataFrame) -> DataFrame:
    """Weighted points, best score and play count per player.

    After ``score_weights`` the rows of a player are together already, so this
    adds no shuffle to the usual plan.
    """

    def weighted_sum(column: str) -> Column:
        return F.sum(F.col(column) * F.col("weight")).alias(column)

    return weighted.groupBy("player_id").agg(
        *[weighted_sum(c) for c in ("pp", "acc_pp", "tech_pp", "pass_pp")],
        F.max("pp").alias("top_pp"),
        F.count("*").alias("ranked_play_count"),
    )


def player_ranks(
    totals: DataFrame,
    players: DataFrame,
    config: RatingConfig = DEFAULT_RATING,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Add the country, the global rank and the rank inside the country (0 without one).

    Totals of unknown players are left out, so the number of players bounds the
    rows of the global window. Above ``policy.hot_rows`` the rows are stored first:
    then they are read several times.
    """
    known = players.count()
    countries = players.select(F.col("id").alias("player_id"), "country")
    located = totals.join(countries, "player_id")
    if known > policy.hot_rows:
        located = materialise(located, "located-players")
    hot_countries = find_hot_countries(players, policy, known)

    order = [tie_key(F.col("pp"), config.tie_decimals).desc(), F.col("player_id").asc()]
    everyone = find_hot_groups(located, [], policy, known)
    ranked = with_position(located, [], order, "rank", hot=everyone, policy=policy)
    ranked = ranked.withColumn("_spread", spread_unranked())
    if hot_countries.groups:
        ranked = materialise(ranked, "ranked-players")
    placed = with_position(
        ranked,
        COUNTRY_GROUP,
        [F.col("rank").asc()],
        "country_rank",
        hot=hot_countries,
        policy=policy,
    )
    return placed.withColumn("country_rank", ranked_at_home("country_rank")).drop("_spread")


COUNTRY_GROUP = ["country", "_spread"]


def spread_unranked() -> Column:
    """The second part of ``COUNTRY_GROUP``: 0 for players with a country."""
    return F.when(
        F.col("country").isNull(), F.pmod(F.xxhash64("player_id"), F.lit(_UNRANKED_GROUPS))
    ).otherwise(F.lit(0))


def find_hot_countries(players: DataFrame, policy: SkewPolicy, known: int) -> HotGroups:
    """Hot groups of ``COUNTRY_GROUP`` among all players, of whom the ranked ones are a part."""
    named = players.where("country is not null")
    hot = find_hot_groups(named, ["country"], policy, known)
    if not hot.groups:
        return hot
    keys = hot.keys.withColumn("_spread", F.lit(0).cast("bigint"))
    return HotGroups(hot.rows, hot.groups, keys)


def ranked_at_home(place: str) -> Column:
    """The place in the country, 0 without one."""
    placed = F.when(F.col("country").isNull(), F.lit(0)).otherwise(F.col(place))
    return placed.cast("bigint")
