"""Many trial configurations in one pass over the scores.

Each configuration has own columns (``pp_0``, ``rank_0``, ``weight_0``, ...) in the same rows.
The scores are scanned once and shuffled once by board, once by player and once more by board
for the statistics, however many configurations there are: what every configuration adds is a
sort of partitions that are in place already. Ratings join after the shuffle by board, anew for
each configuration, so that neither shuffles nor sorts carry them. The points of a configuration
are computed between two windows, each in a generated method of its own (see ``with_points``).
Configurations that differ only in the decay have the same points and ranks, which are
computed, moved and stored once for them.

Hot boards, players and countries are taken apart once and ranked by ranges. That takes a
shuffle for each configuration, as each has an order of its own. A task sorts its rows once
for each configuration, so groups count as hot, and partitions as full, at so many times
fewer rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_SKEW, RatingConfig, SkewPolicy
from tallyboard.functions.points import decay_weight
from tallyboard.functions.rating import with_points
from tallyboard.operators.boards import board_statistics
from tallyboard.operators.players import (
    COUNTRY_GROUP,
    find_hot_countries,
    ranked_at_home,
    spread_unranked,
)
from tallyboard.operators.ranking import HotGroups, find_hot_groups, split_hot, with_position
from tallyboard.operators.scores import (
    POINT_COLUMNS,
    RATING_COLUMNS,
    rank_order,
    weight_order,
    with_ratings,
)
from tallyboard.plans.rescore import COMPARED
from tallyboard.session import SORTED, materialise, sized_shuffles

Place = Callable[[DataFrame, HotGroups, bool], DataFrame]


def _fewer(policy: SkewPolicy, times: int) -> SkewPolicy:
    """For tasks that sort their rows so many times."""
    return replace(policy, hot_rows=max(1, policy.hot_rows // times))


def alike(configs: Sequence[RatingConfig], columns: Sequence[str] = ()) -> list[int]:
    """For each configuration the first one with the same points and order of scores; itself
    where ``columns`` has points of its own."""
    settings = [replace(config, decay=0.0) for config in configs]
    firsts = [settings.index(setting) for setting in settings]
    return [k if f"pp_{k}" in columns else first for k, first in enumerate(firsts)]


def _shared(configs: Sequence[RatingConfig], boards: DataFrame) -> list[int]:
    """``alike``, unless boards of one id may rate a score otherwise for each configuration."""
    same, own = alike(configs), list(range(len(configs)))
    if same == own:
        return own
    repeated = boards.where("id is not null").groupBy("id").count().where("count > 1")
    return same if repeated.isEmpty() else own


def _apart(
    df: DataFrame, by: Sequence[str], hot: HotGroups, policy: SkewPolicy, place: Place
) -> DataFrame:
    """``place`` on the rows of usual groups and on those of hot ones, split only once."""
    if not hot.groups:
        return place(df, HotGroups(), False)
    usual, large = split_hot(df, by, hot, policy)
    return place(usual, HotGroups(), False).unionByName(place(large, hot, True))


def sweep_scores(
    scores: DataFrame,
    boards: DataFrame,
    configs: Sequence[RatingConfig],
    policy: SkewPolicy = DEFAULT_SKEW,
    rows: int | None = None,
) -> DataFrame:
    """Points, rank in the board, weight and the player's best points, per configuration.

    (id, leaderboard_id, player_id, plays and per configuration k weight_k, pp_k, rank_k and
    top_pp_k; the last three only of the first of those that are ``alike``, if no two boards
    have one id). ``rows`` as in ``refresh_scores``.
    """
    same = _shared(configs, boards)
    rows = scores.count() if rows is None else rows
    policy = _fewer(policy, len(configs))
    hot_boards = find_hot_groups(scores, ["leaderboard_id"], policy, rows)
    hot_players = find_hot_groups(scores, ["player_id"], policy, rows)
    few_boards = boards.count() <= policy.broadcast_rows

    def ranks(df: DataFrame, hot: HotGroups, all_hot: bool) -> DataFrame:
        rated, few = boards, few_boards
        if all_hot:
            keys = hot.keys.select(F.col("leaderboard_id").alias("id"))
            rated, few = boards.join(keys, "id", "left_semi"), hot.groups <= policy.broadcast_rows
        else:
            df = df.repartition("leaderboard_id")
        if not few:
            # a table of boards that compresses well looks small enough to broadcast
            rated = rated.hint("shuffle_hash")
        unused = [c for c in POINT_COLUMNS if c != "pp"]
        for k, config in enumerate(configs):
            if same[k] != k:
                continue
            df = with_points(with_ratings(df, rated, few), config)
            df = df.drop(*RATING_COLUMNS, *unused).withColumnRenamed("pp", f"pp_{k}")
            df = with_position(
                df,
                ["leaderboard_id"],
                rank_order(config, f"pp_{k}"),
                f"rank_{k}",
                hot=hot,
                policy=policy,
                all_hot=all_hot,
            )
        return df.drop("accuracy", "modifiers")

    def weights(df: DataFrame, hot: HotGroups, all_hot: bool) -> DataFrame:
        for k, config in enumerate(configs):
            df = with_position(
                df,
                ["player_id"],
                weight_order(config, f"pp_{same[k]}"),
                "_place",
                totals={} if k else {"plays": F.lit(True)},
                highest={f"top_pp_{k}": f"pp_{k}"} if same[k] == k else {},
                hot=hot,
                policy=policy,
                all_hot=all_hot,
            )
            weight = decay_weight(F.col("_place") - 1, config.decay)
            df = df.withColumn(f"weight_{k}", weight).drop("_place")
        return df

    narrow = scores.select("id", "leaderboard_id", "player_id", "accuracy", "modifiers")
    ranked = _apart(narrow, ["leaderboard_id"], hot_boards, policy, ranks)
    if hot_players.groups:
        # usual and hot players are placed separately: do not rank twice for that
        ranked = materialise(ranked, "sweep-ranked")
    return _apart(ranked, ["player_id"], hot_players, policy, weights)


def sweep_players(
    swept: DataFrame,
    players: DataFrame,
    configs: Sequence[RatingConfig],
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """Total, rank and country rank of the players with scores, per configuration.

    ``swept`` are the scores of ``sweep_scores``, stored.
    """
    totals = swept.groupBy(F.col("player_id").alias("id")).agg(
        *[
            F.sum(F.col(f"pp_{first}") * F.col(f"weight_{k}")).alias(f"pp_{k}")
            for k, first in enumerate(alike(configs, swept.columns))
        ]
    )
    known = players.count()
    policy = _fewer(policy, len(configs))
    # all players would meet in one task; ranges move little beside the scores
    ranged = _fewer(policy, SORTED)
    located = totals.join(players.select("id", "country"), "id")
    located = located.withColumnRenamed("id", "player_id")
    everyone = HotGroups()
    if known > ranged.hot_rows:
        located = materialise(located, "sweep-located")
        everyone = find_hot_groups(located, [], ranged, known)
    for k, config in enumerate(configs):
        order = weight_order(config, f"pp_{k}", "player_id")
        located = with_position(located, [], order, f"rank_{k}", hot=everyone, policy=policy)
    located = located.withColumn("_spread", spread_unranked())
    hot_countries = find_hot_countries(players, policy, known)
    if hot_countries.groups:
        located = materialise(located, "sweep-players")

    def at_home(df: DataFrame, hot: HotGroups, all_hot: bool) -> DataFrame:
        for k in range(len(configs)):
            place = f"country_rank_{k}"
            order = [F.col(f"rank_{k}").asc()]
            df = with_position(
                df, COUNTRY_GROUP, order, place, hot=hot, policy=policy, all_hot=all_hot
            )
            df = df.withColumn(place, ranked_at_home(place))
        return df

    placed = _apart(located, COUNTRY_GROUP, hot_countries, policy, at_home)
    return placed.drop("_spread", "country").withColumnRenamed("player_id", "id")


def sweep_boards(
    swept: DataFrame,
    configs: Sequence[RatingConfig],
    policy: SkewPolicy = DEFAULT_SKEW,
    rows: int | None = None,
) -> DataFrame:
    """Total points and mean weight of the heaviest third per board and configuration."""
    rows = swept.count() if rows is None else rows
    policy = _fewer(policy, len(configs))
    hot = find_hot_groups(swept, ["leaderboard_id"], policy, rows)
    same = alike(configs, swept.columns)
    held = swept.select(
        "id",
        "leaderboard_id",
        "plays",
        *[f"weight_{k}" for k in range(len(configs))],
        *[f"{c}_{k}" for k in sorted(set(same)) for c in ("pp", "top_pp")],
    )

    def by_place(df: DataFrame) -> DataFrame:
        sums, means = [], []
        for k, config in enumerate(configs):
            weight, eligible = F.col(f"weight_{k}"), F.col(f"top_pp_{same[k]}") != 0
            df = with_position(
                df,
                ["leaderboard_id"],
                [eligible.desc(), weight.desc(), F.col("id").asc()],
                f"_place_{k}",
                totals={f"_eligible_{k}": eligible},
                hot=HotGroups(),
            )
            cut = (F.col(f"_eligible_{k}") * config.top_share).cast("bigint")
            top = eligible & (F.col(f"_place_{k}") <= cut)
            mean = F.when(
                F.count_if(top) > config.min_top_rows, F.avg(F.when(top, weight))
            ).otherwise(F.lit(0.0))
            sums.append(F.sum(F.col(f"pp_{same[k]}") * weight).alias(f"total_pp_{k}"))
            means.append(mean.alias(f"percentile_{k}"))
        return df.groupBy("leaderboard_id").agg(*sums, *means)

    if not hot.groups:
        return by_place(held).withColumnRenamed("leaderboard_id", "id")
    usual, large = split_hot(held, ["leaderboard_id"], hot, policy)
    found = None
    for k, config in enumerate(configs):
        one = large.select(
            "id",
            "leaderboard_id",
            F.col("plays").alias("ranked_play_count"),
            F.lit(False).alias("top_player"),
            F.col(f"weight_{k}").alias("weight"),
            *[F.col(f"{c}_{same[k]}").alias(c) for c in ("pp", "top_pp")],
        )
        stats = board_statistics(one, config, hot, policy).select(
            "leaderboard_id", *[F.col(c).alias(f"{c}_{k}") for c in COMPARED["leaderboards"]]
        )
        found = stats if found is None else found.join(stats, "leaderboard_id")
    return by_place(usual).unionByName(found).withColumnRenamed("leaderboard_id", "id")


def _compare(
    table: str,
    imported: DataFrame | None,
    current: DataFrame,
    found: DataFrame,
    trials: Sequence[str],
    same: Sequence[int] | None = None,
) -> DataFrame:
    """A row per trial and id: old values, new values and differences.

    Rows of ``imported`` that a trial did not reach keep the values they have there. ``same``
    is ``alike`` where ``found`` holds columns other than weights only for the first ones.
    """
    columns = COMPARED[table]
    joined = current.select("id", *[F.col(c).alias(f"old_{c}") for c in columns])
    if imported is not None:
        kept = imported.select("id", *[F.col(c).alias(f"_kept_{c}") for c in columns])
        joined = joined.join(kept, "id").join(found, "id", "left")
    else:
        joined = joined.join(found, "id")
    entries = []
    for k, trial in enumerate(trials):
        names = {c: f"{c}_{k if same is None or c == 'weight' else same[k]}" for c in columns}
        new = {
            c: F.col(name) if imported is None else F.coalesce(name, f"_kept_{c}")
            for c, name in names.items()
        }
        entries.append(
            F.struct(
                F.lit(trial).alias("trial"),
                *[new[c].alias(f"new_{c}") for c in columns],
                *[(new[c] - F.col(f"old_{c}")).alias(f"{c}_delta") for c in columns],
            )
        )
    old = [f"old_{c}" for c in columns]
    return joined.select("id", *old, F.inline(F.array(*entries)))


def what_if_sweep(
    tables: Mapping[str, DataFrame],
    current: Mapping[str, DataFrame],
    configs: Mapping[str, RatingConfig],
    policy: SkewPolicy = DEFAULT_SKEW,
    only: Sequence[str] = tuple(COMPARED),
    stored: bool = False,
) -> dict[str, DataFrame]:
    """``what_if_rescore`` under several named configurations, whose names are in ``trial``."""
    if not configs:
        raise ValueError("a sweep needs a configuration")
    trials, settings = list(configs), list(configs.values())
    imported, boards = tables["scores"], tables["leaderboards"]
    if not stored:
        imported = materialise(imported, "imported-scores")
    rows = imported.count()
    found = {}
    with sized_shuffles(imported.sparkSession, rows, SORTED * len(trials)):
        swept = materialise(
            sweep_scores(imported, boards, settings, policy, rows), "sweep-scores"
        )
        if "scores" in only:
            found["scores"] = _compare(
                "scores", None, current["scores"], swept, trials, alike(settings, swept.columns)
            )
        if "players" in only:
            players = sweep_players(swept, tables["players"], settings, policy)
            players = materialise(players, "sweep-player-ranks")
            found["players"] = _compare(
                "players", tables["players"], current["players"], players, trials
            )
        if "leaderboards" in only:
            stats = materialise(sweep_boards(swept, settings, policy, rows), "sweep-boards")
            found["leaderboards"] = _compare(
                "leaderboards", boards, current["leaderboards"], stats, trials
            )
    return {table: found[table] for table in only}
