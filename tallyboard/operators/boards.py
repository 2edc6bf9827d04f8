"""Statistics per leaderboard.

The scores of an ordinary board are sorted by weight once, for all five means over the
heaviest third. A board above ``SkewPolicy.hot_rows`` is not sorted. Weights are powers of
the decay, so a board has few distinct ones however many scores it has: its rows are counted
and summed per weight, combined before they move, and running sums of these counts show at
which weight each third ends. Lighter scores are out, heavier ones are summed already; only
those of that weight, of which a part is in, are ordered by id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_RATING, DEFAULT_SKEW, RatingConfig, SkewPolicy
from tallyboard.functions.numbers import ratio, share_of
from tallyboard.functions.points import decay_weight
from tallyboard.operators.ranking import HotGroups, find_hot_groups, with_position
from tallyboard.session import materialise


def held_scores(
    scores: DataFrame, players: DataFrame, config: RatingConfig = DEFAULT_RATING
) -> DataFrame:
    """The columns the statistics need of scores and their players."""
    holders = players.select(
        F.col("id").alias("player_id"),
        "top_pp",
        "ranked_play_count",
        (F.col("rank") < config.top_rank).alias("top_player"),
    )
    plays = scores.select("id", "leaderboard_id", "player_id", "pp", "weight")
    return plays.join(holders, "player_id").drop("player_id")


def flag_top_players(
    scores: DataFrame,
    players: DataFrame,
    config: RatingConfig = DEFAULT_RATING,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """The same for scores that carry ``top_pp`` and ``ranked_play_count`` already.

    Only the best players are joined. They are counted before they are broadcast:
    players who lost their scores keep an old rank, so ranks may repeat.
    """
    best = players.where(F.col("rank").between(1, config.top_rank - 1)).select(
        F.col("id").alias("player_id"), F.lit(True).alias("top_player")
    )
    plays = scores.select(
        "id", "leaderboard_id", "player_id", "pp", "weight", "top_pp", "ranked_play_count"
    )
    if best.count() <= policy.broadcast_rows:
        best = F.broadcast(best)
    flagged = plays.join(best, "player_id", "left").drop("player_id")
    return flagged.withColumn("top_player", F.coalesce("top_player", F.lit(False)))


def _basic(config: RatingConfig, literal: bool) -> list[Column]:
    weight, plays = F.col("weight"), F.col("ranked_play_count")
    share = share_of(F.col("pp"), F.col("top_pp"))
    counted = F.when(plays >= config.ratio_min_plays, share)
    heavy = weight > decay_weight(F.lit(config.top_rank_index), config.decay)
    return [
        F.count("*").alias("count"),
        F.count_if(weight > config.high_weight).alias("count80"),
        F.count_if(weight > config.top_weight).alias("count95"),
        F.avg(weight).alias("average"),
        F.count_if(F.col("top_player") & heavy).alias("top250"),
        F.sum(F.col("pp") * weight).alias("total_pp"),
        F.coalesce(F.avg(counted), F.lit(0.0)).alias("pp_ratio_filtered"),
        F.coalesce(F.avg(counted if literal else share), F.lit(0.0)).alias("pp_ratio_unfiltered"),
    ]


def _placed(joined: DataFrame, config: RatingConfig) -> DataFrame:
    """Place each score by weight, once for all five top-third means.

    Scores of players without points come last, and so never take a place.
    """
    eligible = F.col("top_pp") != 0
    order = [eligible.desc(), F.col("weight").desc(), F.col("id").asc()]
    above = {
        f"_place{t}": eligible & (F.col("ranked_play_count") > t) for t in config.play_thresholds
    }
    placed = with_position(
        joined,
        ["leaderboard_id"],
        order,
        "_place",
        running=above,
        totals={"_eligible": eligible},
        hot=HotGroups(),
    )
    return placed.withColumn("_top", (F.col("_eligible") * config.top_share).cast("bigint"))


def _top_means(config: RatingConfig) -> list[Column]:
    weight, plays = F.col("weight"), F.col("ranked_play_count")
    eligible = F.col("top_pp") != 0
    score = share_of(F.col("pp"), F.col("top_pp")) * weight

    def mean(value: Column, rows: Column) -> Column:
        enough = F.count_if(rows) > config.min_top_rows
        return F.when(enough, F.avg(F.when(rows, value))).otherwise(F.lit(0.0))

    top = eligible & (F.col("_place") <= F.col("_top"))
    means = [
        mean(weight, top).alias("percentile"),
        mean(score, top & (plays > config.top_min_plays)).alias("megametric"),
    ]
    for limit in config.play_thresholds:
        rows = eligible & (plays > limit) & (F.col(f"_place{limit}") <= F.col("_top"))
        means.append(mean(score, rows).alias(f"megametric{limit}"))
    return means


def board_stats(
    scores: DataFrame,
    players: DataFrame,
    config: RatingConfig = DEFAULT_RATING,
    literal: bool = False,
) -> DataFrame:
    """Counts, sums and means per board; one aggregate, combined before its shuffle.

    ``literal`` repeats the filtered point ratio in the unfiltered column.
    """
    return basic_statistics(held_scores(scores, players, config), config, literal)


def basic_statistics(
    held: DataFrame, config: RatingConfig = DEFAULT_RATING, literal: bool = False
) -> DataFrame:
    """The same from ``held_scores``."""
    return held.groupBy("leaderboard_id").agg(*_basic(config, literal))


def board_megametrics(
    scores: DataFrame,
    players: DataFrame,
    config: RatingConfig = DEFAULT_RATING,
    hot: HotGroups | None = None,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """The five means over the heaviest third of each board's scores."""
    if hot is None:
        hot = find_hot_groups(scores, ["leaderboard_id"], policy)
    held = held_scores(scores, players, config).withColumn(
        "top_player", F.coalesce("top_player", F.lit(False))
    )
    statistics = board_statistics(held, config, hot, policy)
    means = [f"megametric{limit}" for limit in config.play_thresholds]
    return statistics.select("leaderboard_id", "percentile", "megametric", *means)


def board_statistics(
    held: DataFrame,
    config: RatingConfig = DEFAULT_RATING,
    hot: HotGroups | None = None,
    policy: SkewPolicy = DEFAULT_SKEW,
    literal: bool = False,
    all_hot: bool = False,
) -> DataFrame:
    """All thirteen statistics from one shuffle and one sort.

    ``held`` comes from ``held_scores`` or ``flag_top_players``. With hot boards it is read
    three times; store it first where computing it takes more than a scan. ``all_hot`` says
    that it has scores of hot boards only.
    """
    if hot is None:
        hot = find_hot_groups(held, ["leaderboard_id"], policy)
    if not hot.groups:
        return _by_place(held, config, literal)
    if all_hot:
        return _by_weight(held, config, hot, policy, literal)
    keys = hot.keys.select(F.col("leaderboard_id").alias("_hot_board"))
    if hot.groups <= policy.broadcast_rows:
        keys = F.broadcast(keys)
    is_hot = F.col("leaderboard_id").eqNullSafe(F.col("_hot_board"))
    usual = _by_place(held.join(keys, is_hot, "left_anti"), config, literal)
    large = _by_weight(held.join(keys, is_hot, "left_semi"), config, hot, policy, literal)
    return usual.unionByName(large)


def _by_place(held: DataFrame, config: RatingConfig, literal: bool) -> DataFrame:
    placed = _placed(held, config)
    return placed.groupBy("leaderboard_id").agg(*_basic(config, literal), *_top_means(config))


def weight_levels(held: DataFrame, config: RatingConfig = DEFAULT_RATING) -> DataFrame:
    """Counts and sums per board, weight and what the means ask of a player; one aggregate,
    combined before its shuffle."""
    weight, plays = F.col("weight"), F.col("ranked_play_count")
    share = share_of(F.col("pp"), F.col("top_pp"))
    heavy = weight > decay_weight(F.lit(config.top_rank_index), config.decay)
    counted = F.when(plays >= config.ratio_min_plays, share)
    eligible = F.coalesce(F.col("top_pp") != 0, F.lit(False))
    return held.groupBy(
        "leaderboard_id",
        "weight",
        eligible.alias("eligible"),
        *[(plays > limit).alias(f"over{limit}") for limit in _limits(config)],
    ).agg(
        F.count("*").alias("n"),
        F.sum(share * weight).alias("score"),
        F.sum(F.col("pp") * weight).alias("points"),
        F.sum(share).alias("share"),
        F.count(share).alias("shares"),
        F.sum(counted).alias("counted"),
        F.count(counted).alias("counted_n"),
        F.count_if(F.col("top_player") & heavy).alias("top_players"),
    )


def _limits(config: RatingConfig) -> list[int]:
    return sorted({*config.play_thresholds, config.top_min_plays})


def _by_weight(
    held: DataFrame, config: RatingConfig, hot: HotGroups, policy: SkewPolicy, literal: bool
) -> DataFrame:
    """The statistics without sorting the boards."""
    levels = materialise(weight_levels(held, config), "weight-levels")
    n, weight = F.col("n"), F.col("weight")

    def mean(total: str, rows: str) -> Column:
        return F.when(F.sum(rows) > 0, F.sum(total) / F.sum(rows))

    share = F.coalesce(mean("share", "shares"), F.lit(0.0))
    filtered = F.coalesce(mean("counted", "counted_n"), F.lit(0.0))
    basic = levels.groupBy("leaderboard_id").agg(
        F.sum(n).alias("count"),
        F.sum(F.when(weight > config.high_weight, n).otherwise(0)).alias("count80"),
        F.sum(F.when(weight > config.top_weight, n).otherwise(0)).alias("count95"),
        (F.sum(weight * n) / F.sum(n)).alias("average"),
        F.sum("top_players").alias("top250"),
        F.sum("points").alias("total_pp"),
        filtered.alias("pp_ratio_filtered"),
        (filtered if literal else share).alias("pp_ratio_unfiltered"),
    )
    cuts = materialise(_cuts(levels, config), "weight-cuts")
    parts = _cut_rows(held, cuts, config, hot, policy)
    means = _means_of_cuts(cuts, parts, config)
    return basic.join(means, "leaderboard_id", "left").fillna(
        0.0, [c for c in means.columns if c != "leaderboard_id"]
    )


def _cuts(levels: DataFrame, config: RatingConfig) -> DataFrame:
    """A row per board and weight: of how many scores the means are, by the players they
    ask for (``n``, ``n125``, ...), and how many of these are among the top (``take``, ...).

    As many rows per board as it has distinct weights: a sorted window over them is small.
    """
    asked = {"": F.lit(True), **{f"{t}": F.col(f"over{t}") for t in config.play_thresholds}}
    ruled = F.col(f"over{config.top_min_plays}")
    wide = (
        levels.where("eligible")
        .groupBy("leaderboard_id", "weight")
        .agg(
            *[F.sum(F.when(rows, F.col("n")).otherwise(0)).alias(f"n{k}") for k, rows in asked.items()],
            *[F.sum(F.when(rows, F.col("score")).otherwise(0.0)).alias(f"score{k}") for k, rows in asked.items()],
            F.sum(F.when(ruled, F.col("n")).otherwise(0)).alias("ruled"),
            F.sum(F.when(ruled, F.col("score")).otherwise(0.0)).alias("ruled_score"),
        )
    )
    board = Window.partitionBy("leaderboard_id")
    heavier = board.orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)
    top = (F.sum("n").over(board) * config.top_share).cast("bigint")
    wide = wide.withColumn("top", top)
    left = {k: F.col("top") - F.coalesce(F.sum(f"n{k}").over(heavier), F.lit(0)) for k in asked}
    return wide.select(
        "*", *[F.greatest(F.least(F.col(f"n{k}"), rest), F.lit(0)).alias(f"take{k}") for k, rest in left.items()]
    )


def _cut_rows(
    held: DataFrame, cuts: DataFrame, config: RatingConfig, hot: HotGroups, policy: SkewPolicy
) -> DataFrame:
    """Per board and mean: number and scores of the rows taken at the weight of its cut.

    At most one weight per board and mean is cut; its rows are ordered by id.
    """
    asked = ["", *[f"{t}" for t in config.play_thresholds]]
    cut = {k: (F.col(f"take{k}") > 0) & (F.col(f"take{k}") < F.col(f"n{k}")) for k in asked}
    some = cuts.where(reduce(lambda a, b: a | b, cut.values())).select(
        F.col("leaderboard_id").alias("_cut_board"),
        F.col("weight").alias("_cut_weight"),
        *[F.when(cut[k], F.col(f"take{k}")).alias(f"take{k}") for k in asked],
    )
    if hot.groups * len(asked) <= policy.broadcast_rows:
        some = F.broadcast(some)
    plays = F.col("ranked_play_count")
    entries = [
        F.struct(
            F.lit(k).alias("mean"),
            F.when(plays > int(k) if k else F.lit(True), F.col(f"take{k}")).alias("take"),
        )
        for k in asked
    ]
    rows = (
        held.where("top_pp <> 0")
        .join(
            some,
            F.col("leaderboard_id").eqNullSafe(F.col("_cut_board")) & (F.col("weight") == F.col("_cut_weight")),
        )
        .select(
            "leaderboard_id",
            "id",
            (share_of(F.col("pp"), F.col("top_pp")) * F.col("weight")).alias("score"),
            (plays > config.top_min_plays).alias("ruled"),
            F.inline(F.array(*entries)),
        )
        .where("take is not null")
    )
    rows = materialise(rows, "cut-rows")
    placed = with_position(rows, ["leaderboard_id", "mean"], [F.col("id").asc()], "place", policy=policy)
    counts = (F.col("mean") != "") | F.col("ruled")
    return (
        placed.where((F.col("place") <= F.col("take")) & counts)
        .groupBy("leaderboard_id", "mean")
        .agg(F.count("*").alias("rows"), F.sum("score").alias("score"))
    )


def _means_of_cuts(cuts: DataFrame, parts: DataFrame, config: RatingConfig) -> DataFrame:
    def whole(k: str, column: str) -> Column:
        """The column summed over the weights that are in whole."""
        return F.sum(F.when(F.col(f"take{k}") == F.col(f"n{k}"), F.col(column)).otherwise(0))

    limits = [f"{t}" for t in config.play_thresholds]
    sums = cuts.groupBy("leaderboard_id").agg(
        F.sum("take").alias("rows"),
        F.sum(F.col("take") * F.col("weight")).alias("weights"),
        whole("", "ruled").alias("ruled"),
        whole("", "ruled_score").alias("ruled_score"),
        *[F.sum(f"take{k}").alias(f"rows{k}") for k in limits],
        *[whole(k, f"score{k}").alias(f"score{k}") for k in limits],
    )
    extra = parts.groupBy(F.col("leaderboard_id").alias("_board")).agg(
        F.sum(F.when(F.col("mean") == "", F.col("rows"))).alias("extra_rows"),
        *[F.sum(F.when(F.col("mean") == k, F.col("score"))).alias(f"extra{k}") for k in ["", *limits]],
    )
    both = sums.join(extra, F.col("leaderboard_id").eqNullSafe(F.col("_board")), "left").fillna(0)

    def mean(total: Column, rows: Column) -> Column:
        return F.when(rows > config.min_top_rows, total / rows).otherwise(F.lit(0.0))

    return both.select(
        "leaderboard_id",
        mean(F.col("weights"), F.col("rows")).alias("percentile"),
        mean(F.col("ruled_score") + F.col("extra"), F.col("ruled") + F.col("extra_rows")).alias("megametric"),
        *[mean(F.col(f"score{k}") + F.col(f"extra{k}"), F.col(f"rows{k}")).alias(f"megametric{k}") for k in limits],
    )


def board_ratios(boards: DataFrame) -> DataFrame:
    """Add the three ratios between the counts; 0 where there is nothing to divide by."""
    return boards.select(
        "*",
        ratio(F.col("count80"), F.col("count")).alias("count80_ratio"),
        ratio(F.col("count95"), F.col("count")).alias("count95_ratio"),
        ratio(F.col("count95"), F.col("count80")).alias("count95to80_ratio"),
    )
