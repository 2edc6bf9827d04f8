"""Score series of leaderboards: axes, comparison, freshness, rating shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.config import DEFAULT_SKEW, SkewPolicy
from tallyboard.functions.modifiers import modifier_list
from tallyboard.functions.numbers import share_of, unix_time
from tallyboard.operators.ranking import HotGroups, with_position

SERIES_COLUMNS = (
    "player_id",
    "weight",
    "rank",
    "timepost",
    "modifiers",
    "player_rank",
    "player_name",
    "player_avatar",
    "accuracy",
    "pp",
    "fc",
    "fc_acc",
)


# Names of the columns in the JSON objects.
JSON_NAMES = {
    "player_id": "playerId",
    "player_rank": "playerRank",
    "player_name": "playerName",
    "player_avatar": "playerAvatar",
    "fc_acc": "fcAcc",
}


def score_series(
    scores: DataFrame, players: DataFrame, leaderboard_id: str | None = None
) -> DataFrame:
    """Scores with their player, accuracy in percent; of one board or of all."""
    if leaderboard_id is not None:
        scores = scores.where(F.col("leaderboard_id") == leaderboard_id)
    about = players.select(
        F.col("id").alias("player_id"),
        F.col("rank").alias("player_rank"),
        F.col("name").alias("player_name"),
        F.col("avatar").alias("player_avatar"),
    )
    joined = scores.withColumn("accuracy", F.col("accuracy") * 100).join(about, "player_id")
    return joined.select("id", "leaderboard_id", *SERIES_COLUMNS)


def series_json(series: DataFrame) -> DataFrame:
    """One JSON object per score, keyed by score id; missing values are nulls."""
    text = F.to_json(_json_fields(), _WITH_NULLS)
    return series.select("leaderboard_id", "id", text.alias("json"))


_WITH_NULLS = {"ignoreNullFields": "false"}


def _json_fields() -> Column:
    return F.struct(*[F.col(c).alias(JSON_NAMES.get(c, c)) for c in SERIES_COLUMNS])


def series_json_chunks(
    series: DataFrame,
    size: int = 1000,
    hot: HotGroups | None = None,
    policy: SkewPolicy = DEFAULT_SKEW,
) -> DataFrame:
    """The array of each board by rank, cut into JSON arrays of ``size`` objects.

    (leaderboard_id, chunk from 0, entries, json); only a board's last chunk may be shorter.
    Joined in the order of ``chunk`` they are the array of the board, which itself is nowhere
    collected: a row holds no more than ``size`` scores, also where ranks repeat or are missing.
    ``hot`` and ``policy`` as in ``with_position``; with hot boards ``series`` is read twice.
    """
    order = [F.col("rank").asc(), F.col("id").asc()]
    placed = with_position(series, ["leaderboard_id"], order, "_place", hot=hot, policy=policy)
    chunk = F.floor((F.col("_place") - 1) / F.lit(size)).cast("bigint")
    entry = F.struct("_place", _json_fields().alias("entry"))
    grouped = placed.groupBy("leaderboard_id", chunk.alias("chunk")).agg(
        F.array_sort(F.collect_list(entry)).alias("_entries")
    )
    return grouped.select(
        "leaderboard_id",
        "chunk",
        F.size("_entries").cast("bigint").alias("entries"),
        F.to_json(F.col("_entries.entry"), _WITH_NULLS).alias("json"),
    )


def axis_value(name: str, literal: bool = False) -> Column:
    """The value of a score on a named axis; null for a name without data.

    ``rank`` needs the column ``board_total``. ``literal`` leaves the full-combo
    accuracy a fraction while subtracting it from 100.
    """
    fc_acc = F.col("fc_acc") if literal else F.col("fc_acc") * 100
    values = {
        "date": unix_time(F.col("timepost")),
        "pp": F.col("pp"),
        "acc": 100 - F.col("accuracy"),
        "fcAcc": 100 - fc_acc,
        "rank": share_of(F.col("rank"), F.col("board_total").cast("double")) * 100,
        "weight": F.col("weight") * 100,
        "weightedPp": F.col("weight") * F.col("pp"),
        "playerRank": F.col("player_rank"),
    }
    return values.get(name, F.lit(None).cast("double"))


# Axes on which a missing or zero value drops the score.
REQUIRED_AXES = ("date", "pp", "acc", "rank", "weight", "weightedPp")


def _present(column: str, axis: str) -> Column:
    if axis not in REQUIRED_AXES:
        return F.lit(True)
    if axis == "date":
        return F.col(column).isNotNull()
    value = F.col(column).cast("double")
    return F.coalesce((value != 0) & ~F.isnan(value), F.lit(False))


def with_board_total(
    series: DataFrame, few_boards: bool = False, boards: DataFrame | None = None
) -> DataFrame:
    """Add the number of scores of each board.

    Taken from refreshed ``boards`` where they are given. Otherwise an aggregate
    joined back, not a window: it is combined before its shuffle and its result is
    one row per board. ``few_boards`` says that the number of boards was checked, and
    broadcasts it; then the scores are not shuffled at all.
    """
    if boards is None:
        totals = series.groupBy("leaderboard_id").agg(F.count("*").alias("board_total"))
    else:
        totals = boards.select(
            F.col("id").alias("leaderboard_id"), F.col("count").alias("board_total")
        )
    if few_boards:
        totals = F.broadcast(totals)
    return series.join(totals, "leaderboard_id")


def series_axes(
    series: DataFrame,
    x_axis: str = "playerRank",
    y_axis: str = "weight",
    literal: bool = False,
    few_boards: bool = False,
    boards: DataFrame | None = None,
) -> DataFrame:
    """Points (x, y) of each score on two named axes, with its modifiers as a list.

    Scores of unranked players, and scores without a value on an axis that needs
    one, are left out. Only the rank axis needs board totals: those of ``boards``,
    or counted.
    """
    if "rank" in (x_axis, y_axis):
        series = with_board_total(series, few_boards, boards)
    points = series.where(F.coalesce("player_rank", F.lit(0)) != 0).select(
        "*",
        axis_value(x_axis, literal).alias("x"),
        axis_value(y_axis, literal).alias("y"),
        modifier_list(F.col("modifiers")).alias("mods"),
    )
    return points.where(_present("x", x_axis) & _present("y", y_axis)).drop("board_total")


def compare_series(
    series: DataFrame,
    leaderboard_id: str,
    compare_id: str,
    x_axis: str = "playerRank",
    y_axis: str = "weight",
    literal: bool = False,
) -> DataFrame:
    """The points of two boards together; the second one's are flagged."""

    def points(board: str, flag: bool) -> DataFrame:
        own = series.where(F.col("leaderboard_id") == board)
        # one board, so one total
        axes = series_axes(own, x_axis, y_axis, literal, few_boards=True)
        return axes.withColumn("is_compare", F.lit(flag))

    return points(leaderboard_id, False).unionByName(points(compare_id, True))


# Age at which a score stops fading, and its brightness range.
OLD_AGE_SECONDS = 240 * 24 * 60 * 60
FRESH_BRIGHTNESS = 255
OLD_BRIGHTNESS = 128


def score_freshness(timepost: Column, as_of: int) -> Column:
    """Brightness of a score by its age at ``as_of`` (unix seconds)."""
    age = (F.lit(as_of) - timepost) / float(OLD_AGE_SECONDS)
    left = F.lit(1.0) - F.least(F.greatest(age, F.lit(0.0)), F.lit(1.0))
    brightness = OLD_BRIGHTNESS + (FRESH_BRIGHTNESS - OLD_BRIGHTNESS) * F.pow(left, F.lit(3.0))
    return F.floor(brightness).cast("int")


# Fixed value: ratings up to this share one scale.
COMMON_RATING = 15.0
_RATINGS = ("tech_rating", "pass_rating", "acc_rating")


def _with_shares(boards: DataFrame, highest: Column) -> DataFrame:
    scale = F.greatest(F.lit(COMMON_RATING), F.ceil(highest).cast("double"))
    scaled = boards.withColumn("max_rating", scale)
    return scaled.select(
        "id",
        "max_rating",
        *[
            (F.col(c) / F.col("max_rating")).alias(c.replace("rating", "share"))
            for c in _RATINGS
        ],
    )


def rating_shares(boards: DataFrame) -> DataFrame:
    """Each rating as a share of the board's scale."""
    return _with_shares(boards, F.greatest(*_RATINGS))


def rating_shares_compare(boards: DataFrame, leaderboard_id: str, compare_id: str) -> DataFrame:
    """The same for two boards on one scale; the window sees these two rows."""
    pair = boards.where(F.col("id").isin(leaderboard_id, compare_id))
    return _with_shares(pair, F.max(F.greatest(*_RATINGS)).over(Window.partitionBy()))
