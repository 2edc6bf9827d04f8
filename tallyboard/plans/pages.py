"""Lookups, searches, sorted listings and their pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.operators.boards import board_ratios

RANKING_PAGE = 50
STATS_PAGE = 50
BOARDS_PAGE = 10
SCORES_PAGE = 10


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of ``df`` in ``order``; numbers below 1 mean 1.

    A top-k plan: each task keeps the rows up to the page's end, nothing is
    sorted as a whole.
    """
    return df.orderBy(*order).offset((max(number, 1) - 1) * size).limit(size)


def page_count(df: DataFrame, size: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows and pages of a listing, or of one listing per ``by``."""
    counted = df.groupBy(*by).agg(F.count("*").alias("total"))
    return counted.withColumn("pages", F.ceil(F.col("total") / float(size)))


# ---- lookups -----------------------------------------------------------------


def by_id(df: DataFrame, key: str) -> DataFrame:
    """The row with this id; no row means not found."""
    return df.where(F.col("id") == key).limit(1)


# ---- players -----------------------------------------------------------------


def ranking_page(players: DataFrame, number: int = 1, size: int = RANKING_PAGE) -> DataFrame:
    """Players by points. For pages far down use ``ranking_slice``."""
    return page(players, [F.desc("pp"), F.asc("id")], number, size)


def ranking_slice(players: DataFrame, number: int, size: int = RANKING_PAGE) -> DataFrame:
    """The ranked players of a page, found by their stored rank.

    Costs the same for every page: the bounds go down to the Parquet scan.
    """
    first = (max(number, 1) - 1) * size + 1
    return players.where(F.col("rank").between(first, first + size - 1)).orderBy("rank").limit(size)


def player_page(
    scores: DataFrame,
    boards: DataFrame,
    player_id: str,
    number: int = 1,
    size: int = SCORES_PAGE,
) -> DataFrame:
    """A player's scores by points, with their leaderboard.

    The page is cut before the join, so only its rows look for a board.
    """
    own = page(
        scores.where(F.col("player_id") == player_id), [F.desc("pp"), F.asc("id")], number, size
    )
    about = boards.select(
        F.col("id").alias("leaderboard_id"),
        F.col("name").alias("leaderboard_name"),
        "difficulty_name",
        "mode_name",
        "stars",
        "cover",
    )
    return page(own.join(about, "leaderboard_id"), [F.desc("pp"), F.asc("id")], 1, size)


# ---- leaderboards ------------------------------------------------------------


def leaderboard_page(
    scores: DataFrame,
    players: DataFrame,
    leaderboard_id: str,
    number: int = 1,
    size: int = SCORES_PAGE,
) -> DataFrame:
    """A leaderboard's scores by points, with their player. For pages far down use
    ``leaderboard_slice``."""
    own = page(
        scores.where(F.col("leaderboard_id") == leaderboard_id),
        [F.desc("pp"), F.asc("id")],
        number,
        size,
    )
    return page(_with_player(own, players), [F.desc("pp"), F.asc("id")], 1, size)


def leaderboard_slice(
    scores: DataFrame,
    players: DataFrame,
    leaderboard_id: str,
    number: int,
    size: int = SCORES_PAGE,
) -> DataFrame:
    """The scores of a leaderboard page, found by their stored rank.

    Costs the same for every page: stored scores are sorted by board and rank.
    """
    first = (max(number, 1) - 1) * size + 1
    own = scores.where(
        (F.col("leaderboard_id") == leaderboard_id)
        & F.col("rank").between(first, first + size - 1)
    )
    return _with_player(own, players).orderBy("rank").limit(size)


def _with_player(scores: DataFrame, players: DataFrame) -> DataFrame:
    about = players.select(
        F.col("id").alias("player_id"),
        F.col("name").alias("player_name"),
        F.col("country").alias("player_country"),
        F.col("rank").alias("player_rank"),
        F.col("avatar").alias("player_avatar"),
    )
    return scores.join(about, "player_id")


def search_like(boards: DataFrame, text: str | None) -> DataFrame:
    """Boards whose name matches ``text`` anywhere; % and _ in it are wildcards.

    No text means all boards. A backslash is an ordinary character.
    """
    if not text:
        return boards
    pattern = "%" + text.lower().replace("\\", "\\\\") + "%"
    return boards.where(F.lower("name").like(pattern))


def search_contains(boards: DataFrame, text: str | None) -> DataFrame:
    """Boards whose name contains ``text`` literally; no text means all boards."""
    if not text:
        return boards
    return boards.where(F.lower("name").contains(text.lower()))


def boards_by_stars(
    boards: DataFrame,
    text: str | None = None,
    descending: bool = False,
    number: int = 1,
    size: int = BOARDS_PAGE,
) -> DataFrame:
    """Board listing by stars, easiest first unless ``descending``."""
    stars = F.desc("stars") if descending else F.asc("stars")
    return page(search_like(boards, text), [stars, F.asc("id")], number, size)


# ---- statistics table --------------------------------------------------------

# Sort names a caller may use, and the column each one sorts by.
STATS_KEYS = {
    "Name": "name",
    "Count": "count",
    "Count80": "count80",
    "Count95": "count95",
    "Average": "average",
    "Percentile": "percentile",
    "Megametric": "megametric",
    "Megametric125": "megametric125",
    "Megametric75": "megametric75",
    "Megametric40": "megametric40",
    "Top250": "top250",
    "PPRatioFiltered": "pp_ratio_filtered",
    "PPRatioUnfiltered": "pp_ratio_unfiltered",
    "AccRating": "acc_rating",
    "PassRating": "pass_rating",
    "TechRating": "tech_rating",
    "TotalPP": "total_pp",
    "Count80Ratio": "count80_ratio",
    "Count95Ratio": "count95_ratio",
    "Count95to80Ratio": "count95to80_ratio",
}

STATS_COLUMNS = ["id", *dict.fromkeys(STATS_KEYS.values())]


def stats_sort_column(sort_by: str, descending: bool, literal: bool = False) -> str:
    """Column for a sort name; unknown names mean total points.

    ``literal`` repeats two oddities: percentile sorts by average when
    descending, and the ratio columns sort by total points.
    """
    if literal and sort_by == "Percentile" and descending:
        return "average"
    if literal and sort_by.endswith("Ratio"):
        return "total_pp"
    return STATS_KEYS.get(sort_by, "total_pp")


def stats_table(boards: DataFrame) -> DataFrame:
    """The columns of the statistics table, ratios included."""
    return board_ratios(boards).select(*STATS_COLUMNS)


def stats_page(
    boards: DataFrame,
    text: str | None = None,
    sort_by: str = "TotalPP",
    descending: bool = True,
    number: int = 1,
    size: int = STATS_PAGE,
    literal: bool = False,
) -> DataFrame:
    """A page of the statistics table."""
    found = stats_table(search_contains(boards, text))
    column = stats_sort_column(sort_by, descending, literal)
    key = F.desc(column) if descending else F.asc(column)
    return page(found, [key, F.asc("id")], number, size)


# Decimals each column is shown with; the ratios and the average are percentages.
_POINTS, _MEANS, _PERCENT = 2, 3, 1
REPORT_DECIMALS = {
    "total_pp": _POINTS,
    "percentile": _MEANS,
    "megametric": _MEANS,
    "megametric125": _MEANS,
    "megametric75": _MEANS,
    "megametric40": _MEANS,
    "pp_ratio_filtered": _MEANS,
    "pp_ratio_unfiltered": _MEANS,
    "acc_rating": _POINTS,
    "pass_rating": _POINTS,
    "tech_rating": _POINTS,
}
REPORT_PERCENT = ("average", "count80_ratio", "count95_ratio", "count95to80_ratio")


def stats_report(stats: DataFrame) -> DataFrame:
    """The statistics rounded as they are shown."""

    def shown(column: str) -> Column:
        if column in REPORT_PERCENT:
            return F.round(F.col(column) * 100, _PERCENT).alias(column)
        if column in REPORT_DECIMALS:
            return F.round(column, REPORT_DECIMALS[column]).alias(column)
        return F.col(column)

    return stats.select(*[shown(c) for c in stats.columns])


def board_header(boards: DataFrame) -> DataFrame:
    """Ratings and stars rounded as they head a leaderboard page."""
    return boards.select(
        "id",
        "name",
        "difficulty_name",
        "mode_name",
        *[F.round(c, 2).alias(c) for c in ("tech_rating", "acc_rating", "pass_rating")],
        F.round("stars", 1).alias("stars"),
    )
