"""Table schemas, keys and declared limits."""

from __future__ import annotations

from pyspark.sql import types as T

RATING_FIELDS = ("predicted_acc", "pass_rating", "acc_rating", "tech_rating", "stars")


def _family() -> T.StructType:
    return T.StructType([T.StructField(f, T.DoubleType()) for f in RATING_FIELDS])


def modifier_ratings_type(codes: tuple[str, ...]) -> T.StructType:
    """One family of five ratings per speed code."""
    return T.StructType([T.StructField(c, _family()) for c in codes])


STORED_FAMILIES = ("FS", "SS", "SF")
DUMP_FAMILIES = ("SS", "FS", "SF", "BFS", "BSF")

# ---- what an import delivers -------------------------------------------------

DUMP_PLAYERS = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("country", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("avatar", T.StringType()),
    ]
)

DUMP_SCORES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("leaderboard_id", T.StringType()),
        T.StructField("accuracy", T.DoubleType()),
        T.StructField("modifiers", T.StringType()),
        T.StructField("player_id", T.StringType()),
        T.StructField("timepost", T.LongType()),
        T.StructField("fc", T.BooleanType()),
        T.StructField("fc_acc", T.DoubleType()),
    ]
)

DUMP_MAPS = T.StructType(
    [
        T.StructField("hash", T.StringType()),
        T.StructField("name", T.StringType()),
        T.StructField("cover_image", T.StringType()),
        T.StructField("mapper", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("song_id", T.StringType()),
        T.StructField("mode_name", T.StringType()),
        T.StructField("difficulty_name", T.StringType()),
        T.StructField("acc_rating", T.DoubleType()),
        T.StructField("pass_rating", T.DoubleType()),
        T.StructField("tech_rating", T.DoubleType()),
        T.StructField("predicted_acc", T.DoubleType()),
        T.StructField("modifiers_rating", modifier_ratings_type(DUMP_FAMILIES)),
    ]
)

DUMP_DOCUMENT = T.StructType(
    [
        T.StructField("players", T.ArrayType(DUMP_PLAYERS)),
        T.StructField("scores", T.ArrayType(DUMP_SCORES)),
        T.StructField("maps", T.ArrayType(DUMP_MAPS)),
    ]
)

# ---- what is stored ----------------------------------------------------------

PLAYER_COMPUTED = {
    "pp": "double",
    "acc_pp": "double",
    "tech_pp": "double",
    "pass_pp": "double",
    "rank": "bigint",
    "country_rank": "bigint",
    "top_pp": "double",
    "ranked_play_count": "bigint",
}

SCORE_COMPUTED = {
    "pp": "double",
    "acc_pp": "double",
    "tech_pp": "double",
    "pass_pp": "double",
    "bonus_pp": "double",
    "weight": "double",
    "rank": "bigint",
}

BOARD_COMPUTED = {
    "count": "bigint",
    "count80": "bigint",
    "count95": "bigint",
    "average": "double",
    "top250": "bigint",
    "total_pp": "double",
    "pp_ratio_filtered": "double",
    "pp_ratio_unfiltered": "double",
    "percentile": "double",
    "megametric": "double",
    "megametric125": "double",
    "megametric75": "double",
    "megametric40": "double",
}

COMPUTED = {
    "players": PLAYER_COMPUTED,
    "scores": SCORE_COMPUTED,
    "leaderboards": BOARD_COMPUTED,
}

# ---- declared limits ---------------------------------------------------------

# Longest allowed text per column; None means not null only.
LIMITS = {
    "players": {"id": 25, "name": 50, "country": 5, "avatar": 100},
    "scores": {
        "id": None,
        "timepost": None,
        "player_id": 25,
        "leaderboard_id": 25,
        "accuracy": None,
        "modifiers": None,
        "fc": None,
        "fc_acc": None,
    },
    "leaderboards": {
        "id": 25,
        "name": 150,
        "hash": None,
        "song_id": 25,
        "mode_name": 25,
        "difficulty_name": 25,
        "cover": 150,
        "mapper": 200,
        "stars": None,
        "pass_rating": None,
        "acc_rating": None,
        "tech_rating": None,
        "predicted_acc": None,
    },
}
