"""Every constant of the rating system, as parameters of one frozen object.

Nothing below is hard-wired into an operator, so a what-if run is a second
``RatingConfig`` (``dataclasses.replace(DEFAULT_RATING, decay=0.95)``).
"""

from __future__ import annotations

from dataclasses import dataclass

# Accuracy knots with the value of curve A and of curve B.
CURVE_KNOTS = (
    (1.0, 7.424, 7.424),
    (0.999, 6.241, 6.241),
    (0.9975, 5.158, 5.158),
    (0.995, 4.010, 4.010),
    (0.9925, 3.241, 3.241),
    (0.99, 2.700, 2.700),
    (0.9875, 2.303, 2.303),
    (0.985, 2.007, 2.007),
    (0.9825, 1.786, 1.786),
    (0.98, 1.618, 1.618),
    (0.9775, 1.490, 1.490),
    (0.975, 1.392, 1.392),
    (0.9725, 1.315, 1.315),
    (0.97, 1.256, 1.256),
    (0.965, 1.167, 1.167),
    (0.96, 1.101, 1.094),
    (0.955, 1.047, 1.039),
    (0.95, 1.000, 1.000),
    (0.94, 0.919, 0.931),
    (0.93, 0.847, 0.867),
    (0.92, 0.786, 0.813),
    (0.91, 0.734, 0.768),
    (0.9, 0.692, 0.729),
    (0.875, 0.606, 0.650),
    (0.85, 0.537, 0.581),
    (0.825, 0.480, 0.522),
    (0.8, 0.429, 0.473),
    (0.75, 0.345, 0.404),
    (0.7, 0.286, 0.345),
    (0.65, 0.246, 0.296),
    (0.6, 0.217, 0.256),
    (0.0, 0.000, 0.000),
)
CURVE_A = tuple((acc, a) for acc, a, _ in CURVE_KNOTS)
CURVE_B = tuple((acc, b) for acc, _, b in CURVE_KNOTS)

# What each modifier code adds to the score multiplier.
DEFAULT_MULTIPLIERS = {
    "DA": 0.0,
    "FS": 0.20,
    "SF": 0.36,
    "SS": -0.3,
    "GN": 0.04,
    "NA": -0.3,
    "NB": -0.2,
    "NF": -0.5,
    "NO": -0.2,
    "PM": 0.0,
    "SC": 0.0,
    "SA": 0.0,
    "OP": -0.5,
}
RANKED_MULTIPLIERS = DEFAULT_MULTIPLIERS | {"FS": 0.40, "SF": 0.72, "GN": 0.08, "NF": -1.0}

# Codes that change the speed of a play. A board may carry its own
# ratings for them, and then their multiplier does not count.
SPEED_CODES = ("FS", "SS", "SF")
NO_FAIL_CODE = "NF"

# Points for the first three places.
PODIUM_POINTS = {1: 5, 2: 3, 3: 1}


@dataclass(frozen=True)
class RatingConfig:
    """Constants of the point formulas and of the statistics built on them."""

    score_curve: tuple = CURVE_B
    prediction_curve: tuple = CURVE_A
    multipliers: tuple = tuple(RANKED_MULTIPLIERS.items())

    # point components
    pass_scale: float = 15.2
    pass_root: float = 2.62
    pass_shift: float = 30.0
    acc_scale: float = 34.0
    tech_growth: float = 1.9
    tech_scale: float = 1.08
    inflate_base: float = 650.0
    inflate_power: float = 1.3
    star_accuracy: float = 0.96
    star_divisor: float = 52.0

    # difficulty derived from a predicted accuracy, or from pass and tech
    predicted_numerator: float = 15.0
    predicted_shift: float = 0.0022
    derived_tech_slope: float = 0.0208
    derived_tech_base: float = 1.1284
    derived_span: float = 8.0
    derived_floor: float = 2.0
    derived_cross: float = 0.01

    # weight of a player's i-th best score is decay ** i
    decay: float = 0.965

    # board statistics
    high_weight: float = 0.8
    top_weight: float = 0.95
    top_rank: int = 250
    top_rank_index: int = 40
    top_share: float = 0.33
    min_top_rows: int = 10
    ratio_min_plays: int = 50
    top_min_plays: int = 75
    play_thresholds: tuple = (125, 75, 40)

    # decimals that decide the order of two scores of a board
    rank_pp_decimals: int = 2
    rank_accuracy_decimals: int = 4
    # points closer than this are one tie, settled by id: it is finer than the
    # precision points are stored with and coarser than the noise of a sum
    tie_decimals: int = 6


DEFAULT_RATING = RatingConfig()


@dataclass(frozen=True)
class SkewPolicy:
    """When a group counts as hot, and how it is split.

    A group of at most ``hot_rows`` rows is sorted by one task. A larger one is
    cut into ranges of about ``chunk_rows`` rows. ``broadcast_rows`` bounds every
    helper table that is broadcast by hint; above it the join is left to AQE.
    """

    hot_rows: int = 4_000_000
    chunk_rows: int = 2_000_000
    broadcast_rows: int = 200_000


DEFAULT_SKEW = SkewPolicy()
