"""Note scores, podium points and decay weights."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyboard.config import PODIUM_POINTS

# Points of one note, and the combo levels as
# (notes before the level, note multiplier in the level).
NOTE_POINTS = 115
COMBO_LEVELS = ((0, 1), (1, 2), (5, 4), (13, 8))


def max_score_for_note(count: Column) -> Column:
    """Best possible score after ``count`` notes, with a rising combo multiplier.

    Each level adds the step of its multiplier for every note past its start, so
    one sum over the levels covers all cases.
    """
    total, before = None, 0
    for start, multiplier in COMBO_LEVELS:
        step = (multiplier - before) * F.greatest(count - start, F.lit(0))
        if total is None:
            step = multiplier * count
        total = step if total is None else total + step
        before = multiplier
    return total * NOTE_POINTS


def score_for_rank(rank: Column) -> Column:
    """Podium points of a rank; 0 off the podium and for a missing rank."""
    points = F.lit(0)
    for place, value in PODIUM_POINTS.items():
        points = F.when(rank == place, F.lit(value)).otherwise(points)
    return points


def update_rank_score(old_score: Column, old_rank: Column, new_rank: Column) -> Column:
    """Replace the points of the old rank (if there was one) by the new rank's."""
    return old_score - score_for_rank(old_rank) + score_for_rank(new_rank)


def decay_weight(index: Column, decay: float) -> Column:
    """Weight of the 0-based ``index``-th best score."""
    return F.pow(F.lit(decay), index.cast("double"))
