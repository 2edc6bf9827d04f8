"""Competitive-score analytics on Spark: rating, ranking and leaderboard statistics."""

from tallyboard.config import DEFAULT_RATING, RatingConfig, SkewPolicy

__all__ = ["DEFAULT_RATING", "RatingConfig", "SkewPolicy"]
