"""Whole jobs and read queries, composed of the operators."""
