"""Searching names through an index of their letter triples.

The index has a row (triple, id) for each distinct run of three characters in a lower-cased
name. It is written once, when the names are published, in ranges of (triple, id): a common
triple spans several files, and a search reads the row groups of the triples it asks for. Ids
that hold all of them are candidates; the plain predicate of ``pages`` decides about them.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.plans import pages

LENGTH = 3


def triples(df: DataFrame, column: str = "name") -> DataFrame:
    """(triple, id) of the lower-cased names; names of fewer characters and null have none."""
    name = F.lower(column)
    starts = F.when(F.length(name) >= LENGTH, F.sequence(F.lit(1), F.length(name) - (LENGTH - 1)))
    parts = F.transform(starts, lambda start: F.substr(name, start, F.lit(LENGTH)))
    return df.select(F.explode(F.array_distinct(parts)).alias("triple"), "id")


def write_index(df: DataFrame, path: str, column: str = "name") -> None:
    """Store the index of ``df`` below ``path``, sorted so that a triple is few row groups."""
    rows = triples(df, column).repartitionByRange("triple", "id")
    rows.sortWithinPartitions("triple", "id").write.parquet(path)


def read_index(df: DataFrame, path: str) -> DataFrame:
    """The stored index of ``df``."""
    spark = df.sparkSession
    return spark.read.schema(triples(df.select("id", F.lit("").alias("name"))).schema).parquet(path)


def asked(text: str, literal: bool) -> list[str]:
    """Triples every match of ``text`` holds: enough to cover its stretches without wildcards.

    Empty when no stretch has three characters.
    """
    text = text.lower()
    found = []
    for part in [text] if literal else re.split("[%_]", text):
        last = len(part) - LENGTH
        if last >= 0:
            found += [part[at : at + LENGTH] for at in (*range(0, last, LENGTH), last)]
    return list(dict.fromkeys(found))


def search(boards: DataFrame, index: DataFrame, text: str | None, literal: bool = False) -> DataFrame:
    """``pages.search_contains`` if ``literal``, else ``pages.search_like``, by the index.

    A text without three characters in a row is searched by a scan. How the candidates meet the
    boards is left to Catalyst and AQE: a common text may have as many as there are boards.
    """
    plain = pages.search_contains if literal else pages.search_like
    wanted = asked(text, literal) if text else []
    if not wanted:
        return plain(boards, text)
    postings = index.where(F.col("triple").isin(wanted))
    if len(wanted) > 1:
        held = postings.groupBy("id").agg(F.count_distinct("triple").alias("held"))
        postings = held.where(F.col("held") == len(wanted))
    return plain(boards.join(postings.select("id"), "id", "left_semi"), text)
