"""The queries of this subpackage and the SQL that some must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tallyboard.llm import (
    conversations,
    exact_dedup,
    fingerprints,
    language,
    mixing,
    near_dedup,
    neighbours,
    packing,
    quality,
    runs,
    token_files,
    url_lists,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_language": language.query,
        "op2_quality": quality.query,
        "op3_fingerprints": fingerprints.query,
        "op4_packing": packing.query,
        "op5_url_lists": url_lists.query,
        "op6_mixing": mixing.query,
        "op7_exact_dedup": exact_dedup.query,
        "op8_near_dedup": near_dedup.query,
        "op9_warc_derivatives": warc.query,
        "op10_token_files": token_files.query,
        "op11_conversations": conversations.query,
        "op12_runs": runs.query,
        "op13_neighbours": neighbours.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_lists": url_lists.SQL,
        "op6_mixing": mixing.SQL,
        "op7_exact_dedup": exact_dedup.SQL,
        "op9_warc_derivatives": warc.SQL,
        "op11_conversations": conversations.SQL,
        "op13_neighbours": neighbours.SQL,
    }
