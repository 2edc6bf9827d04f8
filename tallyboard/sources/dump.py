"""Dumps: documents that hold a list of players, of scores and of maps.

A dump may be one document or many. A JSON document is read by one task here, so anything
large should come as JSON lines with bounded documents (``write_dump`` makes such), or as
one Parquet table per list; ``cut.read_dump_cut`` cuts documents that are too large.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyboard.schema import DUMP_DOCUMENT
from tallyboard.session import passing_shuffles

TABLES = ("players", "scores", "maps")


def read_dump(spark: SparkSession, path: str, multi_line: bool = False) -> dict[str, DataFrame]:
    """Read JSON dump documents: one per line, or one per file.

    A document that is not valid stops the read instead of being skipped. Of a dump by
    ``write_dump`` each table reads its own folder only.
    """
    reader = spark.read.schema(DUMP_DOCUMENT).option("mode", "FAILFAST")
    return unpack_dump(reader.json(path, multiLine=multi_line))


def parse_dump(lines: DataFrame) -> dict[str, DataFrame]:
    """The same for documents that are texts in a column named ``value``."""
    parsed = F.from_json("value", DUMP_DOCUMENT, {"mode": "FAILFAST"})
    return unpack_dump(lines.withColumn("value", parsed).select("value.*", *_known(lines)))


def _known(lines: DataFrame) -> list[str]:
    return ["list"] if "list" in lines.columns else []


def unpack_dump(documents: DataFrame) -> dict[str, DataFrame]:
    """One flat table per list; an absent list is empty.

    A column ``list``, where there is one, names the only list a document holds.
    """

    def holding(table: str) -> DataFrame:
        return documents.where(F.col("list") == table) if "list" in documents.columns else documents

    return {t: holding(t).select(F.inline(t)) for t in TABLES}


def _documents(
    batches: Iterator[pa.RecordBatch], name: str, size: int
) -> Iterator[pa.RecordBatch]:
    """Documents of ``size`` rows each, in the order of a task's rows."""

    def document(rows: list[str]) -> pa.RecordBatch:
        text = f'{{"{name}":[{",".join(rows)}]}}'
        return pa.RecordBatch.from_pydict({"list": [name], "value": [text]})

    held: list[str] = []
    for batch in batches:
        held += batch.column(0).to_pylist()
        while len(held) >= size:
            yield document(held[:size])
            held = held[size:]
    if held:
        yield document(held)


def pack_dump(tables: Mapping[str, DataFrame], rows_per_document: int = 10_000) -> DataFrame:
    """Dump documents as texts in ``value``, each with rows of the table named in ``list``.

    A document holds rows that lie in one task, so none is moved or counted for it; their
    number grows with the table.
    """
    documents = None
    for name in TABLES:
        rows = tables[name].select(F.to_json(F.struct(*tables[name].columns)).alias("value"))
        packed = partial(_documents, name=name, size=rows_per_document)
        texts = rows.mapInArrow(packed, "list string, value string")
        documents = texts if documents is None else documents.unionByName(texts)
    return documents


def write_dump(
    tables: Mapping[str, DataFrame], path: str, rows_per_document: int = 10_000
) -> None:
    """Write a dump as JSON lines that ``read_dump`` reads back, one folder per list."""
    documents = pack_dump(tables, rows_per_document)
    with passing_shuffles(documents.sparkSession):
        documents.write.partitionBy("list").text(path)
