"""Dump documents of any size, cut between the elements of their lists.

A document is an object of lists of objects; a file may hold one huge one or many. Files
are read as text that ends at every ``}``, so that Spark splits them wherever it likes. Such
a piece does not know whether it starts within a string or how deep it is nested. Both are
running sums: of quotes, and of brackets outside strings. A task reads the pieces of its
splits in order and sums them as they come; a first read brings the sums of each split, and
the second starts from those of earlier splits, of which there is one row each. Pieces that
start at the level of a list begin an element; those after it belong to it.

The text is read twice and does not move, but for the elements that lie in several splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.schema import DUMP_DOCUMENT
from tallyboard.session import materialise

_IN_LIST = 2  # an object and a list are open
_OUTERMOST = re.compile(r"^\s*\{", re.ASCII)
_LIST_NAME = re.compile(r'"([^"\\]*)"\s*:\s*\[', re.ASCII)


# what a byte of a text is to the scan; others are skipped
_QUOTE, _OPENING, _CLOSING, _BACKSLASH = 1, 2, 3, 4
_KINDS = np.zeros(256, np.int8)
_KINDS[[ord(c) for c in '"{[]\\']] = _QUOTE, _OPENING, _OPENING, _CLOSING, _BACKSLASH

# a scan takes some times the bytes of its text, so about this much text at once
_SCANNED = 8 * 1024 * 1024


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(_file, _block, _size, value): pieces in the order of their split."""
    text = spark.read.option("lineSep", "}").option("recursiveFileLookup", "true").text(path)
    return text.select(
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.col("_metadata.file_size").alias("_size"),
        "value",
    )


def _plain(at: np.ndarray, kind: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """Which marks are no backslashes and not escaped by one; pieces begin at ``starts``."""
    begins = np.zeros(size + 1, bool)
    begins[starts] = True
    slashes = at[kind == _BACKSLASH]
    first = np.flatnonzero(np.append(True, np.diff(slashes) != 1) | begins[slashes])
    lengths = np.diff(np.append(first, len(slashes)))
    after = (slashes[first] + lengths)[lengths % 2 == 1]
    escaped = np.zeros(size + 1, bool)
    escaped[after[~begins[after]]] = True
    return (kind != _BACKSLASH) & ~escaped[at]


def _scan(texts: pa.StringArray, quotes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per piece its quotes, and how much deeper it ends if its split starts outside or inside a
    string. ``quotes`` are those of the split before the first piece."""
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]]
    kinds = _KINDS[data]
    at = np.flatnonzero(kinds)
    kind = kinds[at]
    if (kind == _BACKSLASH).any():
        plain = _plain(at, kind, starts, len(data))
        at, kind = at[plain], kind[plain]
    # marks before each piece begins and ends
    begin, end = np.searchsorted(at, starts), np.searchsorted(at, ends)
    counted = _before(kind == _QUOTE, quotes)
    steps = (kind == _OPENING).astype(np.int64) - (kind == _CLOSING)
    inside = counted[1:] % 2 == 1

    def change(counts: np.ndarray, closes: np.ndarray) -> np.ndarray:
        depth = _before(np.where(counts, steps, 0), 0)
        return depth[end] - depth[begin] - closes

    ends_inside = counted[end] % 2 == 1
    return counted[end] - counted[begin], change(~inside, ~ends_inside), change(inside, ends_inside)


def _stretches(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """The parts of a batch that are in one split each and not large, and which split."""
    files = batch.column("_file").dictionary_encode().indices.to_numpy()
    blocks = batch.column("_block").to_numpy()
    cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
    ends = np.append(cuts, len(blocks))
    most = max(1, len(blocks) * _SCANNED // max(1, batch.nbytes))
    for begin, end in zip(np.append(0, cuts).tolist(), ends.tolist()):
        for first in range(begin, end, most):
            split = batch.column("_file")[first].as_py(), int(blocks[first])
            yield split, batch.slice(first, min(most, end - first))


def _before(sums: np.ndarray, start: int) -> np.ndarray:
    """The sum before each row, and after the last."""
    return start + np.append(0, np.cumsum(sums))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per batch and split: its sums, were the split to start outside or inside a string."""
    split, quotes, part = None, 0, 0
    for batch in batches:
        for found, rows in _stretches(batch):
            if found != split:
                split, quotes, part = found, 0, 0
            texts = rows.column("value")
            found_quotes, outside, inside = (int(n.sum()) for n in _scan(texts, quotes))
            yield pa.RecordBatch.from_pydict(
                {
                    "_file": [split[0]],
                    "_block": [split[1]],
                    "_size": [rows.column("_size")[0].as_py()],
                    "_part": [part],
                    "quotes": [found_quotes],
                    "outside": [outside],
                    "inside": [inside],
                    "bytes": [pc.sum(pc.binary_length(texts)).as_py() + len(texts)],
                    "last": [texts[-1].as_py()],
                }
            )
            quotes, part = quotes + found_quotes, part + 1


_SUMS = (
    "_file string, _block long, _size long, _part long, quotes long, outside long, inside long,"
    " bytes long, last string"
)


def _blocks(pieces: DataFrame) -> DataFrame:
    """One row per split: whether it starts inside a string, and how deep.

    A file whose brackets do not close, or whose last piece is not blank where it lacks the
    ``}`` that every piece is taken to have, stops the read.
    """
    sums = pieces.mapInArrow(_sums, _SUMS).groupBy("_file", "_block").agg(
        *[F.sum(c).alias(c) for c in ("quotes", "outside", "inside", "bytes")],
        F.max_by("last", "_part").alias("last"),
        F.max("_size").alias("size"),
    )
    file = Window.partitionBy("_file")
    before = file.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def earlier(column: str) -> Column:
        return F.coalesce(F.sum(column).over(before), F.lit(0))

    sums = sums.withColumn("_starts_inside", earlier("quotes") % 2 == 1)
    sums = sums.withColumn("change", F.when(F.col("_starts_inside"), F.col("inside")).otherwise(F.col("outside")))
    # the last piece of a file that does not end in } was given one
    added = F.sum("bytes").over(file) - F.col("size")
    last = F.max_by("last", "_block").over(file)
    closed = (F.sum("change").over(file) + added == 0) & (
        (added == 0) | ((added == 1) & (F.trim(F.regexp_replace(last, r"\s", "")) == ""))
    )
    stop = F.raise_error(F.concat(F.lit("not a whole document: "), F.col("_file")))
    depth = F.when(closed, earlier("change")).otherwise(stop.cast("bigint"))
    return sums.select("_file", "_block", "_starts_inside", depth.alias("_starts_at"))


class _Split:
    """What a task knows of the split it reads, between two batches."""

    def __init__(self, rows: pa.RecordBatch) -> None:
        self.file, self.block = rows.column("_file")[0].as_py(), rows.column("_block")[0].as_py()
        self.quotes = int(rows.column("_starts_inside")[0].as_py())
        self.depth = rows.column("_starts_at")[0].as_py()
        self.list: str | None = None  # of the last element, if it began here
        self.begun = False
        self.text: list[str] | None = []  # of the element that is open; None if it is none

    def begin(self, text: str, depth: int) -> None:
        if depth == 0:  # the outermost object opens in the piece of its first element
            text = _OUTERMOST.sub("", text, count=1)
        head, brace, body = text.partition("{")
        if "[" in head:
            names = _LIST_NAME.findall(head)
            self.list = names[-1] if names else self.list
        self.begun, self.text = True, [brace + body] if brace else None

    def row(self, kind: str, text: str | None) -> tuple:
        return self.file, self.block, kind, self.list, text

    def take(self, rows: pa.RecordBatch) -> Iterator[tuple]:
        quotes, change, _ = _scan(rows.column("value"), self.quotes)
        depth = _before(change, self.depth)
        texts = rows.column("value").to_pylist()
        begins = np.flatnonzero(depth[:-1] <= _IN_LIST).tolist()
        self.extend(texts[: begins[0] if begins else len(texts)])
        for begin, end in zip(begins, [*begins[1:], len(texts)]):
            yield from self.close()
            self.begin(texts[begin] + "}", int(depth[begin]))
            self.extend(texts[begin + 1 : end])
        self.quotes, self.depth = self.quotes + int(quotes.sum()), int(depth[-1])

    def extend(self, texts: list[str]) -> None:
        if self.text is not None:
            self.text += [text + "}" for text in texts]

    def close(self) -> Iterator[tuple]:
        """The element before the one that begins, or what the split starts with."""
        if not self.begun:
            if self.text:
                yield self.row("rest", "".join(self.text))
        elif self.text is not None:
            yield self.row("whole", "".join(self.text))

    def end(self) -> Iterator[tuple]:
        if self.begun and self.depth > _IN_LIST:
            yield self.row("open", None if self.text is None else "".join(self.text))
        else:
            yield from self.close()
        yield self.row("end", None)


_CUT = {"_file": pa.string(), "_block": pa.int64(), "kind": pa.string(), "list": pa.string(), "element": pa.string()}


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The elements of each split: ``whole`` ones, the ``open`` one it ends in and the ``rest``
    of one it starts in; at its ``end`` the last list that was named in it."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [()] * len(_CUT)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, kind) for c, kind in zip(columns, _CUT.values())], names=list(_CUT)
        )

    split, held = None, None
    for batch in batches:
        found: list[tuple] = []
        for key, rows in _stretches(batch):
            if key != split:
                found += held.end() if held else ()
                split, held = key, _Split(rows)
            found += held.take(rows)
        yield table(found)
    if held:
        yield table(list(held.end()))


def _elements(pieces: DataFrame) -> DataFrame:
    """(list, element): the texts of the elements and the names of their lists."""
    # a row per split of the text, so a millionth of it
    blocks = F.broadcast(materialise(_blocks(pieces), "dump-splits"))
    known = pieces.join(blocks, ["_file", "_block"], "left")
    # other splits than at the first read, as when executors came between
    stop = F.raise_error(F.concat(F.lit("split anew between two reads: "), F.col("_file")))
    known = known.withColumn("_starts_at", F.coalesce("_starts_at", stop.cast("bigint")))
    cut = known.mapInArrow(_cut, "_file string, _block long, kind string, list string, element string")
    cut = materialise(cut, "dump-pieces")

    # what a split goes on with is what the last earlier one left open
    kind = F.col("kind")
    ends = cut.where(kind.isin("end", "open")).groupBy("_file", "_block").agg(
        F.max(F.when(kind == "end", F.col("list"))).alias("list"),
        F.bool_or(kind == "open").alias("open"),
    )
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.when(F.col("open"), F.col("_block"))
    carried = ends.select(
        "_file",
        "_block",
        F.last(opened, ignorenulls=True).over(earlier).alias("_from"),
        F.last("list", ignorenulls=True).over(earlier).alias("_named"),
    )
    carried = F.broadcast(materialise(carried, "dump-ends"))
    split = ["_file", "_block"]
    parts = cut.where(kind.isin("open", "rest")).join(carried, split)
    parts = parts.withColumn("list", F.coalesce("list", "_named"))
    joined = parts.select(
        "_file",
        F.when(kind == "open", F.col("_block")).otherwise(F.col("_from")).alias("_element"),
        F.when(kind == "open", F.col("list")).alias("list"),
        F.struct("_block", "element").alias("piece"),
    )
    grouped = joined.groupBy("_file", "_element").agg(
        F.max("list").alias("list"),
        F.array_sort(F.collect_list("piece")).alias("pieces"),
        F.bool_or(F.col("piece.element").isNull()).alias("none"),
    )
    across = materialise(
        grouped.where(~F.col("none")).select(
            "list", F.array_join(F.col("pieces.element"), "").alias("element")
        ),
        "dump-elements",
    )
    # apart, so that a reader of one list skips the row groups that hold others
    whole = cut.where(kind == "whole")
    named = whole.where("list is not null").select("list", "element")
    unnamed = whole.where("list is null").drop("list").join(carried, split)
    unnamed = unnamed.select(F.col("_named").alias("list"), "element")
    return named.unionByName(unnamed).unionByName(across)


def read_dump_cut(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """``dump.read_dump`` of documents that need not fit in one task.

    An element does; it is parsed whole. Lists of other names are left out, and text that
    is not JSON stops the read. Files are UTF-8 without a byte order mark.
    """
    elements = _elements(_pieces(spark, path))

    def table(name: str) -> DataFrame:
        kind = DUMP_DOCUMENT[name].dataType.elementType
        parsed = F.from_json("element", kind, {"mode": "FAILFAST"}).alias("row")
        return elements.where(F.col("list") == name).select(parsed).select("row.*")

    return {field.name: table(field.name) for field in DUMP_DOCUMENT}
