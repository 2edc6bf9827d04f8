"""Quality scores: random Fourier features over document statistics.

A pass over whole texts takes some twenty statistics of each: shares of kinds of
characters, word and line lengths, repetition. Random Fourier features of the
standardised statistics approximate a Gaussian kernel; tasks sum the normal equations
of their labelled rows, and the sum is solved with a ridge. Isotonic regression on
labelled rows that the ridge didn't see turns its output into the share of label 1.

Edge cases: null and empty texts have statistics of their own (no characters) and are
scored like any other. Labels other than 0 and 1 and labels without a document are
left out; a document with both labels counts once with each. Without labels of both
kinds every score is the share of label 1 (0.5 without any). Ties in the ridge's
output share a score. Repeated documents each get their score. Extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm import words
from tallyboard.llm.language import held_out
from tallyboard.session import materialise

#: Random features.
FEATURES = 256
#: Labelled documents the model is fitted on, drawn by a hash if there are more.
LABELLED = 200_000
RIDGE = 1e-2
THRESHOLD = 0.7
SEED = 23
#: Tasks that sum normal equations; each sends one matrix.
SUM_TASKS = 8
#: Part of the score that keeps the ridge's order where the calibration is flat.
ORDER_SHARE = 1e-3

_KINDS = {
    "lower": (*range(97, 123), *range(128, 256)),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "blank": (32,),
    "other space": (9, 10, 11, 12, 13),
    "sentence": (33, 39, 44, 46, 58, 59, 63),  # ! ' , . : ; ?
    "shout": (33,),
    "bar": (124,),
    "symbol": (*range(35, 39), 42, 43, 47, *range(60, 63), 64, *range(91, 97), *range(123, 127)),
    "control": (*range(0, 9), *range(14, 32), 127),
}
_KIND_TABLE = np.zeros((256, len(_KINDS)))
for _k, _members in enumerate(_KINDS.values()):
    _KIND_TABLE[list(_members), _k] = 1
STATISTICS = len(_KINDS) + 11


def statistics(texts: list[bytes]) -> np.ndarray:
    """A row of statistics per text."""
    n = len(texts)
    out = np.zeros((n, STATISTICS))
    lines = np.zeros((n, 2))
    for k, text in enumerate(texts):
        held = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
        out[k, : len(_KINDS)] = held @ _KIND_TABLE / max(1, len(text))
        parts = text.split(b"\n")
        lines[k] = len(parts), len(set(parts))
    sizes = np.array([len(t) for t in texts], np.float64)
    hashes, lengths, counts = words.hashed(texts)
    some = np.maximum(counts, 1)
    owner = np.repeat(np.arange(n), counts)
    mean = np.bincount(owner, lengths, n) / some
    spread = np.sqrt(np.maximum(np.bincount(owner, lengths**2.0, n) / some - mean**2, 0))
    # a word counts for its own text
    codes, _ = pd.factorize(hashes + owner.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    times = np.bincount(codes)
    held_by = np.zeros(len(times), np.int64)
    held_by[codes] = owner
    most = np.zeros(n)
    np.maximum.at(most, held_by, times)
    distinct = np.bincount(held_by, minlength=n)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    at = len(_KINDS)
    out[:, at : at + 11] = np.column_stack(
        [
            np.log1p(sizes),
            np.log1p(counts),
            mean,
            spread,
            distinct / some,
            np.log1p(distinct),
            most / some,
            np.bincount(owner, again, n) / some,
            np.log1p(lines[:, 0]),
            lines[:, 1] / lines[:, 0],
            np.bincount(owner, lengths > 20, n) / some,
        ]
    )
    return out


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            rows = statistics(part.column("text").to_pylist())
            values = pa.FixedSizeListArray.from_arrays(pa.array(rows.reshape(-1)), STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), values.cast(pa.list_(pa.float64()))], ["doc_id", "stats"]
            )


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and stats of every document, written once."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).cast("binary").alias("text"),
    )
    return materialise(
        texts.mapInArrow(_statistics, "doc_id long, stats array<double>"), "statistics"
    )


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, STATISTICS)


@dataclass
class Projection:
    """Standardised statistics to random Fourier features and a constant."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        plain = np.clip((rows - self.mean) / self.scale, -8, 8)
        waves = np.cos(plain @ self.frequency + self.phase) * np.sqrt(2 / len(self.phase))
        return np.column_stack([waves, np.ones(len(rows))])


def isotonic(outputs: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing step function nearest to the labels."""
    order = np.argsort(outputs, kind="stable")
    at, first = np.unique(outputs[order], return_index=True)
    mass = np.diff(np.append(first, len(order))).astype(np.float64)
    value = np.add.reduceat(labels[order].astype(np.float64), first) / mass
    blocks: list[list[float]] = []  # value, mass, lowest and highest output
    for x, m, v in zip(at, mass, value):
        blocks.append([v, m, x, x])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, m2, _, high = blocks.pop()
            v1, m1, low, _ = blocks.pop()
            blocks.append([(v1 * m1 + v2 * m2) / (m1 + m2), m1 + m2, low, high])
    points = [(x, b[0]) for b in blocks for x in ((b[2], b[3]) if b[3] > b[2] else (b[2],))]
    return np.array([p[0] for p in points]), np.array([p[1] for p in points])


@dataclass
class Model:
    projection: Projection | None
    weights: np.ndarray | None
    points: tuple[np.ndarray, np.ndarray] | None
    share: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        if self.projection is None:
            return np.full(len(rows), self.share)
        output = self.projection(rows) @ self.weights
        calibrated = np.interp(output, *self.points)
        return (1 - ORDER_SHARE) * calibrated + ORDER_SHARE * np.clip(output, 0, 1)


def _summed(rows: DataFrame, one) -> list[np.ndarray]:
    """Sums over tasks of the arrays that ``one`` makes of rows and labels."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: list[np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows:
                got = one(_matrix(batch), batch.column("quality").to_numpy())
                total = got if total is None else [a + b for a, b in zip(total, got)]
        if total is not None:
            values = np.concatenate([np.ravel(t) for t in total])
            yield pa.RecordBatch.from_arrays([pa.array([values.tolist()])], ["sums"])

    # as many arrays as SUM_TASKS, whatever the number of rows
    got = rows.repartition(SUM_TASKS).mapInArrow(sums, "sums array<double>").collect()
    return [np.array(r["sums"]) for r in got]


def fit(labelled: DataFrame, features: int = FEATURES, seed: int = SEED) -> Model:
    """The model from rows of stats, quality (0 or 1) and fold."""
    train, rest = labelled.filter("fold <> 3"), labelled.filter("fold = 3")
    kinds = {bool(r["last"]): r for r in labelled.groupBy((F.col("fold") == 3).alias("last")).agg(
        F.count("*").alias("n"), F.sum("quality").alias("good")).collect()}
    n, good = (sum(r[c] for r in kinds.values()) for c in ("n", "good"))
    if not 0 < good < n:
        return Model(None, None, None, good / n if n else 0.5)
    mixed = lambda last: last in kinds and 0 < kinds[last]["good"] < kinds[last]["n"]
    if not (mixed(True) and mixed(False)):
        train = rest = labelled
    moments = sum(_summed(train, lambda x, y: [np.array([len(x)]), x.sum(0), (x * x).sum(0)]))
    mean = moments[1 : 1 + STATISTICS] / moments[0]
    deviation = np.sqrt(np.maximum(moments[1 + STATISTICS :] / moments[0] - mean**2, 0))
    random = np.random.default_rng(seed)
    frequency = random.normal(0, np.sqrt(1 / STATISTICS), (STATISTICS, features))
    phase = random.uniform(0, 2 * np.pi, features)
    project = Projection(mean, np.where(deviation > 1e-9, deviation, 1.0), frequency, phase)

    def equations(x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z = project(x)
        return [z.T @ z, z.T @ y]

    size = features + 1
    total = sum(_summed(train, equations))
    gram, moment = total[: size * size].reshape(size, size), total[size * size :]
    weights = np.linalg.solve(gram + RIDGE * np.eye(size), moment)
    # bounded by LABELLED
    seen = rest.select("stats", "quality").toArrow()
    rows = np.array(seen.column("stats").to_pylist()).reshape(-1, STATISTICS)
    points = isotonic(project(rows) @ weights, seen.column("quality").to_numpy())
    return Model(project, weights, points, good / n)


def score(
    docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, labelled: int = LABELLED
) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    stats = document_statistics(docs)
    known = (
        labels.filter(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
        .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
        .filter("doc_id IS NOT NULL")
        .distinct()
    )
    known = materialise(known, "labels")
    share = min(1.0, labelled / max(1, known.count()))
    drawn = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    rows = materialise(stats.join(drawn, "doc_id").withColumn("fold", fold), "labelled")
    model = docs.sparkSession.sparkContext.broadcast(fit(rows))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.value.score(_matrix(batch)) if batch.num_rows else np.empty(0)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"]
            )

    out = stats.mapInArrow(scored, "doc_id long, score double")
    return out.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return score(
        spark.read.parquet(f"{sf_dir}/documents.parquet"),
        spark.read.parquet(f"{sf_dir}/labels.parquet"),
    )
