"""Packing by lexical retrieval: neighbours by BM25 fill each seed's window.

Every task packs the documents of its input split, shard by shard; nothing is
shuffled. Whole windows of a long document become sequences of their own. What is
left of each document waits in its shard, whose inverted index over token ids holds
all its documents with BM25 weights. A window starts with a seed and takes the unused
documents in the order of their scores for all ids of the seed until it is full; the
last one is cut, and its rest waits on. Only if no unused document shares an id with
the seed, the next one in input order follows. The end id, which all documents have,
is not looked up. What doesn't fill a window goes on to the task's next shard. At the
end of the task it is cut into sequences of powers of two, so nothing is padded.

Edge cases: a null text counts as empty and has only the end id. Null or repeated
doc_ids are documents of their own. Very long texts are cut. An empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm import tokens

WINDOW = 4096
END_ID = 2
#: Characters of text in a shard; the index of a shard takes a few times as many bytes.
SHARD_CHARS = 12_000_000
#: Neighbours of a seed that are put in order at first; more are if they don't fill it.
FIRST_LOT = 32
K1, B = 1.2, 0.75

_PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
_PIECES_DDL = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long,"
    " sequence_id long, offset long"
)


class Index:
    """BM25 postings of one shard."""

    def __init__(self, documents: list[np.ndarray]):
        n = len(documents)
        terms, counts = zip(*(np.unique(d, return_counts=True) for d in documents))
        self.terms = terms
        owner = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in terms])
        term, count = np.concatenate(terms), np.concatenate(counts)
        order = np.argsort(term, kind="stable")
        self.documents = owner[order]
        term, count = term[order], count[order].astype(np.float32)
        top = int(term[-1]) + 1 if len(term) else 0
        self.starts = np.searchsorted(term, np.arange(top + 1))
        self.held = np.diff(self.starts)
        self.idf = np.log1p((n - self.held + 0.5) / (self.held + 0.5)).astype(np.float32)
        sizes = np.array([len(d) for d in documents], np.float32)
        scale = K1 * (1 - B + B * sizes / max(sizes.mean(), 1))
        self.weights = self.idf[term] * count * (K1 + 1) / (count + scale[self.documents])
        self.kept = n

    def drop_used(self, unused: np.ndarray) -> None:
        """Forget the postings of used documents once they are a quarter of those held.
        Weights stay as they are."""
        left = int(unused.sum())
        if 4 * left > 3 * self.kept:
            return
        stay = unused[self.documents]
        self.starts = np.concatenate(([0], np.cumsum(stay)))[self.starts]
        self.documents, self.weights, self.kept = self.documents[stay], self.weights[stay], left

    def best_first(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """The documents unused at the call that share an id with the seed, best score
        first, then in input order."""
        own = self.terms[seed]
        own = own[self.held[own] > 1]
        if not len(own):
            return
        parts = [slice(a, b) for a, b in zip(self.starts[own].tolist(), self.starts[own + 1].tolist())]
        scores = np.bincount(
            np.concatenate([self.documents[part] for part in parts]),
            np.concatenate([self.weights[part] for part in parts]),
            len(unused),
        )
        rest = np.flatnonzero(unused & (scores > 0))
        scores, lot = scores[rest], FIRST_LOT
        # a few at a time, as a window seldom takes all of them
        while len(rest):
            if lot < len(rest):
                least = -np.partition(-scores, lot - 1)[lot - 1]
                now = scores >= least
            else:
                now = np.ones(len(rest), bool)
            yield from rest[now][np.argsort(-scores[now], kind="stable")].tolist()
            rest, scores, lot = rest[~now], scores[~now], 4 * lot

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        """All of ``best_first``."""
        return list(self.best_first(seed, unused))


class Packer:
    """Packs one task's documents. Calls ``place`` with every piece."""

    def __init__(self, first_sequence: int, place):
        self.sequence = first_sequence
        self.place = place

    def _close(self) -> None:
        self.sequence += 1

    def shard(self, waiting: list[tuple], last: bool) -> list[tuple]:
        """Pack (doc_id, ids, start) and return what doesn't fill a window."""
        rest = []
        for doc in waiting:
            doc_id, ids, start = doc
            while len(ids) - start >= WINDOW:
                self.place(doc, start, WINDOW, self.sequence, 0)
                self._close()
                start += WINDOW
            if start < len(ids):
                rest.append((doc_id, ids, start))
        left = sum(len(ids) - start for _, ids, start in rest)
        if left < WINDOW:
            return self._finish(rest) if last else rest
        index = Index([ids[:-1] for _, ids, _ in rest])
        starts = [start for _, _, start in rest]
        unused = np.ones(len(rest), bool)
        seed = 0
        while left >= WINDOW:
            while not unused[seed]:
                seed += 1
            filled, next_up, queue = 0, seed, iter([seed])
            asked = False
            while filled < WINDOW:
                k = next(queue, None)
                if k is None and not asked:
                    index.drop_used(unused)
                    queue, asked = index.best_first(seed, unused), True
                    continue
                if k is None:
                    while not unused[next_up]:
                        next_up += 1
                    k = next_up
                if not unused[k]:
                    continue
                doc = rest[k]
                length = min(len(doc[1]) - starts[k], WINDOW - filled)
                self.place(doc, starts[k], length, self.sequence, filled)
                filled += length
                starts[k] += length
                unused[k] = starts[k] < len(doc[1])
            self._close()
            left -= WINDOW
        rest = [(d, ids, s) for (d, ids, _), s, u in zip(rest, starts, unused) if u]
        return self._finish(rest) if last else rest

    def _finish(self, rest: list[tuple]) -> list[tuple]:
        """Cut less than a window into sequences of powers of two."""
        left, room, offset = sum(len(ids) - start for _, ids, start in rest), 0, 0
        for doc in rest:
            _, ids, start = doc
            while start < len(ids):
                if not room:
                    room, offset = 1 << (left.bit_length() - 1), 0
                    self._close()
                length = min(len(ids) - start, room)
                self.place(doc, start, length, self.sequence, offset)
                start, offset, room, left = start + length, offset + length, room - length, left - length
        self._close()
        return []


def _packing(path: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        columns: list[list] = [[] for _ in _PIECES]
        end = np.array([END_ID], np.uint32)

        def place(doc, start, length, sequence, offset) -> None:
            doc_id, ids, _ = doc
            crc = zlib.crc32(ids[start : start + length].data)
            for column, value in zip(
                columns, (doc_id, start, length, crc, len(ids), sequence, offset)
            ):
                column.append(value)

        def pieces() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _PIECES)], schema=_PIECES
            )
            for column in columns:
                column.clear()
            return out

        packer = Packer(TaskContext.get().partitionId() << 40, place)
        waiting: list[tuple] = []
        chars = 0
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            texts = batch.column("text")
            for at in range(0, len(ids), 512):
                part = texts.slice(at, 512).to_pylist()
                for doc_id, own in zip(ids[at : at + 512], encode.many(part)):
                    waiting.append((doc_id, np.concatenate((own, end)), 0))
                chars += sum(map(len, part))
                if chars >= SHARD_CHARS:
                    waiting, chars = packer.shard(waiting, False), 0
                    yield pieces()
        packer.shard(waiting, True)
        if columns[0]:
            yield pieces()

    return pack


def pack(docs: DataFrame, tokenizer: str) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return texts.mapInArrow(_packing(tokenizer), _PIECES_DDL)


def pack_documents(docs: DataFrame) -> DataFrame:
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
