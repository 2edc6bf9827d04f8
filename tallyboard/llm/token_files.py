"""Token ids in files of word-aligned Simple-8b code.

A 64-bit word holds a selector of 4 bits and as many ids as fit into the other 60 in
equal widths. Values of more than 60 bits are escapes: the word holds a place in the
block's table of whole values. Ids are cut into blocks of a fixed number; a segment
lists the first word of each block, so blocks, and all words of one selector, decode
as arrays.

A file is a Parquet table of segments, written by Spark: ``range`` and ``seq`` order
them, ``first`` counts the ids before a segment in its range, ``payload`` is the
segment. Spark's commit makes the files safe against lost executors, and they can be
in any store Spark writes to. A document is never cut; segments hold documents in
ascending doc_id order.

Edge cases: a null text is an empty one and has only the end id. A null doc_id comes
first. Rows that repeat an id are ordered by a hash of their text; each is a document
of its own. An empty table makes no segments. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm import ranges, tokens
from tallyboard.session import new_path

BLOCK_IDS = 1024
#: A segment is closed at this many ids.
SEGMENT_IDS = 1 << 19
END_ID = 0

MAGIC = b"TS8B\x01\0\0\0"
_HEADER = struct.Struct("<8sIIQQQ")  # magic, block ids, blocks, documents, ids, escapes
# ids per word and bits per id of each selector but the last, which is the escape
_COUNT = np.array([240, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1], np.int64)
_BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60], np.uint64)
_ESCAPE = 15


def pack_words(values: np.ndarray, block: int = BLOCK_IDS):
    """Words, the first word of each block (and the end), and the escaped values."""
    n = len(values)
    blocks = -(-n // block)
    if not blocks:
        return np.empty(0, np.uint64), np.zeros(1, np.uint64), np.empty(0, np.uint64)
    width = block + int(_COUNT.max())
    grid = np.zeros((blocks, width), np.uint64)
    for k in range(blocks):
        part = values[k * block : (k + 1) * block]
        grid[k, : len(part)] = part
    flat = grid.reshape(-1)
    escaped = flat >= np.uint64(1 << 60)
    escapes = flat[escaped]
    # the widest selector that may start at each place: runs of narrow values
    choice = np.full(len(flat), 14, np.int8)
    for selector in range(13, -1, -1):
        narrow = flat < np.uint64(1 << int(_BITS[selector]))
        run, have, want = narrow, 1, int(_COUNT[selector])
        while have < want:
            step = min(have, want - have)
            run = run[:-step] & run[step:]
            have += step
        choice[: len(run)][run] = selector
    choice[escaped] = _ESCAPE
    choice = choice.reshape(blocks, width)
    # all blocks take a word at a time
    lengths = np.full(blocks, block)
    lengths[-1] = n - (blocks - 1) * block
    at, rows, starts, owners, picks = np.zeros(blocks, np.int64), np.arange(blocks), [], [], []
    while len(rows):
        here = at[rows]
        pick = choice[rows, here]
        starts.append(rows * width + here)
        owners.append(rows)
        picks.append(pick)
        at[rows] = here + _COUNT[pick]
        rows = rows[at[rows] < lengths[rows]]
    start, pick = np.concatenate(starts), np.concatenate(picks).astype(np.int64)
    order = np.argsort(start, kind="stable")
    start, pick = start[order], pick[order]
    words = pick.astype(np.uint64) << np.uint64(60)
    where = np.cumsum(escaped) - 1
    for selector in np.unique(pick):
        of = np.flatnonzero(pick == selector)
        if selector == _ESCAPE:
            words[of] |= where[start[of]].astype(np.uint64)
            continue
        for k in range(int(_COUNT[selector]) if _BITS[selector] else 0):
            words[of] |= flat[start[of] + k] << (_BITS[selector] * np.uint64(k))
    firsts = np.searchsorted(start, np.arange(blocks + 1) * width).astype(np.uint64)
    return words, firsts, escapes


def unpack_words(words, firsts, escapes, n: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The values that ``pack_words`` got; any run of blocks can be decoded alone."""
    blocks = len(firsts) - 1
    if not blocks:
        return np.empty(0, np.uint64)
    pick = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[pick]
    after = np.cumsum(counts)
    places = after - counts
    out = np.empty(int(after[-1]), np.uint64)
    body = words & np.uint64((1 << 60) - 1)
    for selector in np.unique(pick):
        of = np.flatnonzero(pick == selector)
        if selector == _ESCAPE:
            out[places[of]] = escapes[body[of].astype(np.int64)]
            continue
        bits = _BITS[selector]
        mask = np.uint64((1 << int(bits)) - 1)
        for k in range(int(_COUNT[selector])):
            out[places[of] + k] = (body[of] >> (bits * np.uint64(k))) & mask if bits else 0
    begin = places[firsts[:-1].astype(np.int64)]
    lengths = np.full(blocks, block)
    lengths[-1] = n - (blocks - 1) * block
    before = np.cumsum(lengths) - lengths
    return out[np.repeat(begin - before, lengths) + np.arange(n)]


def encode_segment(doc_ids: Sequence[int | None], documents: Sequence[np.ndarray]) -> bytes:
    """Documents' ids as one segment."""
    values = np.concatenate(documents).astype(np.uint64) if documents else np.empty(0, np.uint64)
    words, firsts, escapes = pack_words(values)
    head = _HEADER.pack(
        MAGIC, BLOCK_IDS, len(firsts) - 1, len(documents), len(values), len(escapes)
    )
    return b"".join(
        [
            head,
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([len(d) for d in documents], "<u8").tobytes(),
            firsts.astype("<u8").tobytes(),
            escapes.astype("<u8").tobytes(),
            words.astype("<u8").tobytes(),
        ]
    )


def decode_segment(payload: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """doc_ids and the ids of each document."""
    magic, block, blocks, docs, n, n_escapes = _HEADER.unpack_from(payload)
    if magic != MAGIC:
        raise ValueError("not a segment of token ids")
    at = _HEADER.size

    def take(dtype: str, count: int) -> np.ndarray:
        nonlocal at
        part = np.frombuffer(payload, dtype, count, at)
        at += part.nbytes
        return part

    ids, nulls, lengths = take("<i8", docs), take("u1", docs), take("<u8", docs)
    firsts, escapes = take("<u8", blocks + 1), take("<u8", n_escapes)
    words = take("<u8", int(firsts[-1]) if blocks else 0)
    values = unpack_words(words, firsts, escapes, n, block)
    cut = np.split(values, np.cumsum(lengths.astype(np.int64))[:-1]) if docs else []
    return [None if no else int(d) for d, no in zip(ids, nulls)], cut


_SEGMENTS = pa.schema(
    [
        ("range", pa.int32()),
        ("seq", pa.int32()),
        ("first", pa.int64()),
        ("n_docs", pa.int64()),
        ("n_ids", pa.int64()),
        ("payload", pa.binary()),
    ]
)
_SEGMENTS_DDL = "range int, seq int, first long, n_docs long, n_ids long, payload binary"
_DOCS_DDL = "range int, doc_id long, start_in_range long, n_tokens long, ids_crc32 long"


def _writer(path: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(path)
        end = np.array([end_id], np.uint32)
        at, seq, first, held, ids, documents = None, 0, 0, 0, [], []

        def segment():
            return pa.RecordBatch.from_pylist(
                [
                    {
                        "range": at,
                        "seq": seq,
                        "first": first,
                        "n_docs": len(ids),
                        "n_ids": held,
                        "payload": encode_segment(ids, documents),
                    }
                ],
                schema=_SEGMENTS,
            )

        for batch in batches:
            encoded = encode.many(batch.column("text").to_pylist())
            for place, doc_id, own in zip(
                batch.column("range").to_pylist(), batch.column("doc_id").to_pylist(), encoded
            ):
                if ids and (place != at or held >= SEGMENT_IDS):
                    yield segment()
                    seq, first, held, ids, documents = seq + 1, first + held, 0, [], []
                if place != at:
                    at, seq, first = place, 0, 0
                ids.append(doc_id)
                documents.append(np.concatenate((own, end)))
                held += len(own) + 1
        if ids:
            yield segment()

    return write


def write_files(docs: DataFrame, out: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode whole texts and write them to ``out`` in ascending doc_id order."""
    cuts = ranges.bounds(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.xxhash64("text").alias("text_key"),
        ranges.range_of(ranges.order_key(), cuts).alias("range"),
    )
    dealt = rows.repartitionById(len(cuts) + 1, "range").sortWithinPartitions(
        "range", ranges.order_key(), "text_key"
    )
    dealt.mapInArrow(_writer(tokenizer, end_id), _SEGMENTS_DDL).write.parquet(out)


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids, documents = decode_segment(row["payload"])
            sizes = np.array([len(d) for d in documents], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["range"]] * len(ids), pa.int32()),
                    pa.array(ids, pa.int64()),
                    pa.array(row["first"] + np.cumsum(sizes) - sizes, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(d.astype("<u4").tobytes()) for d in documents], pa.int64()),
                ],
                ["range", "doc_id", "start_in_range", "n_tokens", "ids_crc32"],
            )


def read_files(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files."""
    segments = spark.read.schema(_SEGMENTS_DDL).parquet(path)
    # one number per range, of which there are as many as shuffle partitions
    totals = sorted(segments.groupBy("range").agg(F.sum("n_ids")).collect())
    starts, so_far = [], 0
    for place, held in totals:
        starts.append((place, so_far))
        so_far += held
    before = spark.createDataFrame(starts, "range int, before long")
    documents = segments.select("range", "first", "payload").mapInArrow(_reader, _DOCS_DDL)
    return documents.join(F.broadcast(before), "range").select(
        "doc_id",
        (F.col("before") + F.col("start_in_range")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = new_path(spark, "token-files")
    write_files(docs, out, public_tokenizers.path("byte_bpe_50k.json"))
    return read_files(spark, out)
