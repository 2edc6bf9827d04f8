"""Document fingerprints from prefix polynomial hashes.

The prefix array of a text holds the polynomial hash of every prefix, under two
bases modulo 2**31 - 1. The hash of any span follows from two of its entries, so
equality of spans costs a few operations and the longest common extension of two
places is found by binary search. A fingerprint holds the number of code points, the
hash of the whole text, and for each of 128 slots 39 bits of the least of the mixed
hashes of all spans of 6 code points that fall in the slot (in texts below 48 code
points, of all shorter spans too). Spans are hashed under both bases, so that in long
texts neither spans nor least hashes agree by chance. A span's second occurrence is a span of its own, and so on.
Equal texts have equal fingerprints; the share of equal slots estimates the share of
spans that two texts have in common.

Each document meets the next one, by ascending id, in ranges of ids: a range is one
sorted partition, and the first document of a range is also sent to the range before
it (that of the first range to the last). Whole texts move once.

Edge cases: a null text counts as empty; a null doc_id comes first; documents with
one id are ordered by a hash of their texts. Rows that repeat an id and a text are
one document and all get its result. A single document is its own next one. Empty
texts have no spans: they equal each other and are unlike all others. An empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyboard.llm import ranges

MODULUS = (1 << 31) - 1
BASES = (1_000_003_133, 748_391_207)
SPAN = 6
SHORT = 48
SLOTS = 128
#: Bits kept of a slot's least hash; the empty mark is the first number beyond them.
VALUE_BITS = 39
_SLOT_BITS = SLOTS.bit_length() - 1
_MIX = np.uint64(0x9E3779B97F4A7C15)
_TIMES = np.uint64(0xA0761D6478BD642F)
_OF_LENGTH = np.arange(SPAN, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
_EMPTY = 1 << VALUE_BITS


def _fold(x: np.ndarray) -> np.ndarray:
    """x modulo 2**31 - 1 for x below 2**62."""
    x = (x & np.uint64(MODULUS)) + (x >> np.uint64(31))
    x = (x & np.uint64(MODULUS)) + (x >> np.uint64(31))
    return np.where(x == MODULUS, np.uint64(0), x)


class _Powers:
    """Powers of a base, and of its inverse, as far as they were needed."""

    def __init__(self, base: int):
        self.steps = (base, pow(base, -1, MODULUS))
        self.tables = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

    def get(self, n: int, inverse: bool = False) -> np.ndarray:
        table = self.tables[inverse]
        while len(table) < n:
            step = np.uint64(pow(self.steps[inverse], len(table), MODULUS))
            table = np.concatenate((table, _fold(table * step)))
        self.tables[inverse] = table
        return table[:n]


_POWERS = [_Powers(base) for base in BASES]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Prefixes:
    """Prefix hashes of one text."""

    def __init__(self, codes: np.ndarray):
        self.size = len(codes)
        own = codes.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for powers in _POWERS:
            sums = np.zeros(self.size + 1, np.uint64)
            np.cumsum(_fold(own * powers.get(self.size)), out=sums[1:])
            self.sums.append(_fold(sums))

    def span(self, start: int, end: int) -> int:
        """The hash of text[start:end], wherever it stands."""
        out = 0
        for sums, powers in zip(self.sums, _POWERS):
            raw = (int(sums[end]) - int(sums[start])) % MODULUS
            back = int(powers.get(start + 1, True)[start])
            out = out << 31 | raw * back % MODULUS
        return out

    def spans(self, length: int) -> np.ndarray:
        """The hashes of all spans of a length, under both bases."""
        out = np.zeros(self.size + 1 - length, np.uint64)
        for sums, powers in zip(self.sums, _POWERS):
            raw = sums[length:] + np.uint64(MODULUS) - sums[: self.size + 1 - length]
            own = _fold(_fold(raw) * powers.get(self.size + 1 - length, True))
            out = out << np.uint64(31) | own
        return out

    def whole(self) -> int:
        return self.span(0, self.size)


def same_span(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    return a.span(i, i + length) == b.span(j, j + length)


def common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """How far two texts agree from two places on."""
    low, high = 0, min(a.size - i, b.size - j)
    while low < high:
        middle = (low + high + 1) // 2
        if same_span(a, i, b, j, middle):
            low = middle
        else:
            high = middle - 1
    return low


def sketch(prefixes: Prefixes) -> np.ndarray:
    """The least mixed span hash in each slot."""
    slots = np.full(SLOTS, _EMPTY, np.uint64)
    if not prefixes.size:
        return slots
    longest = min(SPAN, prefixes.size)
    lengths = range(1 if prefixes.size < SHORT else longest, longest + 1)
    hashes = np.sort(
        np.concatenate([prefixes.spans(n) + _OF_LENGTH[n % SPAN] for n in lengths])
    )
    # the k-th time a span occurs counts as a span of its own
    places = np.arange(len(hashes), dtype=np.uint64)
    begins = np.concatenate(([True], hashes[1:] != hashes[:-1]))
    times = places - np.maximum.accumulate(np.where(begins, places, np.uint64(0)))
    mixed = (hashes + np.uint64(1) + times * _TIMES) * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(29))) * _MIX
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    keys = np.sort(mixed >> np.uint64(64 - _SLOT_BITS - VALUE_BITS))
    width = np.uint64(VALUE_BITS)
    firsts = np.searchsorted(keys, np.arange(SLOTS, dtype=np.uint64) << width)
    held = firsts[firsts < len(keys)]
    found = keys[held]
    slot = (found >> width).astype(np.int64)
    # a slot without spans finds the first key of a later one
    value = found & np.uint64(_EMPTY - 1)
    own = slot == np.flatnonzero(firsts < len(keys))
    slots[slot[own]] = value[own]
    return slots


class Fingerprint:
    """Number of code points, hash of the whole text, sketch of its spans."""

    def __init__(self, prefixes: Prefixes):
        self.key = (prefixes.size, prefixes.whole())
        self.slots = sketch(prefixes)

    def __str__(self) -> str:
        # five bytes a slot
        slots = self.slots.astype(">u8").view(np.uint8).reshape(SLOTS, 8)[:, 3:]
        return f"{self.key[0]:x}-{self.key[1]:016x}-{slots.tobytes().hex()}"

    def likeness(self, other: Fingerprint) -> float:
        """1 for equal texts, else the share of slots with the same span."""
        if self.key == other.key:
            return 1.0
        either = (self.slots != _EMPTY) | (other.slots != _EMPTY)
        both = either & (self.slots == other.slots)
        return float(both.sum()) / max(1, int(either.sum()))


_ROWS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
        ("common_prefix", pa.int64()),
    ]
)
_ROWS_DDL = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string,"
    " edited_fingerprint string, near_edited double, near_next double, common_prefix long"
)


class _Document:
    def __init__(self, doc_id, text: str):
        self.doc_id, self.text, self.rows = doc_id, text, 0
        self.prefixes = Prefixes(code_points(text))
        self.fingerprint = Fingerprint(self.prefixes)

    def result(self, following: _Document) -> tuple:
        n = len(self.text)
        replaced = n // 4
        text = self.text[: n - replaced] + following.text[:replaced]
        edited = Prefixes(code_points(text))
        print_ = Fingerprint(edited)
        return (
            self.doc_id,
            n,
            hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
            str(self.fingerprint),
            str(print_),
            self.fingerprint.likeness(print_),
            self.fingerprint.likeness(following.fingerprint),
            common_extension(self.prefixes, 0, edited, 0),
        )


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows of whole ranges, each followed by the first document after it."""
    last, at, out = None, None, []
    for batch in batches:
        places, guests = batch.column("range").to_pylist(), batch.column("guest").to_pylist()
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        for k, (place, guest) in enumerate(zip(places, guests)):
            text = texts[k].as_py()
            if place != at:
                last, at = None, place
            if not guest and last is not None and (last.doc_id, last.text) == (ids[k], text):
                last.rows += 1
                continue
            document = _Document(ids[k], text)
            if last is not None and last.rows:
                out += [last.result(document)] * last.rows
            # a guest only ends its range; its other copies find nothing to end
            document.rows = 0 if guest else 1
            last = document
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*out), _ROWS)], schema=_ROWS
            )
            out = []


def compare_with_next(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, common_prefix."""
    cuts = ranges.bounds(docs)
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        ranges.order_key().alias("key"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"),
    )
    # the first document of each range: one small row per shuffle partition
    firsts = rows.select("key", "text_key").withColumn(
        "range", ranges.range_of(F.col("key"), cuts)
    ).groupBy("range").agg(F.min(F.struct("key", "text_key")).alias("first"))
    found = sorted((r["range"], r["first"]["key"], r["first"]["text_key"]) for r in firsts.collect())
    # goes to the range before its own as well; the very first to the last
    visits = [
        (key, text_key, found[k - 1][0]) for k, (_, key, text_key) in enumerate(found)
    ]
    spark = docs.sparkSession
    visits = spark.createDataFrame(visits, "key long, text_key long, visits int")
    placed = rows.withColumn("own", ranges.range_of(F.col("key"), cuts)).join(
        F.broadcast(visits), ["key", "text_key"], "left"
    )
    stays = F.struct(F.col("own").alias("range"), F.lit(False).alias("guest"))
    visit = F.struct(F.col("visits").alias("range"), F.lit(True).alias("guest"))
    dealt = placed.select(
        "doc_id", "text", "key", "text_key",
        F.inline(F.when(F.col("visits").isNull(), F.array(stays)).otherwise(F.array(stays, visit))),
    )
    return (
        dealt.repartitionById(len(cuts) + 1, "range")
        .sortWithinPartitions("range", "guest", "key", "text_key")
        .select("range", "guest", "doc_id", "text")
        .mapInArrow(_compare, _ROWS_DDL)
    )


def query(spark, sf_dir: str) -> DataFrame:
    return compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
