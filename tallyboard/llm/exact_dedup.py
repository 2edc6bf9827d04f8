"""Exact deduplication by an extendible-hash index on shared files.

Keys are digests of normalised texts; their rows are counted first. The directory maps the
leading bits of a key to a bucket. A bucket with more rows than it may hold is split by one
more bit, and the directory doubles when a bucket needs more bits than it has; there is no
limit to that. Documents move once, each to the task that owns its bucket. The owner sorts a
bucket by digest and whole text: equal bytes lie together, different texts of one digest form
a chain, and the row that stays is the first of its text. Nothing else compares texts, so a
document in a wrong bucket would lose its copies.

A key with more rows than a quarter of a bucket is hot and a bucket of its own: its copies are
counted within each task before anything moves, and its texts compared by grouping.

Edge cases: null texts count as empty, and empty texts are copies of each other. A null
doc_id sorts after all others. Of rows that repeat id and text, one stays. An empty table
gives an empty result. Extra columns are ignored; ``keep_first`` keeps them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm.columns import order_of, packed, unpacked
from tallyboard.session import materialise

#: Rows a bucket may hold.
BUCKET_KEYS = 16_000
#: Slots, or hot keys, that are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 1 << 18
_KEY_BITS = 60
_SPACES = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text without ASCII white space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACES, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _key(digest: Column) -> Column:
    return F.conv(F.substring(digest, 1, _KEY_BITS // 4), 16, 10).cast("long")


def _prefix(key: Column, bits: int) -> Column:
    return F.shiftright(key, _KEY_BITS - bits)


def directory(keys: DataFrame, rows: int, bucket_keys: int = BUCKET_KEYS) -> DataFrame:
    """Slots and buckets for ``keys`` (key of 60 bits, rows), which have so many rows in all.

    Returns slot, bits (of the directory), bucket (its lowest slot), depth. Starts
    with half the buckets that would hold all rows and splits what is too full.
    """
    bits = max(0, (-(-rows // bucket_keys) - 1).bit_length() - 1)
    counts = keys.groupBy(_prefix(F.col("key"), bits).alias("slot")).agg(
        F.count("*").alias("keys"), F.sum("rows").alias("rows")
    )
    spark = keys.sparkSession
    buckets = materialise(
        spark.range(1 << bits).select(F.col("id").alias("slot")).join(counts, "slot", "left").select(
            "slot", F.coalesce("keys", F.lit(0)).alias("keys"),
            F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(bits).alias("depth"),
        ),
        "buckets",
    )
    while bits < _KEY_BITS:
        too_full = (F.col("rows") > bucket_keys) & (F.col("keys") > 1)
        full = buckets.filter(too_full & (F.col("depth") == bits))
        if full.isEmpty():
            break
        # double the directory: each full bucket becomes two
        deeper = (
            keys.join(full.select(F.col("slot").alias("of")), _prefix(F.col("key"), bits) == F.col("of"))
            .groupBy(_prefix(F.col("key"), bits + 1).alias("slot"))
            .agg(F.count("*").alias("keys"), F.sum("rows").alias("rows"))
        )
        halves = full.select(
            F.explode(F.array(F.col("slot") * 2, F.col("slot") * 2 + 1)).alias("slot")
        ).join(deeper, "slot", "left").select(
            "slot", F.coalesce("keys", F.lit(0)).alias("keys"),
            F.coalesce("rows", F.lit(0)).alias("rows"), F.lit(bits + 1).alias("depth"),
        )
        rest = buckets.filter(~too_full | (F.col("depth") < bits))
        buckets = materialise(rest.unionByName(halves), "buckets")
        bits += 1
    # every slot of the directory that leads to the bucket
    span = F.pow(F.lit(2), F.lit(bits) - F.col("depth")).cast("long")
    return buckets.select(
        F.explode(F.sequence(F.col("slot") * span, (F.col("slot") + 1) * span - 1)).alias("slot"),
        F.lit(bits).alias("bits"),
        (F.col("slot") * span).alias("bucket"),
        "depth",
    )


_FOUND = (
    "doc_id", "keep_id", "group_size", "kept", "digest", "chain", "bucket", "depth", "n_chars", "text_key",
)


def _texts(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    texts = docs.select(
        "doc_id",
        normalised(F.col("text")).alias("norm"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"),
        F.xxhash64("text").alias("text_key"),
    )
    return texts.withColumn("digest", digest(F.col("norm")))


def _owned(texts: DataFrame, slots: DataFrame) -> DataFrame:
    """What the owners of the buckets find; each text goes to its bucket's task."""
    # one row per slot, as many as there are buckets or a few times more
    bits = slots.first()["bits"]
    held = slots.drop("bits")
    held = F.broadcast(held) if (1 << bits) <= BROADCAST_ROWS else held
    placed = texts.withColumn("slot", _prefix(_key(F.col("digest")), bits)).join(held, "slot").drop("slot")
    copies = Window.partitionBy("bucket", "digest", "norm")
    first = copies.orderBy(F.desc("n_chars"), F.col("doc_id").asc_nulls_last(), "text_key")
    chain = Window.partitionBy("bucket", "digest").orderBy("norm")
    return (
        placed.repartition("bucket")
        .withColumn("keep_id", F.first("doc_id").over(first))
        .withColumn("kept", F.row_number().over(first) == 1)
        .withColumn("group_size", F.count("*").over(copies))
        .withColumn("chain", F.dense_rank().over(chain) - 1)
        .select(*_FOUND)
    )


def _hot(texts: DataFrame) -> DataFrame:
    """The same for hot keys, whose copies are combined before they move."""
    each = texts.groupBy("digest", "norm").agg(F.count("*").alias("copies"))
    clashing = materialise(
        each.groupBy("digest").agg(F.count("*").alias("texts")).filter("texts > 1"), "clashing"
    )
    if clashing.isEmpty():
        rows = texts.withColumn("chain", F.lit(0))
    else:
        order = Window.partitionBy("digest").orderBy("norm")
        chains = materialise(
            each.join(clashing, "digest").select(
                "digest", "norm", (F.row_number().over(order) - 1).alias("chain")
            ),
            "chains",
        )
        rows = texts.join(chains, ["digest", "norm"], "left")
        rows = rows.withColumn("chain", F.coalesce("chain", F.lit(0)))
    # ``row`` tells apart rows that repeat an id and a text
    rows = materialise(rows.drop("norm").withColumn("row", F.monotonically_increasing_id()), "hot-rows")
    best = F.min(
        F.struct(
            (-F.col("n_chars")).alias("less"),
            F.col("doc_id").isNull().alias("no_id"),
            F.col("doc_id").alias("keep_id"),
            "text_key",
            F.col("row").alias("keep_row"),
        )
    )
    stays = rows.groupBy("digest", "chain").agg(best.alias("best"), F.count("*").alias("group_size"))
    stays = stays.select("digest", "chain", "best.keep_id", "best.keep_row", "group_size")
    return (
        rows.join(stays, ["digest", "chain"])
        .withColumns(
            {
                "kept": F.col("row") == F.col("keep_row"),
                "bucket": _key(F.col("digest")),
                "depth": F.lit(_KEY_BITS),
            }
        )
        .select(*_FOUND)
    )


def deduplicate(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    bucket_keys: int = BUCKET_KEYS,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, chain, bucket,
    depth, n_chars, text_key. The longest original text of a group stays, then the
    smallest doc_id."""
    texts = _texts(docs, digest)
    keys = materialise(
        texts.groupBy("digest").agg(F.count("*").alias("rows")).withColumn("key", _key(F.col("digest"))),
        "keys",
    )
    hot = keys.filter(F.col("rows") > max(1, bucket_keys // 4)).select("digest")
    usual = keys.filter(F.col("rows") <= max(1, bucket_keys // 4))
    slots = directory(usual, usual.agg(F.sum("rows")).first()[0] or 0, bucket_keys)
    number = hot.count()
    found = None
    if number:
        hot = F.broadcast(hot) if number <= BROADCAST_ROWS else hot
        found = _hot(texts.join(hot, "digest", "left_semi"))
        texts = texts.join(hot, "digest", "left_anti")
    owned = _owned(texts, slots)
    found = owned if found is None else owned.unionByName(found)
    return found.withColumnRenamed("digest", "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns whatever their names, one of each group.

    Of rows that repeat id and text, the one whose other columns come first as JSON stays.
    """
    kept = deduplicate(docs).filter("kept").select(
        F.coalesce("doc_id", F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("no_id"),
        F.col("text_key").alias("text"),
    )
    keyed = docs.select(
        packed(docs.columns).alias("row"),
        F.coalesce("doc_id", F.lit(-1)).alias("id"),
        F.col("doc_id").isNull().alias("no_id"),
        F.xxhash64("text").alias("text"),
        order_of(docs, ("doc_id", "text")).alias("others"),
    )
    same = Window.partitionBy("id", "no_id", "text").orderBy("others")
    return (
        keyed.join(kept, ["id", "no_id", "text"])
        .withColumn("copy", F.row_number().over(same))
        .filter("copy = 1")
        .select(*unpacked(docs.columns, "row"))
    )


QUERY_COLUMNS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return deduplicate(docs).select(*QUERY_COLUMNS)


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents),
r AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id NULLS LAST
                      ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       place = 1 AS kept, text_sha256
FROM r
"""
