"""Mixing sources to target weights by capped water-filling.

Every source gets a share of all words by its weight, but no more than a number of
epochs of its own words; what a capped source can't take goes to the others by
weight. With sources sorted by cap over weight, the level at which all words are
given out has a closed form. Each document is repeated as often as the whole epochs
say; the fraction is a seeded sample of whole documents: in the order of a hash,
until the words are reached, with the last document in if that comes nearer.

Edge cases: null texts have no words, a null source is a source of its own and the
last one, rows that repeat a document are drawn one by one, an empty table gives an
empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm.columns import order_of, packed, unpacked
from tallyboard.session import materialise

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Times a source may be used.
MAX_EPOCHS = 3
SEED = 17
_WORDS = r"[^\x20\x09-\x0D]+"
# hexadecimal digits of the hash that group documents; a source has 16 to this power
# groups, and only one of them needs to be sorted
_DIGITS = 3


def _place(seed: int) -> Column:
    """A seeded hash of id and text, as hexadecimal digits."""
    return F.md5(
        F.concat_ws(
            ":",
            F.lit(str(seed)),
            F.coalesce(F.col("doc_id").cast("string"), F.lit("-")),
            F.md5(F.coalesce("text", F.lit("")).cast("binary")),
        ).cast("binary")
    )


def sizes(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size in words, place (a seeded hash) and part of each document."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORDS)).cast("long")
    return docs.select(
        "doc_id", "source", size.alias("size"), _place(seed).alias("place")
    ).withColumn("part", F.substring("place", 1, _DIGITS))


def targets(
    words: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS
) -> DataFrame:
    """source, source_size, target for a table of source and source_size.

    A row per source; the windows over all of them see nothing else.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(
        F.array(*[F.lit(int(w)) for w in weights]),
        ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"),
    )
    by_level = Window.partitionBy(F.lit(0)).orderBy("fills", F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    level = (
        F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0))
    ).cast("double") / F.sum("weight").over(onward).cast("double")
    ranked = (
        words.withColumn("weight", weight.cast("long"))
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("fills", F.col("cap").cast("double") / F.col("weight").cast("double"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("own_level", level)
        .withColumn("open", F.col("fills") > F.col("own_level"))
    )
    # the level of the first source that isn't filled holds for all later ones
    shared = F.min(F.when(F.col("open"), F.struct("fills", F.col("source").isNull(), "source", "own_level"))).over(everything)
    return ranked.withColumn("shared", shared["own_level"]).select(
        "source",
        "source_size",
        F.when(F.col("open"), F.col("weight") * F.col("shared"))
        .otherwise(F.col("cap").cast("double"))
        .alias("target"),
    )


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats, taken, place per document."""
    sized = materialise(sizes(docs, seed), "sizes")
    parts = materialise(
        sized.groupBy("source", "part").agg(F.sum("size").alias("part_size")), "parts"
    )
    goal = targets(
        parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, max_epochs
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    goal = goal.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    so_far = Window.partitionBy("source").orderBy("part")
    upto = F.sum("part_size").over(so_far)
    plan = (
        parts.withColumn("upto", upto)
        .withColumn("before", F.col("upto") - F.col("part_size"))
        .join(goal.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
        .select(
            F.col("source").alias("_source"),
            F.col("part").alias("_part"),
            "source_size",
            "target",
            "whole",
            "rest",
            "before",
            (F.col("upto") <= F.col("rest")).alias("inside"),
            ((F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest"))).alias("edge"),
        )
    )
    # by source and part: the parts of a large source go to many tasks
    planned = sized.join(
        plan,
        (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")),
    ).drop("_part", "_source")
    order = Window.partitionBy("source").orderBy("place", "doc_id", "size")
    after = F.col("before") + F.sum("size").over(
        order.rowsBetween(Window.unboundedPreceding, 0)
    )
    edge = planned.filter("edge").withColumn(
        "extra", (2 * after - F.col("size") <= 2 * F.col("rest")).cast("int")
    )
    rest = planned.filter("NOT edge").withColumn("extra", F.col("inside").cast("int"))
    repeats = F.col("whole") + F.col("extra")
    return rest.unionByName(edge).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        repeats.alias("repeats"),
        (F.col("size") * repeats).alias("taken"),
        "place",
    )


def repeat_documents(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents, all columns whatever their names, each as often as the mix takes it.

    Rows that repeat id, text and source share the sum of their repeats evenly, the first by
    their other columns as JSON taking what is left over.
    """
    mixed = mix(docs, **options)
    seed = options.get("seed", SEED)
    drawn = mixed.groupBy(F.col("place").alias("drawn_place"), F.col("source").alias("drawn_source")).agg(
        F.count("*").alias("rows"), F.sum("repeats").alias("repeats")
    )
    keyed = docs.select(
        packed(docs.columns).alias("row"),
        _place(seed).alias("place"),
        "source",
        order_of(docs, ("doc_id", "text", "source")).alias("others"),
    )
    nth = Window.partitionBy("drawn_place", "drawn_source").orderBy("others")
    share = F.floor(F.col("repeats") / F.col("rows")) + (
        F.col("nth") <= F.col("repeats") % F.col("rows")
    ).cast("long")
    return (
        keyed.join(
            drawn,
            (F.col("place") == F.col("drawn_place"))
            & F.col("source").eqNullSafe(F.col("drawn_source")),
        )
        .withColumn("nth", F.row_number().over(nth))
        .withColumn("times", share.cast("int"))
        .filter("times > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select(*unpacked(docs.columns, "row"))
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('{SEED}:' || coalesce(doc_id::VARCHAR, '-') || ':' || md5(coalesce(text, ''))) AS place
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, source_size * {MAX_EPOCHS} AS cap, sum(source_size) OVER ()::BIGINT AS total,
             [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
      FROM s),
f AS (SELECT *, cap::DOUBLE / weight::DOUBLE AS fills FROM w),
l AS (SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY fills, source NULLS LAST
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                / (sum(weight) OVER (ORDER BY fills, source NULLS LAST
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS own_level
      FROM f),
t AS (SELECT source, source_size,
             CASE WHEN fills > own_level
                  THEN weight * first_value(own_level) OVER (
                         ORDER BY fills <= own_level, fills, source NULLS LAST)
                  ELSE cap::DOUBLE END AS target
      FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole
      FROM t),
c AS (SELECT d.*, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY place, doc_id, size
                             ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target,
       (size * (whole + CASE WHEN 2 * upto - size <= 2 * rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
