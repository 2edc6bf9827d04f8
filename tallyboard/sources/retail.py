"""A score database read from retail tables (customer, part, orders, lineitem).

Order lines stand for scores, customers for players, parts for maps. Every row of
every table takes part, and lines that repeat a key stay scores of their own. Boards
follow the parts, except that the lines of every fourth order meet on a few hot
boards; order customers are folded so that a few players hold many scores. Some names,
avatars and covers are longer than allowed, and some scores have no date.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyboard.schema import DUMP_FAMILIES, RATING_FIELDS

HOT_BOARDS = 20
# the n-th line of a key has its id this much above the first one's
_REPEAT = 1 << 40


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def line_id(order: str = "l_orderkey", line: str = "l_linenumber") -> Column:
    return F.col(order) * 8 + F.col(line)


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as they come, with the id the first of each key has as a score."""
    return _table(spark, folder, "lineitem").withColumn("id", line_id())


def scores(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as dump scores. Lines of one key are numbered by all their columns."""
    # numbered and joined where the lines of an order lie, after one shuffle
    lineitem = _table(spark, folder, "lineitem").repartition("l_orderkey")
    key = ["l_orderkey", "l_linenumber"]
    values = [
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_tax",
        "l_returnflag",
        "l_linestatus",
        "l_shipdate",
    ]
    same = Window.partitionBy(*key).orderBy(*values)
    numbered = lineitem.withColumn("repeat", F.row_number().over(same) - 1)
    orders = _table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_custkey"
    )
    customer, line = F.col("o_custkey"), F.col("l_linenumber")
    quantity, tax = F.col("l_quantity"), F.col("l_tax")
    player = (
        F.when(customer % 3 == 0, customer % 30)
        .when(customer % 3 == 1, customer % 300)
        .otherwise(customer)
    )
    accuracy = (
        F.when((quantity == 50) & (tax == 0), 0.0)
        .when((quantity == 1) & (tax == 0), 1.01)
        .otherwise(F.lit(1.0) - (F.col("l_discount") * 2 + quantity / 1000.0 + tax / 4))
    )
    modifiers = (
        F.when(line == 1, "")
        .when(line == 2, "FS")
        .when(line == 3, "SS")
        .when(line == 4, "SF,GN")
        .when(line == 5, "NA,NB")
        .when(line == 6, "fs")
        .otherwise(F.when(F.col("l_linestatus") == "O", "NF").otherwise("BFS"))
    )
    epoch = F.expr("timestamp_ntz'1970-01-01 00:00:00'")
    seconds = F.timestamp_diff("SECOND", epoch, F.col("l_shipdate").cast("timestamp_ntz"))
    return (
        numbered.join(orders, "l_orderkey")
        .withColumn("accuracy", accuracy)
        .select(
            (line_id() + F.col("repeat") * _REPEAT).alias("id"),
            F.when(F.col("l_orderkey") % 4 == 0, F.col("l_partkey") % HOT_BOARDS)
            .otherwise(F.col("l_partkey"))
            .cast("string")
            .alias("leaderboard_id"),
            "accuracy",
            modifiers.alias("modifiers"),
            player.cast("string").alias("player_id"),
            F.when(F.col("l_orderkey") % 89 == 7, 0).otherwise(seconds).alias("timepost"),
            (F.col("l_returnflag") == "R").alias("fc"),
            F.least(F.lit(1.0), F.col("accuracy") + 0.005).alias("fc_acc"),
        )
    )


def players(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as dump players; every twentieth has no country."""
    country = F.when(
        F.col("c_custkey") % 20 != 7, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))
    )
    key = F.col("c_custkey")
    avatar = F.concat(F.lit("avatars/"), key.cast("string"), F.lit(".png"))
    return _table(spark, folder, "customer").select(
        F.when(key % 61 == 17, F.repeat("c_name", 4)).otherwise(F.col("c_name")).alias("name"),
        country.alias("country"),
        key.cast("string").alias("id"),
        F.when(key % 71 == 5, F.repeat(avatar, 10)).otherwise(avatar).alias("avatar"),
    )


def maps(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as dump maps, some without ratings or modifier ratings."""
    key, size = F.col("p_partkey"), F.col("p_size")
    rated = _table(spark, folder, "part").select(
        "*",
        F.when(size % 11 != 0, F.lit(4.0) + size / 5.0).alias("acc_rating"),
        F.when(size % 13 != 0, F.lit(1.0) + (key % 23) * 0.5).alias("pass_rating"),
        ((key % 17) * 0.6).alias("tech_rating"),
        F.when(key % 3 == 0, F.lit(0.95) + size / 1000.0).alias("predicted_acc"),
    )
    acc, passing = (F.coalesce(F.col(c), F.lit(0.0)) for c in ("acc_rating", "pass_rating"))
    tech = F.col("tech_rating")
    by_code = {
        "FS": (acc * 1.2 + 0.5, passing * 1.2, tech * 1.1),
        "SS": (acc * 0.8, passing * 0.7, tech * 0.9),
        "SF": (acc * 1.4 + 1.0, passing * 1.5, tech * 1.2),
        "BFS": (acc * 1.1 + 0.25, passing * 1.1, tech * 1.05),
        "BSF": (acc * 1.3 + 0.75, passing * 1.3, tech * 1.15),
    }

    def family(code: str) -> Column:
        place = DUMP_FAMILIES.index(code) + 1
        values = dict(zip(("acc_rating", "pass_rating", "tech_rating"), by_code[code]))
        values["predicted_acc"] = F.lit(0.9) + tech / 200 + place / 100
        values["stars"] = acc + place / 4
        return F.struct(*[values[f].alias(f) for f in RATING_FIELDS]).alias(code)

    cover = F.concat(F.lit("covers/"), F.md5("p_name"), F.lit(".jpg"))
    return rated.select(
        F.md5(F.concat("p_name", key.cast("string"))).alias("hash"),
        F.concat("p_name", F.lit(" "), "p_type").alias("name"),
        F.when(key % 59 == 13, F.repeat(cover, 4)).otherwise(cover).alias("cover_image"),
        F.col("p_brand").alias("mapper"),
        key.cast("string").alias("id"),
        F.floor(key / 5).cast("string").alias("song_id"),
        F.col("p_type").alias("mode_name"),
        F.col("p_brand").alias("difficulty_name"),
        "acc_rating",
        "pass_rating",
        "tech_rating",
        "predicted_acc",
        F.when(key % 4 != 0, F.struct(*[family(c) for c in DUMP_FAMILIES])).alias(
            "modifiers_rating"
        ),
    )


def dump(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The three tables of a dump."""
    return {
        "players": players(spark, folder),
        "scores": scores(spark, folder),
        "maps": maps(spark, folder),
    }
