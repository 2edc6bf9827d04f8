"""URL filters: captures against dated lists, as of the day they were fetched.

List entries come as dated events (added, removed). They become validity intervals,
and a capture is held against the entries of its host and all parent domains that
were valid on its day. The entry of the longest domain decides, then the later one.
Hosts repeat, so hosts and days are joined once each and the verdict goes back to the
captures by both, which also spreads a host that holds many captures.

Edge cases: a null url, one without a host, or a null day is never blocked. A
removal on the day of an addition wins. Repeated events count once; removals without
an addition change nothing; repeated captures each get their verdict. Empty tables
give empty results or unblocked captures. Extra columns are kept; where a capture has a column
named like one of the verdict, the verdict's gets an underscore in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyboard.llm.columns import free, packed, unpacked

VERDICT = ("host", "blocked", "list", "pattern", "valid_from", "active_entries")

def host(url: Column) -> Column:
    """Lower-case host of an absolute http or https URL, without user and port."""
    found = F.regexp_extract(url, r"^[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.when(found != "", F.rtrim(F.lower(found), F.lit(".")))


def intervals(events: DataFrame) -> DataFrame:
    """list, pattern, valid_from, valid_until (null: open) from list, pattern, action, day."""
    known = (F.col("day").isNotNull()) & F.col("pattern").isNotNull()
    entry = Window.partitionBy("list", "pattern").orderBy("day")
    return (
        events.filter(known & F.col("action").isin("add", "remove"))
        # 'remove' sorts after 'add' and wins the day
        .groupBy("list", "pattern", "day")
        .agg(F.max("action").alias("action"))
        .withColumn("was", F.coalesce(F.lag("action").over(entry), F.lit("remove")))
        .filter("action <> was")
        .withColumn("valid_until", F.lead("day").over(entry))
        .filter("action = 'add'")
        .select("list", "pattern", F.col("day").alias("valid_from"), "valid_until")
    )


def _parents(name: Column) -> Column:
    """The host itself and every domain above it."""
    labels = F.split(name, r"\.")
    return F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."),
    )


def evaluate(captures: DataFrame, valid: DataFrame) -> DataFrame:
    """Captures (url, fetched_on, others) with host, blocked, list, pattern, valid_from
    and active_entries."""
    result = free(VERDICT, captures.columns)
    own = captures.select(
        packed(captures.columns).alias("capture"), host(F.col("url")).alias("host"), "fetched_on"
    )
    asked = (
        own.select("host", "fetched_on").distinct().filter("host IS NOT NULL AND fetched_on IS NOT NULL")
    )
    names = asked.withColumn("pattern", F.explode(_parents(F.col("host"))))
    active = names.join(
        valid.select("list", F.col("pattern").alias("listed"), "valid_from", "valid_until"),
        (F.col("pattern") == F.col("listed"))
        & (F.col("valid_from") <= F.col("fetched_on"))
        & (F.col("valid_until").isNull() | (F.col("fetched_on") < F.col("valid_until"))),
    )
    first = F.max(
        F.struct(F.length("pattern").alias("n"), "valid_from", "list", "pattern")
    ).alias("first")
    verdicts = active.groupBy("host", "fetched_on").agg(
        first, F.count("*").alias("active_entries")
    )
    verdict = {
        "host": F.col("host"),
        "blocked": F.col("first").isNotNull(),
        "list": F.col("first.list"),
        "pattern": F.col("first.pattern"),
        "valid_from": F.col("first.valid_from"),
        "active_entries": F.coalesce("active_entries", F.lit(0)),
    }
    return own.join(verdicts, ["host", "fetched_on"], "left").select(
        *unpacked(captures.columns, "capture"),
        *[verdict[name].alias(result[name]) for name in VERDICT],
    )


def _share(text: Column, at: int) -> Column:
    """A number below 65536 from an md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), at, 4), 16, 10).cast("int")


def page_captures(pages: DataFrame) -> DataFrame:
    """Pages with the day they count as fetched."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page_id") * 37) % 366).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_on"))


def page_events(pages: DataFrame) -> DataFrame:
    """Dated lists over the pages' own hosts: some hosts come, go and come back on
    list 'hosts'; some domains of two labels come on list 'domains'."""
    hosts = pages.select(host(F.col("url")).alias("pattern")).filter("pattern IS NOT NULL").distinct()
    start = F.lit("2024-01-01").cast("date")
    first = F.date_add(start, _share(F.col("pattern"), 5) % 200)
    day = lambda k: F.date_add(first, F.lit(k))
    by_host = hosts.filter(_share(F.col("pattern"), 1) % 4 == 0).select(
        F.lit("hosts").alias("list"),
        "pattern",
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(action).alias("action"), day(k).alias("day"))
                    for action, k in (("add", 0), ("remove", 60), ("add", 120), ("add", 130))
                ]
            )
        ),
    )
    by_domain = (
        hosts.select(F.substring_index("pattern", ".", -2).alias("pattern"))
        .distinct()
        .filter(_share(F.col("pattern"), 9) % 8 == 0)
        .select(
            F.lit("domains").alias("list"),
            "pattern",
            F.lit("add").alias("action"),
            F.date_add(start, _share(F.col("pattern"), 13) % 300).alias("day"),
        )
    )
    return by_host.unionByName(by_domain)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return evaluate(page_captures(pages), intervals(page_events(pages))).drop("url")


SQL = r"""
WITH p AS (
  SELECT page_id, DATE '2024-01-01' + ((page_id * 37) % 366)::INT AS fetched_on,
         nullif(rtrim(lower(regexp_extract(url,
           '^[Hh][Tt][Tt][Pp][Ss]?://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '.'), '') AS host
  FROM pages),
h AS (SELECT DISTINCT host AS pattern, md5(host) AS m FROM p WHERE host IS NOT NULL),
a AS (SELECT 'hosts' AS list, pattern,
             DATE '2024-01-01' + (('0x' || substr(m, 5, 4))::INT % 200) AS first
      FROM h WHERE ('0x' || substr(m, 1, 4))::INT % 4 = 0),
g AS (SELECT DISTINCT array_to_string(list_slice(string_split(pattern, '.'), -2, -1), '.') AS pattern FROM h),
v AS (SELECT list, pattern, first AS valid_from, first + 60 AS valid_until FROM a
      UNION ALL SELECT list, pattern, first + 120, NULL FROM a
      UNION ALL SELECT 'domains', pattern,
             DATE '2024-01-01' + (('0x' || substr(md5(pattern), 13, 4))::INT % 300), NULL
      FROM g WHERE ('0x' || substr(md5(pattern), 9, 4))::INT % 8 = 0),
j AS (SELECT p.page_id, v.list, v.pattern, v.valid_from,
             row_number() OVER (PARTITION BY p.page_id
               ORDER BY length(v.pattern) DESC, v.valid_from DESC, v.list DESC) AS k,
             count(*) OVER (PARTITION BY p.page_id) AS n
      FROM p JOIN v ON (p.host = v.pattern OR suffix(p.host, '.' || v.pattern))
       AND v.valid_from <= p.fetched_on AND (v.valid_until IS NULL OR p.fetched_on < v.valid_until))
SELECT p.page_id, p.fetched_on, p.host, j.page_id IS NOT NULL AS blocked, j.list, j.pattern,
       j.valid_from, coalesce(j.n, 0) AS active_entries
FROM p LEFT JOIN j ON p.page_id = j.page_id AND j.k = 1
"""
