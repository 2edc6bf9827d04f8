"""Extra columns keep their values, whatever they are called."""

import datetime
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyboard.llm import exact_dedup, language, mixing, near_dedup, url_lists, warc

# names that the operators use for columns of their own, or have used
HELPERS = (
    "_id _text _no _copy _key _nth _place _source _times _row_place _rows _repeats id no_id copy row others key "
    "blank nth kept_id kept_text place drawn_place drawn_source rows repeats times size part component digest "
    "chain first active_entries host blocked list pattern valid_from valid_until listed capture n title links "
    "language block record record_type content_type refers_to source_headers payload_digest a.b"
).split()
DOCS = [
    (1, "one two three four five six seven", "en", "a"),
    (1, "one two three four five six seven", "en", "a"),
    (2, "one  two three four five six seven", "en", "a"),
    (3, "quite another text of several words is this", "en", "b"),
    (4, "", "en", "b"),
    (None, "no id but some words are held here", "en", None),
]


def widened(df, names=HELPERS):
    """With a column of each name, whose values differ between rows and names."""
    own = {c.lower() for c in df.columns}
    df = df.withColumn("number", F.monotonically_increasing_id())
    for name in names:
        if name.lower() not in own:
            df = df.withColumn(name, F.concat(F.lit(f"{name}:"), F.col("number").cast("string")))
    return df


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(DOCS, "doc_id long, text string, lang string, source string").coalesce(1)
    return widened(plain).checkpoint()


@pytest.mark.parametrize(
    "stage", [exact_dedup.keep_first, near_dedup.keep_one, mixing.repeat_documents, language.keep_identified]
)
def test_stages_keep_rows_whole(spark, docs, stage):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    kept = stage(docs)
    assert kept.columns == docs.columns
    rows = list(map(tuple, kept.collect()))
    assert rows and set(rows) <= set(map(tuple, docs.collect()))
    assert Counter(rows) == Counter(map(tuple, stage(docs).collect()))
    assert stage(docs.limit(0)).count() == 0


def test_one_of_repeated_rows_stays(docs):
    first = min(r.number for r in docs.collect() if r.doc_id == 1)
    assert [r.number for r in near_dedup.keep_one(docs).collect() if r.doc_id == 1] == [first]
    kept = {r.doc_id: r.number for r in exact_dedup.keep_first(docs).collect()}
    assert 1 not in kept and kept[2] == 2


def test_verdicts_beside_columns_of_their_names(spark):
    day = datetime.date(2024, 1, 5)
    plain = spark.createDataFrame(
        [(1, "http://bad.org/x", day), (2, "http://good.org", day), (2, "http://good.org", day), (3, None, None)],
        "page int, url string, fetched_on date",
    )
    valid = spark.createDataFrame(
        [("l", "bad.org", day, None)], "list string, pattern string, valid_from date, valid_until date"
    )
    wide = widened(plain).checkpoint()
    found = url_lists.evaluate(wide, valid)
    assert found.columns == [*wide.columns, *(f"_{c}" for c in url_lists.VERDICT)]
    rows = found.collect()
    assert sorted(r[: len(wide.columns)] for r in map(tuple, rows)) == sorted(map(tuple, wide.collect()))
    assert [(r["page"], r["_host"], r["_list"]) for r in rows if r["_blocked"]] == [(1, "bad.org", "l")]
    assert url_lists.evaluate(plain, valid).columns == [*plain.columns, *url_lists.VERDICT]


def test_records_beside_columns_of_their_names(spark):
    plain = spark.createDataFrame(
        [("<r:1>", "http://a/", "d", "H: 1\r\n", "<title>t</title><p>x"), (None, None, None, None, None)],
        "record_id string, target_uri string, warc_date string, headers string, payload string",
    ).coalesce(1)
    wide = widened(plain, [*HELPERS, "text"]).checkpoint()
    others = [c for c in wide.columns if c not in plain.columns]
    rows = warc.derive(wide).collect()
    for name in others:
        assert Counter(r[name] for r in rows) == Counter({r[name]: 2 for r in wide.collect()})
    blocks = Counter(r.block for r in warc.derive(plain).collect())
    assert Counter(r["_block"] for r in rows) == blocks
    assert warc.derive(plain).columns == list(warc.RECORD)
