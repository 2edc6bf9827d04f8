"""WARC derivatives: metadata and plain-text conversion records from responses.

Each response gives a metadata record and a conversion record. Both refer to the
response by its record id, keep its target, date, source headers and payload digest,
and carry digests of their own. Record ids are made from the response's id, so a
rerun makes the same records. Everything is one pass without a shuffle.

Edge cases: a null payload counts as empty; a null url gives a null target and no
header line; responses without a record id get one from their target, date and
payload. Rows that repeat a response repeat its records. An empty table gives an
empty result. Extra columns are kept; where the source has one named like a column of
the records, that of the records gets an underscore in front.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyboard.llm.columns import free, packed, unpacked

CRLF = "\r\n"
RECORD = (
    "refers_to", "target_uri", "warc_date", "source_headers", "source_payload_digest", "record_type",
    "content_type", "block", "record_id", "block_digest", "content_length", "record",
)
#: What conversion records say of the way they were made.
CONVERTER = "markup removed; script, style and comments dropped"

# Elements that end a line of text, and entities.
_BREAKS = (
    "address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr|li|main"
    "|nav|ol|option|p|pre|section|table|title|td|th|tr|ul"
)
_ENTITIES = (
    ("&nbsp;", " "),
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&amp;", "&"),
)
# patterns that both Spark's and DuckDB's expressions read alike
_DROP = (
    r"(?s)<!--.*?-->",
    r"(?is)<script[ \t\r\n>/].*?</script[ \t\r\n]*>",
    r"(?is)<style[ \t\r\n>/].*?</style[ \t\r\n]*>",
)
_BREAK = rf"(?i)</?(?:{_BREAKS})(?:[ \t\r\n/][^<>]*)?>"
_TAG = r"</?[A-Za-z!][^<>]*>"


def plain_text(html: Column) -> Column:
    """The text of a page, a line per block."""
    text = html
    for pattern in _DROP:
        text = F.regexp_replace(text, pattern, " ")
    text = F.regexp_replace(text, _BREAK, "\n")
    text = F.regexp_replace(text, _TAG, "")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    return F.regexp_replace(F.regexp_replace(text, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def _uuid(text: Column) -> Column:
    digits = F.md5(text.cast("binary"))
    cuts = [F.substring(digits, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _sha256(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def responses(pages: DataFrame) -> DataFrame:
    """Response records of pages: page_id, record_id, target_uri, warc_date, headers, payload."""
    html = F.coalesce("html", F.lit(""))
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(html).cast("string"),
        F.lit(CRLF),
    )
    return pages.select(
        "page_id",
        _uuid(F.concat_ws("|", F.lit("response"), F.col("page_id").cast("string"), "url")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.concat(
            F.date_format(
                F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("page_id") * 37) % 366).cast("int")),
                "yyyy-MM-dd",
            ),
            F.lit("T00:00:00Z"),
        ).alias("warc_date"),
        headers.alias("headers"),
        F.col("html").alias("payload"),
    )


def derive(source: DataFrame) -> DataFrame:
    """Two records per response (record_id, target_uri, warc_date, headers, payload, others)."""
    others = [c for c in source.columns if c not in
              ("record_id", "target_uri", "warc_date", "headers", "payload")]
    payload = F.coalesce("payload", F.lit(""))
    fallback = _uuid(F.concat_ws("|", F.lit("response"), "target_uri", "warc_date", payload))
    result = free(RECORD, others)
    rows = source.select(
        packed(others).alias("others"),
        F.coalesce("record_id", fallback).alias("refers_to"),
        "target_uri",
        "warc_date",
        F.coalesce("headers", F.lit("")).alias("source_headers"),
        _sha256(payload).alias("source_payload_digest"),
        plain_text(payload).alias("text"),
        F.regexp_extract(payload, r"(?is)<title[^<>]*>(.*?)</title", 1).alias("title"),
        F.regexp_extract(payload, r"""(?i)<html[^<>]*[ \t\r\n]lang=["']?([A-Za-z-]+)""", 1).alias("language"),
        F.regexp_count(payload, F.lit(r"(?i)<a[ \t\r\n][^<>]*href")).alias("links"),
    )
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    fields = F.concat(
        line("title", F.regexp_replace("title", r"[ \t\r\n]+", " ")),
        line("language", F.col("language")),
        line("outlinks", F.col("links").cast("string")),
        line("text-length", F.length("text").cast("string")),
        F.col("source_headers"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("record_type"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("record_type"), F.lit("text/plain; charset=utf-8").alias("content_type"), F.col("text").alias("block")),
    )
    records = (
        rows.select("others", "refers_to", "target_uri", "warc_date", "source_headers",
                    "source_payload_digest", F.inline(kinds))
        .withColumn("record_id", _uuid(F.concat_ws("|", "record_type", "refers_to")))
        .withColumn("block_digest", _sha256(F.col("block")))
        .withColumn("content_length", F.octet_length("block").cast("long"))
    )
    optional = lambda name, column: F.when(
        F.col(column).isNotNull(), line(name, F.col(column))
    ).otherwise("")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")),
        optional("WARC-Target-URI", "target_uri"),
        optional("WARC-Date", "warc_date"),
        line("WARC-Block-Digest", F.col("block_digest")),
        line("WARC-Source-Payload-Digest", F.col("source_payload_digest")),
        F.when(F.col("record_type") == "conversion", line("WARC-Conversion", F.lit(CONVERTER))).otherwise(""),
        line("Content-Type", F.col("content_type")),
        line("Content-Length", F.col("content_length").cast("string")),
        F.lit(CRLF),
    )
    records = records.withColumn("record", F.concat(header, F.col("block"), F.lit(CRLF * 2)))
    return records.select(
        *unpacked(others, "others"), *[F.col(name).alias(result[name]) for name in RECORD]
    )


def query(spark, sf_dir: str) -> DataFrame:
    return derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def _sql() -> str:
    text = "payload"
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    for pattern in _DROP:
        text = f"regexp_replace({text}, {quote(pattern)}, ' ', 'g')"
    text = f"regexp_replace({text}, {quote(_BREAK)}, chr(10), 'g')"
    text = f"regexp_replace({text}, {quote(_TAG)}, '', 'g')"
    for entity, char in _ENTITIES:
        text = f"replace({text}, {quote(entity)}, {quote(char)})"
    text = rf"regexp_replace({text}, '[ \t\r\f]+', ' ', 'g')"
    text = rf"regexp_replace(regexp_replace({text}, ' ?\n[ \n]*', chr(10), 'g'), '^[ \n]+|[ \n]+$', '', 'g')"
    uuid = lambda x: (
        f"'<urn:uuid:' || substr(md5({x}),1,8) || '-' || substr(md5({x}),9,4) || '-' || "
        f"substr(md5({x}),13,4) || '-' || substr(md5({x}),17,4) || '-' || substr(md5({x}),21,12) || '>'"
    )
    return rf"""
WITH n AS (SELECT chr(13) || chr(10) AS nl),
r AS (
  SELECT page_id, {uuid("concat_ws('|', 'response', page_id::VARCHAR, url)")} AS refers_to,
         url AS target_uri,
         strftime(DATE '2024-01-01' + ((page_id * 37) % 366)::INT, '%Y-%m-%d') || 'T00:00:00Z' AS warc_date,
         'HTTP/1.1 200 OK' || nl || 'Content-Type: text/html; charset=utf-8' || nl
           || 'Content-Length: ' || strlen(coalesce(html, '')) || nl AS source_headers,
         coalesce(html, '') AS payload, nl
  FROM pages, n),
t AS (
  SELECT * EXCLUDE (payload), 'sha256:' || sha256(payload) AS source_payload_digest, {text} AS text,
         regexp_extract(payload, '(?is)<title[^<>]*>(.*?)</title', 1) AS title,
         regexp_extract(payload, '(?i)<html[^<>]*[ \t\r\n]lang=["'']?([A-Za-z-]+)', 1) AS language,
         len(regexp_extract_all(payload, '(?i)<a[ \t\r\n][^<>]*href')) AS links
  FROM r),
b AS (
  SELECT page_id, refers_to, target_uri, warc_date, source_headers, source_payload_digest, nl,
         'metadata' AS record_type, 'application/warc-fields' AS content_type,
         'title: ' || regexp_replace(title, '[ \t\r\n]+', ' ', 'g') || nl || 'language: ' || language || nl
           || 'outlinks: ' || links || nl || 'text-length: ' || length(text) || nl || source_headers AS block
  FROM t
  UNION ALL
  SELECT page_id, refers_to, target_uri, warc_date, source_headers, source_payload_digest, nl,
         'conversion', 'text/plain; charset=utf-8', text FROM t),
i AS (SELECT *, {uuid("record_type || '|' || refers_to")} AS record_id,
             'sha256:' || sha256(block) AS block_digest, strlen(block)::BIGINT AS content_length FROM b)
SELECT page_id, refers_to, target_uri, warc_date, source_headers, source_payload_digest, record_type,
       content_type, block, record_id, block_digest, content_length,
       'WARC/1.1' || nl || 'WARC-Type: ' || record_type || nl || 'WARC-Record-ID: ' || record_id || nl
       || 'WARC-Refers-To: ' || refers_to || nl
       || CASE WHEN target_uri IS NOT NULL THEN 'WARC-Target-URI: ' || target_uri || nl ELSE '' END
       || CASE WHEN warc_date IS NOT NULL THEN 'WARC-Date: ' || warc_date || nl ELSE '' END
       || 'WARC-Block-Digest: ' || block_digest || nl
       || 'WARC-Source-Payload-Digest: ' || source_payload_digest || nl
       || CASE WHEN record_type = 'conversion' THEN 'WARC-Conversion: {CONVERTER}' || nl ELSE '' END
       || 'Content-Type: ' || content_type || nl || 'Content-Length: ' || content_length || nl || nl
       || block || nl || nl AS record
FROM i
"""


SQL = _sql()
