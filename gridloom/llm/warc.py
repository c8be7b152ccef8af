"""WARC content-addressed archive.

Two tables make the archive. `payloads` has each payload of at least `min_revisit` bytes once, under its
SHA-256; `headers` has one row per record with the exact bytes of the WARC and the HTTP header, the digest of
its payload and, for smaller payloads, the payload itself. reconstruct() joins the two back to the exact record, whose
digest it checks, and read_records() reads what the rebuilt records say.

Cases: a null html is an empty payload; empty and small payloads are always responses; rows that repeat a
page_id with the same payload are each a response if that page_id is the smallest of the payload, else each a
revisit; a null page_id sorts after all others; empty tables give empty archives; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 100
BROADCAST_PAYLOAD = 65536
"""Only payloads up to so many bytes are broadcast, and at most HOT_SHARE of them: 64 MiB."""
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Archive:
    payloads: DataFrame
    headers: DataFrame


def record_uuid(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("warc-record/"), F.coalesce(page_id.cast("string"), F.lit("null"))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(pages: DataFrame, min_revisit: int = MIN_REVISIT, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Writes both tables to the shared folder. Payload bytes shuffle once, after map-side removal of copies."""
    base = pages.select(
        F.col("page_id"),
        F.coalesce(F.col("url"), F.lit("")).alias("url"),
        F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"),
    ).select("*", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    payloads = common.save(
        base.filter(F.col("n_bytes") >= min_revisit)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first_page"), F.count(F.lit(1)).alias("copies"), F.first("payload").alias("payload")),
        "warc-payloads",
    )
    index = payloads.select("digest", "first_page", "copies")
    total = index.agg(F.sum("copies")).first()[0] or 0
    small = F.when(F.col("n_bytes") < min_revisit, F.col("payload"))
    slim = base.select("page_id", "url", "digest", "n_bytes", small.alias("inline"))
    shared = index.filter(F.col("copies") > 1)
    big = common.join_hot(slim.filter(F.col("n_bytes") >= min_revisit), shared, "digest", "copies", total)
    rows = big.unionByName(slim.filter(F.col("n_bytes") < min_revisit), allowMissingColumns=True)
    revisit = F.col("copies").isNotNull() & F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    rows = rows.withColumn("revisit", revisit)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("n_bytes").cast("string"),
        F.lit(CRLF * 2),
    )
    block = F.octet_length("http_header") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n_bytes"))
    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "),
        F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(f"{CRLF}WARC-Record-ID: "),
        record_uuid(F.col("page_id")),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "),
        F.regexp_replace("url", "[\r\n]", "%0A"),
        F.lit(f"{CRLF}WARC-Payload-Digest: sha256:"),
        F.col("digest"),
        F.when(
            F.col("revisit"),
            F.concat(
                F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: "),
                record_uuid(F.col("first_page")),
                F.lit(f"{CRLF}WARC-Refers-To-Page: "),
                F.col("first_page").cast("string"),
            ),
        ).otherwise(F.lit("")),
        F.lit(f"{CRLF}Content-Type: application/http; msgtype=response{CRLF}Content-Length: "),
        block.cast("string"),
        F.lit(CRLF * 2),
    )
    headers = common.save(
        rows.withColumn("http_header", http).select(
            "page_id", "digest", warc.cast("binary").alias("warc_header"), F.col("http_header").cast("binary").alias("http_header"), "inline"
        ),
        "warc-headers",
    )
    return Archive(payloads, headers)


def _field(name: str) -> Column:
    return F.nullif(F.regexp_extract(F.col("warc_header").cast("string"), rf"\r\n{name}: ([^\r]*)\r\n", 1), F.lit(""))


def reconstruct(archive: Archive) -> DataFrame:
    """(page_id, record): the exact bytes of every record, header, HTTP header, payload for responses, end of record.

    Only responses meet their payload, as a rule one per payload: the header side is hashed, so that payload bytes are moved once
    and never sorted. A payload that is missing or differs from its digest stops the job.
    """
    h = archive.headers.withColumn("revisit", _field("WARC-Type") == "revisit")
    stored = archive.payloads.select("digest", "copies", "payload")
    hot = stored.filter((F.col("copies") * common.HOT_SHARE >= archive.payloads.agg(F.coalesce(F.sum("copies"), F.lit(0))).first()[0]) & (F.octet_length("payload") <= BROADCAST_PAYLOAD))
    wanted = h.filter(~F.col("revisit") & F.col("inline").isNull()).drop("inline")
    cold = stored.join(F.broadcast(hot.select("digest")), "digest", "left_anti")
    far = wanted.join(F.broadcast(hot.select("digest")), "digest", "left_anti").hint("shuffle_hash").join(cold, "digest", "left")
    near = wanted.join(F.broadcast(hot), "digest")
    small = h.filter(F.col("revisit") | F.col("inline").isNotNull()).withColumnRenamed("inline", "payload")
    rows = near.unionByName(far).drop("copies").unionByName(small)
    sound = F.coalesce(F.sha2("payload", 256) == F.col("digest"), F.lit(False))
    stop = F.raise_error(F.concat(F.lit("payload differs from its digest "), F.col("digest")))
    body = F.when(F.col("revisit"), F.lit(b"")).when(sound, F.col("payload")).otherwise(stop)
    return rows.select("page_id", F.concat("warc_header", "http_header", body, F.lit((CRLF * 2).encode())).alias("record"))


def read_records(records: DataFrame) -> DataFrame:
    """One row per rebuilt record: what its header says, and the length and digest of the payload in its block, or, of a
    revisit, of that in the record it refers to. `verified` says that lengths and digests are those of the header."""
    text = F.col("record").cast("string")
    head = records.withColumn("warc_header", F.concat(F.substring_index(text, CRLF * 2, 1), F.lit(CRLF)).cast("binary"))
    fields = head.select(
        "page_id", "record",
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Refers-To-Page").cast("long").alias("refers_to"),
        _field("WARC-Payload-Digest").substr(8, 64).alias("named"),
        _field("Content-Length").cast("long").alias("block_bytes"),
        F.octet_length("warc_header").alias("n_head"),
    )
    block = fields.withColumn("block", F.expr("substring(record, n_head + 3, octet_length(record) - n_head - 6)")).drop("record")
    body = F.expr("substring(block, n_http + 5)")
    read = block.withColumn("n_http", F.octet_length(F.substring_index(F.col("block").cast("string"), CRLF * 2, 1))).select(
        "page_id", "record_type", "refers_to", "named", (F.octet_length("block") == F.col("block_bytes")).alias("whole"),
        F.when(F.col("record_type") == "response", F.octet_length(body).cast("long")).alias("payload_bytes"),
        F.when(F.col("record_type") == "response", F.sha2(body, 256)).alias("payload_digest"),
    )
    # no bytes of payloads from here on
    read = common.save(read, "warc-read")
    response, revisit = read.filter("record_type = 'response'"), read.filter("record_type = 'revisit'").drop("payload_bytes", "payload_digest")
    asked = revisit.groupBy("named").agg(F.count(F.lit(1)).alias("n"))
    known = response.groupBy("payload_digest").agg(F.first("payload_bytes").alias("payload_bytes")).join(asked, F.col("payload_digest") == F.col("named"))
    again = common.join_hot(revisit, known.select("named", "payload_digest", "payload_bytes", "n"), "named", "n", revisit.count()).drop("n")
    return response.unionByName(again).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to",
        (F.col("whole") & F.coalesce(F.col("payload_digest") == F.col("named"), F.lit(False))).alias("verified"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_records(reconstruct(write_archive(common.table(spark, sf_dir, "pages"))))


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
m AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_page FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_page IS NOT NULL AND page_id IS DISTINCT FROM first_page
            THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_page IS NOT NULL AND page_id IS DISTINCT FROM first_page
            THEN first_page END AS refers_to,
       true AS verified
FROM m
"""
