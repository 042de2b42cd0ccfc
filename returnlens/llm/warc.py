"""Content-addressed WARC archive.

An archive is a folder of two tables. ``payloads`` holds the bytes of every payload once, under its SHA-256;
``headers`` holds the exact header bytes of every record with the digest of its payload. Reading joins them and puts
the original records together again. The digest is verified on both ways: when writing, equal digests must have equal
length and equal SHA-1; when reading, the stored bytes must give their digest. A violation raises an error.

Copies are combined before the payload shuffle. Headers of a hot payload meet one row on the other side of every
join, so Spark can split them.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from returnlens.functions.skew import once_per_key

DATE = "2024-01-01T00:00:00Z"
END = "\r\n"
RECORD_END = b"\r\n\r\n"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four groups of ten hex digits give eight letters each."""
    digits = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), HEX32, BASE32)


#: Controls, and the line and paragraph separators: what some reader may take for the end of a line.
BREAKS = "".join(map(chr, [*range(0x20), 0x7F, 0x85, 0x2028, 0x2029]))


def one_line(address: Column) -> Column:
    """The address with each of ``BREAKS`` percent-encoded, byte by byte of its UTF-8."""
    encoded = functools.reduce(
        lambda left, c: F.replace(left, F.lit(c), F.lit("".join(f"%{b:02X}" for b in c.encode()))), BREAKS, address
    )
    return F.when(address.rlike(r"[\x00-\x1F\x7F\x85\u2028\u2029]"), encoded).otherwise(address)


def write_archive(
    pages: DataFrame,
    folder: str,
    least_bytes: int = 0,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    date: str = DATE,
) -> None:
    """Writes one record per row; runs at once.

    The payload is the page in UTF-8 (NULL: empty). Of records with equal payloads of at least ``least_bytes`` bytes,
    that with the largest key is the response and the others revisit it; smaller ones are all responses. A repeated
    row gives a repeated record of the same type. A NULL key counts as smallest; a NULL address is empty, and
    controls and line separators in an address are percent-encoded. An empty table gives an empty archive. Other columns
    are not read.
    """
    rows = pages.select(
        pages[key].cast("long").alias("key"),
        F.coalesce(pages[url].cast("string"), F.lit("")).alias("uri"),
        F.coalesce(pages[html].cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    rows.groupBy("digest").agg(F.any_value("payload").alias("payload")).write.parquet(f"{folder}/payloads")

    records = rows.select("key", "uri", "digest", F.length("payload").cast("long").alias("size"),
                          base32_sha1(F.col("payload")).alias("sha1"))
    kept = once_per_key(
        records,
        "digest",
        F.max("key").alias("owner"),
        *(f(c).alias(f"{n}_{c}") for c in ("size", "sha1") for n, f in (("low", F.min), ("high", F.max))),
    ).select(
        F.col("digest").alias("stored"),
        F.when((F.col("low_size") == F.col("high_size")) & (F.col("low_sha1") == F.col("high_sha1")), F.col("owner"))
        .otherwise(F.raise_error(F.concat(F.lit("different payloads under digest "), "digest")).cast("long"))
        .alias("owner"),
    )
    joined = records.join(kept, F.col("digest") == F.col("stored"))
    revisit = (F.col("size") >= least_bytes) & ~F.col("key").eqNullSafe(F.col("owner"))
    block = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("size").cast("string"),
        F.lit(END + END),
    )
    named = joined.select(
        "digest", "size", "sha1", "owner", one_line(F.col("uri")).alias("uri"), block.alias("block"), revisit.alias("revisit"),
        F.coalesce(F.col("key").cast("string"), F.lit("none")).alias("name"),
    )
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(F.col("revisit"), "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: <urn:page:"), "name", F.lit(">")),
        F.concat(F.lit("WARC-Target-URI: "), "uri"),
        F.lit(f"WARC-Date: {date}"),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), "sha1"),
        F.when(F.col("revisit"), F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("owner").cast("string"), F.lit(">"))),
        F.when(F.col("revisit"), F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(
            F.lit("Content-Length: "),
            (F.octet_length("block") + F.when(F.col("revisit"), 0).otherwise(F.col("size"))).cast("string"),
        ),
    ]
    head = F.concat(F.concat_ws(END, *lines), F.lit(END + END))  # NULL lines are left out
    named.select(
        "digest", F.col("revisit").alias("without_payload"), F.concat(head, "block").cast("binary").alias("head")
    ).write.parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """All records, put together and read: ``record`` (its exact bytes) and what it says.

    ``page_id``, ``uri``, ``record_type`` and ``refers_to`` come from the record's header; ``payload`` from its body,
    or for revisits from the payload they share. ``payload_digest`` is the header's, checked against the payload.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads").withColumnRenamed("digest", "stored")
    joined = headers.join(payloads, headers.digest == payloads.stored)
    body = F.when(F.col("without_payload"), F.lit(b"")).otherwise(F.col("payload"))
    records = joined.select(
        "digest", F.col("payload").alias("shared"), F.concat("head", body, F.lit(RECORD_END)).alias("record")
    )
    header = F.substring_index(F.col("record").cast("string"), END + END, 1)
    blocks = records.withColumn("header", header).withColumn(
        "block", F.expr("substring(record, octet_length(header) + 5, octet_length(record) - octet_length(header) - 8)")
    )
    says = lambda name, value: F.regexp_extract("header", rf"(?md)^{name}: {value}\r?$", 1)
    front = F.octet_length(F.substring_index(F.col("block").cast("string"), END + END, 1))
    parsed = blocks.select(
        "digest",
        "shared",
        "record",
        says("WARC-Record-ID", "<urn:page:(-?[0-9]+)>").try_cast("long").alias("page_id"),
        says("WARC-Target-URI", "(.*?)").alias("uri"),
        says("WARC-Type", "([a-z]+)").alias("record_type"),
        says("WARC-Refers-To", "<urn:page:(-?[0-9]+)>").try_cast("long").alias("refers_to"),
        says("WARC-Payload-Digest", "sha1:([A-Z2-7]+)").alias("payload_digest"),
        (says("Content-Length", "([0-9]+)").try_cast("long") == F.octet_length("block")).alias("whole"),
        F.expr("substring(block, 1, octet_length(block))").alias("block"),
        front.alias("front"),
    )
    payload = F.when(F.col("record_type") == "revisit", F.col("shared")).otherwise(
        F.expr("substring(block, front + 5, octet_length(block))")
    )
    found = parsed.select(
        "page_id", "uri", "record_type", "refers_to", "payload_digest", "record", "digest", "whole",
        payload.alias("payload"),
    )
    sound = (
        F.col("whole")
        & (F.sha2("payload", 256) == F.col("digest"))
        & (base32_sha1(F.col("payload")) == F.col("payload_digest"))
    )
    checked = F.when(sound, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged record with digest "), "digest")).cast("binary")
    )
    return found.select(
        "page_id", "uri", "record_type", "refers_to", "payload_digest", "record", checked.alias("payload")
    )
