"""Content-addressed web archive: payload bytes once by a strong digest, exact record headers apart, records rebuilt by joins.

An archive is two Parquet tables in a folder: payloads (sha256, payload), each different payload once, and headers (page_id, sha256, header), one exact
WARC header for each record, bytes as they would stand in a .warc file. A record is its header, its payload (for responses) and two line ends.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir

#: Smaller payloads are never made revisits.
MIN_REVISIT_BYTES = 0
WARC_DATE = "1970-01-01T00:00:00Z"
_HEX32, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """The payload's SHA-1 in base 32: five hex digits at a time are four digits of base 32, whose alphabet is then exchanged."""
    h = F.sha1(payload)
    fives = [F.lpad(F.conv(F.substring(h, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*fives)), _HEX32, _BASE32)


def _uri(url: Column) -> Column:
    """The URL on one line: control characters and blanks are percent-encoded as their bytes; null is empty."""
    out = F.coalesce(url, F.lit(""))
    for c in ("\r", "\n", "\t", " "):
        out = F.replace(out, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return out


def record_header(kind: Column, page_id: Column, url: Column, digest: Column, refers_to: Column, size: Column) -> Column:
    """The header's exact text, up to and with its blank line."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda x: F.concat(F.lit("<urn:page:"), F.url_encode(x.cast("string")), F.lit(">"))
    revisit = F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), F.coalesce(line("WARC-Refers-To", urn(refers_to)), F.lit("")))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", kind), line("WARC-Record-ID", F.coalesce(urn(page_id), F.lit("<urn:page:none>"))), line("WARC-Date", F.lit(WARC_DATE)),
        line("WARC-Target-URI", _uri(url)), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), F.when(kind == "revisit", revisit).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")), line("Content-Length", F.when(kind == "revisit", F.lit("0")).otherwise(size.cast("string"))), F.lit("\r\n"),
    )


def write_archive(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> None:
    """Write pages (page_id, url, html) to the folder.

    A null html is an empty payload. Of equal payloads of at least min_bytes, the row of the smallest page_id (ties: smallest url) is the
    response and all others revisit it; rows with a null page_id never are the first, unless all are. Repeated rows are records of their own.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "page_id", "url", "payload", F.sha2("payload", 256).alias("sha256"), base32_sha1(F.col("payload")).alias("sha1"), F.octet_length("payload").cast("long").alias("size")
    )
    slim = rows.drop("payload")
    order = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"))
    first = slim.groupBy("sha256").agg(F.min(order).alias("first"), F.count("*").alias("copies"))
    joined = slim.join(first, "sha256")
    # Repeated rows that tie for the first are all responses; their payload is still stored once.
    is_first = F.col("page_id").eqNullSafe(F.col("first.page_id")) & (F.coalesce("url", F.lit("")) == F.col("first.url"))
    kind = F.when(is_first | (F.col("size") < min_bytes), F.lit("response")).otherwise(F.lit("revisit"))
    header = record_header(kind, F.col("page_id"), F.col("url"), F.col("sha1"), F.col("first.page_id"), F.col("size"))
    joined.select("page_id", "sha256", header.alias("header")).write.mode("overwrite").parquet(f"{folder}/headers")
    # Partial aggregation leaves one row of a payload for each task before the shuffle.
    rows.groupBy("sha256").agg(F.any_value("payload").alias("payload")).write.mode("overwrite").parquet(f"{folder}/payloads")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """(page_id, header, record, payload, verified) of every record: header and payload joined by digest.

    record: the record's exact bytes; payload: the full payload, for revisits that of the record they refer to; verified: the payload has the digest it is stored by.
    """
    headers = spark.read.parquet(f"{folder}/headers")
    payloads = spark.read.parquet(f"{folder}/payloads").withColumn("verified", F.sha2("payload", 256) == F.col("sha256"))
    joined = headers.join(payloads, "sha256", "left")
    body = F.when(_field("WARC-Type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    record = F.concat(F.col("header").cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))
    return joined.select("page_id", "header", record.alias("record"), "payload", F.coalesce("verified", F.lit(False)).alias("verified"))


def export_warc(spark: SparkSession, folder: str, out: str) -> None:
    """Write the archive's records, byte for byte, as WARC files in the folder `out`: parts in page order, each a sequence of whole records."""
    # A record ends with a line end, which is what the sink puts after each row.
    whole = read_archive(spark, folder).select("page_id", F.substring("record", F.lit(1), F.octet_length("record") - 1).cast("string").alias("value"))
    whole.repartitionByRange("page_id").sortWithinPartitions("page_id").select("value").write.mode("overwrite").option("lineSep", "\n").text(out)


def _field(name: str) -> Column:
    return F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)\r\n", 1)


def archive_digests(pages: DataFrame) -> DataFrame:
    """Archive the pages in the shared folder, read the archive back, and give for each record page_id, payload_bytes, payload_digest, record_type and refers_to.

    All come from the archive: the digest is computed anew from the joined payload, verified tells whether it is that of the header too. An empty
    table gives an empty result.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archive(pages, folder)
    back = read_archive(spark, folder)
    kind = _field("WARC-Type")
    refers = F.regexp_extract(_field("WARC-Refers-To"), r"^<urn:page:(.*)>$", 1)
    digest = base32_sha1(F.col("payload"))
    return back.select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest"), kind.alias("record_type"),
        F.when((kind == "revisit") & (refers != ""), F.url_decode(refers).cast(pages.schema["page_id"].dataType)).alias("refers_to"),
        (F.col("verified") & (F.concat(F.lit("sha1:"), digest) == _field("WARC-Payload-Digest"))).alias("verified"), F.octet_length("record").cast("long").alias("record_bytes"),
    )
