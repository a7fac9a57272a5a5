"""A content-addressed WARC archive.

An archive is two Parquet tables. ``payloads`` holds the bytes of every distinct payload once, under
its SHA-256; equal digests are confirmed by their bytes. ``records`` holds the exact header bytes of
every record and the digest of the payload that it had. Joining the two gives back each record byte
by byte, and the payload of a revisit as well, whose own record has no body.

Only payloads that occur more than once are shuffled to be reduced to one; the others go from the
scan straight to the store.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterscope.llm.common import save, scratch_folder, small

#: Payloads of fewer bytes are always written as responses.
REVISIT_BYTES = 1000
# Fixed values of the WARC 1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
BREAK = "\r\n"


@dataclass(frozen=True)
class Archive:
    """Folders of the two tables."""

    records: str
    payloads: str


def _header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))


def _record_id(page_id: Column, row: Column) -> Column:
    """A urn:uuid made of the page number and of the row, so that repeated rows and null ids differ."""
    digest = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(":"), row.cast("string")))
    parts = [F.substring(digest, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _headers() -> Column:
    """Header block of a record, up to and including the HTTP header of its body."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(BREAK + BREAK),
    )
    body = F.length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes"))
    # Line breaks in a URL would end the header; they are written percent-coded.
    url = F.regexp_replace(F.regexp_replace(F.coalesce("url", F.lit("")), "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(f"WARC/1.1{BREAK}"),
        _header("WARC-Type", F.col("record_type")),
        _header("WARC-Record-ID", _record_id(F.col("page_id"), F.col("row"))),
        _header("WARC-Date", F.lit(DATE)),
        _header("WARC-Target-URI", url),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(
            revisit,
            F.concat(
                _header("WARC-Profile", F.lit(REVISIT_PROFILE)),
                _header("WARC-Refers-To", _record_id(F.col("refers_to"), F.col("last.row"))),
                _header("X-Refers-To-Page", F.col("refers_to").cast("string")),
            ),
        ).otherwise(F.lit("")),
        F.when(F.col("page_id").isNull(), F.lit("")).otherwise(
            _header("X-Page", F.col("page_id").cast("string"))
        ),
        _header("Content-Type", F.lit("application/http; msgtype=response")),
        _header("Content-Length", body.cast("string")),
        F.lit(BREAK),
        http,
    )


def write_archive(
    pages: DataFrame,
    folder: str,
    id_column: str = "page_id",
    url_column: str = "url",
    payload_column: str = "html",
    revisit_bytes: int = REVISIT_BYTES,
) -> Archive:
    """Write one record per row of ``pages`` into ``folder``, which every executor must reach.

    A null payload counts as empty. Of records with equal payloads of at least ``revisit_bytes``
    bytes the one with the largest id is a response and the others are revisits of it; among rows that
    share that id (repeated rows) exactly one is the response. A null id is smaller than any other;
    where all ids of a group are null, all its records are responses, as there is none to refer to.
    A null URL is written as an empty one. An empty table gives an empty archive. Other columns are
    not read.
    """
    archive = Archive(f"{folder}/records", f"{folder}/payloads")
    payload = F.encode(F.coalesce(F.col(payload_column), F.lit("")), "UTF-8")
    index = save(
        pages.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_column).alias("page_id"),
            F.col(url_column).alias("url"),
            F.octet_length(payload).cast("long").alias("payload_bytes"),
            F.sha1(payload).alias("payload_digest"),
            F.unhex(F.sha2(payload, 256)).alias("address"),
        ),
        "warc-index",
    )
    groups = save(
        index.groupBy("address")
        .agg(F.max(F.struct("page_id", "row")).alias("last"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1"),
        "warc-groups",
    )
    few = small(groups, 96)
    first = (
        F.col("last").isNull()
        | (F.col("payload_bytes") < revisit_bytes)
        | F.col("last.page_id").isNull()
        | (F.col("last.row") == F.col("row"))
    )
    records = (
        index.join(few, "address", "left")
        .withColumn("record_type", F.when(first, "response").otherwise("revisit"))
        .withColumn("refers_to", F.when(~first, F.col("last.page_id")))
        .select(F.encode(_headers(), "UTF-8").alias("header"), "address")
    )
    records.write.parquet(archive.records)

    stored = pages.select(payload.alias("payload")).select(
        F.unhex(F.sha2("payload", 256)).alias("address"), "payload"
    )
    once = stored.join(few, "address", "left_anti").select("address", "payload")
    # Grouping by digest and bytes: a digest with two different payloads would give two rows.
    repeated = stored.join(few, "address", "left_semi").groupBy("address", "payload").agg(
        F.count(F.lit(1)).alias("copies")
    )
    once.unionByName(repeated.select("address", "payload")).write.parquet(archive.payloads)
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """The records of an archive: page_id, record_type, refers_to, record, payload, payload_bytes, payload_digest.

    Each record is put together from its header and its payload, and everything else is read from
    the bytes: type, page and reference from the header, size and digest from the payload. The
    address of a payload is computed anew from its bytes, and a record whose payload is missing or
    damaged, or whose header states another digest or another length of its body, stops the job.
    """
    records = spark.read.parquet(archive.records)
    payloads = spark.read.parquet(archive.payloads).select(
        F.unhex(F.sha2("payload", 256)).alias("address"),
        "payload",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        F.lit(True).alias("found"),
    )
    header = F.decode("header", "UTF-8")

    def field(name: str) -> Column:
        value = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
        return F.when(value != "", value)

    record_type = field("WARC-Type")
    empty, end = F.encode(F.lit(""), "UTF-8"), F.encode(F.lit(BREAK + BREAK), "UTF-8")
    record = F.concat("header", F.when(record_type == "revisit", empty).otherwise(F.col("payload")), end)
    # The body begins behind the first blank line of the record and ends ahead of the last one.
    ahead = F.octet_length(F.substring_index(header, BREAK + BREAK, 1)) + len(BREAK + BREAK)
    body = F.octet_length("record") - ahead - len(BREAK + BREAK)
    sound = (
        F.col("found")
        & (F.col("payload_digest") == field("WARC-Payload-Digest").substr(6, 40))
        & (body == field("Content-Length").cast("long"))
    )
    damaged = F.raise_error(F.lit("a payload of the archive is missing or damaged")).cast("string")
    return records.join(payloads, "address", "left").withColumn("record", record).select(
        field("X-Page").cast("long").alias("page_id"),
        F.when(F.coalesce(sound, F.lit(False)), record_type).otherwise(damaged).alias("record_type"),
        field("X-Refers-To-Page").cast("long").alias("refers_to"),
        "record",
        "payload",
        "payload_bytes",
        "payload_digest",
    )


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write ``pages`` to a new archive in the shared folder and read it back."""
    spark = pages.sparkSession
    folder = f"{scratch_folder(spark)}/archive-{uuid.uuid4().hex}"
    return read_archive(spark, write_archive(pages, folder, **options))
