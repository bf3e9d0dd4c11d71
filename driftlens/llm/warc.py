"""Content-addressed WARC archive: payloads once by SHA-256, exact record headers apart.

Two tables make an archive. `payloads` has each distinct payload once, under
its digest; `records` has one row for each record with its header block byte
for byte. Joining them by digest gives back the original records.

A header line cannot hold a line end, so one within a URL is percent-encoded for
other readers, and the exact URL stands apart, in base64; all other URLs are
written as they are. A null URL or id has no header line.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm.common import hot_keys, materialize, spread_join, workers_know

#: Shorter payloads are never revisits.
LEAST_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


@dataclass(frozen=True)
class Archive:
    payloads: DataFrame
    records: DataFrame
    #: The type that page ids have outside of headers.
    id_type: str = "bigint"


def _field(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))


_LINE_END = r"[\r\n]"


def _line(name: str, value: Column) -> Column:
    """A header line, none for null."""
    return F.coalesce(_field(name, value), F.lit(""))


def _one_line(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))


def _exact(name: str, value: Column) -> Column:
    """A line for a value that has a line end within."""
    return F.when(value.rlike(_LINE_END), _field(name, F.base64(F.encode(value, "UTF-8")))).otherwise(F.lit(""))


def _id_text(value: Column) -> Column:
    """An id as a header value; the percent sign is encoded, so the line ends can be told back."""
    return _one_line(F.replace(value.cast("string"), F.lit("%"), F.lit("%25")))


def _urn(*parts: Column) -> Column:
    """A record id that follows from its parts alone."""
    h = F.md5(F.concat_ws("/", *parts))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def write_archive(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    least_revisit: int = LEAST_REVISIT,
    date: str = DATE,
    date_column: str | None = None,
    archive_id: str | None = None,
) -> Archive:
    """One WARC record for each row; null payloads are empty.

    WARC-Date is what date_column says (a timestamp, or text as it is), or
    `date`, where it is null or not given. Record ids follow from archive_id, by
    default a new one, so no two archives share any. Page ids keep their type.

    Of the records with one payload of at least least_revisit bytes, that with
    the smallest page_id is a response (null ids last; of repeated rows, the
    one written first) and the others revisit it; shorter payloads are
    responses all. An empty table makes an empty archive. Columns other than
    the three named ones are not archived.
    """
    when = F.lit(None).cast("string")
    if date_column:
        timed = pages.schema[date_column].dataType.typeName().startswith("timestamp")
        when = F.date_format(F.to_utc_timestamp(date_column, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if timed else F.col(date_column).cast("string")
    own = F.lit(archive_id or uuid.uuid4().hex)
    base = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).cast("string").alias("url"),
        F.coalesce(when, F.lit(date)).alias("date"),
        F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # Written before anything refers to them, so that record numbers never change.
    plain = materialize(
        base.select(
            F.monotonically_increasing_id().alias("record"), "page_id", "url", "date", "digest", F.length("payload").cast("long").alias("n_bytes")
        ),
        "plain",
    )
    payloads = materialize(
        base.select("digest", "payload").groupBy("digest").agg(F.first("payload").alias("payload")), "payloads"
    )
    first = (
        plain.filter(F.col("n_bytes") >= least_revisit)
        .groupBy("digest")
        .agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record")).alias("first"), F.count("*").alias("n"))
        .filter("n > 1")
        .select("digest", "n", F.col("first.page_id").alias("first_page"), F.col("first.record").alias("first_record"))
    )
    rows = spread_join(plain, first.drop("n"), ["digest"], hot_keys(first, ["digest"], plain.count()), ["record"], "left")
    revisit = F.col("first_record").isNotNull() & (F.col("first_record") != F.col("record"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        _field("Content-Length", F.col("n_bytes").cast("string")),
        F.lit(CRLF),
    )
    rows = rows.withColumn("http", http).withColumn("revisit", revisit)
    block = F.when(revisit, F.length("http")).otherwise(F.length("http") + F.col("n_bytes"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _field("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _field("WARC-Record-ID", _urn(own, F.col("record").cast("string"), F.col("digest"))),
        _field("WARC-Date", _one_line(F.col("date"))),
        _line("WARC-Target-URI", _one_line(F.col("url"))),
        F.coalesce(_exact("X-Original-URI", F.col("url")), F.lit("")),
        _line("X-Page-ID", _id_text(F.col("page_id"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(
                _field("WARC-Refers-To", _urn(own, F.col("first_record").cast("string"), F.col("digest"))),
                _line("X-Refers-To-Page-ID", _id_text(F.col("first_page"))),
                _field("WARC-Profile", F.lit(PROFILE)),
            ),
        ).otherwise(""),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", block.cast("string")),
        F.lit(CRLF),
        F.col("http"),
    )
    records = rows.select("record", "digest", F.encode(header, "UTF-8").alias("header"), (~F.col("revisit")).alias("has_payload"))
    return Archive(payloads, materialize(records, "records"), base.schema["page_id"].dataType.simpleString())


def read_archive(archive: Archive) -> DataFrame:
    """The records by their header bytes, each with its verified payload.

    A payload whose digest or length differs from what the header says, or that
    is missing, ends the job.
    """
    # Verified once for each distinct payload, before copies meet it.
    store = archive.payloads.select(
        "digest", "payload", F.length("payload").cast("long").alias("stored"), (F.sha2("payload", 256) == F.col("digest")).alias("sound")
    )
    counts = archive.records.groupBy("digest").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, ["digest"], archive.records.count())
    return spread_join(_parsed(archive), store, ["digest"], hot, ["record"], "left").transform(_checked)


def _parsed(archive: Archive) -> DataFrame:
    text = F.decode("header", "UTF-8")

    def field(name: str) -> Column:
        """Null where the header has no such line; the names here need no escape."""
        return F.when(F.contains(text, F.lit(f"\n{name}: ")), F.regexp_extract(text, f"\n{name}: ([^\r\n]*)\r\n", 1))

    def page(name: str) -> Column:
        whole = F.replace(F.replace(field(name), F.lit("%0D"), F.lit("\r")), F.lit("%0A"), F.lit("\n"))
        return F.replace(whole, F.lit("%25"), F.lit("%")).cast(archive.id_type)

    exact = F.decode(F.unbase64(F.replace(field("X-Original-URI"), F.lit(" "), F.lit(""))), "UTF-8")
    return archive.records.select(
        "record",
        "header",
        "has_payload",
        F.replace(field("WARC-Payload-Digest"), F.lit("sha256:"), F.lit("")).alias("digest"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Date").alias("date"),
        F.coalesce(exact, field("WARC-Target-URI")).alias("url"),
        page("X-Page-ID").alias("page_id"),
        page("X-Refers-To-Page-ID").alias("refers_to"),
        F.element_at(F.regexp_extract_all(text, F.lit("Content-Length: ([0-9]+)"), F.lit(1)), -1).cast("long").alias("payload_bytes"),
    )


def _checked(rows: DataFrame) -> DataFrame:
    sound = F.coalesce(F.col("sound") & (F.col("stored") == F.col("payload_bytes")), F.lit(False))
    failed = F.raise_error(F.concat(F.lit("no sound payload for record "), F.col("record").cast("string")))
    return rows.withColumn("payload_bytes", F.when(sound, F.col("payload_bytes")).otherwise(failed.cast("long"))).drop("sound", "stored")


def records_as_bytes(archive: Archive) -> DataFrame:
    """The original records, byte for byte: header, then the payload of a response, then two line ends."""
    rows = read_archive(archive)
    body = F.when(F.col("has_payload"), F.col("payload")).otherwise(F.lit(b""))
    return rows.select("record", "page_id", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("bytes"))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and blocks of a WARC file's bytes, in order."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode().split(CRLF)
        if not first.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(line.split(": ", 1) for line in lines)
        size = int(fields["Content-Length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def warc_members(archive: Archive) -> DataFrame:
    """record and member: each record as a gzip member; members one after another, in any order, are a .warc.gz file."""
    workers_know(archive.records.sparkSession)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [gzip.compress(b.as_py(), 6, mtime=0) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["record", "member"])

    return records_as_bytes(archive).select("record", "bytes").mapInArrow(members, "record long, member binary")


def save_archive(archive: Archive, path: str) -> None:
    archive.payloads.write.parquet(f"{path}/payloads")
    archive.records.write.parquet(f"{path}/records")


def load_archive(spark: SparkSession, path: str, id_type: str = "bigint") -> Archive:
    return Archive(spark.read.parquet(f"{path}/payloads"), spark.read.parquet(f"{path}/records"), id_type)


__all__ = ["Archive", "load_archive", "parse_records", "read_archive", "records_as_bytes", "save_archive", "warc_members", "write_archive"]
