"""WARC archives with revisit records.

Headers are shuffled by payload digest to choose each payload's original, the
other copies become revisit records that carry headers only, and a reader
joins revisits to their originals again.

Archives are written by Spark's text writer, so they are committed whole, on
any file system Spark can write, and a lost executor's files are written
again.  Every record begins with the version line and the archive's own
``WARC-Warcinfo-ID``; that identifier is drawn when the archive is written, so
no payload can hold it, and the reader splits files at it however large a
payload is or whatever it contains.  Files are gzip-compressed as a whole.

Other archives are read by ``read_records``, which frames records by their
``Content-Length``, whatever version, headers, blocks and gzip members they
have; it streams each file through one task and keeps one record at a time.

Defined results: a null payload is empty; null urls give records without a
target; a null page_id gives a record without a page number, which is never a
payload's original unless all its copies have none, and then all are
responses; rows that repeat the largest page_id of a payload are all
responses; an empty table gives an empty archive.  Further columns of the
input are not archived.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .tables import whole_text

END = "\r\n\r\n"
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base32: each five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    fives = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fives), _DIGITS, _BASE32)


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest) of all pages."""
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        whole_text(payload_col).alias("payload"),
    )
    return rows.withColumns(
        {
            "payload_bytes": F.octet_length("payload").cast("bigint"),
            "payload_digest": base32_sha1(F.col("payload").cast("binary")),
        }
    )


def originals(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(digest, original): the largest page of each payload of enough bytes; headers only, met map-side."""
    large = rows.where(F.col("payload_bytes") >= least_bytes)
    return large.groupBy(F.col("payload_digest").alias("digest")).agg(F.max("page_id").alias("original"))


def plan_revisits(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """The records with record_type and refers_to (the original's page_id; null for responses)."""
    joined = rows.join(originals(rows, least_bytes), F.col("payload_digest") == F.col("digest"), "left")
    revisit = (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("original"))
    return joined.select(
        *rows.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
    )


def _record_id(archive: str, page: Column, digest: Column) -> Column:
    """The record of a page and payload in an archive, as a name-based id."""
    h = F.md5(F.concat_ws("|", F.lit(archive), F.coalesce(page.cast("string"), F.lit("-")), digest))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archive(rows: DataFrame, path: str, archive: str | None = None, records_per_file: int = 50_000) -> str:
    """Write planned records as WARC files with fresh headers; returns the archive's id."""
    archive = archive or str(uuid.uuid4())
    page, digest = F.col("page_id"), F.col("payload_digest")
    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    header = F.concat_ws(
        "\r\n",
        F.concat(F.lit("WARC-Type: "), F.col("record_type")),
        F.concat(F.lit("WARC-Record-ID: "), _record_id(archive, page, digest)),
        F.concat(F.lit("WARC-Target-URI: "), url),
        F.concat(F.lit("WARC-Date: "), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_id(archive, F.col("refers_to"), digest))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("X-Page-Id: "), page.cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string")),
    )
    value = F.concat(F.lit(f"{VERSION}WARC-Warcinfo-ID: <urn:uuid:{archive}>\r\n"), header, F.lit(END), body)
    (
        rows.select(value.alias("value"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )
    return archive


def read_archive(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """The archive's records: header fields, payload, and whether its length is the stated one."""
    mark = f"{VERSION}WARC-Warcinfo-ID: <urn:uuid:{archive}>\r\n"
    raw = spark.read.option("lineSep", mark).text(path).where("value <> ''")
    header = F.concat(F.lit("\r\n"), F.substring_index("value", END, 1), F.lit("\r\n"))
    rows = raw.select("value", header.alias("header"))
    head = F.length("header")  # the header with two more line ends, so payload begins right after as many characters

    def field(name: str) -> Column:
        found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)
        return F.when(F.instr("header", f"\r\n{name}: ") > 0, found)

    payload = F.substring(F.col("value"), head + 1, F.length("value") - head - len(END))
    rows = rows.select(
        field("WARC-Record-ID").alias("record_id"),
        field("WARC-Type").alias("record_type"),
        field("WARC-Target-URI").alias("url"),
        field("X-Page-Id").cast("bigint").alias("page_id"),
        F.replace(field("WARC-Payload-Digest"), F.lit("sha1:"), F.lit("")).alias("payload_digest"),
        field("WARC-Refers-To").alias("refers_to_record"),
        field("Content-Length").cast("bigint").alias("content_length"),
        payload.alias("payload"),
    )
    return rows.withColumn("complete", F.octet_length("payload") == F.col("content_length"))


def _fields(block: bytes) -> dict[str, str]:
    """Named fields of a header block; names in lower case, continued lines joined, of repeated names the first."""
    fields: dict[str, str] = {}
    lines = block.replace(b"\r\n", b"\n").split(b"\n")
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and fields:
            last = next(reversed(fields))
            fields[last] = f"{fields[last]} {text.strip()}"
        elif ":" in text:
            name, value = text.split(":", 1)
            fields.setdefault(name.strip().lower(), value.strip())
    return fields


def _header_end(content: bytes) -> tuple[int, int]:
    """Where a header block ends and what follows it begins; (-1, -1) if it does not end."""
    found = [(i, i + len(e)) for e in (b"\r\n\r\n", b"\n\n") if (i := content.find(e)) >= 0]
    return min(found, default=(-1, -1))


def _http_payload(fields: dict[str, str], block: bytes) -> bytes:
    """What a block carries: the body behind the headers of an HTTP message, or the block itself."""
    if not fields.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        return block
    _, begin = _header_end(block)
    return block[begin:] if begin >= 0 else b""


_SPLIT_AT = "WARC/"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of any WARC files: file, offset (their number there), version, fields, block, payload, complete.

    ``fields`` is a map with names in lower case.  ``payload`` is the body of an
    HTTP message, or the block.  A record whose file ends before its stated
    length is not complete.  What stands between records is skipped.
    """
    # files are cut where a record may begin; a cut inside a block is undone as the stated length is not yet reached
    raw = spark.read.option("lineSep", _SPLIT_AT).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("piece"),
    )
    pieces = raw.repartition("file").sortWithinPartitions("file", "start", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["file", "offset", "version", "fields", "block", "payload", "complete"]
        types = [pa.string(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary(), pa.binary(), pa.bool_()]
        file, number, parts, missing, head = None, 0, [], 0, None

        def record(complete: bool) -> pa.RecordBatch:
            version, fields, length = head
            block = b"".join(parts)[:length]
            row = [file, number, version, list(fields.items()), block, _http_payload(fields, block), complete]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names)

        for batch in batches:
            for of, piece in zip(batch.column("file").to_pylist(), batch.column("piece")):
                piece, begins = piece.as_py() or b"", True
                if of != file:
                    if head is not None:
                        yield record(False)
                    file, number, parts, missing, head = of, 0, [], 0, None
                    begins = False  # what stands before the first mark
                if head is not None:
                    mark = _SPLIT_AT.encode()
                    if missing > 0:
                        parts.append(mark + piece)
                        missing -= len(mark) + len(piece)
                        if missing <= 0:
                            yield record(True)
                            head, number = None, number + 1
                        continue
                if not begins:
                    continue
                end, begin = _header_end(piece)
                line, _, block = piece[:end].partition(b"\n")
                fields = _fields(block) if end >= 0 else {}
                length = fields.get("content-length", "")
                if not (length.isdigit() and "warc-type" in fields):
                    continue  # no record begins here
                head, parts = ("WARC/" + line.strip().decode("utf-8", "replace"), fields, int(length)), [piece[begin:]]
                missing = int(length) - len(parts[0])
                if missing <= 0:
                    yield record(True)
                    head, number = None, number + 1
        if head is not None:
            yield record(False)

    return pieces.mapInArrow(
        run,
        "file string, offset long, version string, fields map<string,string>, block binary, payload binary, complete boolean",
    )


def resolve_revisits(archived: DataFrame) -> DataFrame:
    """Facts of every archived record, a revisit's taken from the original that it refers to.

    The digest of a response is computed from the payload read, that of a
    revisit is its original's.  A revisit whose original is missing keeps null
    facts.  Only headers are shuffled.
    """
    facts = archived.select(
        "page_id",
        "record_type",
        "record_id",
        "refers_to_record",
        F.when(F.col("record_type") == "response", F.octet_length("payload").cast("bigint")).alias("own_bytes"),
        F.when(F.col("record_type") == "response", base32_sha1(F.col("payload").cast("binary"))).alias("own_digest"),
    )
    responses = (
        facts.where("record_type = 'response'")
        .groupBy(F.col("record_id").alias("original_id"))
        .agg(
            F.first("page_id").alias("original_page"),
            F.first("own_bytes").alias("original_bytes"),
            F.first("own_digest").alias("original_digest"),
        )
    )
    at = F.coalesce("refers_to_record", "record_id")
    joined = facts.join(responses, at == F.col("original_id"), "left")
    revisit = F.col("record_type") == "revisit"
    return joined.select(
        "page_id",
        F.col("original_bytes").alias("payload_bytes"),
        F.col("original_digest").alias("payload_digest"),
        "record_type",
        F.when(revisit, F.col("original_page")).alias("refers_to"),
    )


def archive_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages as one deduplicated archive in the shared folder, read it back and resolve it."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    archive = write_archive(plan_revisits(records(pages), least_bytes), path)
    return resolve_revisits(read_archive(spark, path, archive))


def deduplicate_archive(spark: SparkSession, path: str, archive: str, to: str, least_bytes: int = 0) -> str:
    """Rewrite an archive with fresh headers so that equal payloads are stored once; returns the new archive's id."""
    old = read_archive(spark, path, archive)
    heads = resolve_revisits(old).select(
        F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")
    )
    payloads = old.where("record_type = 'response'").select(
        base32_sha1(F.col("payload").cast("binary")).alias("digest"), "payload"
    )
    planned = plan_revisits(
        heads.select(F.col("p").alias("page_id"), F.col("b").alias("payload_bytes"), F.col("d").alias("payload_digest")),
        least_bytes,
    )
    once = payloads.dropDuplicates(["digest"])
    urls = old.select(F.col("page_id").alias("url_page"), "url").dropDuplicates(["url_page"])
    rows = planned.join(once, planned.payload_digest == once.digest, "left").join(
        urls, F.col("page_id").eqNullSafe(F.col("url_page")), "left"
    )
    return write_archive(rows, to)
