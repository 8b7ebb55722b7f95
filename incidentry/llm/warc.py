"""WARC archives in which a payload stands once: later captures of the same payload are revisit records.

Headers alone (page id, digest, size) are grouped by payload digest to find the original of each repeated payload:
the largest page id. The few digests that repeat are joined back to the pages, and Spark's text writer lays the records
down one after the other, so a part of the archive is a gzipped WARC file as it stands. Reading parses the parts and joins
revisit records to their originals for what a revisit does not repeat.

Records: a response carries an HTTP header and the payload; a revisit carries the HTTP header alone, under the
identical-payload-digest profile, and names its original. Both have fresh ids, dates, digests and lengths.

Defined results: null html is an empty payload; null urls are left out, line breaks in urls are escaped. Payloads
shorter than ``LEAST_BYTES`` are always responses. Rows that repeat the largest page id of a payload are all
responses. A null page id is smaller than any other; a payload whose ids are all null has responses alone. Columns
beyond id, url and html are not kept. An empty table gives an empty archive.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.llm.common import arrow_schema, checked_broadcast, written

LEAST_BYTES = 1000
#: Size of one archive part before the last record in it.
PART_BYTES = 24 * 1024 * 1024
# Fixed values of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
END = "\r\n\r\n"


def headers(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, digest, bytes) of each page; the digest is the lower-case hex SHA-1 of the UTF-8 payload."""
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8")
    return pages.select(F.col(id_col).alias("page_id"), F.sha1(payload).alias("digest"),
                        F.octet_length(payload).cast("long").alias("bytes"))


def originals(heads: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(digest, bytes, original): the response of every payload that more than one row holds.

    Counted per digest before the shuffle, so a payload that a third of all pages hold is one row a task.
    """
    return heads.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(
        F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1 and original is not null").drop("n")


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(""))))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n")), F.lit(""))


def records(pages: DataFrame, date: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            least: int = LEAST_BYTES) -> DataFrame:
    """(bytes, record): the text of each page's WARC record without its closing blank lines."""
    payload = F.coalesce(F.col(html_col), F.lit(""))
    url = F.replace(F.replace(F.col(url_col), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    # The payloads that repeat are few beside the pages; where they are not, the join shuffles.
    again = written(originals(headers(pages, id_col, html_col), least), "originals")
    rows = pages.select(F.col(id_col).alias("page_id"), url.alias("url"), payload.alias("payload"),
                        F.sha1(F.encode(payload, "utf-8")).alias("digest"),
                        F.octet_length(F.encode(payload, "utf-8")).cast("long").alias("bytes"))
    placed = rows.join(checked_broadcast(again, 96), ["digest", "bytes"], "left").withColumn(
        "again", F.coalesce(~F.col("page_id").eqNullSafe(F.col("original")) & F.col("original").isNotNull(), F.lit(False)))
    http = F.concat(F.lit(HTTP), F.lit("Content-Length: "), F.col("bytes").cast("string"), F.lit(END))
    block = F.when(F.col("again"), http).otherwise(F.concat(http, F.col("payload")))
    original = F.when(F.col("again"), F.col("original"))
    head = F.concat(
        F.lit(f"{VERSION}\r\n"),
        _line("WARC-Type", F.when(F.col("again"), "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page_id"))), _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")), _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        _line("WARC-Profile", F.when(F.col("again"), PROFILE)),
        _line("WARC-Refers-To", F.when(F.col("again"), _record_id(original))),
        _line("WARC-Refers-To-Date", F.when(F.col("again"), date)),
        _line("X-Page-ID", F.col("page_id")), _line("X-Refers-To-Page-ID", original),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", F.octet_length(F.encode(block, "utf-8"))), F.lit("\r\n"))
    return placed.select(F.octet_length(F.encode(block, "utf-8")).cast("long").alias("bytes"),
                         F.concat(head, block).alias("record"))


def write_archive(pages: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z", part_bytes: int = PART_BYTES,
                  id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Write ``pages`` as WARC parts of about ``part_bytes`` each before they are compressed."""
    total = pages.agg(F.sum(F.octet_length(html_col) + 600)).first()[0] or 0
    found = records(pages, date, id_col, url_col, html_col)
    parts = max(1, -(-total // part_bytes))
    found.select("record").repartition(int(parts)).write.option("lineSep", END).text(path, compression="gzip")


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record of a WARC file."""
    at = 0
    while at < len(raw):
        cut = raw.index(b"\r\n\r\n", at)
        first, *lines = raw[at:cut].decode("utf-8", "surrogatepass").split("\r\n")
        if first != VERSION:
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines)}
        start = cut + 4
        end = start + int(fields["content-length"])
        yield fields, raw[start:end]
        at = end + 4


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, record_type, digest, bytes, refers_to) as the records of an archive say.

    ``bytes`` and ``digest`` of a response are those of the payload that was read; a revisit has no payload.
    """
    schema = "page_id long, record_type string, digest string, bytes long, refers_to long"
    target = arrow_schema(schema)

    def unpack(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                rows = []
                for fields, block in parse(gzip.decompress(batch.column(0)[k].as_py())):
                    page, other = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                    payload = memoryview(block)[block.index(b"\r\n\r\n") + 4:]
                    said = fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-type"] == "response":
                        if hashlib.sha1(payload).hexdigest() != said:
                            raise ValueError(f"payload of page {page} differs from its digest")
                        size = len(payload)
                    else:
                        size = None
                    rows.append((page and int(page), fields["warc-type"], said, size, other and int(other)))
                columns = zip(*rows) if rows else [()] * len(target)  # an empty table leaves an empty part
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t.type) for c, t in zip(columns, target)], schema=target)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(unpack, schema)


def resolved(found: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take size from their originals."""
    responses = found.where("record_type = 'response'")
    revisits = found.where("record_type = 'revisit'").drop("bytes")
    wanted = revisits.select(F.col("refers_to").alias("original"), F.col("digest")).distinct()
    sizes = responses.select(F.col("page_id").alias("original"), "digest", "bytes").join(
        wanted, ["original", "digest"], "left_semi").distinct()
    met = revisits.join(sizes, (F.col("refers_to") == F.col("original")) & (revisits.digest == sizes.digest)).select(
        "page_id", "record_type", revisits.digest, "bytes", "refers_to")
    return responses.unionByName(met).select(
        "page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type",
        "refers_to")
