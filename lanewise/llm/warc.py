"""WARC archives of pages: writing them through Spark, and reading them record by record."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.rows import FILE, KEY, ROW, keyed, ship, utf8
from lanewise.session import shared_folder, write_table

SMALLEST_REVISIT = 100
PIECE = 1 << 16
RECORDS_PER_ARCHIVE = 2_000
DATE = "2025-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def member(payload: bytes) -> bytes:
    """One gzip member; the time stamp is left out, so equal records are equal bytes."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(payload) + packer.flush()


def record(uri: str, name: str, payload: bytes, original: str | None) -> bytes:
    """A response record with the payload, or a revisit of ``original`` with its HTTP head only.

    Both carry the digest and, in the HTTP head, the length of the full payload.
    """
    head = _HTTP.format(len(payload)).encode()
    block = head if original else head + payload
    fields = [
        ("WARC-Type", "revisit" if original else "response"),
        ("WARC-Record-ID", f"<{name}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", "sha256:" + hashlib.sha256(payload).hexdigest()),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        *([("WARC-Refers-To", f"<{original}>"), ("WARC-Profile", PROFILE)] if original else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {v}\r\n" for k, v in fields), "\r\n"]).encode() + block + b"\r\n\r\n"


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    faults: list[str]

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def payload_bytes(self) -> int:
        """Length of the full payload as the HTTP head states it."""
        head = self.block.partition(b"\r\n\r\n")[0].decode("latin-1").lower()
        return int(dict(x.split(": ", 1) for x in head.split("\r\n")[1:])["content-length"])


def _members(archive: bytes) -> Iterator[bytes]:
    """Each gzip member's content, unpacked piece by piece; the next begins where it ends."""
    at, view = 0, memoryview(archive)
    while at < len(view):
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            piece = view[at : at + PIECE]
            if not piece:
                raise EOFError("an archive ends within a gzip member")
            parts.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        if content := b"".join(parts):
            yield content


def records(archive: bytes) -> Iterator[Record]:
    """Sequential reader: one member, one record, framed by Content-Length, digests verified.

    A record that breaks the frame or a digest is returned with its faults; a member that is no
    gzip, or is cut short, raises.
    """
    for content in _members(archive):
        head, _, body = content.partition(b"\r\n\r\n")
        version, *lines = head.decode("utf-8").split("\r\n")
        headers = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
        length = int(headers["content-length"])
        found = Record(headers, body[:length], [])
        if not version.startswith("WARC/"):
            found.faults.append("version")
        if body[length:] != b"\r\n\r\n":
            found.faults.append("frame")
        if headers["warc-block-digest"] != "sha256:" + hashlib.sha256(found.block).hexdigest():
            found.faults.append("block digest")
        if headers["warc-type"] == "response" and headers["warc-payload-digest"] != "sha256:" + hashlib.sha256(found.payload).hexdigest():
            found.faults.append("payload digest")
        yield found


def _name(page: str, file: str, row: str) -> F.Column:
    """Record name: the page and, since pages may repeat, its row."""
    return F.concat(F.lit("urn:page:"), F.coalesce(F.col(page).cast("string"), F.lit("")), F.lit(":"), F.col(file), F.lit(":"), F.col(row))


def write_archives(pages: DataFrame, folder: str, smallest: int = SMALLEST_REVISIT) -> None:
    """One record for each row of ``pages`` (page_id, url, html), as .warc.gz files in ``folder``.

    Payload is the html in UTF-8, null is empty. Of rows with equal payloads of at least
    ``smallest`` bytes, the one with the smallest page_id (null last), then the first row, is
    the response; the others revisit it. Which payloads repeat is found from digests, summed
    before they meet; only repeated ones are joined back, and a payload that a third of the
    rows share is split like any skewed join. An archive holds RECORDS_PER_ARCHIVE at most.

    Spark's text sink writes the bytes, so any store that Spark knows will do: a gzip member of
    less than 16 MiB ends in a zero byte, which serves as the line end. A longer one is
    followed by an empty member, which ends in zero too and which readers skip.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    slim = keyed(pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")), "page_id", "url", "html")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", *KEY)
    large = F.octet_length("html") >= smallest
    firsts = (
        slim.where(large)
        .groupBy(F.sha2("html", 256).alias("digest"))
        .agg(F.min(order).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", F.col("first.page_id").alias("p"), F.col(f"first.{FILE}").alias("f"), F.col(f"first.{ROW}").alias("r"))
    )
    own, original = _name("page_id", FILE, ROW), _name("p", "f", "r")
    joined = slim.join(write_table(firsts, "firsts"), large & (F.sha2("html", 256) == F.col("digest")), "left")
    named = joined.select("url", "html", own.alias("name"), F.when(original != own, original).alias("original"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = []
            for url, html, name, original in zip(batch["url"].to_pylist(), utf8(batch["html"]), batch["name"].to_pylist(), batch["original"].to_pylist()):
                uri = "".join(c if " " < c < "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or name)
                packed = member(record(uri, name, html, original))
                lines.append((packed if packed[-1] == 0 else packed + member(b""))[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["line"])

    lines = named.mapInArrow(run, "line binary").select(F.col("line").cast("string"))
    lines.write.option("lineSep", "\0").option("maxRecordsPerFile", RECORDS_PER_ARCHIVE).text(folder)


def read_archives(spark, folder: str) -> DataFrame:
    """(record_id, record_type, payload_digest, payload_bytes, refers_to_id, faults) of every record in ``folder``.

    Archives are read whole by a task each, and their records one after the other.
    """
    names = ["record_id", "record_type", "payload_digest", "payload_bytes", "refers_to_id", "faults"]
    schema = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.list_(pa.string()) if n == "faults" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in utf8(batch["content"]):
                out = []
                for x in records(archive):
                    refers = x.headers.get("warc-refers-to")
                    values = (x.headers["warc-record-id"][1:-1], x.headers["warc-type"], x.headers["warc-payload-digest"].removeprefix("sha256:"), x.payload_bytes, refers and refers[1:-1], x.faults)
                    out.append(dict(zip(names, values)))
                yield pa.RecordBatch.from_pylist(out, schema)

    files = spark.read.format("binaryFile").load(folder).select("content")
    return files.mapInArrow(run, "record_id string, record_type string, payload_digest string, payload_bytes long, refers_to_id string, faults array<string>")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write every page to archives, read them back, and return one row for each page.

    (page_id, payload_bytes, payload_digest, record_type, refers_to): refers_to is the page of
    the response that a revisit names, which must be in the archives with the same digest. A
    record with a fault, or a revisit without its response, raises. Null html is an empty
    payload and always a response; null page_ids stay null; repeated rows give a record each;
    extra columns are ignored; no pages give no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/warc-{spark.sql('SELECT uuid()').first()[0]}"
    write_archives(pages, folder)
    found = write_table(read_archives(spark, folder), "records")
    page = lambda c: F.split(c, ":")[2].try_cast("long")
    responses = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("payload_digest").alias("original_digest"))
    joined = found.join(responses, "refers_to_id", "left")
    lost = (F.col("record_type") == "revisit") & ~F.coalesce(F.col("original_digest") == F.col("payload_digest"), F.lit(False))
    fault = F.when(F.size("faults") > 0, F.concat_ws(", ", "faults")).when(lost, F.lit("no response for a revisit"))
    checked = F.when(fault.isNull(), F.col("payload_bytes")).otherwise(F.raise_error(F.concat_ws(": ", "record_id", fault)).cast("long"))
    return joined.select(page("record_id").alias("page_id"), checked.alias("payload_bytes"), "payload_digest", "record_type", page("refers_to_id").alias("refers_to"))


ship(__name__)
