"""Web archives: written from pages, read back, and assembled into one nested row per capture.

A page is written as three records: its response (or, where another page has the same payload, a
revisit of that page's), the request, and metadata with the payload's length. Request and metadata
name the response through WARC-Concurrent-To; assembly joins on it. Record ids are unique, so the join
has no hot keys; pages are matched by payload digest on counts made beforehand, in a join that Spark may
split. Files are text whose records end in two line breaks, so Spark's text writer makes them, as gzip,
in folders that need only be visible to Spark. Gzip files, of one member or many, are read the same way: as
pieces between such breaks, which a task puts together by each record's Content-Length, so that it holds one
record at a time, however long the archive. Archives that aren't compressed are read whole, one at a time.

Null html counts as empty. Of rows with equal payloads those with the largest page_id are responses
(more than one if rows repeat), all others revisits. Line breaks and spaces in addresses are percent-encoded,
a null address has no header. Rows with a null page_id are captures like others, largest last.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import shared_dir

END = "\r\n\r\n"
#: Bytes of records that a task gathers before it hands them on.
BATCH = 1 << 22
DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8" + END
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(text: Column) -> Column:
    """Of the UTF-8 bytes: five hex digits at a time make four digits of base 32."""
    hexes = F.sha1(text)
    fours = [F.lpad(F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fours), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(kind: Column | str, name: Column, content_type: Column | str, block: Column, *headers: Column) -> Column:
    """A record without its end; headers that are null are left out."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), lit(kind)), F.concat(F.lit("WARC-Record-ID: <"), name, F.lit(">")), F.lit(f"WARC-Date: {DATE}"), *headers]
    lines += [F.concat(F.lit("Content-Type: "), lit(content_type)), F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"))]
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(END), block)


def header(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value)


def with_originals(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, digest, bytes, and the page_id whose payload a page revisits (null for responses)."""
    html = F.coalesce("html", F.lit(""))
    known = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html")).withColumn("bytes", F.octet_length("html").cast("long")).withColumn("digest", base32_sha1(F.col("html")))
    repeated = known.groupBy("digest").agg(F.max("page_id").alias("original"), F.count("*").alias("n")).where("n > 1").drop("n")
    original = F.when((F.col("bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))
    return known.join(repeated, "digest", "left").withColumn("original", original)


def write(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives of all pages, in a new folder."""
    p = with_originals(pages, least_bytes).withColumn("uid", F.monotonically_increasing_id().cast("string"))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    name = lambda part: F.concat(F.lit(f"urn:{part}:"), page, F.lit(":"), F.col("uid"))
    url = header("WARC-Target-URI", F.replace(F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(" "), F.lit("%20")))
    revisit = F.col("original").isNotNull()
    capture = record(
        F.when(revisit, "revisit").otherwise("response"), name("page"), "application/http; msgtype=response",
        F.when(revisit, F.lit(HTTP)).otherwise(F.concat(F.lit(HTTP), F.col("html"))),
        url, header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, header("WARC-Profile", F.lit(REVISIT))), header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("original").cast("string"), F.lit(">"))),
    )
    concurrent = header("WARC-Concurrent-To", F.concat(F.lit("<"), name("page"), F.lit(">")))
    request = record("request", name("request"), "application/http; msgtype=request", F.lit("GET / HTTP/1.1" + END), url, concurrent)
    metadata = record("metadata", name("metadata"), "application/warc-fields", F.concat(F.lit("payload-length: "), F.col("bytes").cast("string"), F.lit("\r\n")), url, concurrent)
    p.select(F.explode(F.array(capture, request, metadata)).alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


class Records:
    """Headers (names in lower case) and blocks of the records of an archive that comes in pieces."""

    def __init__(self):
        self.data, self.start, self.end, self.headers = bytearray(), 0, 0, None

    def feed(self, piece: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.data += piece
        while True:
            if self.headers is None:
                while self.data.startswith(b"\r\n"):  # more breaks than two between records, or at the end
                    del self.data[:2]
                at = self.data.find(b"\r\n\r\n")
                if at < 0:
                    return
                version, *lines = self.data[:at].decode("utf-8", "replace").split("\r\n")
                if not version.startswith("WARC/"):
                    raise ValueError(f"no WARC record: {version[:40]!r}")
                self.headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
                if "content-length" not in self.headers:
                    raise ValueError("a record without a length, or an archive that ends within a record")
                self.start, self.end = at + 4, at + 4 + int(self.headers["content-length"])
            if len(self.data) < self.end + 4:
                return
            headers, self.headers = self.headers, None
            block = bytes(self.data[self.start : self.end])
            del self.data[: self.end + 4]
            yield headers, block

    def finish(self) -> None:
        if self.data.strip():
            raise ValueError("an archive ends within a record")


RECORD = "record_type string, record_id string, concurrent_to string, refers_to string, target_uri string, payload_digest string, payload_bytes long, fields string, payload string"


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """All records of the archives in a folder; digest and length are worked out from the payload where there is one."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    bare = lambda x: x.strip("<>") if x else None

    def row(h: dict[str, str], block: bytes) -> tuple:
        kind, digest, n, fields, payload = h["warc-type"], (h.get("warc-payload-digest") or "").removeprefix("sha1:") or None, None, None, None
        if kind == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            digest, n = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
        elif kind == "metadata":
            fields = block.decode("utf-8", "replace")
        text = payload.decode("utf-8", "replace") if payloads and payload is not None else None
        return kind, bare(h["warc-record-id"]), bare(h.get("warc-concurrent-to")), bare(h.get("warc-refers-to")), h.get("warc-target-uri"), digest, n, fields, text

    types = [pa.int64() if c.endswith(" long") else pa.string() for c in RECORD.split(", ")]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces of files, in order: each file's records."""
        now, records, rows, size = None, Records(), [], 0
        for batch in batches:
            for path, piece in zip(batch.column("path").to_pylist(), batch.column("piece"), strict=True):
                if path != now:
                    records.finish()
                    now, records = path, Records()
                for headers, block in records.feed(piece.as_py() + (b"" if path is None else END.encode())):
                    rows.append(row(headers, block))
                    size += len(block)
                    if len(rows) == 2000 or size > BATCH:
                        yield packed(rows)
                        rows, size = [], 0
        records.finish()
        if rows:
            yield packed(rows)

    def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                records, data = Records(), content.as_py()
                for found in (list(records.feed(data[i : i + BATCH])) for i in range(0, len(data), BATCH)):
                    if found:
                        yield packed([row(*x) for x in found])
                for found in records.feed(END.encode()):
                    yield packed([row(*found)])

    pieces = spark.read.option("lineSep", END).option("pathGlobFilter", "part-*.gz").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("piece"))
    plain = spark.read.format("binaryFile").option("pathGlobFilter", "part-*[^z]").load(path).select("content")
    return pieces.mapInArrow(run, RECORD).unionAll(plain.mapInArrow(run_whole, RECORD))


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: the response or revisit, with its requests and metadata nested in arrays (empty if it has none).

    Records are joined on what they are concurrent to (captures: on themselves) in one exchange; those of no capture are left out.
    """
    capture = F.col("record_type").isin("response", "revisit")
    whole = F.struct("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload")
    request = F.struct(F.col("record_id").alias("request_id"), "target_uri")
    metadata = F.struct(F.col("record_id").alias("metadata_id"), "fields")
    joined = records.where(capture | F.col("record_type").isin("request", "metadata")).groupBy(F.when(capture, F.col("record_id")).otherwise(F.col("concurrent_to")).alias("id")).agg(
        F.collect_list(F.when(capture, whole)).alias("captures"),
        F.sort_array(F.collect_list(F.when(F.col("record_type") == "request", request))).alias("request"),
        F.sort_array(F.collect_list(F.when(F.col("record_type") == "metadata", metadata))).alias("metadata"),
    )
    return joined.select(F.explode("captures").alias("c"), "request", "metadata").select("c.*", "request", "metadata")


def page_of(urn: str) -> Column:
    return F.nullif(F.split_part(F.col(urn), F.lit(":"), F.lit(3)), F.lit("")).cast("long")


def captures(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, from archives written to the shared folder and read back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least_bytes)
    rows = assemble(read(spark, path, payloads=False))
    told = F.regexp_extract(F.element_at("metadata", 1)["fields"], r"payload-length: (\d+)", 1)
    return rows.select(page_of("record_id").alias("page_id"), F.coalesce("payload_bytes", F.try_to_number(told, F.lit("9" * 18)).cast("long")).alias("payload_bytes"), "payload_digest", "record_type", page_of("refers_to").alias("refers_to"))
