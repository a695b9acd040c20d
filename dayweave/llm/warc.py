"""WARC archives: written as one gzip stream a file, normalised to one member a record, read."""

from __future__ import annotations

import base64
import hashlib
import sys
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dayweave.sources import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Fixed values of the format.
BREAK = "\r\n"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
GZIP = 31
STEP = 1 << 16
BATCH_BYTES = 4 << 20


def base32(sha1_hex: Column) -> Column:
    """The 160 bits of a SHA-1 in base 32, five hexadecimal digits to four of base 32."""
    quads = [F.lpad(F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_verdicts(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, n_bytes, digest, record_type and refers_to of every page.

    Of pages with equal payloads of at least `min_bytes` bytes the one with the largest page_id
    is the response, and the others revisit it. Only digests that occur twice are written and
    joined back; Spark decides by the size of that table whether it is sent to all tasks.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", payload.alias("payload")).select(
        "*", F.octet_length("payload").cast("long").alias("n_bytes"), F.sha1(F.col("payload").cast("binary")).alias("sha1")
    )
    shared = (
        rows.where(F.col("n_bytes") >= min_bytes)
        .groupBy(F.col("sha1").alias("__sha1"), F.col("n_bytes").alias("__bytes"))
        .agg(F.max("page_id").alias("holder"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("__sha1", "__bytes", "holder")
    )
    shared = materialize(shared, "shared-payloads")
    joined = rows.join(shared, (F.col("sha1") == F.col("__sha1")) & (F.col("n_bytes") == F.col("__bytes")), "left")
    revisits = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return joined.select(
        "page_id",
        "url",
        "payload",
        "n_bytes",
        base32(F.col("sha1")).alias("digest"),
        F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("holder")).alias("refers_to"),
    )


def _record(sep: Column) -> Column:
    """A record without the two line breaks at its end. Lines without a value are left out."""
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit(HTTP), F.col("n_bytes").cast("string"), sep, sep)
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("n_bytes"))
    uri = F.when(F.col("url").rlike(r"[\x00-\x20\x7F]"), F.url_encode("url")).otherwise(F.col("url"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        BREAK,
        F.lit("WARC/1.1"),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", uri),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, line("WARC-Refers-To", urn(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", length.cast("string")),
    )
    return F.concat(head, sep, sep, http, F.when(revisit, "").otherwise(F.col("payload")))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> None:
    """Write a record per page, each file of `folder` one gzip stream.

    The two line breaks that end a record are the writer's line separator.
    """
    records = with_verdicts(pages, min_bytes).select(_record(F.lit(BREAK)).alias("value"))
    records.write.option("lineSep", BREAK * 2).option("compression", "gzip").text(folder)


def _inflated(content: memoryview) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, piece by piece."""
    stream, at = zlib.decompressobj(GZIP), 0
    while at < len(content):
        yield stream.decompress(content[at : at + STEP])
        at += STEP
        if stream.eof:
            at -= len(stream.unused_data)
            stream = zlib.decompressobj(GZIP)
    yield stream.flush()


def split_records(pieces: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, int]]:
    """(header, whole record, place of its block) of every record in a stream of pieces."""
    held = bytearray()
    header, block, end = None, 0, 0
    for piece in pieces:
        held += piece
        while True:
            if header is None:
                block = held.find(b"\r\n\r\n") + 4
                if block < 4:
                    break
                lines = held[:block].decode(errors="replace").split("\r\n")
                header = dict(x.split(": ", 1) for x in lines[1:] if ": " in x)
                end = block + int(header["Content-Length"]) + 4
            if len(held) < end:
                break
            yield header, bytes(held[:end]), block
            del held[:end]
            header = None
    if held:
        raise ValueError("the archive ends inside a record")


def member(record: bytes) -> bytes:
    """A gzip member that ends with a zero byte.

    The last byte of a member is the highest of its length's four, zero below 16 MB; beyond
    that an empty member follows.
    """
    packed = zlib.compress(record, 6, GZIP)
    return packed if packed.endswith(b"\0") else packed + zlib.compress(b"", 6, GZIP)


def _rewriter(batches):
    for batch in batches:
        paths = batch.column("path").to_pylist()
        for path, content in zip(paths, batch.column("content")):
            name = path.rsplit("/", 1)[1].split(".")[0]
            rows, size, offset, index = [], 0, 0, []
            for seq, (header, record, _) in enumerate(split_records(_inflated(memoryview(content.as_buffer())))):
                packed = member(record)
                index.append(f"{header['WARC-Record-ID']}\t{offset}\t{len(packed)}\n")
                offset += len(packed)
                rows.append(("warc", name, seq, packed[:-1]))
                size += len(packed)
                if size > BATCH_BYTES:
                    yield _members(rows)
                    rows, size = [], 0
            rows.append(("index", name, 0, member("".join(index).encode())[:-1]))
            yield _members(rows)


def _members(rows):
    kinds = (pa.string(), pa.string(), pa.int64(), pa.binary())
    arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=["kind", "archive", "seq", "value"])


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder; without rows no folder was written."""
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], "path string, content binary")
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "content")


def normalise(spark: SparkSession, folder: str, out: str) -> None:
    """Rewrite gzip archives so that each record is a member of its own, with an offset index.

    Each file is inflated once, as a stream; its compressed bytes come as one row, so a file must be
    smaller than 2 GB. `out/kind=warc/archive=<name>` has the members and
    `out/kind=index/archive=<name>` their record ids, offsets and lengths, gzipped lines. Both
    go through Spark's text writer, so they reach any file system and a lost task leaves nothing
    behind: the zero byte that ends each member is the writer's line separator.
    """
    rows = _files(spark, folder).mapInArrow(_rewriter, "kind string, archive string, seq long, value binary")
    (
        rows.sortWithinPartitions("kind", "archive", "seq")
        .select("kind", "archive", F.col("value").cast("string").alias("value"))
        .write.option("lineSep", "\0")
        .partitionBy("kind", "archive")
        .text(out)
    )


def _page(urn: str | None) -> int | None:
    number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number not in ("", "null") else None


def _archive(path: str) -> str:
    return path.rsplit("/archive=", 1)[1].split("/")[0]


def _scanner(batches):
    names = ["archive", "offset", "size", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = (pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), pa.int64())
    for batch in batches:
        paths = batch.column("path").to_pylist()
        for path, content in zip(paths, batch.column("content")):
            rows = [(_archive(path), *r) for r in _scanned(memoryview(content.as_buffer()))]
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _scanned(content: memoryview):
    """What the members of an archive hold. A digest that does not fit its payload is an error."""
    start = 0
    while start < len(content):
        stream, at, parts = zlib.decompressobj(GZIP), start, []
        while not stream.eof:
            if at >= len(content):
                raise ValueError("the archive ends inside a member")
            parts.append(stream.decompress(content[at : at + STEP]))
            at += STEP
        end = min(at, len(content)) - len(stream.unused_data)
        record = b"".join(parts)
        if not record:  # the empty member behind a very long one
            start = end
            continue
        header, _, block = next(split_records(iter([record])))
        http = record.index(b"\r\n\r\n", block) + 4
        payload = record[http:-4]
        n_bytes = int(record[block:http].rsplit(b"Content-Length: ", 1)[1])
        digest = header["WARC-Payload-Digest"].removeprefix("sha1:")
        revisit = header["WARC-Type"] == "revisit"
        if not revisit and (len(payload), _sha1(payload)) != (n_bytes, digest):
            raise ValueError(f"{header['WARC-Record-ID']}: the payload does not fit its digest")
        refers = _page(header.get("WARC-Refers-To")) if revisit else None
        yield start, end - start, _page(header["WARC-Record-ID"]), n_bytes, digest, header["WARC-Type"], refers
        start = end


def _sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _index_lines(batches):
    for batch in batches:
        paths = batch.column("path").to_pylist()
        for path, content in zip(paths, batch.column("content")):
            lines = b"".join(_inflated(memoryview(content.as_buffer()))).decode().splitlines()
            rows = [(_archive(path), _page(a), int(b), int(c)) for a, b, c in (x.split("\t") for x in lines)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            columns = zip(*rows) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=["archive", "page_id", "offset", "size"]
            )


def read_index(spark: SparkSession, out: str) -> DataFrame:
    """archive, page_id, offset and size of every record, from the sidecar files."""
    return _files(spark, f"{out}/kind=index").mapInArrow(
        _index_lines, "archive string, page_id long, offset long, size long"
    )


def read_archives(spark: SparkSession, out: str) -> DataFrame:
    """What every record of the normalised archives says, and where it lies.

    `payload_bytes` and `payload_digest` are those of the full payload, also for a revisit, whose
    record does not hold it.
    """
    return _files(spark, f"{out}/kind=warc").mapInArrow(
        _scanner,
        "archive string, offset long, size long, page_id long, payload_bytes long, payload_digest string, "
        "record_type string, refers_to long",
    )


def round_trip(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Write the pages, normalise the archives and read every record through the index.

    A missing payload is an empty one, a missing url leaves out its line, a missing page_id is
    smaller than any other and comes back missing. Rows repeated with the page_id of a response
    are responses all. No pages give no records. Other columns of `pages` are not used.
    """
    spark = pages.sparkSession
    write_archives(pages, f"{folder}/streams", min_bytes)
    normalise(spark, f"{folder}/streams", f"{folder}/archives")
    records = read_archives(spark, f"{folder}/archives")
    index = read_index(spark, f"{folder}/archives").select("archive", "offset", "size")
    return records.join(index, ["archive", "offset", "size"]).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
