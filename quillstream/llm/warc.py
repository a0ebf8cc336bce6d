"""WARC archives: a writer through Spark's own sinks, and a salvage reader.

The writer makes each record a string on the JVM side and lets the text sink write it, with CRLF CRLF
as the line separator: files go to any store that Spark writes, under its commit protocol, so a lost
executor or a second attempt leaves no half-written archive behind.

The reader takes plain and gzip archives, with any number of records in a member.  Every record is
checked: version line, header block, Content-Length, the CRLF CRLF behind the block, block and payload
digests, and the CRC of a gzip member.  After a failed check it searches for the next place where a valid
member or version line starts, carries on there, and logs the bytes between as a quarantined gap.  The
same search goes on inside a member, over as much of it as can be inflated: sound records before and
behind a broken one are recovered.  Where the compressed data themselves are broken, inflated bytes may be
wrong without an error: only records with a digest that fits, in front of the first failure, count as sound.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

END = b"\r\n\r\n"
_END = re.compile(END)
DIGESTS = ("sha1", "sha256", "md5")
#: Where a member or a version line may start: anywhere, since a cut-off record need not end in a line break.
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.")
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "


class Record(NamedTuple):
    """A sound record; offset and length are bytes of the file: of the member, if it is inside one.

    `inner` is the place in the inflated member, else -1.
    """

    offset: int
    length: int
    headers: dict[str, str]
    block: bytes
    inner: int = -1


class Gap(NamedTuple):
    """Quarantined bytes of the file or, with `inner` and `inner_length`, of the inflated member there."""

    offset: int
    length: int
    reason: str
    inner: int = -1
    inner_length: int = 0


class Broken(ValueError):
    """A record that failed a check."""


class Ends:
    """Finds the ends of header blocks; a search that goes forward reads a buffer once."""

    def __init__(self, buf: bytes | memoryview):
        self.buf, self.start, self.found = buf, 0, -2

    def after(self, at: int) -> int:
        """Place of the first CRLF CRLF at or behind `at`, or -1."""
        if self.found == -2 or at < self.start or 0 <= self.found < at:
            hit = _END.search(self.buf, at)
            self.start, self.found = at, hit.start() if hit else -1
        return self.found


def parse_record(buf: bytes | memoryview, at: int, ends: Ends | None = None) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record that starts at `at`; raises Broken if a check fails."""
    if buf[at : at + 7] != b"WARC/1.":
        raise Broken("no version line")
    head_end = (ends or Ends(buf)).after(at)
    if head_end < 0:
        raise Broken("header block without end")
    lines = bytes(buf[at:head_end]).split(b"\r\n")
    if not re.fullmatch(rb"WARC/1\.\d+", lines[0]):
        raise Broken("malformed version line")
    headers: dict[str, str] = {}
    name = ""
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and name:
            headers[name] += " " + line.strip().decode("utf-8", "replace")
            continue
        key, colon, value = line.partition(b":")
        if not colon or not key.strip():
            raise Broken("malformed header line")
        name = key.strip().decode("utf-8", "replace").lower()
        headers[name] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        raise Broken("no Content-Length")
    start = head_end + 4
    end = start + int(length)
    if buf[end : end + 4] != END:
        raise Broken("block is not followed by CRLF CRLF")
    block = bytes(buf[start:end])
    if "warc-block-digest" in headers and not digest_fits(headers["warc-block-digest"], block):
        raise Broken("block digest differs")
    if headers.get("warc-type") != "revisit" and "warc-payload-digest" in headers and not digest_fits(headers["warc-payload-digest"], payload_of(headers, block)):
        raise Broken("payload digest differs")
    return headers, block, end + 4


def proven(headers: dict[str, str]) -> bool:
    """Whether a digest of a known kind has been checked against the record's own bytes."""
    digests = [headers.get("warc-block-digest", "")]
    if headers.get("warc-type") != "revisit":
        digests.append(headers.get("warc-payload-digest", ""))
    return any(d.partition(":")[0].lower() in DIGESTS for d in digests)


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The payload: what follows the HTTP header of an application/http block, else the block."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(END)[2]
    return block


def digest_fits(digest: str, data: bytes) -> bool:
    """Whether a labelled digest (hex or base 32) is that of `data`; unknown algorithms pass."""
    kind, _, value = digest.partition(":")
    if kind.lower() not in DIGESTS:
        return True
    raw = hashlib.new(kind.lower(), data)
    return value.lower() == raw.hexdigest() or value.upper() == base64.b32encode(raw.digest()).decode().rstrip("=")


def _member(buf: bytes | memoryview, at: int) -> tuple[bytes, int, str]:
    """Content of the gzip member at `at` as far as it can be inflated, its end, and what is wrong with it."""
    inflate, parts, view = zlib.decompressobj(31), [], memoryview(buf)
    for start in range(at, len(buf), 1 << 16):
        chunk = view[start : start + (1 << 16)]
        try:
            parts.append(inflate.decompress(chunk))
        except zlib.error as e:
            parts.append(_until_error(inflate_to(buf, at, start), chunk))
            return b"".join(parts), len(buf), f"gzip member: {str(e)[:60]}"
        if inflate.eof:
            return b"".join(parts), start + len(chunk) - len(inflate.unused_data), ""
    return b"".join(parts), len(buf), CUT_OFF


CUT_OFF = "gzip member without end"


def inflate_to(buf: bytes | memoryview, at: int, end: int):
    """An inflater that has read the bytes from `at` to `end`."""
    inflate, view = zlib.decompressobj(31), memoryview(buf)
    for start in range(at, end, 1 << 16):
        inflate.decompress(view[start : min(end, start + (1 << 16))])
    return inflate


def _until_error(inflate, chunk: memoryview) -> bytes:
    """What can be inflated of a chunk that holds an error, byte by byte."""
    parts = []
    try:
        for i in range(len(chunk)):
            parts.append(inflate.decompress(chunk[i : i + 1]))
    except zlib.error:
        pass
    return b"".join(parts)


def _unit(buf: bytes | memoryview, at: int, ends: Ends) -> tuple[list[Record | Gap], int, bool]:
    """Records and inner gaps of the member or plain record at `at`, its end, and whether it is sound.

    Of a member with broken data the end is not known: it counts as the end of the file.
    """
    if buf[at : at + 3] != b"\x1f\x8b\x08":
        headers, block, end = parse_record(buf, at, ends)
        return [Record(at, end - at, headers, block)], end, True
    content, end, wrong = _member(buf, at)
    found: list[Record | Gap] = []
    inner = list(_items(content))
    failure = next((i for i, x in enumerate(inner) if isinstance(x, Gap)), 0)
    for i, item in enumerate(inner):
        if isinstance(item, Record) and wrong and wrong != CUT_OFF and (i >= failure or not proven(item.headers)):
            item = Gap(item.offset, item.length, "not proven in a broken member")
        if isinstance(item, Record):
            found.append(Record(at, end - at, item.headers, item.block, item.offset))
        else:
            found.append(Gap(at, end - at, item.reason, item.offset, item.length))
    if not any(isinstance(x, Record) for x in found):
        raise Broken(wrong or (found[0].reason if found else "empty gzip member"))
    return found, end, not wrong


def _items(buf: bytes | memoryview) -> Iterator[Record | Gap]:
    """Records and gaps of a buffer, in order."""
    at, ends, reason, gap = 0, Ends(buf), "", -1
    while at < len(buf):
        try:
            found, end, sound = _unit(buf, at, ends)
        except Broken as broken:
            if gap < 0:
                reason, gap = str(broken), at
            start = _START.search(buf, at + 1)
            at = len(buf) if start is None else start.start()
            continue
        if gap >= 0:
            yield Gap(gap, at - gap, reason)
            gap = -1
        if not sound:  # its bytes reach to the next place where something is sound
            nxt = _next_sound(buf, at + 1, ends)
            found, end = [x._replace(length=nxt - at) for x in found], nxt
        yield from found
        at = end
    if gap >= 0:
        yield Gap(gap, len(buf) - gap, reason)


def _next_sound(buf: bytes | memoryview, at: int, ends: Ends) -> int:
    """The next place at which a unit starts that holds a record, or the end."""
    while (start := _START.search(buf, at)) is not None:
        try:
            _unit(buf, start.start(), ends)
            return start.start()
        except Broken:
            at = start.start() + 1
    return len(buf)


def salvage(buf: bytes | memoryview) -> Iterator[Record | Gap]:
    """All records of an archive that pass the checks, and the gaps, in order.

    An empty archive has neither; one without any sound record is one gap.  Records that repeat, also
    their ids, all come.  Items tile the file: each starts where the one before it ends, but for those
    inside one member, which share its place and have an inner one.
    """
    yield from _items(buf)


def encode_record(headers: dict[str, str], block: bytes, gzip: bool = False) -> bytes:
    """One record as bytes, for archives built outside Spark."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers.items()) + f"Content-Length: {len(block)}\r\n\r\n"
    data = head.encode() + block + END
    if gzip:
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        data = pack.compress(data) + pack.flush()
    return data


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of all archives under `path`.

    Columns: path, offset, length (bytes in the file), inner_offset, inner_length (of items inside a gzip
    member: bytes of the inflated member), kind (record or gap), reason (of a gap), warc_type, record_id, target_uri, refers_to, date, payload_digest (SHA-1 of the payload as read; a
    revisit's is the one it names), payload_bytes (likewise), headers, payload (if `with_payload`; null
    for revisits).  An empty file has no rows; a file without any valid record is one gap; a path without
    files has no rows.  A file is one task, in memory once, and Spark reads none of 2 GiB or more: it fails
    there and leaves nothing out.  `write_warc` makes archives of some tens of MB.
    """
    schema = "path string, offset long, length long, inner_offset long, inner_length long, kind string, reason string, warc_type string, record_id string, target_uri string, refers_to string, date string, payload_digest string, payload_bytes long, headers map<string,string>" + (", payload binary" if with_payload else "")
    names = [x.strip().split(" ")[0] for x in re.sub(r"<.*?>", "", schema).split(",")]
    types = [pa.string(), *[pa.int64()] * 4, *[pa.string()] * 8, pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                for item in salvage(memoryview(content.as_buffer()).cast("B")):
                    rows.append(_row(path.as_py(), item, with_payload))
                    held += len(item.block) if isinstance(item, Record) else 0
                    if held > 8 << 20:
                        yield _batch(rows, names, types)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names, types)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") > 0)
    return files.select("path", "content").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=names)


def _row(path: str, item: Record | Gap, with_payload: bool) -> tuple:
    if isinstance(item, Gap):
        inner = (item.inner, item.inner_length) if item.inner >= 0 else (None, None)
        row = (path, item.offset, item.length, *inner, "gap", item.reason, None, None, None, None, None, None, None, None)
        return (*row, None) if with_payload else row
    h = item.headers
    bare = lambda name: h[name].strip("<>") if name in h else None
    if h.get("warc-type") == "revisit":
        payload, digest = None, h.get("warc-payload-digest", "").partition(":")[2] or None
        size = int(h["warc-payload-length"]) if h.get("warc-payload-length", "").isdigit() else None
    else:
        payload = payload_of(h, item.block)
        digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
    inner = (item.inner, None) if item.inner >= 0 else (None, None)
    row = (path, item.offset, item.length, *inner, "record", None, h.get("warc-type"), bare("warc-record-id"), h.get("warc-target-uri"), bare("warc-refers-to"), h.get("warc-date"), digest, size, list(h.items()))
    return (*row, payload) if with_payload else row


def resolve_revisits(records: DataFrame) -> DataFrame:
    """`records` (of `read_warc`) with the payload size and digest of revisits taken from the record they name.

    These are those of the payload as it was read back; a revisit of a record that is not there, or of
    one whose id is repeated with unlike payloads, keeps what its own header says.  Digests and ids are
    shuffled, payloads are not looked at.
    """
    own = records.filter("kind = 'record' and warc_type <> 'revisit' and record_id is not null")
    own = own.groupBy(F.col("record_id").alias("_id")).agg(F.min("payload_digest").alias("_digest"), F.max("payload_digest").alias("_other"), F.min("payload_bytes").alias("_bytes"))
    own = own.filter("_digest = _other").drop("_other")
    named = F.when(F.col("warc_type") == "revisit", F.col("refers_to"))
    return records.join(own, named == F.col("_id"), "left").withColumns({
        "payload_digest": F.coalesce("_digest", "payload_digest"), "payload_bytes": F.coalesce("_bytes", "payload_bytes"),
    }).select(records.columns)


def plan_revisits(pages: DataFrame, id_col: str, payload: Column, least_bytes: int = 1000) -> DataFrame:
    """(digest, bytes, keeper) of payloads of at least `least_bytes` that several rows share.

    The keeper is the row with the largest id.  Only digests are shuffled, after partial aggregation.
    """
    keys = pages.select(F.col(id_col).alias("keeper"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("bytes"))
    shared = keys.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.max("keeper").alias("keeper"), F.count(F.lit(1)).alias("n"))
    return written(shared.filter("n > 1").drop("n"), "warc-shared")


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", least_bytes: int = 1000, records_per_file: int = 2000, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write one record per row: a response with the payload, or a revisit of the row that holds it.

    The payload is the text in UTF-8 (null: empty).  Of rows with equal payloads of `least_bytes` or more
    the one with the largest id is the response (all of them, if that id is repeated) and the others are
    revisits.  Null ids make records without a number; line breaks in URLs become spaces.  Other columns
    are left out.  The payloads are shuffled only where the table of shared digests is too large for
    Spark to broadcast.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(text_col), F.lit("")).alias("payload"))
    shared = plan_revisits(rows, "id", F.col("payload"), least_bytes)
    rows = rows.withColumns({"digest": F.sha1("payload"), "bytes": F.octet_length("payload").cast("long")}).join(shared, ["digest", "bytes"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("id"))
    line = lambda name, value: F.concat(F.lit(f"\r\n{name}: "), value)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    uri = F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]+", " "))).otherwise("")
    http = F.concat(F.lit(_HTTP), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    common = F.concat(line("WARC-Record-ID", urn(F.col("id"))), line("WARC-Date", F.lit(date)), uri, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))))
    response = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response"), common, F.lit("\r\nContent-Type: application/http; msgtype=response"),
        line("Content-Length", (F.octet_length(http) + F.col("bytes")).cast("string")), F.lit("\r\n\r\n"), http, F.col("payload"),
    )
    again = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: revisit"), common, line("WARC-Refers-To", urn(F.col("keeper"))), line("WARC-Payload-Length", F.col("bytes").cast("string")),
        F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nContent-Length: 0\r\n\r\n"),
    )
    rows.select(F.when(revisit, again).otherwise(response).alias("value")).write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", records_per_file).text(path)
