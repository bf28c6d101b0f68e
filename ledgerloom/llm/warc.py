"""WARC archives: pages written as records with revisits, and a reader that salvages damaged archives.

`write` makes one record of every page, payload the html in UTF-8 (null: empty). Of equal payloads the one of the smallest
page_id (null last) is the response, the others are revisits that name it; page rows that share even the id are told apart
by their place in a written copy of the table, so one of them is the response, also where rows repeat entirely. Which row
it is comes from counts per (digest, salt): a digest that a third of all rows share is spread over the salts, in the counts
and in the join that hands the winner to the rows. Archives hold about ARCHIVE bytes, a longer record is one of its own.
They are written by Spark's text sink, whose commit keeps lost tasks out, as `part-*` files whatever their content: gzip
members, one a record, with a zero byte of padding at the end, or plain records.

`read` gives one row per record and one per gap. A record counts when its checks hold: version line, the three named
fields that WARC asks for, block length, record end, and the SHA-1 digests of block and payload it states; in a member the
checksum of gzip too. Where they fail, the reader looks for the next member or version line with a whole record
behind it, goes on there, and reports the bytes between as a gap with the reason. A whole record that lies inside the
payload of a damaged one is recovered as a record. A gap inside a sound member has offsets within its inflated bytes too.

Memory: one archive, and one record inflated, a task; an archive is a row of Spark's binary reader and so below 2 GB.
Empty tables give a folder without archives and no rows. Control characters and spaces of a url are percent-encoded.
Columns other than the three named are not read, so their names don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.common import byte_bound, cut

ARCHIVE = 8 << 20
#: Bytes fed to the inflater at once.
FEED = 1 << 18
# Fixed values of the file format.
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/\d+\.\d+\r?\n")
NAMED = ("warc-type", "warc-record-id", "content-length")
END = b"\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

COLUMNS = ("path string, kind string, offset long, length long, inner long, inner_length long, reason string, type string, "
           "record_id string, headers map<string,string>, http map<string,string>, payload_bytes long, payload_digest string, "
           "payload binary")


def digest_name(raw: bytes) -> str:
    return base64.b32encode(raw).decode()


# writing

def routed(pages: DataFrame, least: int, id: str, url: str, html: str) -> DataFrame:
    """Rows with their payload, digest and, for a revisit, the response: `to_id`, `to_row`."""
    spark = pages.sparkSession
    salts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    body = F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")
    rows = cut(pages.select(F.col(id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
               .withColumn("digest", F.unhex(F.sha1("payload"))), "pages", compression="zstd")
    rows = rows.select("*", F.concat_ws(":", F.col("_metadata.file_name"), F.col("_metadata.row_index").cast("string"))
                       .alias("row")).withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts)).cast("int"))
    place = F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "row")
    counted = rows.where(F.length("payload") >= least).groupBy("digest", "salt").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    first = counted.groupBy("digest").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").drop("n")
    known = counted.select("digest", "salt").join(first, "digest")
    same = F.col("row") == F.col("first.row")
    return rows.join(known, ["digest", "salt"], "left").select(
        "page_id", "url", "payload", "digest", "row", F.when(~same, F.col("first.page_id")).alias("to_id"),
        F.when(~same, F.col("first.row")).alias("to_row"))


def record_id(row: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(row.encode()).digest())}>"


def line(text: str) -> str:
    """A field value on one line."""
    return re.sub("[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record(page_id, url, payload: bytes, digest: bytes, row: str, to_id, to_row, date: str) -> bytes:
    """One record without its end mark."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if to_row is not None else http + payload
    fields = ["WARC/1.1", f"WARC-Type: {'response' if to_row is None else 'revisit'}", f"WARC-Record-ID: {record_id(row)}",
              f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest_name(digest)}",
              f"WARC-Block-Digest: sha1:{digest_name(hashlib.sha1(block).digest())}",
              "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        fields.append(f"WARC-Target-URI: {line(url)}")
    if page_id is not None:
        fields.append(f"Page-ID: {page_id}")
    if to_row is not None:
        fields += [f"WARC-Refers-To: {record_id(to_row)}", f"WARC-Profile: {REVISIT}", "WARC-Truncated: length"]
        if to_id is not None:
            fields.append(f"Refers-To-Page-ID: {to_id}")
    return "\r\n".join(fields).encode() + END + block


def write(pages: DataFrame, folder: str, compress: bool = True, least: int = 0, date: str = "1970-01-01T00:00:00Z",
          id: str = "page_id", url: str = "url", html: str = "html", archive: int = ARCHIVE) -> None:
    """Archives of all pages in a new folder. Payloads of fewer than `least` bytes are responses always."""
    byte_bound(pages.sparkSession)

    def archives(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def full():
            whole = b"".join(held) if compress else END.join(held)
            return pa.record_batch([pa.array([whole], pa.binary())], ["archive"])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                one = record(*row, date)
                if compress:
                    z = zlib.compressobj(6, zlib.DEFLATED, 31)
                    one = z.compress(one + END) + z.flush()
                if held and size + len(one) > archive:
                    yield full()
                    held, size = [], 0
                held.append(one)
                size += len(one)
        if held:
            yield full()

    made = routed(pages, least, id, url, html).mapInArrow(archives, "archive binary")
    made.select(F.col("archive").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option(
        "lineSep", "\0" if compress else END.decode()).text(folder)


# reading

class Bad(Exception):
    """A check that fails, by name."""


def fields(lines: list[bytes]) -> dict[str, str]:
    found: dict[str, str] = {}
    for x in lines:
        name, sep, value = x.partition(b":")
        if sep:
            name, value = name.strip().lower().decode("latin-1"), value.strip().decode("utf-8", "replace")
            found[name] = f"{found[name]}, {value}" if name in found else value
    return found


def stated(head: dict, name: str) -> str | None:
    """The base32 SHA-1 that a field states."""
    kind, _, value = head.get(name, "").partition(":")
    return value.strip().upper() if kind.strip().lower() == "sha1" else None


def parse(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at a place, and where it ends; Bad where a check fails."""
    begun = VERSION.match(data, at)
    if not begun:
        raise Bad("no version line")
    to = data.find(END, begun.end() - 2)
    if to < 0:
        raise Bad("headers without end")
    within = VERSION.search(data, begun.end(), to)
    if within and whole(data, within.start()):
        raise Bad("headers run into the next record")
    head = fields(data[begun.end():to].split(b"\r\n"))
    if any(not head.get(x) for x in NAMED):
        raise Bad("named field missing")
    if not head["content-length"].isdecimal():
        raise Bad("length is no number")
    start = to + 4
    end = start + int(head["content-length"])
    if end > len(data):
        raise Bad("block cut off")
    if data[end:end + 4] != END:
        raise Bad("record end missing")
    block = data[start:end]
    if (want := stated(head, "warc-block-digest")) and want != digest_name(hashlib.sha1(block).digest()):
        raise Bad("block digest differs")
    http, payload = {}, block
    if head.get("content-type", "").lower().startswith("application/http"):
        top, mark, payload = block.partition(END)
        http = fields(top.split(b"\r\n")[1:])
        if not mark:
            payload = b""
    want = stated(head, "warc-payload-digest")
    if head["warc-type"] == "revisit":
        size = http.get("content-length", "")
        size, sha = int(size) if size.isdecimal() else None, want
    else:
        size, sha = len(payload), digest_name(hashlib.sha1(payload).digest())
        if want and want != sha and "warc-truncated" not in head:
            raise Bad("payload digest differs")
    return {"type": head["warc-type"], "record_id": head["warc-record-id"], "headers": head, "http": http,
            "payload_bytes": size, "payload_digest": sha, "payload": payload}, end + 4


def whole(data: bytes, at: int) -> bool:
    try:
        return bool(parse(data, at))
    except Bad:
        return False


def inflate(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at a place, and where it ends."""
    z, out, to = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if to >= len(data):
                raise Bad("member cut off")
            out.append(z.decompress(data[to:to + FEED]))
            to += FEED
    except zlib.error as e:
        raise Bad("member damaged") from e
    return b"".join(out), min(to, len(data)) - len(z.unused_data)


PADDING = re.compile(rb"[\x00\r\n]*")


def salvage(data: bytes, members: bool = True) -> Iterator[dict]:
    """Records and gaps of an archive's bytes, in order."""
    at, size = 0, len(data)

    def taken(at: int) -> tuple[list[dict], int]:
        if members and data[at:at + 3] == GZIP:
            whole, end = inflate(data, at)
            inner = list(salvage(whole, members=False))
            if not any(x["kind"] == "record" for x in inner):
                raise Bad(inner[0]["reason"] if inner else "empty member")
            return [x | {"offset": at, "length": end - at, "inner": x["offset"], "inner_length": x["length"]} for x in inner], end
        found, end = parse(data, at)
        return [found | {"kind": "record", "offset": at, "length": end - at}], end

    def candidates(after: int) -> Iterator[int]:
        """Places behind one that look like a member or a version line, in order."""
        gz = data.find(GZIP, after) if members else -1
        ver = VERSION.search(data, after)
        while gz >= 0 or ver:
            if ver and (gz < 0 or ver.start() < gz):
                yield ver.start()
                ver = VERSION.search(data, ver.start() + 1)
            else:
                yield gz
                gz = data.find(GZIP, gz + 1)

    while (at := PADDING.match(data, at).end()) < size:
        try:
            got, end = taken(at)
        except Bad as why:
            got, end, begin = [], size, size
            for begin in candidates(at + 1):
                try:
                    got, end = taken(begin)
                    break
                except Bad:
                    begin = size
            yield {"kind": "gap", "offset": at, "length": begin - at, "reason": str(why)}
        yield from got
        at = end


def read(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """One row per record and per gap of all archives in a folder (or matched by a pattern); `kind` tells them apart.

    Digest and size of a payload are computed from it; a revisit has those that it states. `payload=False` leaves the
    payload null, after its checks.
    """
    byte_bound(spark)
    schema = spark.createDataFrame([], COLUMNS).schema
    names = schema.names
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(schema)

    def scanned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                path, held, size = path.as_py(), [], 0
                for x in salvage(content.as_py()):
                    body = x.pop("payload", None)
                    x["path"], x["payload"] = path, body if payload else None
                    held.append([list(v.items()) if isinstance(v := x.get(n), dict) else v for n in names])
                    size += len(body or b"") + 1000
                    if size > ARCHIVE:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*held), arrow)], schema=arrow)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(scanned, schema)


def records(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    return read(spark, folder, payload).where("kind = 'record'").drop("kind", "reason")


def gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Log of quarantined bytes: path, offset, length, inner, inner_length, reason."""
    return read(spark, folder, payload=False).where("kind = 'gap'").select("path", "offset", "length", "inner", "inner_length", "reason")
