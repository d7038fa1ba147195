"""WARC archives: written with one gzip member per record, read back by a splittable reader.

Reading: tasks take byte ranges of the archives and scan them for the gzip magic (1f 8b 08). Every piece from one magic
to the next is a candidate member; it counts only if its header decodes and it inflates to a WARC record, else the
magic stood inside compressed data and the piece is glued to the one before. A task owns the records that start inside
its range and reads the last of them to its end. If a false magic is the first one in a range, what stands before the
range's first true member is a fragment: it goes back to the range before by (file, byte position), in a small second
step that only fragments enter.

Spark decides by name whether to split a file: one that ends in ".gz" it inflates itself, in one task, and its records are
then cut out of the plain text by their lengths. So archives that are to be read in ranges are named otherwise, as the
writer does. The writer puts an empty gzip member after each record, as what ends a row of the byte-exact text sink;
readers of gzip skip it.

No record is dropped for its digest: payload_digest of a response is computed, and digest_ok says whether the record's label
(MD5 or SHA, hex or base32) agrees; it is null where there is none that can be judged. A member that doesn't inflate even
when it is mended is a row with nothing but error, and a record shorter than it says is a row with error.

Defined cases: a member's header fields may not hold the gzip magic; null html is an empty payload; a null page_id is written as "null" and read as null; of equal payloads
all rows that carry the largest page_id are responses (repeated rows), null ids being smallest; an empty table gives no
records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, shared_dir

MAGIC = b"\x1f\x8b\x08"
#: An empty gzip member.
END = bytes.fromhex("1f8b080000000000000303000000000000000000")[:10] + bytes.fromhex("0300") + bytes(8)
#: Copies of one payload are dealt over a task for each so many.
SHARE = 50_000
#: Rows that are broadcast.
FEW = 1_000_000
MIN_REVISIT_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
RECORDS = "record_id string, record_type string, refers_to string, uri string, payload_digest string, payload_bytes long, payload binary, digest_ok boolean, error string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(page_id: int | None, uri: str | None, payload: bytes, refers: tuple | None) -> bytes:
    """One record as a gzip member. refers: the response's page_id in a tuple, or None for a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers else http + payload
    name = lambda i: f"<urn:x-page:{'null' if i is None else i}>"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    head += [f"WARC-Target-URI: {re.sub(r'[\r\n]', '', uri)}"] if uri else []
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}"]
    head += [f"WARC-Refers-To: {name(refers[0])}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if refers else []
    head.append(f"Content-Length: {len(block)}")
    coder = zlib.compressobj(4, zlib.DEFLATED, 31)
    return coder.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + coder.flush()


def plausible(piece: bytes) -> bool:
    """Whether a candidate member's header decodes: no reserved flags, and it begins to inflate as a WARC record or as nothing."""
    if len(piece) < 18 or piece[3] & 0xE0:
        return False
    try:
        got = zlib.decompressobj(31).decompress(piece, 5)
    except zlib.error:
        return False
    return got == b"WARC/" or piece == END


def inflate(piece: bytes) -> bytes | None:
    """What a whole member holds; None if it doesn't end or its check sum is wrong."""
    try:
        coder = zlib.decompressobj(31)
        out = coder.decompress(piece)
        return out if coder.eof else None
    except zlib.error:
        return None


def parse(record: bytes) -> tuple | None:
    """A row of RECORDS; None for anything but a WARC record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        return None
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    said = fields.get("content-length", "0")
    size = int(said) if said.isdecimal() else len(rest)
    error = "no length" if not said.isdecimal() else "record is cut off" if size > len(rest) else None
    block = rest[:size]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", http)
    revisit = fields.get("warc-type") == "revisit"
    label = fields.get("warc-payload-digest", "")
    own = None if revisit else sha1_base32(payload)
    return (fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-refers-to"), fields.get("warc-target-uri"), own or label.removeprefix("sha1:") or None, int(said[1]) if revisit and said else len(payload), None if revisit else payload, None if revisit else digest_ok(label, payload), error)


def digest_ok(label: str, payload: bytes) -> bool | None:
    """Whether a digest label, in hex or base32, is that of the payload; None without one, or by an algorithm that isn't known here."""
    kind, _, value = label.partition(":")
    if kind.lower() not in ("md5", "sha1", "sha256", "sha512"):
        return None
    found = hashlib.new(kind.lower(), payload).digest()
    return value.lower() == found.hex() or value.upper().rstrip("=") == base64.b32encode(found).decode().rstrip("=")


def write_archives(spark: SparkSession, pages: DataFrame, *, min_revisit_bytes: int = MIN_REVISIT_BYTES, share: int = SHARE) -> str:
    """Write a record for each row of pages (page_id, url, html) into a new folder of archives; return its path.

    Equal payloads are found by SHA-256 with partial aggregation; only groups of two and more are joined back. A group of
    more than share rows meets its response in as many parts as it has shares.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).alias("html"))
    keyed = rows.withColumn("digest", F.sha2("html", 256))
    copies = keyed.filter(F.octet_length("html") >= min_revisit_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    copies = materialise(spark, copies.withColumn("parts", F.ceil(F.col("n") / share).cast("int")), "warc-copies")
    # There is one large group for each share rows at most.
    large = copies.filter("parts > 1").select("digest", "parts")
    keyed = keyed.join(F.broadcast(large) if large.count() <= FEW else large, "digest", "left")
    keyed = keyed.withColumn("part", F.when(F.col("parts") > 1, F.pmod(F.xxhash64("page_id", "url"), F.col("parts"))).otherwise(0).cast("int"))
    first = copies.select("digest", F.struct("first").alias("first"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    joined = keyed.join(first, ["digest", "part"], "left")
    joined = joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first.first")), F.col("first")).alias("refers"))

    def run(batches):
        for batch in batches:
            ids, urls, html, refers = (batch.column(i) for i in range(4))
            for a in range(0, batch.num_rows, 128):
                out = []
                for i in range(a, min(a + 128, batch.num_rows)):
                    to = refers[i].as_py()
                    out.append(member(ids[i].as_py(), urls[i].as_py(), html[i].as_py().encode(), (to["first"],) if to else None))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    # The sink writes the bytes as they are, and after each the line separator: an empty gzip member.
    joined.mapInArrow(run, "value binary").select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option("lineSep", END.decode("latin-1")).text(path)
    return path


FIELDS = [x.split()[0] for x in RECORDS.split(", ")]


def inflated_records(lines: DataFrame) -> DataFrame:
    """Rows of RECORDS from what Spark inflates itself. lines: file and piece, what stands between two "WARC/1." of a file, in order."""

    def run(batches):
        out, file, have, held = [], None, b"", 0
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.bool_(), pa.string()]

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 9, kinds, strict=True)], FIELDS)

        def close():
            if have and (got := parse(have)):
                out.append(got)

        for batch in batches:
            for name, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head, _, rest = have.partition(b"\r\n\r\n")
                size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", head)
                if name == file and have and (not size or len(rest) < int(size[1])):
                    # The mark stood inside a record.
                    have += MARK + piece
                    continue
                close()
                # What stands before the first mark of a file is no record.
                have, file = (MARK + piece if name == file else b""), name
                held += len(piece)
                if held > 1 << 22:
                    yield batch_of()
                    out, held = [], 0
        close()
        yield batch_of()

    return lines.mapInArrow(run, RECORDS)


MARK = b"WARC/1."


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Rows of RECORDS from all archives in a folder, with whole payloads; revisits have a null payload."""
    named = spark.read.format("binaryFile").load(path).select("path").filter("lower(path) like '%.gz'")
    if not named.limit(1).count():
        return ranged_records(spark, spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).text(path))
    whole = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MARK.decode()).option("pathGlobFilter", "*.[gG][zZ]").text(path)
    out = inflated_records(whole.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")))
    rest = spark.read.format("binaryFile").load(path).select("path").filter("lower(path) not like '%.gz'")
    if rest.limit(1).count():
        plain = spark.read.option("encoding", "ISO-8859-1").option("lineSep", MAGIC.decode("latin-1")).option("pathGlobFilter", "{*[!zZ],*[!gG][zZ],*[!.][gG][zZ]}").text(path)
        out = out.unionByName(ranged_records(spark, plain))
    return out


def ranged_records(spark: SparkSession, text: DataFrame) -> DataFrame:
    """Rows of RECORDS from archives that are read in ranges, cut at the gzip magic."""
    pieces = (
        text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.col("_metadata.file_block_length").alias("size"), F.col("value").cast("binary").alias("piece"))
    )
    fields = RECORDS + ", file string, at long, fragment binary"

    def rows(found, file=None, at=None, fragment=None):
        return found + (file, at, fragment) if found else (None,) * 9 + (file, at, fragment)

    def batch_of(out):
        kinds = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        cols = list(zip(*out, strict=True)) or [()] * 12
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [*FIELDS, "file", "at", "fragment"])

    def run(batches):
        out, block, have, orphan, held = [], None, b"", b"", 0

        def close():
            """What was gathered is a whole member, or the start of one that the next range goes on with."""
            nonlocal have
            if have:
                whole = inflate(have)
                if whole is None:
                    out.append(rows(None, block[0], 2 * (block[1] + block[2]) - 1, have))
                elif whole and (found := parse(whole)):
                    out.append(rows(found))
            have = b""

        def leave():
            close()
            if block and orphan:
                out.append(rows(None, block[0], 2 * block[1], orphan))

        for batch in batches:
            files, begins, sizes, values = (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                here = (files[i].as_py(), begins[i].as_py(), sizes[i].as_py())
                if here != block:
                    leave()
                    block, orphan = here, b""
                    fresh = True
                value = values[i].as_py()
                # The first piece of a file stands before its first magic.
                piece = value if fresh and here[1] == 0 and not value else MAGIC + value
                fresh = False
                if not piece:
                    continue
                if plausible(piece):
                    close()
                    have = piece
                elif have:
                    have += piece
                else:
                    orphan += piece
                held += len(value)
                if held > 1 << 22:
                    yield batch_of(out)
                    out, held = [], 0
        leave()
        yield batch_of(out)

    found = materialise(spark, pieces.mapInArrow(run, fields), "warc-records")

    def mend(key, pdf):
        import pandas as pd

        # By twice the place, a start just before its range's end: each start is followed by what goes on with it.
        out, have = [], b""
        for part in pdf.sort_values("at", kind="stable")["fragment"].tolist() + [None]:
            if part is None or plausible(part):
                if have:
                    whole = inflate(have)
                    out += [(None,) * 8 + ("member does not inflate",)] if whole is None else [got] if (got := parse(whole)) else []
                have = part or b""
            else:
                have += part
        return pd.DataFrame(out, columns=FIELDS).astype({"payload_bytes": "Int64", "digest_ok": "boolean"})

    broken = found.filter("fragment is not null").select("file", "at", "fragment").groupBy("file").applyInPandas(mend, RECORDS)
    return found.filter("fragment is null").select(*FIELDS).unionByName(broken)


def page_id_of(column: str) -> F.Column:
    return F.regexp_extract(F.col(column), "^<urn:x-page:(-?[0-9]+)>$", 1).try_cast("long") if hasattr(F.Column, "try_cast") else F.expr(f"try_cast(regexp_extract({column}, '^<urn:x-page:(-?[0-9]+)>$', 1) as long)")


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages as archives and read them back; a row per page, from what was read."""
    found = read_archives(spark, write_archives(spark, pages))
    return found.select(page_id_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_id_of("refers_to").alias("refers_to"))


__all__ = ["END", "MAGIC", "gzip", "inflate", "member", "parse", "plausible", "read_archives", "round_trip", "write_archives"]
