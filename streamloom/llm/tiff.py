"""TIFF media columns: write and read baseline TIFF with strips or tiles, one output row per page.

The reader walks the chain of image directories in either byte order, decodes uncompressed, PackBits, LZW and deflate
strips or tiles, undoes horizontal differencing (predictor 2), bit-reversed bytes (fill order 2) and samples in planes
(planar configuration 2), and crops tiles at the right and lower edge.

Defined cases: a null or empty blob has no pages; a broken blob, and one with samples other than 8 bits or another
predictor, gives one row with page -1 and the fault in error, so one bad file doesn't end a job; a directory chain that
returns to itself ends there; columns of the input named like one of a page are kept as input_page and so on.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import string_buffers

NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
WIDTH, PAGE_ROWS, STRIP_ROWS = 64, 4096, 256
_SIZES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        k = data[i]
        if k < 128:
            out += data[i + 1 : i + 2 + k]
            i += k + 2
        elif k > 128:
            out += data[i + 1 : i + 2] * (257 - k)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """TIFF's LZW: most significant bit first, code 256 clears, 257 ends, widths grow one code early."""
    acc = bits = 0
    out = bytearray()

    def put(code: int, width: int) -> None:
        nonlocal acc, bits
        acc, bits = acc << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(acc >> bits & 255)
        acc &= (1 << bits) - 1

    table, width, nxt, have = {bytes((i,)): i for i in range(256)}, 9, 258, b""
    put(256, 9)
    for i in range(len(data)):
        more = have + data[i : i + 1]
        if more in table:
            have = more
            continue
        put(table[have], width)
        table[more], nxt = nxt, nxt + 1
        width = (nxt).bit_length() if nxt >= 511 else 9
        if nxt == 4094:
            put(256, width)
            table, width, nxt = {bytes((i,)): i for i in range(256)}, 9, 258
        have = data[i : i + 1]
    if have:
        put(table[have], width)
        nxt += 1
        width = nxt.bit_length() if nxt >= 511 else 9
    put(257, width)
    if bits:
        put(0, 8 - bits)
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    table: list[bytes] = []
    out, acc, bits, width, last = [], 0, 0, 9, None
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = acc >> bits
        acc &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((i,)) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        # One code early: width grows when the next entry would be the last of this width.
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: packbits_encode}
DECODE = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: packbits_decode}


def encode_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = STRIP_ROWS, order: str = "<") -> bytes:
    """pages: uint8 arrays (rows, width) or (rows, width, samples). tile: (rows, width), multiples of 16."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 0))
    link = 4
    for page in pages:
        image = page if page.ndim == 3 else page[:, :, None]
        rows, width, samples = image.shape
        th, tw = tile or (strip_rows, width)
        places = []
        for y in range(0, rows, th):
            for x in range(0, width, tw):
                part = image[y : y + th, x : x + tw]
                if tile:
                    part = np.pad(part, ((0, th - part.shape[0]), (0, tw - part.shape[1]), (0, 0)))
                if predictor == 2:
                    part = np.concatenate([part[:, :1], part[:, 1:] - part[:, :-1]], 1)
                coded = ENCODE[compression](part.tobytes())
                places.append((len(out), len(coded)))
                out += coded
        out += b"\0" * (len(out) % 2)
        tags: dict[int, tuple[int, list[int]]] = {
            256: (4, [width]), 257: (4, [rows]), 258: (3, [8] * samples), 259: (3, [compression]), 262: (3, [1 if samples < 3 else 2]), 277: (3, [samples]), 317: (3, [predictor]),
        }
        tags |= {322: (4, [tw]), 323: (4, [th]), 324: (4, [p[0] for p in places]), 325: (4, [p[1] for p in places])} if tile else {273: (4, [p[0] for p in places]), 278: (4, [th]), 279: (4, [p[1] for p in places])}
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            body = struct.pack(f"{order}{len(values)}{_SIZES[kind]}", *values)
            if len(body) > 4:
                at = len(out)
                out += body + b"\0" * (len(body) % 2)
                body = struct.pack(order + "I", at)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + body.ljust(4, b"\0")
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def decode_tiff(blob: bytes):
    """Yield (page, array of rows x width x samples, tags) for each image directory."""
    order = {b"II": "<", b"MM": ">"}.get(blob[:2])
    if order is None or struct.unpack_from(order + "H", blob, 2)[0] != 42:
        raise ValueError("no TIFF header")
    (at,), seen, page = struct.unpack_from(order + "I", blob, 4), set(), 0
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", blob, at)
        tags: dict[int, tuple] = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", blob, at + 2 + 12 * i)
            if kind not in _SIZES:
                continue
            form = f"{order}{count}{_SIZES[kind]}"
            place = at + 10 + 12 * i
            if struct.calcsize(form) > 4:
                (place,) = struct.unpack_from(order + "I", blob, place)
            tags[tag] = struct.unpack_from(form, blob, place)
        yield page, read_image(blob, tags), tags
        (at,) = struct.unpack_from(order + "I", blob, at + 2 + 12 * n)
        page += 1


_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def read_image(blob: bytes, tags: dict[int, tuple]) -> np.ndarray:
    width, rows = tags[256][0], tags[257][0]
    samples, predictor, planar, fill = (tags.get(t, (1,))[0] for t in (277, 317, 284, 266))
    if set(tags.get(258, (8,))) != {8}:
        raise ValueError("only 8-bit samples")
    if predictor not in (1, 2) or planar not in (1, 2) or fill not in (1, 2):
        raise ValueError(f"predictor {predictor}, planar configuration {planar} or fill order {fill} is not known")
    code = tags.get(259, (1,))[0]
    if code not in DECODE:
        raise ValueError(f"compression {code} is not known")
    tiled = 324 in tags
    th, tw = (tags[323][0], tags[322][0]) if tiled else (min(tags.get(278, (rows,))[0], rows), width)
    out = np.zeros((rows, width, samples), np.uint8)
    across = -(-width // tw)
    planes, deep = (samples, 1) if planar == 2 else (1, samples)
    each = across * -(-rows // th)
    places = list(zip(tags[324 if tiled else 273], tags[325 if tiled else 279], strict=True))
    if len(places) != each * planes:
        raise ValueError("strips or tiles are missing")
    for k, (start, size) in enumerate(places):
        plane, at = divmod(k, each)
        y, x = at // across * th, at % across * tw
        high = th if tiled else min(th, rows - y)
        raw = blob[start : start + size]
        part = np.frombuffer(DECODE[code](raw.translate(_REVERSED) if fill == 2 else raw), np.uint8)[: high * tw * deep].reshape(high, tw, deep)
        if predictor == 2:
            part = np.cumsum(part, 1, dtype=np.uint8)
        out[y : y + high, x : x + tw, plane : plane + deep] = part[: rows - y, : width - x]
    return out


def payload_of(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of WIDTH."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b"\0")


def store(payload: bytes, compression: int = DEFLATE, predictor: int = 2) -> bytes:
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_tiff([image[i : i + PAGE_ROWS] for i in range(0, len(image), PAGE_ROWS)], compression, predictor)


def encode_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (TIFF, WIDTH samples a row, PAGE_ROWS rows a page) for every document."""

    def run(batches):
        for batch in batches:
            data, offs = string_buffers(batch.column(1))
            data = data.tobytes()
            for a in range(0, len(offs) - 1, 256):
                rows = range(a, min(a + 256, len(offs) - 1))
                media = [store(payload_of(data[offs[i] : offs[i + 1]])) for i in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(rows)), pa.array([int(offs[i + 1] - offs[i]) for i in rows], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


PAGES = {"page": T.IntegerType(), "height": T.IntegerType(), "width": T.IntegerType(), "samples": T.IntegerType(), "compression": T.IntegerType(), "pixels": T.BinaryType(), "error": T.StringType()}


def read_pages(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per page: the other columns of the input, then page, height, width, samples, compression, pixels, error."""
    media = media.select(*(F.col(c).alias(f"input_{c}" if c in PAGES else c) for c in media.columns if c != column), F.col(column).alias("_media"))
    keep = media.columns[:-1]
    schema = T.StructType([*media.schema.fields[:-1], *(T.StructField(n, t) for n, t in PAGES.items())])
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string())

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                blob, got = batch.column(len(keep))[i].as_py(), []
                try:
                    got = [(p, *x.shape, int(tags.get(259, (1,))[0]), x.tobytes(), None) for p, x, tags in decode_tiff(blob)] if blob else []
                except Exception as fault:  # a broken blob is data, not a failure of the job
                    got = [(-1, None, None, None, None, None, f"{type(fault).__name__}: {fault}")]
                if got:
                    own = batch.slice(i, 1).select(list(range(len(keep)))).take(pa.array([0] * len(got))).columns if keep else []
                    yield pa.RecordBatch.from_arrays([*own, *(pa.array(x, t) for x, t in zip(zip(*got, strict=True), kinds, strict=True))], schema.names)

    return media.mapInArrow(run, schema)


def digest_media(media: DataFrame) -> DataFrame:
    """Read stored documents back as page rows, and give the digests and a feature of each document's samples.

    The pages of a document follow each other in one partition, so they are put together again as they come, without
    a shuffle. feature: pages, rows, and the mean and largest of the samples. Equal texts give equal values. Null ids
    stay null; a document that can't be read fails the job, since it was just written.
    """
    stored = media.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.monotonically_increasing_id().alias("number"), "media")
    pages = read_pages(stored).select("number", "doc_id", "n_bytes", "media_bytes", "media_sha256", "page", "pixels", "error")
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches):
        out, have = [], None

        def close():
            if have:
                _, doc, n, size, sha, digest, read, total, top, pages, tail = have
                out.append((doc, n, read, digest.hexdigest(), zlib.crc32(tail), size, sha, f"pages={pages};rows={read // WIDTH};mean={total * 1000 // read};max={top}"))

        for batch in batches:
            cols = [batch.column(k).to_pylist() for k in range(6)]
            for i, (number, doc, n, size, sha, page) in enumerate(zip(*cols, strict=True)):
                if page < 0:
                    raise ValueError(batch.column(7)[i].as_py())
                if have is None or have[0] != number:
                    close()
                    have = [number, doc, n, size, sha, hashlib.sha256(), 0, 0, 0, 0, b""]
                part = batch.column(6)[i].as_py()
                pixels = np.frombuffer(part, np.uint8)
                have[5].update(part)
                have[6] += len(part)
                have[7] += int(pixels.sum(dtype=np.int64))
                have[8] = max(have[8], int(pixels.max()))
                have[9] += 1
                have[10] = part[-64:]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out.clear()
        close()
        cols = list(zip(*out, strict=True)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return pages.mapInArrow(run, schema)
