"""Frames of uncompressed video by presentation time: a data source over YUV4MPEG2 files, read in byte ranges.

The driver only lists files. A file is split by its size; each task reads the file's header, finds by the frame size which
frames start in its range and in the times asked for, and reads these bytes alone. Filters on pts reach the source, so a
window of a long video costs its frames and one header a range. Frames can be resized as arrays on the way.

Formats: mono and planar 4:2:0, 4:2:2 and 4:4:4 of 8 bits; luma is what is returned. A file or frame that cannot be read
is a row with a fault (and no luma), never an error or a missing row; a range goes no further behind a broken frame.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "path string, frame long, pts double, width int, height int, luma binary, fault string"
KINDS = [pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
MAGIC, MARK = b"YUV4MPEG2 ", b"FRAME\n"
#: Bytes of a file in one task, of frames in one batch, and of a header at most.
RANGE, BATCH, HEADER = 64 << 20, 8 << 20, 1 << 12
#: Bytes of a frame for each luma sample, as a fraction.
PLANES = {"mono": (1, 1), "420": (3, 2), "422": (2, 1), "444": (3, 1)}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or re.match(r"\w+:/", path) else "file://" + path)


@dataclass
class Header:
    """What a file's first line says: where frames begin, their size in the file, the size of a picture, frames a second."""

    begin: int
    stride: int
    width: int
    height: int
    rate: tuple[int, int]

    @classmethod
    def of(cls, head: bytes) -> Header:
        line, end, _ = head.partition(b"\n")
        if not end or not line.startswith(MAGIC):
            raise ValueError("no YUV4MPEG2 header")
        said = {x[:1]: x[1:] for x in line[len(MAGIC) :].decode("ascii", "replace").split(" ") if x}
        kind = re.match(r"mono$|4\d\d", said.get("C", "420"))
        if not kind or kind[0] not in PLANES or re.search(r"p\d", said.get("C", "")):
            raise ValueError(f"pictures of kind {said.get('C')} are not read")
        try:
            width, height, (num, den) = int(said["W"]), int(said["H"]), map(int, said["F"].split(":"))
        except (KeyError, ValueError):
            raise ValueError("header without size or rate") from None
        if min(width, height, num, den) <= 0:
            raise ValueError("header with a size or rate of nothing")
        chroma = 0 if kind[0] == "mono" else {"420": 2 * -(-width // 2) * -(-height // 2), "422": 2 * -(-width // 2) * height, "444": 2 * width * height}[kind[0]]
        return cls(len(line) + 1, len(MARK) + width * height + chroma, width, height, (num, den))

    def pts(self, frame: int) -> float:
        return frame * self.rate[1] / self.rate[0]


def resize(luma: np.ndarray, width: int, height: int) -> np.ndarray:
    """Frames (n, h, w) at another size: the rounded mean of the samples that fall into each new one, or the one under it."""
    out, parts = luma.astype(np.int64), np.ones((1, 1, 1), np.int64)
    for axis, size in ((1, height), (2, width)):
        have = luma.shape[axis]
        edge = np.arange(size) * have // size
        if size > have:
            out = np.take(out, edge, axis)
        elif size < have:
            out = np.add.reduceat(out, edge, axis)
            parts = parts * np.diff(np.append(edge, have)).reshape([-1 if a == axis else 1 for a in range(3)])
    return ((2 * out + parts) // (2 * parts)).astype(np.uint8)


@dataclass
class Range(InputPartition):
    path: str
    begin: int
    end: int
    size: int

    def __init__(self, path: str, begin: int, end: int, size: int) -> None:
        super().__init__((path, begin))
        self.path, self.begin, self.end, self.size = path, begin, end, size


class FrameReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.share = int(options.get("rangeBytes", RANGE))
        self.to = (int(options["width"]), int(options["height"])) if "width" in options and "height" in options else None
        self.low, self.low_open, self.high, self.high_open = -np.inf, False, np.inf, False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Bounds on pts are kept; whatever else goes back to Spark."""
        for f in filters:
            if not isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)) or f.attribute != ("pts",):
                yield f
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low, self.low_open = max((self.low, self.low_open), (float(f.value), isinstance(f, GreaterThan)))
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high, closed = min((self.high, not self.high_open), (float(f.value), not isinstance(f, LessThan)))
                self.high_open = not closed

    def asked(self, pts: float) -> bool:
        return (pts > self.low or (pts == self.low and not self.low_open)) and (pts < self.high or (pts == self.high and not self.high_open))

    def partitions(self) -> list[Range]:
        system, path = opened(self.path)
        info = system.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and not f.base_name.startswith(("_", "."))]
        stem = self.path[: len(self.path) - len(path)] if self.path.endswith(path) else ""
        return [Range(stem + f.path, a, min(a + self.share, f.size), f.size) for f in sorted(files, key=lambda f: f.path) for a in range(0, max(f.size, 1), self.share)] or [Range("", 0, 0, -1)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.size < 0:
            return
        system, path = opened(part.path)
        fault = lambda text, frame=None, pts=None: batch([(part.path, frame, pts, None, None, None, text)])
        with system.open_input_file(path) as file:
            try:
                head = Header.of(file.read(HEADER))
            except ValueError as e:
                if part.begin == 0:
                    yield fault(str(e))
                return
            first, last = (max(0, -(-(x - head.begin) // head.stride)) for x in (part.begin, part.end))
            first, last = self.within(head, first, last)
            step = max(1, BATCH // head.stride)
            for a in range(first, last, step):
                b = min(a + step, last)
                file.seek(head.begin + a * head.stride)
                data = np.frombuffer(file.read((b - a) * head.stride), np.uint8)
                whole = data[: len(data) // head.stride * head.stride].reshape(-1, head.stride)
                good = (whole[:, : len(MARK)] == np.frombuffer(MARK, np.uint8)).all(1)
                n = len(whole) if good.all() else int(np.argmin(good))
                luma = whole[:n, len(MARK) : len(MARK) + head.width * head.height].reshape(n, head.height, head.width)
                if self.to and n:
                    luma = resize(luma, *self.to)
                w, h = self.to or (head.width, head.height)
                if n:
                    yield batch([(part.path, a + k, head.pts(a + k), w, h, luma[k].tobytes(), None) for k in range(n)])
                if n < b - a:
                    yield fault("no frame where one should begin" if n < len(whole) else "frame is cut off", a + n, head.pts(a + n))
                    return

    def within(self, head: Header, first: int, last: int) -> tuple[int, int]:
        """The frames of [first, last) whose times are asked for."""
        scale = head.rate[0] / head.rate[1]
        if np.isfinite(self.low):
            first = max(first, int(np.floor(self.low * scale)) - 1)
            while first < last and not self.asked(head.pts(first)) and head.pts(first) <= self.low:
                first += 1
        if np.isfinite(self.high):
            last = min(last, int(np.ceil(self.high * scale)) + 2)
            while last > first and not self.asked(head.pts(last - 1)):
                last -= 1
        return first, last


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])


class FrameSource(DataSource):
    """spark.read.format("y4m").load(folder); options: rangeBytes, and width with height to resize to."""

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))


def frames(spark: SparkSession, path: str, start: float | None = None, end: float | None = None, **options) -> DataFrame:
    """Frames with start <= pts < end of all files of a folder; faults of files as a whole are given out when no start or end is set."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)
    found = spark.read.format("y4m").options(**options).load(path)
    if start is not None:
        found = found.filter(found["pts"] >= float(start))
    return found if end is None else found.filter(found["pts"] < float(end))


def write_files(rows: DataFrame, folder: str, width: int, height: int, rate: tuple[int, int]) -> DataFrame:
    """rows (video, frame, luma), one mono file for each video, frames in order; video, path and frames of each. A video's frames pass through its task, they are not gathered there."""

    def run(batches):
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        done, video, out, n = [], None, None, 0
        for b in batches:
            for v, luma in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if out is None or v != video:
                    if out is not None:
                        out.close()
                        done.append((video, n))
                    video, n = v, 0
                    out = system.open_output_stream(f"{root}/{v}.y4m")
                    out.write(MAGIC + f"W{width} H{height} F{rate[0]}:{rate[1]} Ip A1:1 Cmono\n".encode())
                out.write(MARK + luma)
                n += 1
        if out is not None:
            out.close()
            done.append((video, n))
        yield pa.RecordBatch.from_arrays([pa.array([v for v, _ in done], pa.int64()), pa.array([n for _, n in done], pa.int64())], ["video", "frames"])

    ordered = rows.select(rows["video"].cast("long").alias("video"), "frame", "luma").repartition("video").sortWithinPartitions("video", "frame")
    return ordered.mapInArrow(run, "video long, frames long")
