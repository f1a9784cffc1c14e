"""Uncompressed video and image files as a data source: ``frame_files``.

YUV4MPEG2 (``.y4m``, eight bits, the luma plane as it is stored) and binary PGM and PPM
images. A file ``<video>@<n>.y4m`` starts with frame n of its video (0 without a number), an image is one
frame. The driver lists files only; tasks take ranges of bytes of large files and bundles
of small ones, and seek to the frames that start in their range. Conditions on video_id and frame
reach the reader: files of other videos are not opened, frames out of range are not read."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

FRAME = "video_id string, frame long, h int, w int, pixels binary"
FILE = "video_id string, first long, frames long, w int, h int, fps double, path string"
_FRAME = pa.schema([("video_id", pa.string()), ("frame", pa.int64()), ("h", pa.int32()), ("w", pa.int32()), ("pixels", pa.binary())])
#: Bytes of files that a task takes, and of frames in a batch.
PART_BYTES, BATCH_BYTES = 64 << 20, 16 << 20
NAME = re.compile(r"(?P<video>[^/]+?)(?:@(?P<first>\d+))?\.(?P<kind>y4m|pgm|ppm)$")
#: Bytes of a frame for each byte of its luma plane, by colour space.
PLANES = {"420": 1.5, "420jpeg": 1.5, "420mpeg2": 1.5, "420paldv": 1.5, "411": 1.5, "422": 2.0, "444": 3.0, "444alpha": 4.0, "mono": 1.0}


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if urlparse(path).scheme else (pafs.LocalFileSystem(), path)


@dataclass
class Piece(InputPartition):
    """Byte ranges of files: (path, video, number of the first frame, kind, start, end)."""

    ranges: tuple[tuple[str, str, int, str, int, int], ...]


def y4m_header(line: bytes) -> tuple[int, int, float, int]:
    """Width, height, rate and bytes of a frame with its head."""
    if not line.startswith(b"YUV4MPEG2 "):
        raise ValueError("not a YUV4MPEG2 file")
    tags = {t[:1]: t[1:].decode() for t in line.split()[1:]}
    w, h, colour = int(tags[b"W"]), int(tags[b"H"]), tags.get(b"C", "420")
    if colour not in PLANES:
        raise ValueError(f"colour space {colour} is not read: {', '.join(PLANES)}")
    top, bottom = (int(v) for v in tags.get(b"F", "0:0").split(":"))
    half = -(-w // 2), -(-h // 2)
    chroma = {"420": 2 * half[0] * half[1], "411": 2 * -(-w // 4) * h, "422": 2 * half[0] * h}.get(colour[:3])
    size = w * h + (chroma if chroma is not None else int((PLANES[colour] - 1) * w * h))
    return w, h, top / bottom if bottom else 0.0, len(b"FRAME\n") + size


def pnm_header(data: bytes) -> tuple[str, int, int, int]:
    """Magic number, width, height and where the pixels begin."""
    found = re.match(rb"(P[56])" + rb"(?:\s|#[^\n]*\n)+(\d+)" * 3 + rb"\s", data)
    if not found or not 0 < int(found[4]) < 256:
        raise ValueError("not a binary PGM or PPM image of eight bits")
    return found[1].decode(), int(found[2]), int(found[3]), found.end()


def grey(rgb: np.ndarray) -> np.ndarray:
    return np.rint(rgb @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


class FrameReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.bytes = options["path"], int(options.get("partbytes", PART_BYTES))
        self.info = str(options.get("info", "false")).lower() == "true"
        self.videos: set | None = None
        self.least, self.most = 0, (1 << 63) - 1

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes comparisons of frame with a number and of video_id with texts; the others stay with Spark."""
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            if column == ("frame",) and not self.info and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.least = max(self.least, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.most = min(self.most, value - isinstance(f, LessThan))
            elif column == ("video_id",) and isinstance(f, (EqualTo, In)):
                wanted = set(value) if isinstance(f, In) else {value}
                self.videos = wanted if self.videos is None else self.videos & wanted
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, root = file_system(self.path)
        info = system.get_file_info(root)
        files = [info] if info.is_file else system.get_file_info(pafs.FileSelector(root, recursive=True))
        pieces, bundle, held = [], [], 0
        for f in sorted((f for f in files if f.is_file), key=lambda f: f.path):
            name = NAME.search(f.path)
            if not name or (self.videos is not None and name["video"] not in self.videos):
                continue
            first = int(name["first"] or 0)
            if first > self.most or (name["kind"] != "y4m" and first < self.least):
                continue
            step = f.size if self.info or name["kind"] != "y4m" else self.bytes
            for start in range(0, max(1, f.size), max(1, step)):
                end = min(f.size, start + step)
                if bundle and held + end - start > self.bytes:
                    pieces.append(Piece(tuple(bundle)))
                    bundle, held = [], 0
                bundle.append((f.path, name["video"], first, name["kind"], start, end))
                held += end - start
        return [*pieces, Piece(tuple(bundle))]

    def _y4m(self, file, video: str, first: int, start: int, end: int) -> Iterator[tuple]:
        head = bytearray()
        while not head.endswith(b"\n") and len(head) < 4096:
            head += file.read(1) or b"\n"
        w, h, _, size = y4m_header(bytes(head))
        begin = max(-(-(start - len(head)) // size), 0, self.least - first)
        for n in range(begin, max(begin, -(-(end - len(head)) // size))):
            if first + n > self.most:
                return
            file.seek(len(head) + n * size)
            data = file.read(6 + w * h)
            if len(data) < 6 + w * h:
                raise ValueError(f"frame {n} of {video} is cut short")
            if data[:6] != b"FRAME\n":
                raise ValueError(f"frame {n} of {video} has a head with parameters, which is not read")
            yield video, first + n, h, w, data[6:]

    def _frames(self, piece: Piece) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        for path, video, first, kind, start, end in piece.ranges:
            with system.open_input_file(path) as file:
                if kind == "y4m":
                    yield from self._y4m(file, video, first, start, end)
                else:
                    data = file.read()
                    magic, w, h, at = pnm_header(data)
                    n = w * h * (3 if magic == "P6" else 1)
                    if len(data) < at + n:
                        raise ValueError(f"image {path} is cut short")
                    px = np.frombuffer(data, np.uint8, n, at)
                    yield video, first, h, w, (grey(px.reshape(-1, 3)) if magic == "P6" else px).tobytes()

    def _files(self, piece: Piece) -> Iterator[tuple]:
        system, _ = file_system(self.path)
        for path, video, first, kind, _, end in piece.ranges:
            with system.open_input_file(path) as file:
                if kind == "y4m":
                    head = file.read(4096).split(b"\n", 1)[0] + b"\n"
                    w, h, fps, size = y4m_header(head)
                    yield video, first, (end - len(head)) // size, w, h, fps, path
                else:
                    _, w, h, _ = pnm_header(file.read(4096))
                    yield video, first, 1, w, h, 0.0, path

    def read(self, piece: Piece) -> Iterator:
        if self.info:
            yield from self._files(piece)
            return
        rows, held = [], 0
        for row in self._frames(piece):
            if held and held + len(row[4]) > BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FRAME)], schema=_FRAME)
                rows, held = [], 0
            rows.append(row)
            held += len(row[4])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _FRAME)], schema=_FRAME)


class FrameFiles(DataSource):
    """Options: path, partbytes (bytes that a task takes), info (true: a row for each file in place of its frames)."""

    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return FILE if str(self.options.get("info", "false")).lower() == "true" else FRAME

    def reader(self, schema) -> FrameReader:
        return FrameReader(dict(self.options))


def _source(spark: SparkSession, path: str, **options):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # read when a plan is made, so it stays set
    spark.dataSource.register(FrameFiles)
    return spark.read.format("frame_files").options(path=path, **options).load()


def frames(spark: SparkSession, path: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Dense frames of the files at a path; conditions on video_id and frame reach the files."""
    return _source(spark, path, partbytes=str(part_bytes))


def videos(spark: SparkSession, path: str) -> DataFrame:
    """video_id, fps (25 where none is given), frame_count, width, height of the videos in the files' heads."""
    files = _source(spark, path, info="true")
    rows = files.groupBy("video_id").agg(F.max("fps").alias("fps"), F.max(F.col("first") + F.col("frames")).cast("int").alias("frame_count"), F.max("w").alias("width"), F.max("h").alias("height"))
    return rows.withColumn("fps", F.when(F.col("fps") > 0, F.col("fps")).otherwise(25.0))


def write_y4m(frames: DataFrame, folder: str, fps: int = 25, segment: int = 256) -> DataFrame:
    """Writes dense frames as files of runs of at most ``segment`` consecutive frames: a task a segment of a video,
    under names that a repeated task writes again. path, frames of the files, once they are written."""
    ddl = "path string, frames long"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows, (system, root) = rows.sort_by("frame"), file_system(folder)
        system.create_dir(root, recursive=True)
        done, out, last, size = [], None, None, None
        for frame, h, w, px in zip(*(rows[c].to_pylist() for c in ("frame", "h", "w", "pixels"))):
            if out is None or frame != last + 1 or (w, h) != size:
                if out is not None:
                    out.close()
                path = f"{root}/{key[0].as_py()}@{frame:09d}.y4m"
                out, size = system.open_output_stream(path), (w, h)
                out.write(b"YUV4MPEG2 W%d H%d F%d:1 Ip A1:1 Cmono\n" % (w, h, fps))
                done.append([path, 0])
            out.write(b"FRAME\n" + px)
            done[-1][1], last = done[-1][1] + 1, frame
        if out is not None:
            out.close()
        return pa.table({"path": [p for p, _ in done], "frames": [n for _, n in done]})

    keyed = frames.select("video_id", "frame", "h", "w", "pixels", F.floor(F.col("frame") / segment).alias("segment"))
    return keyed.groupBy("video_id", "segment").applyInArrow(run, ddl)
