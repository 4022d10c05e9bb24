"""Image sources and sinks: folder scans, header probes, encoded files published in two steps."""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import unquote, urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import codecs
from tessera.functions import planning as P

MOST_FILES = 50_000
HUGE_PIXELS = 100_000_000
HEADER = "width int, height int, mime string, orientation int, alpha boolean"


def scan(spark: SparkSession, path: str, most: int = MOST_FILES) -> DataFrame:
    """path, length and content of image files below a folder. Unread columns are pruned: names alone read no file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true").load(path)
    return files.where(P.is_image(P.last_segment(F.col("path")))).limit(most)


def _orientation(data: bytes) -> int:
    at = data.find(b"Exif\0\0")
    if at < 0 or len(data) < at + 16:
        return 1
    tiff = data[at + 6 :]
    end = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if end is None:
        return 1
    (start,) = struct.unpack_from(end + "I", tiff, 4)
    if len(tiff) < start + 2:
        return 1
    (n,) = struct.unpack_from(end + "H", tiff, start)
    for k in range(n):
        entry = tiff[start + 2 + 12 * k : start + 14 + 12 * k]
        if len(entry) == 12 and struct.unpack(end + "H", entry[:2])[0] == 0x0112:
            return struct.unpack(end + "H", entry[8:10])[0]
    return 1


def _jxl_size(data: bytes) -> tuple[int, int]:
    """Width and height of a JPEG XL code stream: bits from the lowest, sizes of one of four lengths, a width by ratio of the height."""
    held, bits = int.from_bytes(data[2:18], "little"), 8 * len(data[2:18])

    def take(n: int) -> int:
        nonlocal held, bits
        value, held, bits = held & (1 << n) - 1, held >> n, bits - n
        if bits < 0:
            raise IndexError("the header is cut")
        return value

    def edge(small: int) -> int:
        return (take(5) + 1) * 8 if small else take((9, 13, 18, 30)[take(2)]) + 1

    small = take(1)
    h = edge(small)
    ratio = take(3)
    # Width to height by the ratio's number; 0 stands for a width of its own.
    over, under = ((0, 1), (1, 1), (12, 10), (4, 3), (3, 2), (16, 9), (5, 4), (2, 1))[ratio]
    return (h * over // under if ratio else edge(small)), h


def _tiff_size(data: bytes) -> tuple[int, int]:
    end = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(end + "I", data, 4)
    (n,) = struct.unpack_from(end + "H", data, at)
    found = {}
    for k in range(n):
        tag, kind = struct.unpack_from(end + "HH", data, at + 2 + 12 * k)
        (found[tag],) = struct.unpack_from(end + ("H" if kind == 3 else "I"), data, at + 10 + 12 * k)
    return found[256], found[257]


def _size(data: bytes, mime: str) -> tuple[int, int] | None:
    """Width and height by a header of the type that the first bytes show."""
    if mime == "image/png":
        return struct.unpack(">II", data[16:24])
    if mime == "image/gif":
        return struct.unpack("<HH", data[6:10])
    if mime == "image/bmp":
        w, h = struct.unpack("<ii", data[18:26])
        return w, abs(h)
    if mime == "image/webp":
        if data[12:16] == b"VP8X":
            return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
        w, h = struct.unpack("<HH", data[26:30])
        return w & 0x3FFF, h & 0x3FFF
    if mime in ("image/heif", "image/avif"):
        # a box of the size per item: the largest is the whole image, others are tiles and thumbnails
        sizes, at = [], data.find(b"ispe")
        while at >= 0:
            if len(data) >= at + 16:
                sizes.append(struct.unpack(">II", data[at + 8 : at + 16]))
            at = data.find(b"ispe", at + 4)
        return max(sizes, key=lambda s: s[0] * s[1], default=None)
    if mime == "image/jxl":
        if data[:2] != b"\xff\x0a":
            at = data.find(b"\xff\x0a", 12)
            data = data[at:] if at >= 0 else b""
        return _jxl_size(data) if data else None
    if mime == "image/tiff":
        return _tiff_size(data)
    at = 2
    while at + 9 < len(data):
        mark, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", data[at + 5 : at + 9])
            return w, h
        at += 2 + size
    return None


def header(data: bytes) -> tuple | None:
    """(width, height, mime, orientation, alpha) by the first bytes; None if they are no image's. Types that can hold
    transparency count as having it (png, webp)."""
    mime = _format(data)
    try:
        size = _size(data, mime) if mime else None
    except (struct.error, IndexError, KeyError):
        size = None
    if not size or min(size) <= 0:
        return None
    return (*size, mime, _orientation(data) if mime == "image/jpeg" else 1, mime in ("image/png", "image/webp"))


# First bytes of image files.
STARTS = {
    b"\x89PNG\r\n\x1a\n": "png", b"GIF87a": "gif", b"GIF89a": "gif", b"BM": "bmp", b"\xff\xd8": "jpeg", b"II*\0": "tiff", b"MM\0*": "tiff", b"\xff\x0a": "jxl", b"\0\0\0\x0cJXL ": "jxl",
}


def _format(data: bytes) -> str | None:
    """The MIME type by the first bytes; None if they are no image's."""
    if data[:4] == b"RIFF":
        return "image/webp" if data[8:12] == b"WEBP" else None
    if data[4:8] == b"ftyp":
        return "image/avif" if data[8:12] in (b"avif", b"avis") else "image/heif"
    return next((f"image/{v}" for k, v in STARTS.items() if data.startswith(k)), None)


HEAD_BYTES = 1 << 18


def _derived(probed: DataFrame) -> DataFrame:
    pixels = F.col("width").cast("long") * F.col("height")
    return probed.withColumn("pixels", pixels).withColumn("huge", pixels > HUGE_PIXELS)


def probe_in_place(paths: DataFrame) -> DataFrame:
    """As ``probe``, of files (path, length) that executors can open themselves (a mounted folder): only the first 256 KB are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for path, length in zip(batch["path"], batch["length"], strict=True):
                try:
                    with open(_mounted(path), "rb") as file:
                        head = header(file.read(HEAD_BYTES))
                except OSError:
                    continue
                if head:
                    found.append((path, length, *head))
            yield pd.DataFrame(found, columns=["path", "length", "width", "height", "mime", "orientation", "alpha"])

    return _derived(paths.select("path", "length").mapInPandas(run, f"path string, length long, {HEADER}"))


def _mounted(path: str) -> str:
    where = urlparse(path)
    return unquote(where.path) if where.scheme == "file" else path


def probe(files: DataFrame) -> DataFrame:
    """Files with their header; unreadable ones go. Derived: pixels and huge."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(p, n, *h) for p, n, c in zip(batch["path"], batch["length"], batch["content"], strict=True) if (h := header(bytes(c[:HEAD_BYTES])))]
            yield pd.DataFrame(found, columns=["path", "length", "width", "height", "mime", "orientation", "alpha"])

    made = files.select("path", "length", "content").mapInPandas(run, f"path string, length long, {HEADER}")
    return _derived(made)


PARTS = pa.schema([("id", pa.int64()), ("fmt", pa.string()), ("part", pa.int32()), ("bytes", pa.binary()), ("error", pa.string())])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, fmt, part, bytes, error) of rows sorted by id and y. A failing image ends with a row that has an error, and a row before
    the first (y below 0) is the message of one that failed earlier."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True))
    for key, group in groupby(rows, key=lambda r: r[0]):
        first = next(group)
        _, fmt, quality, width, height = first[:5]
        part = 0

        def lines(first=first, group=group):
            if first[5] < 0:
                raise ValueError((first[6] or b"").decode())
            yield first[5], first[6] or b""
            for r in group:
                yield r[5], r[6] or b""

        fmt = codecs.written_as(fmt or "")
        try:
            for part, piece in enumerate(codecs.encoded_parts(fmt, lines(), width, height, quality)):
                yield key, fmt, part, piece, ""
        except (ValueError, TypeError) as problem:
            yield key, fmt, part + 1, b"", str(problem)[:200] or "not encoded"


def _by_image(rows: DataFrame) -> DataFrame:
    """Rows of an image in one task, sorted on disk where they do not fit into memory."""
    wanted = rows.select(F.col("id").cast("long"), "fmt", F.col("quality").cast("int"), F.col("width").cast("int"), F.col("height").cast("int"), F.col("y").cast("int"), "rgb")
    return wanted.repartition("id").sortWithinPartitions("id", "y")


def encoded_parts(rows: DataFrame) -> DataFrame:
    """Files in pieces (id, fmt, part, bytes, error) of pixel rows (id, fmt, quality, width, height, y, rgb).

    Rows come sorted and pass through a row-wise encoder one by one; neither an image nor its file is ever held whole. A failure is
    a value in ``error`` of the last piece, not the end of the job. Repeated rows are an error, as missing ones are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _pieces(batches):
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(piece, PARTS, strict=True)], schema=PARTS)

    return _by_image(rows).mapInArrow(run, "id long, fmt string, part int, bytes binary, error string")


def encoded(rows: DataFrame) -> DataFrame:
    """Files (id, fmt, bytes, error), one row each, of the same rows; for files that fit into a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, pieces in groupby(_pieces(batches), key=lambda p: p[0]):
            got = list(pieces)
            error = got[-1][4]
            row = {"id": key, "fmt": got[0][1], "bytes": b"" if error else b"".join(p[3] for p in got), "error": error}
            yield pa.RecordBatch.from_pylist([row], schema=pa.schema([PARTS.field(n) for n in ("id", "fmt", "bytes", "error")]))

    return _by_image(rows).mapInArrow(run, "id long, fmt string, bytes binary, error string")


def saved(rows: DataFrame, folder: str) -> DataFrame:
    """Encode pixel rows (as ``encoded_parts``, and name) into ``folder``, which driver and executors share: (id, path, length, error).

    A file grows under a name of its own and takes its place in one step when it is whole; a failed one is deleted. A repeated
    task replaces the file by the same bytes.
    """
    schema = pa.schema([("id", pa.int64()), ("path", pa.string()), ("length", pa.int64()), ("error", pa.string())])
    names = rows.select(F.col("id").cast("long"), "fmt", "quality", "width", "height", "y", "rgb", "name")
    sorted_rows = names.repartition("id").sortWithinPartitions("id", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, str] = {}

        def plain():
            for b in batches:
                known.clear()
                known.update(zip(b.column(0).to_pylist(), b.column(7).to_pylist(), strict=True))
                yield b.select(list(range(7)))

        os.makedirs(folder, exist_ok=True)
        for key, pieces in groupby(_pieces(plain()), key=lambda p: p[0]):
            staged, length, error, target = os.path.join(folder, f".{uuid.uuid4().hex}.pending"), 0, "", ""
            with open(staged, "wb") as file:
                for _, fmt, _, piece, error in pieces:
                    target = target or os.path.join(folder, f"{known[key]}.{fmt}")
                    length += file.write(piece)
            if error:
                os.remove(staged)
                target, length = None, 0
            else:
                os.replace(staged, target)
            yield pa.RecordBatch.from_pylist([{"id": key, "path": target, "length": length, "error": error}], schema=schema)

    return sorted_rows.mapInArrow(run, "id long, path string, length long, error string")


def copied(files: DataFrame, folder: str) -> DataFrame:
    """Files (path, mime, content) copied into ``folder`` under names of their own: (path, copy, error). The extension goes by
    the MIME type: png, webp, else jpg. A file without content, or one that cannot be written, has an error and no copy."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            out = []
            for path, mime, content in zip(batch["path"], batch["mime"], batch["content"], strict=True):
                kind = (mime or "").lower()
                ext = "png" if "png" in kind else "webp" if "webp" in kind else "jpg"
                target = os.path.join(folder, f"{hashlib.sha256(path.encode()).hexdigest()[:24]}.{ext}")
                try:
                    if content is None:
                        raise OSError("no content")
                    staged = f"{target}.{uuid.uuid4().hex}"
                    with open(staged, "wb") as file:
                        file.write(content)
                    os.replace(staged, target)
                    out.append((path, target, ""))
                except OSError as problem:
                    out.append((path, None, str(problem)[:200]))
            yield pd.DataFrame(out, columns=["path", "copy", "error"])

    return files.select("path", "mime", "content").mapInPandas(run, "path string, copy string, error string")


VERSION = "version="


def _versions(spark: SparkSession, path: str) -> tuple[object, object, list[str]]:
    """File system, its path class and the finished versions below a path, oldest first."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    root = Path(path)
    fs = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return fs, Path, sorted(n for n in names if n.startswith(VERSION))


def publish(df: DataFrame, path: str, fmt: str = "parquet", keep: int = 2) -> str:
    """Write a new version of a table beside the older ones and name it in one step once it is whole; its path.

    A version is renamed into place under a number of its own, so ``published`` finds the old or the new one at any
    moment, and never none. The ``keep`` newest stay: the one before the last is the backup.
    """
    fs, Path, versions = _versions(df.sparkSession, path)
    number = int(versions[-1][len(VERSION) :].split("-")[0]) + 1 if versions else 1
    staged, target = f"{path}/_tmp-{uuid.uuid4().hex}", f"{path}/{VERSION}{number:012d}-{uuid.uuid4().hex[:8]}"
    try:
        df.write.format(fmt).save(staged)
        if not fs.rename(Path(staged), Path(target)):
            raise OSError(f"{target} could not be named")
    finally:
        fs.delete(Path(staged), True)
    for old in (versions + [target])[:-keep]:
        fs.delete(Path(f"{path}/{old}"), True)
    return target


def published(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame | None:
    """The newest version of a published table; None if there is none."""
    _, _, versions = _versions(spark, path)
    return spark.read.format(fmt).load(f"{path}/{versions[-1]}") if versions else None


def decoded_tiles(files: DataFrame, tiles: DataFrame) -> DataFrame:
    """Pixels (path, tile_no, x, y, tw, th, rgb, error) of tiles (path, tile_no, x, y, tw, th) of files (path, content).

    An image is decoded once for all of its tiles, which leave one by one; a tile that the image does not hold, and files
    that do not begin like an image, are left out. Tiles of an image that cannot be decoded, as its format has no decoder or its
    data are broken, have an error and no pixels. One rectangle per image is a region read.
    """
    lists = tiles.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("tile_no", "x", "y", "tw", "th"))).alias("tiles"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "tile_no", "x", "y", "tw", "th", "rgb", "error"]
        for batch in batches:
            for path, content, wanted in zip(batch["path"], batch["content"], batch["tiles"], strict=True):
                kind = _format(bytes(content[:HEAD_BYTES]))
                if not kind:
                    continue
                pixels, error = None, ""
                try:
                    decode = codecs.DECODERS.get(kind)
                    if decode is None:
                        raise ValueError(f"no decoder for {kind}")
                    pixels = decode(bytes(content))
                except ValueError as problem:
                    error = str(problem)[:200] or "not decoded"
                for t in wanted:
                    place = (path, t["tile_no"], t["x"], t["y"], t["tw"], t["th"])
                    if error:
                        yield pd.DataFrame([(*place, None, error)], columns=columns)
                        continue
                    cut = pixels[t["y"] : t["y"] + t["th"], t["x"] : t["x"] + t["tw"]]
                    if cut.shape[:2] == (t["th"], t["tw"]):
                        yield pd.DataFrame([(*place, cut.tobytes(), "")], columns=columns)

    joined = files.select("path", "content").join(lists, "path")
    return joined.mapInPandas(run, "path string, tile_no int, x int, y int, tw int, th int, rgb binary, error string")
