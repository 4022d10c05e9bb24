"""Image encoders that take rows and give bytes as they go: PNG (filter 0, 8-bit RGB) and baseline JPEG (4:4:4); decoders of PNG, baseline JPEG and BMP."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np

from tessera.functions.rasters import CHROMINANCE, LUMINANCE, dct_matrix, zigzag

# The standard Huffman tables, as counts per code length and symbols in order of their codes.
DC_LUMINANCE = ((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), bytes(range(12)))
DC_CHROMINANCE = ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), bytes(range(12)))
AC_LUMINANCE = (
    (0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125),
    bytes.fromhex(
        "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a "
        "25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 "
        "7a 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 "
        "ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa"
    ),
)
AC_CHROMINANCE = (
    (0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119),
    bytes.fromhex(
        "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 "
        "18 19 1a 26 27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 "
        "79 7a 82 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 "
        "c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa"
    ),
)


def ordered_rows(rows: Iterable[tuple[int, bytes]], width: int, height: int) -> Iterable[np.ndarray]:
    """Rows 0 .. height - 1 of RGB bytes; a missing, doubled or short one is an error."""
    expected = 0
    for y, row in rows:
        if y != expected or len(row) != width * 3:
            raise ValueError(f"row {y} of {len(row)} bytes where row {expected} of {width * 3} was due")
        expected += 1
        yield np.frombuffer(row, np.uint8).reshape(width, 3)
    if expected != height:
        raise ValueError(f"{expected} rows of {height}")


def png_parts(rows: Iterable[tuple[int, bytes]], width: int, height: int, level: int = 6) -> Iterator[bytes]:
    """A PNG in pieces: a chunk of image data whenever 64 KB of it are ready, so that no more than that is held."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    yield b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0))
    packer, held = zlib.compressobj(level), b""
    for row in ordered_rows(rows, width, height):
        held += packer.compress(b"\0" + row.tobytes())
        if len(held) >= 1 << 16:
            yield chunk(b"IDAT", held)
            held = b""
    yield chunk(b"IDAT", held + packer.flush()) + chunk(b"IEND", b"")


def png(rows: Iterable[tuple[int, bytes]], width: int, height: int, level: int = 6) -> bytes:
    return b"".join(png_parts(rows, width, height, level))


def huffman_codes(table: tuple[tuple[int, ...], bytes]) -> dict[int, tuple[int, int]]:
    """Symbol: (code, length). Canonical: codes of one length count up, and shift where the length grows."""
    out, code, symbols = {}, 0, iter(table[1])
    for length, count in enumerate(table[0], 1):
        for _ in range(count):
            out[next(symbols)] = (code, length)
            code += 1
        code <<= 1
    return out


def scaled(table: tuple[int, ...], quality: int) -> np.ndarray:
    quality = min(100, max(1, quality))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table) * scale + 50) // 100, 1, 255)


class Bits:
    """Bits to bytes, a zero behind every 0xFF, ones at the end."""

    def __init__(self):
        self.out, self.held, self.count = bytearray(), 0, 0

    def put(self, value: int, length: int) -> None:
        self.held, self.count = self.held << length | value, self.count + length
        while self.count >= 8:
            self.count -= 8
            byte = self.held >> self.count & 255
            self.out += b"\xff\0" if byte == 255 else bytes([byte])
        self.held &= (1 << self.count) - 1

    def finish(self) -> bytes:
        if self.count:
            self.put((1 << 8 - self.count) - 1, 8 - self.count)
        return bytes(self.out)


def jpeg_parts(rows: Iterable[tuple[int, bytes]], width: int, height: int, quality: int = 95) -> Iterator[bytes]:
    """A JPEG in pieces, eight rows at a time; edges are repeated to full blocks."""
    tables = [scaled(LUMINANCE, quality), scaled(CHROMINANCE, quality)]
    zig, dct = np.array(zigzag()), np.array(dct_matrix())
    codes = [(huffman_codes(DC_LUMINANCE), huffman_codes(AC_LUMINANCE)), (huffman_codes(DC_CHROMINANCE), huffman_codes(AC_CHROMINANCE))]
    segment = lambda mark, body: struct.pack(">BBH", 255, mark, len(body) + 2) + body
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")
    head += segment(0xDB, b"".join(bytes([k]) + bytes(tables[k][zig].tolist()) for k in (0, 1)))
    head += segment(0xC0, struct.pack(">BHHB", 8, height, width, 3) + bytes([1, 17, 0, 2, 17, 1, 3, 17, 1]))
    kinds = ((0x00, DC_LUMINANCE), (0x10, AC_LUMINANCE), (0x01, DC_CHROMINANCE), (0x11, AC_CHROMINANCE))
    head += segment(0xC4, b"".join(bytes([k, *t[0]]) + t[1] for k, t in kinds))
    head += segment(0xDA, bytes([3, 1, 0, 2, 17, 3, 17, 0, 63, 0]))
    bits, previous = Bits(), [0, 0, 0]
    mix = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])

    def magnitude(v: int) -> tuple[int, int]:
        size = abs(v).bit_length()
        return size, v if v >= 0 else v + (1 << size) - 1

    def block(values: np.ndarray, comp: int) -> None:
        dc, ac = codes[comp > 0]
        size, value = magnitude(int(values[0]) - previous[comp])
        previous[comp] = int(values[0])
        bits.put(*dc[size])
        bits.put(value, size)
        last = 0
        for k in np.flatnonzero(values[1:]) + 1:
            run = int(k) - last - 1
            for _ in range(run // 16):
                bits.put(*ac[0xF0])
            size, value = magnitude(int(values[k]))
            bits.put(*ac[run % 16 << 4 | size])
            bits.put(value, size)
            last = int(k)
        if last < 63:
            bits.put(*ac[0])

    def band(lines: list[np.ndarray]) -> None:
        pixels = np.stack(lines + [lines[-1]] * (8 - len(lines))).astype(float)
        pixels = np.pad(pixels, ((0, 0), (0, -width % 8), (0, 0)), mode="edge")
        planes = np.einsum("ck,yxk->cyx", mix, pixels)
        planes[0] -= 128
        blocks = planes.reshape(3, 8, -1, 8).transpose(2, 0, 1, 3)
        coefficients = np.einsum("uy,ncyx,vx->ncuv", dct, blocks, dct).reshape(-1, 3, 64)
        for n in coefficients:
            for comp in range(3):
                block(np.floor(n[comp] / tables[comp > 0] + 0.5).astype(int)[zig], comp)

    yield head
    held: list[np.ndarray] = []
    for row in ordered_rows(rows, width, height):
        held.append(row)
        if len(held) == 8:
            band(held)
            held = []
            yield bytes(bits.out)
            bits.out.clear()
    if held:
        band(held)
    yield bits.finish() + b"\xff\xd9"


def jpeg(rows: Iterable[tuple[int, bytes]], width: int, height: int, quality: int = 95) -> bytes:
    return b"".join(jpeg_parts(rows, width, height, quality))


#: Encoders that need nothing else. Others are added where their library is installed; a format without one becomes jpeg.
ENCODERS: dict[str, Callable[..., Iterator[bytes]]] = {"png": png_parts, "jpeg": jpeg_parts}


def written_as(fmt: str) -> str:
    return fmt if fmt in ENCODERS else "jpeg"


def encoded_parts(fmt: str, rows: Iterable[tuple[int, bytes]], width: int, height: int, quality: int = 95) -> Iterator[bytes]:
    """The file of ``written_as(fmt)`` in pieces."""
    fmt = written_as(fmt)
    return ENCODERS[fmt](rows, width, height, max(0, (100 - min(100, max(1, quality))) * 9 // 99) if fmt == "png" else quality)


def encode(fmt: str, rows: Iterable[tuple[int, bytes]], width: int, height: int, quality: int = 95) -> tuple[str, bytes]:
    """(format written, bytes)."""
    return written_as(fmt), b"".join(encoded_parts(fmt, rows, width, height, quality))


def _unfiltered(raw: np.ndarray, step: int) -> np.ndarray:
    """Rows of a PNG stream without their filters."""
    out = np.zeros((len(raw) + 1, raw.shape[1] - 1 + step), np.int64)
    for y, line in enumerate(raw, 1):
        kind, body = int(line[0]), line[1:].astype(np.int64)
        up = out[y - 1]
        if kind == 0:
            out[y, step:] = body
        elif kind == 1:
            out[y, step:] = (np.cumsum(body.reshape(-1, step), axis=0) & 255).ravel()
        elif kind == 2:
            out[y, step:] = body + up[step:] & 255
        else:
            row = out[y]
            for i, v in enumerate(body.tolist(), step):
                a, b, c = int(row[i - step]), int(up[i]), int(up[i - step])
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
                row[i] = v + guess & 255
    return out[1:, step:].astype(np.uint8)


def decode_png(data: bytes) -> np.ndarray:
    """(h, w, 3) of a non-interlaced 8-bit PNG; grey is repeated and alpha dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, w, h, kind = 8, b"", 0, 0, 0
    while at + 8 <= len(data):
        n, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if name == b"IHDR":
            w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", part)
            if depth != 8 or kind not in (0, 2, 4, 6) or interlaced:
                raise ValueError("only 8-bit grey or RGB without interlacing is read")
        elif name == b"IDAT":
            body += part
        at += 12 + n
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    try:
        raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * channels)
    except zlib.error as problem:
        raise ValueError(str(problem)) from problem
    pixels = _unfiltered(raw, channels).reshape(h, w, channels)
    return pixels[:, :, :3] if channels >= 3 else pixels[:, :, :1].repeat(3, axis=2)


def decode_bmp(data: bytes) -> np.ndarray:
    """(h, w, 3) of an uncompressed BMP of 24 or 32 bits."""
    try:
        (start,) = struct.unpack_from("<I", data, 10)
        w, h, _, depth, packing = struct.unpack_from("<iiHHI", data, 18)
    except struct.error as problem:
        raise ValueError(f"broken BMP: {problem}") from problem
    if data[:2] != b"BM" or depth not in (24, 32) or packing not in (0, 3) or w <= 0 or not h:
        raise ValueError("only uncompressed BMPs of 24 or 32 bits are read")
    line = (w * depth // 8 + 3) // 4 * 4
    if len(data) < start + line * abs(h):
        raise ValueError("the BMP's data are cut")
    rows = np.frombuffer(data, np.uint8, line * abs(h), start).reshape(abs(h), line)[:, : w * depth // 8].reshape(abs(h), w, depth // 8)
    return (rows[::-1] if h > 0 else rows)[:, :, 2::-1]


class _Scan:
    """Bits of one stretch of a JPEG scan, between restart markers."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.count = data.replace(b"\xff\0", b"\xff"), 0, 0, 0

    def fill(self, length: int) -> None:
        while self.count < length:
            # past the end, ones are read, as many as a code can have
            if self.at > len(self.data) + 2:
                raise ValueError("the JPEG's data are cut")
            self.held = self.held << 8 | (self.data[self.at] if self.at < len(self.data) else 255)
            self.at, self.count = self.at + 1, self.count + 8

    def take(self, length: int) -> int:
        self.fill(length)
        self.count -= length
        value = self.held >> self.count
        self.held &= (1 << self.count) - 1
        return value

    def symbol(self, lookup: list[tuple[int, int]]) -> int:
        self.fill(16)
        length, found = lookup[self.held >> self.count - 16 & 65535]
        if not length:
            raise ValueError("no code of the JPEG's table")
        self.take(length)
        return found

    def signed(self, size: int) -> int:
        if not size:
            return 0
        value = self.take(size)
        return value if value >> size - 1 else value - (1 << size) + 1


def _lookup(table: tuple[tuple[int, ...], bytes]) -> list[tuple[int, int]]:
    """(length, symbol) for every 16 bits that may follow."""
    out = [(0, 0)] * 65536
    for found, (code, length) in huffman_codes(table).items():
        first, n = code << 16 - length, 1 << 16 - length
        if first + n > 65536:
            raise ValueError("a JPEG table with too many codes")
        out[first : first + n] = [(length, found)] * n
    return out


def decode_jpeg(data: bytes) -> np.ndarray:
    """(h, w, 3) of a baseline or extended sequential 8-bit JPEG with one or three components, of any sampling and with restarts."""
    try:
        return _decoded_jpeg(data)
    except (IndexError, KeyError, StopIteration, struct.error) as problem:
        raise ValueError(f"broken JPEG: {problem!r}") from problem


def _decoded_jpeg(data: bytes) -> np.ndarray:
    if data[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, quant, codes, restart, adobe, parts = 2, {}, {}, 0, None, {}
    width = height = 0
    planes: dict[int, np.ndarray] = {}
    while len(planes) < len(parts) or not parts:
        while data[at] == 255 and data[at + 1] == 255:
            at += 1
        if data[at] != 255:
            raise ValueError("no JPEG marker where one is due")
        mark = data[at + 1]
        if mark == 0xD9:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            while body:
                n = 128 if body[0] >> 4 else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if n == 128 else np.uint8, 64).astype(float)
                body = body[1 + n :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = _lookup((tuple(body[1:17]), body[17 : 17 + n]))
                body = body[17 + n :]
        elif mark == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack(">BHHB", body[:6])
            parts = {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)}
            if depth != 8 or n not in (1, 3) or len(parts) != n or not width or not height or any(not 1 <= f <= 4 for c in parts.values() for f in c[:2]):
                raise ValueError("only 8-bit grey or three-component JPEGs are read")
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("only sequential Huffman-coded JPEGs are read, no progressive ones")
        elif mark == 0xDA:
            if not parts:
                raise ValueError("a scan before the frame")
            chosen = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
            stretches, begin = [], at
            while True:  # to the next marker that is no restart
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(data):
                    at = len(data)
                elif data[at + 1] == 0:
                    at += 2
                    continue
                elif data[at + 1] == 255:
                    at += 1
                    continue
                stretches.append(data[begin:at].rstrip(b"\xff") if data[at - 1 : at] == b"\xff" else data[begin:at])
                if data[at + 1 : at + 2] and 0xD0 <= data[at + 1] <= 0xD7:
                    at = begin = at + 2
                    continue
                break
            planes |= _scanned(stretches, chosen, parts, codes, quant, restart, width, height)
    if not parts or len(planes) < len(parts):
        raise ValueError("a JPEG without all of its components")
    wide, high = max(c[0] for c in parts.values()), max(c[1] for c in parts.values())
    full = []
    for k, (fx, fy, _) in parts.items():
        rows, columns = np.arange(height) * fy // high, np.arange(width) * fx // wide
        full.append(planes[k][np.ix_(rows, columns)])
    if len(full) == 1:
        pixels = np.repeat(full[0][:, :, None], 3, axis=2)
    elif adobe == 0 or adobe is None and bytes(parts) == b"RGB":
        pixels = np.stack(full, axis=2)
    else:
        y, cb, cr = full[0], full[1] - 128, full[2] - 128
        pixels = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.floor(pixels + 0.5), 0, 255).astype(np.uint8)


def _scanned(stretches, chosen, parts, codes, quant, restart, width, height) -> dict[int, np.ndarray]:
    """Sample planes, 0 .. 255 and padded to whole blocks, of a scan's components."""
    wide, high = max(c[0] for c in parts.values()), max(c[1] for c in parts.values())
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    zig, dct = np.array(zigzag()), np.array(dct_matrix())
    blocks = {k: np.zeros((down * parts[k][1], across * parts[k][0], 64)) for k, _, _ in chosen}
    if len(chosen) == 1:  # one component alone: its own blocks, without those that only fill up
        k, dc, ac = chosen[0]
        fx, fy, _ = parts[k]
        columns, lines = -(-(-(-width * fx // wide)) // 8), -(-(-(-height * fy // high)) // 8)
        units = [[(k, dc, ac, y, x)] for y in range(lines) for x in range(columns)]
    else:
        units = (
            [(k, dc, ac, v * parts[k][1] + y, u * parts[k][0] + x) for k, dc, ac in chosen for y in range(parts[k][1]) for x in range(parts[k][0])]
            for v in range(down)
            for u in range(across)
        )
    left, scan, previous = 0, None, {}
    waiting = iter(stretches)
    for unit in units:
        if scan is None or restart and not left:
            stretch = next(waiting, None)
            if stretch is None:
                raise ValueError("the JPEG's data are cut")
            scan, left, previous = _Scan(stretch), restart, {}
        left -= 1
        for k, dc, ac, y, x in unit:
            block = blocks[k][y, x]
            previous[k] = block[0] = previous.get(k, 0) + scan.signed(scan.symbol(codes[dc]))
            i = 1
            while i < 64:
                run = scan.symbol(codes[16 | ac])
                if run & 15:
                    i += run >> 4
                    block[i] = scan.signed(run & 15)
                    i += 1
                elif run == 0xF0:
                    i += 16
                else:
                    break
    out = {}
    for k, found in blocks.items():
        flat = np.zeros_like(found)
        flat[:, :, zig] = found * quant[parts[k][2]]
        samples = np.einsum("uy,rcuv,vx->rycx", dct, flat.reshape(*found.shape[:2], 8, 8), dct)
        out[k] = np.clip(np.floor(samples.reshape(found.shape[0] * 8, -1) + 128.5), 0, 255)
    return out


#: Decoders by MIME type; others are added where their library is installed.
DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {"image/png": decode_png, "image/jpeg": decode_jpeg, "image/bmp": decode_bmp}
