import datetime as dt
import json
import struct
import zlib

import numpy as np
import pytest

from tessera.functions import codecs
from tessera.functions.rasters import dct_matrix, zigzag
from tessera.operators import rasters
from tessera.sources import images, records


def quadrants(w, h):
    """Top left red, top right blue, below white."""
    p = np.full((h, w, 3), 255, np.uint8)
    p[: h // 2, : w // 2] = (255, 0, 0)
    p[: h // 2, w // 2 :] = (0, 0, 255)
    return p


def gradient(w, h):
    y, x = np.mgrid[:h, :w]
    return np.stack([x * 255 // w, y * 255 // h, 255 - x * 255 // w], axis=2).astype(np.uint8)


def rows(p):
    return [(y, p[y].tobytes()) for y in range(len(p))]


def read_png(data):
    at, raw = 8, b""
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            w, h = struct.unpack(">II", body[:8])
        raw += body if kind == b"IDAT" else b""
        at += 12 + n
    return np.frombuffer(zlib.decompress(raw), np.uint8).reshape(h, 1 + w * 3)[:, 1:].reshape(h, w, 3)


def read_jpeg(data):
    """A plain baseline 4:4:4 decoder."""
    at, quant, codes = 2, {}, {}
    while True:
        mark, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            for k in range(0, len(body), 65):
                quant[body[k]] = np.array(list(body[k + 1 : k + 65]))
        elif mark == 0xC0:
            h, w = struct.unpack(">HH", body[1:5])
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0]] = {v: k for k, v in codecs.huffman_codes((tuple(body[1:17]), body[17 : 17 + n])).items()}
                body = body[17 + n :]
        elif mark == 0xDA:
            break
    bits = iter("".join(f"{b:08b}" for b in data[at:-2].replace(b"\xff\0", b"\xff")))

    def symbol(table):
        code = length = 0
        while (code, length) not in table or not length:
            code, length = code * 2 + int(next(bits)), length + 1
        return table[code, length]

    def value(n):
        v = int("".join(next(bits) for _ in range(n)) or "0", 2)
        return v if not n or v >> n - 1 else v - (1 << n) + 1

    zig, dct, last = zigzag(), np.array(dct_matrix()), [0, 0, 0]
    out = np.zeros((3, -(-h // 8) * 8, -(-w // 8) * 8))
    for by in range(0, h, 8):
        for bx in range(0, w, 8):
            for comp in range(3):
                k, block = 1, np.zeros(64)
                last[comp] += value(symbol(codes[int(comp > 0)]))
                block[0] = last[comp]
                while k < 64 and (s := symbol(codes[16 + int(comp > 0)])):
                    k += s >> 4
                    if s != 0xF0:
                        block[zig[k]] = value(s & 15)
                    k += 1
                q = np.zeros(64)
                q[zig] = quant[int(comp > 0)]
                out[comp, by : by + 8, bx : bx + 8] = dct.T @ (block * q).reshape(8, 8) @ dct
    y, cb, cr = out[0] + 128, out[1], out[2]
    return np.clip(np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2), 0, 255)[:h, :w]


@pytest.mark.parametrize("pixels", [quadrants(160, 120), gradient(61, 45), np.full((3, 5, 3), 7, np.uint8)])
def test_png_is_exact_and_jpeg_near(pixels):
    h, w, _ = pixels.shape
    assert (read_png(codecs.png(rows(pixels), w, h)) == pixels).all()
    data = codecs.jpeg(rows(pixels), w, h, 95)
    assert data[:2] == b"\xff\xd8" and data[-2:] == b"\xff\xd9"
    gap = np.abs(read_jpeg(data) - pixels)
    assert gap.max() <= 12
    assert images.header(data)[:3] == (w, h, "image/jpeg") and images.header(codecs.png(rows(pixels), w, h))[:3] == (w, h, "image/png")


def test_rows_must_be_in_order():
    p = gradient(4, 3)
    for bad in (rows(p)[::-1], rows(p)[:2], [(0, b"x"), *rows(p)[1:]]):
        with pytest.raises(ValueError):
            codecs.png(bad, 4, 3)


def test_zigzag_and_codes():
    z = zigzag()
    assert sorted(z) == list(range(64)) and z[:10] == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and z[-3:] == [55, 62, 63]
    for table in (codecs.AC_LUMINANCE, codecs.AC_CHROMINANCE):
        assert sum(table[0]) == len(table[1]) == len(set(table[1])) == 162
        assert sum(2.0 ** -n for _, n in codecs.huffman_codes(table).values()) < 1


def test_files_round_trip(spark, tmp_path):
    p = gradient(20, 9)
    made = [(1, "png", 95, 20, 9, y, r) for y, r in rows(p)] + [(2, "heic", 90, 20, 9, y, r) for y, r in rows(p)] + [(3, "png", 90, 20, 9, y, r) for y, r in rows(p)[1:]]
    df = spark.createDataFrame(made, "id long, fmt string, quality int, width int, height int, y int, rgb binary").repartition(4)
    got = {r.id: r for r in images.encoded(df).collect()}
    assert (read_png(got[1].bytes) == p).all() and got[2].fmt == "jpeg" and got[3].error and not got[3].bytes
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/one.PNG").write_bytes(got[1].bytes)
    (tmp_path / "a/b/two.jpeg").write_bytes(got[2].bytes)
    (tmp_path / "a/b/broken.png").write_bytes(b"no image")
    (tmp_path / "a/notes.txt").write_text("x")
    files = images.scan(spark, str(tmp_path / "a"))
    assert files.select("path").count() == 3
    found = sorted((r.width, r.height, r.mime, r.huge) for r in images.probe(files).collect())
    assert found == [(20, 9, "image/jpeg", False), (20, 9, "image/png", False)]


def filtered_png(p, kinds):
    """A PNG whose rows use the given filters in turn."""
    h, w, n = p.shape
    raw, up = b"", np.zeros(w * n, int)
    for y in range(h):
        line, kind = p[y].ravel().astype(int), kinds[y % len(kinds)]
        left, corner = np.r_[np.zeros(n, int), line[:-n]], np.r_[np.zeros(n, int), up[:-n]]
        near = np.stack([left, up, corner])
        pick = np.abs(left + up - corner - near).argmin(axis=0)
        guess = {0: 0 * line, 1: left, 2: up, 3: (left + up) // 2, 4: np.choose(pick, near)}[kind]
        raw += bytes([kind]) + (line - guess & 255).astype(np.uint8).tobytes()
        up = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_decoding_and_tiles(spark):
    rng = np.random.default_rng(1)
    p = rng.integers(0, 256, (13, 17, 4)).astype(np.uint8)
    assert (codecs.decode_png(filtered_png(p, (0, 1, 2, 3, 4))) == p[:, :, :3]).all()
    assert (codecs.decode_png(filtered_png(p[:, :, :1], (4, 3))) == p[:, :, :1]).all()
    with pytest.raises(ValueError):
        codecs.decode_png(b"\x89PNG\r\n\x1a\n")
    files = spark.createDataFrame([("a", filtered_png(p[:, :, :3].copy(), (4,))), ("bad", b"x")], "path string, content binary")
    tiles = spark.createDataFrame([("a", 0, 0, 0, 8, 8), ("a", 1, 8, 5, 9, 8), ("a", 2, 9, 9, 9, 9), ("bad", 0, 0, 0, 1, 1)], "path string, tile_no int, x int, y int, tw int, th int")
    got = {r.tile_no: r for r in images.decoded_tiles(files, tiles).collect()}
    assert set(got) == {0, 1}
    for r in got.values():
        assert bytes(r.rgb) == p[r.y : r.y + r.th, r.x : r.x + r.tw, :3].tobytes()


def sampled_jpeg(values):
    """A 4:2:0 JPEG of two units side by side with a restart between; values: four DC for luminance, two for colour, a unit."""
    segment = lambda mark, body: struct.pack(">BBH", 255, mark, len(body) + 2) + body
    dc, ac = codecs.huffman_codes(codecs.DC_LUMINANCE), codecs.huffman_codes(codecs.AC_LUMINANCE)
    out = b"\xff\xd8" + segment(0xDB, b"\0" + b"\x08" * 64) + segment(0xDD, b"\0\1")
    out += segment(0xC0, struct.pack(">BHHB", 8, 15, 30, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0]))
    out += segment(0xC4, b"".join(bytes([k, *t[0]]) + t[1] for k, t in ((0, codecs.DC_LUMINANCE), (16, codecs.AC_LUMINANCE))))
    out += segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    for n, unit in enumerate(values):
        bits, last = codecs.Bits(), {}
        for k, v in zip((0, 0, 0, 0, 1, 2), unit, strict=True):
            gap = v - last.get(k, 0)
            last[k] = v
            bits.put(*dc[abs(gap).bit_length()])
            bits.put(gap if gap >= 0 else gap + (1 << abs(gap).bit_length()) - 1, abs(gap).bit_length())
            bits.put(*ac[0])
        out += bits.finish() + (b"\xff\xd0" if n == 0 else b"\xff\xd9")
    return out


def test_jpeg_is_decoded():
    for p in (quadrants(40, 24), gradient(61, 45), np.full((3, 5, 3), 7, np.uint8)):
        data = codecs.jpeg(rows(p), p.shape[1], p.shape[0], 90)
        gap = np.abs(codecs.decode_jpeg(data).astype(int) - read_jpeg(data))
        assert gap.mean() <= 0.7 and gap.max() <= 5  # samples are whole and held to 0 .. 255 before colours are mixed
        with pytest.raises(ValueError):
            codecs.decode_jpeg(data[: len(data) // 2])
    # a DC of 1 is 1 step of grey here
    got = codecs.decode_jpeg(sampled_jpeg([(10, -20, 30, 0, 0, 0), (-5, 5, 60, -60, 20, -10)])).astype(int)
    assert got.shape == (15, 30, 3)
    assert (got[:8, :8] == 138).all() and (got[:8, 8:16] == 108).all() and (got[8:, :8] == 158).all() and (got[8:, 8:16] == 128).all()
    for y, part in ((-5, got[:8, 16:24]), (5, got[:8, 24:]), (60, got[8:, 16:24]), (-60, got[8:, 24:])):
        want = 128 + y + np.array([-14.02, -6.88688 + 7.14136, 35.44])
        assert np.abs(part - want).max() <= 0.51


def test_formats_without_decoder_give_errors(spark):
    p = gradient(20, 12)
    contents = {"j": codecs.jpeg(rows(p), 20, 12, 90), "g": b"GIF89a" + bytes(20), "h": b"\0\0\0\x18ftypheic" + bytes(20), "cut": codecs.png(rows(p), 20, 12)[:60]}
    files = spark.createDataFrame(list(contents.items()), "path string, content binary")
    tiles = spark.createDataFrame([(k, n, 4 * n, 0, 4, 4) for k in contents for n in (0, 1)], "path string, tile_no int, x int, y int, tw int, th int")
    got = {(r.path, r.tile_no): r for r in images.decoded_tiles(files, tiles).collect()}
    assert set(got) == {(k, n) for k in contents for n in (0, 1)}
    want = codecs.decode_jpeg(contents["j"])
    for (k, n), r in got.items():
        assert bool(r.error) == (k != "j") and (r.rgb is None) == (k != "j")
        assert k != "j" or bytes(r.rgb) == want[:4, 4 * n : 4 * n + 4].tobytes()
    assert got["g", 0].error == "no decoder for image/gif" and got["h", 1].error == "no decoder for image/heif"


def test_published_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    assert images.published(spark, path) is None
    for n in (5, 3, 7):
        images.publish(spark.range(n), path)
        assert images.published(spark, path).count() == n
    assert sorted(x.name[:20] for x in (tmp_path / "out").iterdir()) == ["version=000000000002", "version=000000000003"]


def test_files_grow_in_pieces(spark, tmp_path):
    p = np.random.default_rng(3).integers(0, 256, (300, 200, 3)).astype(np.uint8)
    made = [(i, fmt, 90, 200, 300, y, r, f"n{i}") for i, fmt in ((1, "png"), (2, "jpeg"), (3, "avif")) for y, r in rows(p)]
    made += [(4, "png", 90, 200, 300, 0, rows(p)[0][1], "n4"), (5, "png", 90, 200, 300, -1, b"broken before", "n5")]
    df = spark.createDataFrame(made, "id long, fmt string, quality int, width int, height int, y int, rgb binary, name string").repartition(3)
    parts = {}
    for r in images.encoded_parts(df).collect():
        parts.setdefault(r.id, []).append(r)
    assert len(parts[1]) > 2 and max(len(r.bytes) for r in parts[1]) < 1 << 18  # never a whole image
    assert (read_png(b"".join(bytes(r.bytes) for r in sorted(parts[1], key=lambda r: r.part))) == p).all()
    assert max(parts[4], key=lambda r: r.part).error and max(parts[5], key=lambda r: r.part).error == "broken before"
    got = {r.id: r for r in images.saved(df, str(tmp_path / "o")).collect()}
    assert sorted(x.name for x in (tmp_path / "o").iterdir()) == ["n1.png", "n2.jpeg", "n3.jpeg"]
    assert (codecs.decode_png((tmp_path / "o/n1.png").read_bytes()) == p).all() and got[1].length == (tmp_path / "o/n1.png").stat().st_size
    assert got[4].error and got[4].path is None and got[5].error == "broken before"


def test_headers_of_other_formats():
    ispe = lambda w, h: struct.pack(">I4sIII", 20, b"ispe", 0, w, h)
    assert images.header(b"\0\0\0\x18ftypheic" + bytes(12) + ispe(512, 512) + ispe(4032, 3024) + ispe(320, 240))[:3] == (4032, 3024, "image/heif")
    assert images.header(b"\0\0\0\x18ftypavif" + bytes(12) + ispe(64, 48))[:3] == (64, 48, "image/avif")

    def jxl(*fields):
        bits = at = 0
        for value, n in fields:
            bits, at = bits | value << at, at + n
        return b"\xff\x0a" + bits.to_bytes(20, "little")

    assert images.header(jxl((1, 1), (5, 5), (0, 3), (7, 5)))[:3] == (64, 48, "image/jxl")  # eighths of both edges
    assert images.header(jxl((0, 1), (1, 2), (1079, 13), (5, 3)))[:3] == (1920, 1080, "image/jxl")  # a height and 16:9
    assert images.header(b"\0\0\0\x0cJXL \r\n\x87\n" + bytes(8) + jxl((0, 1), (0, 2), (99, 9), (0, 3), (0, 2), (149, 9)))[:2] == (150, 100)
    tiff = b"II*\0" + struct.pack("<IHHHIIHHII", 8, 2, 256, 3, 1, 70, 257, 4, 1, 80)
    assert images.header(tiff)[:3] == (70, 80, "image/tiff")
    assert images.header(b"\xff\x0a") is None and images.header(b"II*\0") is None and images.header(b"\0\0\0\x18ftypheic") is None
    p = gradient(5, 4)
    for sign in (1, -1):
        lines = b"".join(row[:, ::-1].tobytes() + b"\0" for row in (p[::-1] if sign > 0 else p))
        bmp = b"BM" + struct.pack("<IHHI", 54 + len(lines), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 5, 4 * sign, 1, 24, 0, 0, 0, 0, 0, 0) + lines
        assert images.header(bmp)[:3] == (5, 4, "image/bmp") and (codecs.decode_bmp(bmp) == p).all()


def test_copies_and_probes_in_place(spark, tmp_path):
    p = gradient(9, 7)
    data = codecs.png(rows(p), 9, 7)
    files = spark.createDataFrame([("u/1", "image/PNG", data), ("u/2", "image/webp", b"w"), ("u/3", None, b"j"), ("u/4", "image/png", None)], "path string, mime string, content binary")
    got = {r.path: r for r in images.copied(files, str(tmp_path / "c")).collect()}
    assert [got[f"u/{n}"].copy and got[f"u/{n}"].copy.rsplit(".", 1)[1] for n in (1, 2, 3, 4)] == ["png", "webp", "jpg", None]
    assert open(got["u/1"].copy, "rb").read() == data and got["u/4"].error
    paths = images.scan(spark, str(tmp_path / "c")).select("path", "length")
    probed = images.probe_in_place(paths)
    assert [(r.width, r.height, r.mime, r.alpha, r.pixels) for r in probed.collect()] == [(9, 7, "image/png", True, 63)]


def test_checksums(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.crc for r in rasters.row_checksums(spark, sf_dir).collect()}
    assert got == {k: zlib.crc32((t or "").encode()) for k, t in texts.items()}


def test_settings(spark, tmp_path):
    path = str(tmp_path / "settings")
    assert records.settings(spark, path).first().asDict() == records.DEFAULTS
    records.update_settings(spark, path, lambda s: {"quality": s["quality"] - 5})
    got = records.update_settings(spark, path, lambda s: {"format": "png"}).first()
    assert (got.quality, got.format, got.concurrency) == (90, "png", "balanced")


def test_records(spark, tmp_path):
    path = tmp_path / "queue.json"
    path.write_text("\n".join([json.dumps({"id": "a", "status": "running", "progress": 0.5, "startedAt": 7, "extra": 1, "upscalePlan": {"targetScale": 2}}), json.dumps({"id": "b", "status": "failed", "lastError": "e"}), "{broken"]))
    got = {r.id: r for r in records.queue(spark, str(path)).collect()}
    assert (got["a"].status, got["a"].progress, got["a"].startedAt, got["a"].upscalePlan.targetScale) == ("pending", 0.0, 0, 2)
    assert got["b"].status == "failed" and set(got) == {"a", "b"}
    seeds = spark.createDataFrame([("seed",)], "id string")
    path.write_text("{broken")
    assert records.profiles(spark, str(path), seeds).collect()[0].id == "seed"
    assert records.profiles(spark, str(tmp_path / "none.json"), seeds).collect()[0].id == "seed"
    path.write_text(" \n")
    assert records.profiles(spark, str(path), seeds).count() == 0
    text = spark.createDataFrame([(json.dumps({"e1": {"tile": {"enabled": True, "value": 192, "defaultValue": 256}, "pad": {"enabled": False, "value": 1, "defaultValue": 18}}}),), ("{",)], "json string")
    assert {(r.engine, r.name): r.effective for r in records.parameters(text).collect()} == {("e1", "tile"): 192.0, ("e1", "pad"): 18.0}


def test_graph(spark):
    text = ["7767517", "4 4", "Input in0 0 1 in0", "Convolution conv 1 1 in0 a 0=32 1=3 -23310=1,2.0e-1", "Split split 1 2 a b c", "BinaryOp add 2 1 b c out0 0=0"]
    lines = spark.createDataFrame([("m", i, v) for i, v in enumerate(text)], "file string, n int, value string")
    layers = records.layers(lines).cache()
    conv = layers.where("name = 'conv'").first()
    assert (conv.inputs, conv.outputs, conv.params["-23310"]) == (["in0"], ["a"], "1,2.0e-1")
    assert sorted((r.source, r.target) for r in records.edges(layers).collect()) == [("conv", "split"), ("in0", "conv"), ("split", "add"), ("split", "add")]
    assert tuple(records.graph_ends(layers).first()) == ("m", "in0", "out0")


def test_logs(spark, tmp_path):
    head = "01-01 10:00:00.000 42 7"
    kept = [(f"{head} E App: FATAL x", "E"), (f"{head} I mytag: y" + "z" * 500, "I"), (f"{head} V lib: dlopen failed", "I"), ("01-01 x y z D x(42): Abort message", "D"), (f"{head} W DEBUG: SIGSEGV", "W")]
    gone = ["01-01 10:00:00 43 7 E FATAL", f"{head} I other", f"{head} E exception", f"{head} E Logcat: FATAL", "01-01 10:00:00 421 7 E FATAL"]
    lines = spark.createDataFrame([(k,) for k, _ in kept] + [(g,) for g in gone], "value string")
    got = {r.message: r.level for r in records.system_log(lines, 42, ("mytag",)).collect()}
    assert got == {k if len(k) <= 400 else k[:400] + "…": level for k, level in kept}
    entries = spark.createDataFrame([(dt.datetime(2024, 1, 1, 10, 0, n, 5000), "I", "t", f"m{n}") for n in (2, 1)], "ts timestamp_ntz, level string, tag string, message string")
    want = ["10:00:01.005 I/t: m1", "10:00:02.005 I/t: m2"]
    assert [r.value for r in records.log_dump(entries, "now").collect()] == ["# debug log", "# captured at now", "# entries: 2", "", *want]
    for _ in range(2):
        records.append_log(entries.coalesce(1), str(tmp_path / "log"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "log")).collect()) == sorted(want * 2)
