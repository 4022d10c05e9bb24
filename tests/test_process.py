"""Networks made of arithmetic through the probe and the drivers, and whole jobs from a folder to files."""

import numpy as np
import pytest

from tessera.functions import codecs
from tessera.operators import engine, process
from tessera.operators import networks as N
from tessera.sources import images
from tests.test_sources import gradient, rows


class Net:
    """Repeats samples; gives images of 0..1, of 0..255 or residuals; crops, or takes one size only."""

    def __init__(self, scale=2, kind="unit", lost=0, size=None, last=False, channels=3):
        self.scale, self.kind, self.lost, self.size, self.last = scale, kind, lost, size, last
        h, w = size or (-1, -1)
        self.shape = (h, w, 3) if last else (channels, h, w)

    def run(self, t):
        t = t.transpose(2, 0, 1) if self.last else t
        if self.size and t.shape[1:] != self.size:
            raise N.Rejected(str(t.shape))
        out = t.repeat(self.scale, 1).repeat(self.scale, 2)
        out = out * 0 if self.kind == "residual" else out / 255 * 0.01 if self.kind == "none" else out * (self.kind != "wide" or np.abs(t).max() > 1)
        out = out[:, : out.shape[1] - self.lost, : out.shape[2] - self.lost]
        return out.transpose(1, 2, 0) if self.last else out[None]


@pytest.mark.parametrize("net, want", [
    (Net(2), N.Probe(2)), (Net(4, "wide"), N.Probe(4, wide=True)), (Net(4, "residual"), N.Probe(4, residual=True)), (Net(3, lost=6), N.Probe(3, lost=6, whole=True)),
    (Net(3, lost=5), N.Probe(3)), (Net(2, last=True), N.Probe(2, planar=False)), (Net(2, channels=1), N.Probe(2, channels=1)), (Net(2, size=(32, 48)), N.Probe(2, fixed=(32, 48))),
    (Net(2, "residual", size=(32, 48)), N.Probe(2, fixed=(32, 48), residual=True)), (Net(20), N.Probe(4, whole=True)),
])
def test_probe(net, want):
    assert N.probe(net, 4) == want


def test_probe_of_a_network_that_takes_nothing():
    class Picky(Net):
        def run(self, t):
            raise N.Rejected("never")

    assert N.probe(Picky(), 3) == N.Probe(3, whole=True)
    with pytest.raises(ValueError):
        N.layout((2, 8, 8))


@pytest.mark.parametrize("net", [Net(2), Net(2, "wide"), Net(2, "residual"), Net(2, last=True), Net(2, size=(32, 48)), Net(2, "residual", size=(16, 16))])
@pytest.mark.parametrize("size", [(250, 201), (5, 3), (33, 49)])
def test_tiles_of_a_network_give_the_image(net, size):
    p = gradient(*size)
    made = N.NetworkEngine(net, 2)
    gap = np.abs(made.upscale(p).astype(int) - p.repeat(2, 0).repeat(2, 1))
    assert gap.max() <= 1 and made.skipped == 0  # samples are cut, not rounded, on their way back


def test_tiles_that_are_too_small_stay_black():
    net = Net(2)
    made = N.NetworkEngine(net, 2, tile=16)
    net.lost = 40  # what a model does that behaves otherwise than when it was probed
    out = made.upscale(gradient(64, 16))
    assert made.skipped and (out == 0).all(axis=2).any()


def test_grey_networks_and_chains():
    p = np.full((8, 8, 3), 90, np.uint8)
    assert (N.NetworkEngine(Net(2, channels=1), 2).upscale(p)[:, :, 0] >= 89).all()
    seen = []
    out = engine.chained(engine.Nearest(2), p, 3, seen.append)
    assert out.shape == (64, 64, 3) and seen[0] == 0.02 and seen[-1] == 1.0
    assert [engine.chain_length(b, t) for b, t in ((2, 8), (2, 12), (4, 8), (1, 5), (4, 2))] == [3, 3, 2, 1, 1]
    assert [N.threads(o, 16) for o in (None, 0, 3, 9)] == [4, 1, 3, 4] and N.threads(None, 1) == 2
    loads = []
    noisy = engine.Noisy(lambda level: loads.append(level) or engine.Nearest(2))
    assert noisy.at(1) is noisy.at(1) is not noisy.at(2) and loads == [1, 2]


def test_resize():
    p = gradient(8, 6)
    assert N.resized(p, 8, 6) is p
    half = N.resized(p, 4, 3)
    assert (half == np.floor(p.reshape(3, 2, 4, 2, 3).mean(axis=(1, 3)) + 0.5)).all()  # centres lie between two pixels
    assert (N.resized(np.full((3, 3, 3), 9, np.uint8), 7, 5) == 9).all()


JOBS = [("a.png", 2, 2, "png"), ("a.png", 2, 4, "png"), ("a.png", 2, 3, "png"), ("b.jpg", 4, 2, "jpeg"), ("big.png", 2, 2, "png"), ("big.png", 2, 2, "heic"), ("broken.png", 2, 2, "png"), ("none.png", 2, 2, "png"), ("x.gif", 2, 2, "png")]


def test_jobs_from_a_folder_to_files(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    a, b, big = gradient(20, 14), gradient(17, 9), gradient(90, 70)
    for name, data in (("a.png", codecs.png(rows(a), 20, 14)), ("b.jpg", codecs.jpeg(rows(b), 17, 9, 95)), ("big.png", codecs.png(rows(big), 90, 70)), ("broken.png", b"x"), ("x.gif", b"GIF89a\x05\0\x05\0" + bytes(20))):
        (folder / name).write_bytes(data)
    files = images.scan(spark, str(folder))
    jobs = spark.createDataFrame([(f"file:{folder}/{n}", "nearest", base, target, True, fmt, 95) for n, base, target, fmt in JOBS], process.JOB)
    out = tmp_path / "out"
    got = {(r.path.rsplit("/", 1)[1], r.target, r.fmt): r for r in process.processed(files, jobs, str(out), tile=32, direct_pixels=5000).collect()}
    assert len(got) == len(JOBS)
    read = lambda r: codecs.DECODERS[images.header(open(r.output, "rb").read())[2]](open(r.output, "rb").read())
    assert (read(got["a.png", 2, "png"]) == a.repeat(2, 0).repeat(2, 1)).all()
    assert (read(got["a.png", 4, "png"]) == a.repeat(4, 0).repeat(4, 1)).all()
    assert (read(got["a.png", 3, "png"]) == N.resized(a.repeat(2, 0).repeat(2, 1), 60, 42)).all()  # 2 cannot make 3: one pass, then the size is corrected
    assert read(got["b.jpg", 2, "jpeg"]).shape == (18, 34, 3)
    assert got["big.png", 2, "png"].branch == "tiled" and (read(got["big.png", 2, "png"]) == big.repeat(2, 0).repeat(2, 1)).all()
    assert got["big.png", 2, "heic"].output.endswith(".jpeg")
    for key in (("broken.png", 2, "png"), ("none.png", 2, "png"), ("x.gif", 2, "png")):
        assert got[key].status == "failed" and got[key].output is None and got[key].error
    assert len(list(out.iterdir())) == 6


def test_stitching_fills_black(spark):
    pieces = spark.createDataFrame([(1, 0, 0, 6, b"abcdef"), (1, 0, 4, 6, b"uvw"), (1, 1, 2, 6, b"xyz")], "id long, y int, x int, width int, rgb binary")
    got = {r.y: bytes(r.rgb) for r in process.stitched(pieces).collect()}
    assert got == {0: b"abcdef" + bytes(6) + b"uvw" + bytes(3), 1: bytes(6) + b"xyz" + bytes(9)}


def test_subcanvases_and_row_table(spark, tmp_path):
    p = gradient(10, 9)
    lines = spark.createDataFrame([(7, "png", 95, 10, 9, y, r, "n") for y, r in rows(p)], process.LINES)
    images.saved(process.subcanvases(lines), str(tmp_path)).collect()
    out = np.zeros_like(p)
    for f in tmp_path.glob("*.png"):
        y, x = (int(v) * 3 for v in f.stem.split("_")[1:])
        part = codecs.decode_png(f.read_bytes())
        out[y : y + part.shape[0], x : x + part.shape[1]] = part
    assert (out == p).all()
    process.register_rows(spark)
    spark.createDataFrame([(codecs.png(rows(p), 10, 9),), (None,), (b"x",)], "content binary").createOrReplaceTempView("some_files")
    got = spark.sql("SELECT y, rgb FROM some_files, LATERAL image_rows(content) ORDER BY y").collect()
    assert [bytes(r.rgb) for r in got] == [r for _, r in rows(p)]
