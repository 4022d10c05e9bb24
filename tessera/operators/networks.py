"""Engines backed by a network: what it takes and gives is found by probing it, and images go through it in tiles or whole.

A network is anything with ``run``; a model runtime's session fits behind it. The weights of the surveyed models are not
available, so tests use networks made of arithmetic.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from typing import Protocol

import numpy as np

from tessera.functions.rasters import HALF_LIMIT, WIDE_LIMIT

TILE = 192
SIZES = (64, 96)
LEAST_PAD = 16


class Rejected(Exception):
    """What a network raises for an input of a shape that it does not take."""


class Network(Protocol):
    #: Declared input: (channels, height, width) or, with the channels last, (height, width, 3); sizes may be -1 for any.
    shape: tuple[int, int, int]

    def run(self, tensor: np.ndarray) -> np.ndarray:
        """A float tensor of the declared layout to another one; Rejected for sizes it does not take."""


@dataclass(frozen=True)
class Probe:
    """What is known of a network. ``lost``: pixels of the output that are missing; ``whole``: not to be tiled."""

    scale: int
    lost: int = 0
    pad: int = LEAST_PAD
    residual: bool = False
    wide: bool = False
    fixed: tuple[int, int] | None = None
    whole: bool = False
    channels: int = 3
    planar: bool = True


def layout(shape: tuple[int, int, int]) -> tuple[bool, int, int, int]:
    """(planar, channels, height, width): three at the end are channels."""
    planar = shape[2] != 3
    channels, h, w = shape if planar else (shape[2], shape[0], shape[1])
    if channels not in (1, 3):
        raise ValueError(f"{channels} input channels, where 1 or 3 are taken")
    return planar, channels, h, w


def planes(out: np.ndarray) -> np.ndarray:
    """An output as (channels, height, width); dimensions of one in front are dropped."""
    out = np.asarray(out, np.float32)
    while out.ndim > 3 and out.shape[0] == 1:
        out = out[0]
    if out.ndim == 2:
        out = out[None]
    if out.ndim != 3:
        raise ValueError(f"output of {out.ndim} dimensions")
    out = out.transpose(2, 0, 1) if out.shape[2] == 3 else out
    if not 1 <= out.shape[0] <= 4:
        raise ValueError(f"output of {out.shape[0]} channels")
    return out


def grey(net: Network, h: int, w: int, value: float) -> np.ndarray:
    """Output planes for an input of one value."""
    planar, channels, _, _ = layout(net.shape)
    return planes(net.run(np.full((channels, h, w) if planar else (h, w, channels), value, np.float32)))


def probe(net: Network, scale: int, mean: float = 0.0, std: float = 1.0) -> Probe:
    """Scale, crop, domain and kind of a network; ``scale`` is used where they cannot be found.

    Two grey squares show by how much the output grows: their difference gives the scale, what is missing the crop. A network that
    crops, or whose scale makes no sense, takes whole images. A mean output near nothing for grey input, on both domains, is a
    residual's. A network that takes one size only is probed at that size.
    """
    planar, channels, h, w = layout(net.shape)
    base = Probe(scale, channels=channels, planar=planar)
    neutral = 0.5 if mean == 0 else (0.5 - mean) / std
    level = lambda out: float(np.abs(out * std + mean, dtype=np.float64).mean())
    try:
        small, large, bright = grey(net, SIZES[0], SIZES[0], neutral), grey(net, SIZES[1], SIZES[1], neutral), grey(net, SIZES[0], SIZES[0], 127.5)
    except Rejected:
        if h <= 0 or w <= 0:
            return replace(base, whole=True)
        out = grey(net, h, w, neutral)
        found = min(16, max(1, out.shape[1] // h)) if out.shape[1] else scale
        return replace(base, scale=found, fixed=(h, w), residual=level(out) < HALF_LIMIT and mean == 0)
    full = level(small) >= HALF_LIMIT
    wide = not full and level(bright) >= WIDE_LIMIT
    base = replace(base, wide=wide, residual=not full and not wide)
    growth = (large.shape[2] - small.shape[2]) / (SIZES[1] - SIZES[0])
    if not 1 <= growth <= 16:
        return replace(base, whole=True)
    found = int(growth)
    lost = max(0, SIZES[0] * found - small.shape[2])
    lost = 0 if lost % found else lost
    return replace(base, scale=found, lost=lost, whole=lost > 0, pad=max(LEAST_PAD, lost // found // 2))


def resized(pixels: np.ndarray, w: int, h: int) -> np.ndarray:
    """Bilinear resize to (h, w): centres of pixels are matched, edges are held, values rounded."""
    if pixels.shape[:2] == (h, w):
        return pixels
    out = pixels.astype(np.float64)
    for axis, n in ((0, h), (1, w)):
        have = out.shape[axis]
        at = np.clip((np.arange(n) + 0.5) * have / n - 0.5, 0, have - 1)
        low = np.floor(at).astype(int)
        part = (at - low).reshape((-1, 1, 1) if axis == 0 else (1, -1, 1))
        out = out.take(low, axis) * (1 - part) + out.take(np.minimum(low + 1, have - 1), axis) * part
    return np.floor(out + 0.5).astype(np.uint8)


class NetworkEngine:
    """An engine (scale, upscale) around a network. Tiles whose output is too small stay black and are counted in ``skipped``."""

    def __init__(self, net: Network, scale: int, mean: float = 0.0, std: float = 1.0, tile: int = TILE):
        self.net, self.mean, self.std, self.tile, self.skipped = net, mean, std, tile, 0
        self.probe = probe(net, scale, mean, std)
        self.scale = self.probe.scale

    def infer(self, pixels: np.ndarray) -> np.ndarray:
        """Pixels (h, w, 3) of 0..255 through the network: bytes of the size that comes out, shades of one channel repeated."""
        p = self.probe
        samples = pixels.astype(int)
        samples = samples.sum(axis=2, keepdims=True) // 3 if p.channels == 1 else samples
        tensor = (samples if p.wide else (samples / 255.0 - self.mean) / self.std).astype(np.float32)
        out = planes(self.net.run(tensor.transpose(2, 0, 1) if p.planar else tensor))
        out = out[:3] if len(out) >= 3 else out[:1].repeat(3, axis=0)
        if p.residual and self.mean == 0:
            # the residual lies on the input pixel it grew from
            h, w = out.shape[1:]
            ys, xs = (np.minimum(np.arange(n) // p.scale, m - 1) for n, m in ((h, pixels.shape[0]), (w, pixels.shape[1])))
            out = out + pixels[np.ix_(ys, xs)].transpose(2, 0, 1) / 255.0
        elif p.wide:
            out = out / 255.0
        else:
            out = out * self.std + self.mean
        return np.clip(np.trunc(out.transpose(1, 2, 0) * 255), 0, 255).astype(np.uint8)

    def upscale(self, pixels: np.ndarray) -> np.ndarray:
        if self.probe.fixed:
            return self._blended(pixels)
        return self.infer(pixels) if self.probe.whole else self._tiled(pixels)

    def _tiled(self, pixels: np.ndarray) -> np.ndarray:
        """Tiles with a border, of which the middle is kept."""
        s, pad, (h, w, _) = self.scale, self.probe.pad, pixels.shape
        out = np.zeros((h * s, w * s, 3), np.uint8)
        up4 = lambda v: (v + 3) // 4 * 4
        for y in range(0, h, self.tile):
            for x in range(0, w, self.tile):
                top, left = max(0, y - pad), max(0, x - pad)
                made = self.infer(pixels[top : min(h, up4(y + self.tile + pad)), left : min(w, up4(x + self.tile + pad))])
                th, tw = min(self.tile, h - y) * s, min(self.tile, w - x) * s
                cut = made[(y - top) * s :, (x - left) * s :][:th, :tw]
                if cut.shape[:2] != (th, tw):
                    self.skipped += 1
                    continue
                out[y * s : y * s + th, x * s : x * s + tw] = cut
        return out

    def _blended(self, pixels: np.ndarray) -> np.ndarray:
        """Tiles of the network's one size, half a tile apart, edges repeated, overlaps averaged in whole numbers."""
        s, (th, tw), (h, w, _) = self.scale, self.probe.fixed, pixels.shape
        total, count = np.zeros((h * s, w * s, 3), np.int64), np.zeros((h * s, w * s, 1), np.int64)
        starts = lambda n, t: [min(i * max(1, t // 2), n - 1) for i in range(max(1, math.ceil((n - t) / max(1, t // 2)) + 1))]
        for y in starts(h, th):
            for x in starts(w, tw):
                ys, xs = np.minimum(np.arange(y, y + th), h - 1), np.minimum(np.arange(x, x + tw), w - 1)
                made = self.infer(pixels[np.ix_(ys, xs)])
                bottom, right = min(h, y + th) * s, min(w, x + tw) * s
                cut = made[: bottom - y * s, : right - x * s]
                if cut.shape[:2] != (bottom - y * s, right - x * s):
                    self.skipped += 1
                    continue
                total[y * s : bottom, x * s : right] += cut
                count[y * s : bottom, x * s : right] += 1
        return (total // np.maximum(count, 1)).astype(np.uint8)


def threads(override: int | None, processors: int) -> int:
    """Threads of a native engine: an override of 1 to 8, else as many as there are processors, 2 to 6; four are used at most."""
    return min(4, min(8, max(1, override)) if override is not None else min(6, max(2, processors)))
