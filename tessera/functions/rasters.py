"""Pixel, tensor and codec arithmetic as columns and array expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard luminance quantisation table in natural order.
LUMINANCE = (
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
)
# The standard chrominance quantisation table in natural order.
CHROMINANCE = (
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
)


# Least mean |output| of networks that give whole images, for grey input 0.5 and 127.5.
HALF_LIMIT = 0.05
WIDE_LIMIT = 1.0


def zigzag() -> list[int]:
    """Places of an 8x8 block in zigzag order, by its rule: diagonals in turn, alternately upwards and downwards."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    cells.sort(key=lambda c: (sum(c), c[0] if sum(c) % 2 else -c[0]))
    return [y * 8 + x for y, x in cells]


def dct_matrix() -> list[list[float]]:
    """Orthonormal DCT-II of eight points."""
    return [[(math.sqrt(0.125) if u == 0 else 0.5) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]


def bound(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, however often lambdas in ``body`` use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def channel(pixel: Column, shift: int) -> Column:
    return F.shiftrightunsigned(pixel, shift).bitwiseAND(255)


def packed(a: Column, r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(a, 24).bitwiseOR(F.shiftleft(r, 16)).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def grey(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r + g + b) / 3).cast("int")


def normalised(v: Column, mean: float, std: float, wide: bool = False) -> Column:
    """Network input of a sample: as it is where the network works on 0..255 (``wide``), else scaled, shifted and divided."""
    return v * F.lit(1.0) if wide else (v / F.lit(255.0) - F.lit(mean)) / F.lit(std)


def denormalised(v: Column, mean: float, std: float, source: Column | None = None, wide: bool = False) -> Column:
    """0..1 of a network's output: on top of its input (``source``, a residual network), divided by 255 (``wide``), or by mean and std."""
    if source is not None:
        return source + v
    return v / F.lit(255.0) if wide else v * F.lit(std) + F.lit(mean)


def domain_probe(half: Column, wide: Column, low: float = HALF_LIMIT, high: float = WIDE_LIMIT) -> Column:
    """What a network gives, by the mean of |output| for grey input 0.5 and for 127.5: whole images of 0..1, of 0..255, or residuals."""
    return F.when(half >= low, "full 0..1").when(wide >= high, "full 0..255").otherwise("residual")


def tile_padding(scale: Column, probed: Column, requested: Column) -> Column:
    """Border of a tile: the most of the usual one for the scale, the probed and the requested one, and 3."""
    usual = F.when(scale == 3, 14).when(scale == 4, 19).otherwise(18)
    return F.greatest(usual, F.coalesce(probed, F.lit(0)), F.coalesce(requested, F.lit(0)), F.lit(3)).cast("int")


def interleaved(last: Column) -> Column:
    """Whether a tensor's shape is (height, width, channels): its last dimension is 3."""
    return last == 3


def flattened(nested: Column, size: Column) -> Column:
    """A nested array as one; an error where its size is not the expected one."""
    flat = F.flatten(nested)
    return F.when(F.size(flat) == size, flat).otherwise(F.raise_error(F.concat(F.lit("tensor of "), F.size(flat).cast("string"), F.lit(" values where "), size.cast("string"), F.lit(" were due"))))


def to_byte(v: Column, rounded: bool = False) -> Column:
    """0..1 to 0..255: clamped and truncated, or rounded half away from zero."""
    v = v * 255
    v = F.round(v) if rounded else v
    return F.greatest(F.lit(0), F.least(F.lit(255), v.cast("int")))


def aligned(v: Column, step: int) -> Column:
    return (F.ceil(v / step) * step).cast("int")


def edge_clamped(i: Column, n: Column) -> Column:
    return F.greatest(F.lit(0), F.least(n - 1, i))


def half_up(v: Column) -> Column:
    """Java's rounding: half towards positive infinity."""
    return F.floor(v + F.lit(0.5))


def magnitude(v: Column) -> Column:
    """Bits of |v|; 0 has none."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("long"))))


def luma(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Y - 128, Cb, Cr by BT.601."""
    return (
        0.299 * r + 0.587 * g + 0.114 * b - 128,
        -0.168736 * r - 0.331264 * g + 0.5 * b,
        0.5 * r - 0.418688 * g - 0.081312 * b,
    )


def quant_step(base: Column, quality: Column) -> Column:
    scale = F.when(quality < 50, F.floor(F.lit(5000) / quality)).otherwise(200 - 2 * quality)
    return F.greatest(F.lit(1), F.least(F.lit(255), F.floor((base * scale + 50) / 100))).cast("int")
