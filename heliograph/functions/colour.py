"""Colour arithmetic on columns of linear components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Luminance weights, and linear sRGB to XYZ.
LUMA = (0.2126, 0.7152, 0.0722)
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
#: Linear RGB to LMS, cube roots of LMS to OKLab, and both backwards.
LMS = ((0.4122214708, 0.5363325363, 0.0514459929), (0.2119034982, 0.6806995451, 0.1073969566), (0.0883024619, 0.2817188376, 0.6299787005))
OKLAB = ((0.2104542553, 0.7936177850, -0.0040720468), (1.9779984951, -2.4285922050, 0.4505937099), (0.0259040371, 0.7827717662, -0.8086757660))
FROM_OKLAB = ((1.0, 0.3963377774, 0.2158037573), (1.0, -0.1055613458, -0.0638541728), (1.0, -0.0894841775, -1.2914855480))
FROM_LMS = ((4.0767416621, -3.3077115913, 0.2309699292), (-1.2684380046, 2.6097574011, -0.3413193965), (-0.0041960863, -0.7034186147, 1.7076147010))


def clamp01(v: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))


def combined(matrix: tuple[tuple[float, ...], ...], *v: Column) -> tuple[Column, ...]:
    """A 3 x 3 matrix times three columns."""
    return tuple(v[0] * row[0] + v[1] * row[1] + v[2] * row[2] for row in matrix)


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * LUMA[0] + g * LUMA[1] + b * LUMA[2]


def to_linear(v: Column) -> Column:
    """sRGB-encoded to linear."""
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((v + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def chroma(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """Cb and Cr of encoded components."""
    # fixed values: the rows of the matrix; a constant offset of all components cancels
    return r * -0.168736 + g * -0.331264 + b * 0.5, r * 0.5 + g * -0.418688 + b * -0.081312


def chromaticity(r: Column, g: Column, b: Column) -> tuple[Column, Column]:
    """CIE x and y of encoded components; null where dark or outside the unit square."""
    x, y, z = combined(XYZ, to_linear(r), to_linear(g), to_linear(b))
    total = x + y + z
    cx, cy = x / total, y / total
    good = (total > 1e-4) & cx.between(0, 1) & cy.between(0, 1)
    return F.when(good, cx), F.when(good, cy)


def to_oklab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return combined(OKLAB, *(F.cbrt(c) for c in combined(LMS, r, g, b)))


def from_oklab(lightness: Column, a: Column, b: Column) -> tuple[Column, Column, Column]:
    return combined(FROM_LMS, *(c * c * c for c in combined(FROM_OKLAB, lightness, a, b)))


def lch(a: Column, b: Column) -> tuple[Column, Column]:
    """Chroma and hue angle of a and b."""
    return F.sqrt(a * a + b * b), F.atan2(b, a)
