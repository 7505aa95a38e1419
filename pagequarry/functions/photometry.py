"""Light and colour of a cell as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..limits import GLARE_BIAS, GLARE_WEIGHTS

# Luminance weights of linear blue, green and red, and of the grey value of a stored image.
LUMINANCE_BGR = (0.0722, 0.7152, 0.2126)
GREY_BGR = (0.114, 0.587, 0.299)
# sRGB to CIE XYZ (rows X, Y, Z for linear red, green, blue) and the D65 white point.
XYZ = ((0.412453, 0.357580, 0.180423), (0.212671, 0.715160, 0.072169), (0.019334, 0.119193, 0.950227))
WHITE = (0.950456, 1.0, 1.088754)


def linear(channel: Column) -> Column:
    """An sRGB channel value 0..255 in linear light 0..1."""
    c = channel / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def luminance(b: Column, g: Column, r: Column) -> Column:
    """Luminance of linear channels."""
    return b * LUMINANCE_BGR[0] + g * LUMINANCE_BGR[1] + r * LUMINANCE_BGR[2]


def grey(b: Column, g: Column, r: Column) -> Column:
    """Grey value 0..1 of stored channels 0..255."""
    return (b * GREY_BGR[0] + g * GREY_BGR[1] + r * GREY_BGR[2]) / 255.0


def darkest(b: Column, g: Column, r: Column) -> Column:
    return F.least(b, g, r)


def clipped_share(b: Column, g: Column, r: Column, at: int = 250) -> Column:
    return ((b >= at).cast("int") + (g >= at).cast("int") + (r >= at).cast("int")) / 3.0


def lab(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    """CIE L*a*b*: lightness scaled to 0..255, a and b around 0."""
    lin = [linear(c) for c in (r, g, b)]
    xyz = [sum((m * c for m, c in zip(row[1:], lin[1:])), lin[0] * row[0]) / w for row, w in zip(XYZ, WHITE)]
    f = [F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise(t * 7.787 + 16 / 116) for t in xyz]
    return (f[1] * 116 - 16) * 2.55, (f[0] - f[1]) * 500, (f[1] - f[2]) * 200


def chroma(b: Column, g: Column, r: Column) -> Column:
    _, a, bb = lab(b, g, r)
    return F.hypot(a, bb)


def clamp01(c: Column) -> Column:
    return F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))


def evidence(veil: Column, desat: Column, flat: Column, clip: Column) -> Column:
    """The weighted sum of the four glare features, without the bias."""
    w = GLARE_WEIGHTS
    return veil * w["veil"] + desat * w["desat"] + flat * w["flat"] + clip * w["clip"]


def logistic(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def glare_score(veil: Column, desat: Column, flat: Column, clip: Column, bias: float | Column = GLARE_BIAS) -> Column:
    return logistic(evidence(veil, desat, flat, clip) + bias)
