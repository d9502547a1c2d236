"""RGB from 0 to 255 to CIE L*a*b* and back: sRGB primaries and gamma, white point D65."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sRGB matrices, the D65 white point, and the constants of the CIE formula.
TO_XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
FROM_XYZ = ((3.2404542, -1.5371385, -0.4985314), (-0.9692660, 1.8760108, 0.0415560), (0.0556434, -0.2040259, 1.0572252))
WHITE = (0.95047, 1.0, 1.08883)
EPSILON, KAPPA = 216 / 24389, 24389 / 27


def rgb_to_lab(r: Column, g: Column, b: Column) -> list[Column]:
    linear = [F.when(c / 255.0 <= 0.04045, c / 255.0 / 12.92).otherwise(F.pow((c / 255.0 + 0.055) / 1.055, F.lit(2.4))) for c in (r, g, b)]
    xyz = [sum((m * c for m, c in zip(row, linear)), F.lit(0.0)) / w for row, w in zip(TO_XYZ, WHITE)]
    f = [F.when(t > EPSILON, F.pow(t, F.lit(1 / 3))).otherwise((KAPPA * t + 16) / 116) for t in xyz]
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def lab_to_rgb(lightness: Column, a: Column, b: Column) -> list[Column]:
    fy = (lightness + 16) / 116
    f = [fy + a / 500, fy, fy - b / 200]
    xyz = [F.when(F.pow(t, F.lit(3.0)) > EPSILON, F.pow(t, F.lit(3.0))).otherwise((116 * t - 16) / KAPPA) * w for t, w in zip(f, WHITE)]
    linear = [sum((m * c for m, c in zip(row, xyz)), F.lit(0.0)) for row in FROM_XYZ]
    return [255 * F.when(c <= 0.0031308, 12.92 * c).otherwise(1.055 * F.pow(F.greatest(c, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055) for c in linear]
