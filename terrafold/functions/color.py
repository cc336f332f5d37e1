"""Colour and radiometry as column expressions."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stops of the colour ramps, evenly spaced on 0..1.
RAMPS = {
    "depth": [(48, 18, 59), (70, 134, 251), (26, 228, 182), (164, 252, 60), (251, 185, 56), (227, 68, 10), (122, 4, 3)],
    "viridis": [(68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37)],
    "rdylgn": [(165, 0, 38), (253, 174, 97), (255, 255, 191), (166, 217, 106), (0, 104, 55)],
    "rdbu": [(178, 24, 43), (244, 165, 130), (247, 247, 247), (146, 197, 222), (33, 102, 172)],
}


def ramp(t: Column, name: str = "viridis") -> tuple[Column, Column, Column]:
    """Piecewise linear colour at t, clamped to 0..1."""
    stops = RAMPS[name]
    last = len(stops) - 1
    at = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) * last
    k = F.least(F.floor(at), F.lit(last - 1)).cast("int")
    part = at - k
    table = [F.array(*[F.lit(float(s[c])) for s in stops]) for c in range(3)]
    return tuple(F.floor(F.get(a, k) + (F.get(a, k + 1) - F.get(a, k)) * part + 0.5).cast("int") for a in table)


def srgb_to_linear(v: Column) -> Column:
    """0..255 to linear 0..1."""
    c = v / 255.0
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4))


def linear_to_srgb(v: Column) -> Column:
    return 255.0 * F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, 1 / 2.4) - 0.055)


def excess_green(r: Column, g: Column, b: Column) -> Column:
    total = r + g + b
    return F.when(total == 0, 0.0).otherwise((2 * g - r - b) / F.nullif(total, F.lit(0)))


def terrarium(r: Column, g: Column, b: Column) -> Column:
    return r * 256.0 + g + b / 256.0 - 32768.0


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); null where the sum is 0."""
    return (a - b) / F.nullif(a + b, F.lit(0.0))


#: Bands of the usual indices.
INDICES = {"NDVI": ("nir", "red"), "NDRE": ("nir", "rededge"), "GNDVI": ("nir", "green"), "NDWI": ("green", "nir"), "NDSI": ("green", "swir")}


def index(name: str, bands: dict[str, Column]) -> Column:
    a, b = INDICES[name]
    return normalized_difference(bands[a], bands[b])


def stretch(v: Column, low: Column | float, high: Column | float, gamma: float = 1.0) -> Column:
    """Linear stretch to 0..255 with gamma; null stays null."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - low) / F.nullif(high - low, F.lit(0.0))))
    return F.when(v.isNotNull(), F.floor(255 * F.pow(t, F.lit(1 / gamma)) + 0.5).cast("int"))


def radiance(raw: Column, black: float, gain: Column, exposure: Column, a1: float, a2: Column, row: Column, vignette: Column, bits: int = 16) -> Column:
    """Counts to radiance: black level, vignette, row gradient, gain and exposure."""
    return vignette * a1 / gain * ((raw - black) / float(2**bits)) / (exposure + a2 * row - exposure * a2 * row)


def vignette(x: Column, y: Column, cx: float, cy: float, poly: list[float]) -> Column:
    r = F.sqrt((x - cx) ** 2 + (y - cy) ** 2)
    k = F.lit(1.0)
    for p, c in enumerate(poly, 1):
        k = k + c * F.pow(r, p)
    return 1.0 / k


def reflectance_factor(irradiance: Column | None = None, panel_albedo: float | None = None, panel_radiance: Column | None = None) -> Column:
    """pi / E, or albedo / L of a panel."""
    return F.lit(pi) / irradiance if irradiance is not None else F.lit(panel_albedo) / panel_radiance


def multiband(cells, expression):
    """cells with `index` from an expression over its bands; null bands give null."""
    return cells.withColumn("index", expression)
