"""Measures of images, one row an image: histograms, scopes, sharpness, colours, automatic settings.

Grey images have ``luma`` (0..255, row by row), colour images ``pixels`` (r, g, b in 0..1, row by row),
both with ``width`` and ``height``.  Helpers take one image as an array; Spark hands out the rows, a few
at a time, and pixels go no further than the task that reads them.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import configured

LUMA = np.array([0.2126, 0.7152, 0.0722])


def per_image(images: DataFrame, key: str, column: str, helper: Callable, schema: str) -> DataFrame:
    """key, then what ``helper(array, width, height)`` gives: a tuple a row of output, any number an image."""
    configured(images.sparkSession)
    kinds = [f.dataType.simpleString() for f in images.sparkSession.createDataFrame([], schema).schema]
    arrow = {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "float": pa.float32(), "array<double>": pa.list_(pa.float64()), "array<bigint>": pa.list_(pa.int64()), "array<float>": pa.list_(pa.float32())}
    names = [f.name for f in images.sparkSession.createDataFrame([], schema).schema]
    key_type = images.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out = [], []
            for k, w, h, values in zip(*(batch.column(i) for i in range(4)), strict=True):
                rows = helper(values.values.to_numpy(zero_copy_only=False), w.as_py(), h.as_py()) if values.is_valid else []
                out += rows
                keys += [k.as_py()] * len(rows)
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow[key_type]), *(pa.array(c, arrow[t]) for c, t in zip(columns, kinds, strict=True))], [key, *names])

    return images.select(key, "width", "height", column).mapInArrow(run, f"{key} {key_type}, {schema}")


def rgb8(pixels: np.ndarray) -> np.ndarray:
    return (np.clip(pixels.reshape(-1, 3), 0, 1) * 255).astype(np.int64)


def luma8(rgb: np.ndarray) -> np.ndarray:
    return np.minimum((rgb @ np.array([218, 732, 74])) >> 10, 255)


def _bins(pixels: np.ndarray, _w: int, _h: int) -> list[tuple]:
    even = rgb8(pixels)[::2]
    channels = [*even.T, luma8(even)]
    counts = [np.bincount(c, minlength=256) for c in channels]
    return [(name, int(b), int(n[b])) for name, n in zip(("red", "green", "blue", "luma"), counts, strict=True) for b in np.flatnonzero(n)]


def histogram_bins(images: DataFrame, key: str = "path") -> DataFrame:
    """key, channel, bin and n over every second pixel."""
    return per_image(images, key, "pixels", _bins, "channel string, bin int, n bigint")


def library_histogram(images: DataFrame, by: str = "folder", key: str = "path") -> DataFrame:
    """Sums of bins over many images; bins, not pixels, are shuffled."""
    bins = histogram_bins(images, key).join(images.select(key, by), key) if by != key else histogram_bins(images, key)
    return bins.groupBy(by, "channel", "bin").agg(F.sum("n").alias("n"))


def smoothed(counts: np.ndarray, sigma: float = 2.0) -> np.ndarray:
    """Gauss of radius 6 with repeated ends, scaled by the value at 99% of the sorted bins, 1 at most."""
    at = np.arange(-6, 7)
    kernel = np.exp(-(at**2) / (2 * sigma * sigma))
    out = np.convolve(np.pad(counts.astype(float), 6, mode="edge"), kernel / kernel.sum(), mode="valid")
    top = np.sort(out)[round(255 * 0.99)]
    return np.minimum(out / top, 1) if top > 1e-6 else np.zeros(256)


def histogram(images: DataFrame, key: str = "path") -> DataFrame:
    """key, channel and 256 smoothed values."""

    def helper(pixels: np.ndarray, _w: int, _h: int) -> list[tuple]:
        even = rgb8(pixels)[::2]
        return [(name, smoothed(np.bincount(c, minlength=256)).tolist()) for name, c in zip(("red", "green", "blue", "luma"), [*even.T, luma8(even)], strict=True)]

    return per_image(images, key, "pixels", helper, "channel string, bins array<double>")


def _scopes(pixels: np.ndarray, w: int, h: int) -> list[tuple]:
    rgb = rgb8(pixels)
    x = np.arange(len(rgb)) % w
    column = np.minimum((x * np.float32(256 / w)).astype(int), 255)
    strip = (x / w * 82).astype(int) % 82
    cb, cr = 0.836 * (rgb @ np.array([-0.1146, -0.3854, 0.5])), 0.836 * (rgb @ np.array([0.5, -0.4542, -0.0458]))
    far = np.maximum(np.sqrt(cb * cb + cr * cr) / 127, 1)
    # six digits, so that whole numbers don't depend on the order of sums
    vx, vy = (np.clip(np.round(v, 6), 0, 255).astype(int) for v in (cb / far + 128, 128 - cr / far))
    places = [(name, 255 - c, column) for name, c in zip(("red", "green", "blue"), rgb.T, strict=True)] + [("luma", 255 - luma8(rgb), column)]
    places += [("parade", np.concatenate([255 - c for c in rgb.T]), np.concatenate([strip, 87 + strip, 174 + strip])), ("vectorscope", vy, vx)]
    out = []
    for name, y, at in places:
        cell, n = np.unique(y * 256 + at, return_counts=True)
        out += [(name, int(c) // 256, int(c) % 256, int(k)) for c, k in zip(cell, n, strict=True)]
    return out


def waveform(images: DataFrame, channel: str | None = None, key: str = "path") -> DataFrame:
    """key, kind, y, x and n: the cells of 256x256 scopes that aren't empty."""
    rows = per_image(images, key, "pixels", _scopes, "kind string, y int, x int, n bigint")
    kinds = {None: None, "rgb": ["red", "green", "blue", "luma"], "luma": ["luma"], "parade": ["parade"], "vectorscope": ["vectorscope"]}[channel]
    return rows if kinds is None else rows.where(F.col("kind").isin(*kinds))


def laplacian_variance(grey: np.ndarray) -> float:
    if min(grey.shape) < 3:
        return 0.0
    g = grey.astype(np.int64)
    lap = g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]
    return float(lap.var())


def exposure_value(grey: np.ndarray) -> float:
    n = grey.size
    return max(0.0, 1 - 5 * float((grey < 5).sum() + (grey >= 250).sum()) / n) if n else 0.0


def _focus(luma: np.ndarray, w: int, h: int) -> list[tuple]:
    grey = luma.reshape(h, w)
    return [(laplacian_variance(grey), laplacian_variance(grey[h // 4 : h // 4 + h // 2, w // 4 : w // 4 + w // 2]), exposure_value(grey))]


def focus_measures(images: DataFrame, key: str = "img_id") -> DataFrame:
    """key, sharpness, center_focus and exposure of grey images, in one pass."""
    return per_image(images, key, "luma", _focus, "sharpness double, center_focus double, exposure double")


def sharpness(images: DataFrame, key: str = "img_id") -> DataFrame:
    return focus_measures(images, key).select(key, "sharpness")


def center_focus(images: DataFrame, key: str = "img_id") -> DataFrame:
    return focus_measures(images, key).select(key, "center_focus")


def exposure_metric(images: DataFrame, key: str = "img_id") -> DataFrame:
    return focus_measures(images, key).select(key, "exposure")


def quality_score(sharp: Column, center: Column, exposed: Column) -> Column:
    scaled = lambda v: F.least(F.lit(1.0), F.log10(v + 1) / 3.5)
    return 0.40 * scaled(sharp) + 0.35 * scaled(center) + 0.25 * exposed


def color_names(rgb: np.ndarray) -> np.ndarray:
    """Name of the colour of each 8-bit pixel, by hue, saturation and value."""
    r, g, b = rgb.astype(float).T
    top, low = rgb.max(1).astype(float), rgb.min(1)
    delta = top - low
    safe = np.where(delta > 0, delta, 1)
    hue = 60 * np.where(top == r, np.where(g >= b, (g - b) / safe, (g - b) / safe + 6), np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4))
    hue = np.where(delta > 0, hue, 0)
    s, v = np.where(top > 0, delta / np.where(top > 0, top, 1), 0), top / 255
    bands = np.array(["red", "orange", "yellow", "green", "blue", "purple", "red"])[np.digitize(hue, [20, 45, 70, 160, 260, 340])]
    named = np.where(np.isin(bands, ["red", "orange"]) & (v < 0.6) & (s < 0.7), "brown", bands)
    return np.where(v < 0.2, "black", np.where(s < 0.1, np.where(v > 0.8, "white", "gray"), named))


def color_tags(images: DataFrame, key: str = "path") -> DataFrame:
    """key, tag and place: the two commonest colours, or the commonest neutral if there is no colour; ties by name."""

    def helper(pixels: np.ndarray, _w: int, _h: int) -> list[tuple]:
        names, n = np.unique(color_names(rgb8(pixels)), return_counts=True)
        ranked = [str(names[k]) for k in np.lexsort((names, -n))]
        bright = [x for x in ranked if x not in ("black", "white", "gray")][:2]
        return [(tag, k) for k, tag in enumerate(bright or ranked[:1], 1)]

    return per_image(images, key, "pixels", helper, "tag string, place int")


def white_balance_gains(temperature: np.ndarray, tint: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    t, n = temperature / 25, tint / 100
    return (1 + 0.2 * t) * (1 + 0.25 * n), (1 + 0.05 * t) * (1 - 0.25 * n), (1 - 0.2 * t) * (1 + 0.25 * n)


_GRID = np.arange(-85, 86)
_T, _N = (a.ravel() for a in np.meshgrid(_GRID, _GRID, indexing="ij"))
with np.errstate(invalid="ignore"):
    _R, _G, _B = white_balance_gains(_T.astype(float), _N.astype(float))
    _RED_LOG, _BLUE_LOG = np.log(_R / _G), np.log(_B / _G)


def auto_white_balance_of(rgb: np.ndarray) -> tuple[float, float]:
    """Temperature and tint that make the least saturated third of the pixels neutral."""
    c = rgb / 255.0
    top, low, luma = c.max(1), c.min(1), c @ LUMA
    c, luma, top, low = (a[(luma >= 0.08) & (top <= 0.98) & (low > 0)] for a in (c, luma, top, low))
    if len(c) < 16:
        return 0.0, 0.0
    s = (top - low) / np.maximum(top, 1e-6)
    counts = np.bincount(np.floor(s * 255 + 0.5).astype(int), minlength=256).cumsum()
    limit = min(max(float(np.argmax(counts >= np.ceil(len(c) * 0.35))) / 255, 0.08), 0.72)
    own = s <= limit
    if not own.any():
        return 0.0, 0.0
    weight = (1 - s[own]) ** 3 * np.clip(luma[own] / 0.6, 0.2, 1)
    if weight.sum() <= 1e-6:
        return 0.0, 0.0
    ratio = lambda k: float(np.clip((np.log(c[own, 1] / np.maximum(c[own, k], 1 / 255)) * weight).sum() / weight.sum(), -1, 1))
    best = int(np.nanargmin((_RED_LOG - ratio(0)) ** 2 + (_BLUE_LOG - ratio(2)) ** 2))
    return float(_T[best]), float(_N[best])


def auto_white_balance(images: DataFrame, key: str = "path") -> DataFrame:
    return per_image(images, key, "pixels", lambda p, _w, _h: [auto_white_balance_of(rgb8(p))], "temperature double, tint double")


def _percentile(counts: np.ndarray, share: float) -> int:
    return int(np.argmax(counts.cumsum() >= int(counts.sum() * share)))


def auto_settings(pixels: np.ndarray, w: int, h: int) -> dict[str, float]:
    """Slider values from the distribution of luma, saturation, and centre against edge."""
    rgb = rgb8(pixels)
    n = len(rgb)
    # six digits, so that halves don't depend on the order of sums
    luma = np.round(rgb @ LUMA, 6)
    counts = np.bincount(np.minimum(np.floor(luma + 0.5).astype(int), 255), minlength=256)
    top, low = rgb.max(1), rgb.min(1)
    saturation = float(np.where(top > 0, (top - low) / np.maximum(top, 1), 0).mean())
    x, y = np.arange(n) % w, np.arange(n) // w
    middle = (x >= int(w * 0.25)) & (x < int(w * 0.75)) & (y >= int(h * 0.25)) & (y < int(h * 0.75))
    p1, p50, p99 = (_percentile(counts, s) for s in (0.01, 0.5, 0.99))
    spread = max(1.0, float(p99 - p1))
    bright, clipped, dark = counts[240:].sum() / n, counts[250:].sum() / n, counts[:32].sum() / n
    exposure = (128.0 - p50) * 0.125
    if p99 > 245 or bright > 0.02 or clipped > 0.005:
        exposure = min(exposure, 0.0)
    exposure = min(exposure, 250.0 - p99)
    contrast = (220 / spread - 1) * 10 * (0.5 if bright > 0.02 else 1) if spread < 220 else 0.0
    ahead = float(luma[middle].mean() - luma[~middle].mean()) / 255 if middle.any() and (~middle).any() else 0.0
    shifted = np.clip((luma + exposure - 128) * (1 + contrast / 100) + 128, 0, 255)
    after = np.bincount(np.floor(shifted + 0.5).astype(int), minlength=256)
    a1, a50, a99 = (_percentile(after, s) for s in (0.01, 0.5, 0.99))
    temperature, tint = auto_white_balance_of(rgb)
    raw = {
        "exposure": exposure / 20, "brightness": (128 - a50) * 0.007, "contrast": contrast, "highlights": -min(bright * 120, 70.0) if bright > 0.02 else 0.0,
        "shadows": min(dark * 40, 50.0) if dark > 0.05 else 0.0, "vibrance": (0.2 - saturation) * 120 if saturation < 0.2 else 0.0, "vignetteAmount": -ahead * 100 if ahead > 0 else 0.0,
        "temperature": temperature, "tint": tint, "dehaze": (1 - spread / 120) * 35 if spread < 120 and saturation < 0.15 else 0.0, "clarity": (1 - spread / 180) * 50 if spread < 180 else 0.0,
        "centré": min(ahead * 100, 60.0) if ahead > 0.05 else 0.0, "whites": (a99 - 255) * 0.2, "blacks": -a1 * 0.5,
    }
    return {k: float(np.clip(v, -5, 5) if k in ("exposure", "brightness") else np.clip(v, -100, 100)) for k, v in raw.items()}


def auto_adjust(images: DataFrame, key: str = "path") -> DataFrame:
    """key and a long table of setting and value, from images of at most 1024 pixels a side (see downscale)."""
    return per_image(images, key, "pixels", lambda p, w, h: list(auto_settings(p, w, h).items()), "setting string, value double")


def auto_patch(images: DataFrame, key: str = "path") -> DataFrame:
    """key and patch: the automatic settings as adjustments in JSON text, for apply_auto."""
    long = auto_adjust(images, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("setting", F.col("value").cast("string")))).alias("patch"))
    extra = F.create_map(F.lit("whiteBalanceMode"), F.lit('"auto"'), F.lit("sectionVisibility"), F.lit(json.dumps({"basic": True, "color": True, "effects": True})))
    return long.withColumn("patch", F.map_concat("patch", extra))


def double_gradient_words(grey: np.ndarray) -> list[int]:
    """Bits of each cell against its right and its lower neighbour, in signed 64-bit words."""
    bits = np.concatenate([(grey[:, :-1] > grey[:, 1:]).ravel(), (grey[:-1] > grey[1:]).ravel()])
    padded = np.zeros(-(-len(bits) // 64) * 64, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view("<i8").tolist()


def double_gradient_hash(images: DataFrame, key: str = "img_id", size: int = 8) -> DataFrame:
    """key and words; images larger than ``size`` are averaged down to that grid."""

    def helper(luma: np.ndarray, w: int, h: int) -> list[tuple]:
        grey = luma.reshape(h, w).astype(float)
        if (h, w) != (size, size):
            rows, columns = np.linspace(0, h, size + 1).astype(int), np.linspace(0, w, size + 1).astype(int)
            grey = np.array([[grey[a : max(b, a + 1), c : max(d, c + 1)].mean() for c, d in zip(columns, columns[1:], strict=False)] for a, b in zip(rows, rows[1:], strict=False)])
        return [(double_gradient_words(grey),)]

    return per_image(images, key, "luma", helper, "words array<bigint>")


def blurry(measures: DataFrame, threshold: float = 100.0) -> DataFrame:
    return measures.where(F.col("sharpness") < threshold).orderBy("sharpness")


def ranked_quality(measures: DataFrame, group: str, order: str) -> DataFrame:
    return measures.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("quality"), order)))
