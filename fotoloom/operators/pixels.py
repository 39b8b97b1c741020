"""Pointwise colour work on many images, one row an image; nothing is shuffled.

Each step is a NumPy function on an (n, 3) array of r, g, b.  ``apply`` runs steps over a table of
images in one pass, ``grade`` joins edit documents to images first and then runs all their steps.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import configured
from .edits import DEFAULTS, SCALES, SECTIONS
from .imaging import LUMA

Step = Callable[[np.ndarray], np.ndarray]


def luma(c: np.ndarray) -> np.ndarray:
    return c @ LUMA


def smoothstep(low: float, high: float, x: np.ndarray) -> np.ndarray:
    t = np.clip((x - low) / (high - low), 0, 1)
    return t * t * (3 - 2 * t)


def mix(a, b, t):
    return a + (b - a) * t


def to_linear(c: np.ndarray) -> np.ndarray:
    c = np.maximum(c, 0)
    return np.where(c <= 0.04045, c / 12.92, ((c + 0.055) / 1.055) ** 2.4)


def to_srgb(c: np.ndarray) -> np.ndarray:
    c = np.clip(c, 0, 1)
    return np.where(c <= 0.0031308, c * 12.92, 1.055 * c ** (1 / 2.4) - 0.055)


def to_hsv(c: np.ndarray) -> np.ndarray:
    top, low = c.max(1), c.min(1)
    d = top - low
    safe = np.where(d > 0, d, 1)
    r, g, b = c.T
    h = np.where(top == r, ((g - b) / safe) % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 60
    return np.stack([np.where(d > 0, h % 360, 0), np.where(top > 0, d / np.where(top > 0, top, 1), 0), top], 1)


def from_hsv(hsv: np.ndarray) -> np.ndarray:
    h, s, v = hsv.T
    k = (np.array([5, 3, 1])[None] + (h / 60)[:, None]) % 6
    return v[:, None] - (v * s)[:, None] * np.clip(np.minimum(k, 4 - k), 0, 1)


def exposure(c: np.ndarray, ev: float) -> np.ndarray:
    return c * 2.0**ev


def white_balance(c: np.ndarray, temp: float, tint: float) -> np.ndarray:
    return c * np.array([1 + 0.2 * temp, 1 + 0.05 * temp, 1 - 0.2 * temp]) * np.array([1 + 0.25 * tint, 1 - 0.25 * tint, 1 + 0.25 * tint])


def brightness(c: np.ndarray, b: float) -> np.ndarray:
    """Rational curve on luma that keeps the ends; colour follows with less strength in the lights."""
    if b == 0:
        return c
    y = luma(c)
    top = 1.06
    base = np.floor(np.abs(y) / top) * top
    part = (np.abs(y) - base) / top
    curved = np.sign(y) * (base + top * part / (part + (1 - part) * 2.0 ** (-0.95 * 1.2 * b))) * 2.0 ** (0.05 * b)
    safe = np.where(np.abs(y) < 1e-5, 1, y)
    chroma = np.maximum(curved / safe, 0) ** mix(0.95, 0.65, np.clip(curved, 0, 2) * 0.5) / (1 + 2 * np.maximum(0, curved - 0.9))
    return np.where((np.abs(y) < 1e-5)[:, None], c, curved[:, None] + (c - y[:, None]) * chroma[:, None])


def whites(c: np.ndarray, w: float) -> np.ndarray:
    return c / max(1 - 0.25 * w, 0.01)


def contrast(c: np.ndarray, strength: float) -> np.ndarray:
    """S-curve around the middle of a 2.2 gamma; values over 1 stay."""
    if strength == 0:
        return c
    safe = np.maximum(c, 0)
    p, power = np.clip(safe ** (1 / 2.2), 0, 1), 2.0 ** (1.25 * strength)
    curved = np.where(p < 0.5, 0.5 * (2 * p) ** power, 1 - 0.5 * (2 * (1 - p)) ** power) ** 2.2
    return mix(curved, c, smoothstep(1.0, 1.01, safe))


def calibration(c: np.ndarray, hue: tuple = (0, 0, 0), saturation: tuple = (0, 0, 0), shadows_tint: float = 0.0) -> np.ndarray:
    """Turns the primaries, scales their saturation, and tints the shadows."""
    up, down, keep = np.maximum(hue, 0), np.maximum(np.negative(hue), 0), 1 - np.abs(hue)
    columns = np.array([[keep[0], up[0], down[0]], [down[1], keep[1], up[1]], [up[2], down[2], keep[2]]])
    c = c @ columns
    y, total = luma(np.maximum(c, 0))[:, None], c.sum(1, keepdims=True)
    share = np.where(total > 0.001, c / np.where(total > 0.001, total, 1), 0)
    c = c + (c - y) * (share @ np.asarray(saturation, float))[:, None]
    if abs(shadows_tint) > 0.001:
        mask = 1 - smoothstep(0.0, 0.3, luma(np.maximum(c, 0)))[:, None]
        t = 0.25 * shadows_tint
        c = mix(c, c * np.array([1 + t, 1 - t, 1 + t]), mask)
    return c


def saturation_vibrance(c: np.ndarray, s: float, v: float) -> np.ndarray:
    """Even saturation, and vibrance that spares what is vivid already and skin."""
    y = luma(c)[:, None]
    c = mix(y, c, 1 + s) if s else c
    if not v:
        return c
    top, low = c.max(1), c.min(1)
    vivid = (top - low) / np.maximum(top, 0.001)
    if v > 0:
        away = np.abs(to_hsv(c)[:, 0] - 25.0)
        skin = 1 - smoothstep(10.0, 35.0, np.minimum(away, 360 - away))
        amount = 3 * v * (1 - smoothstep(0.4, 0.9, vivid)) * mix(1.0, 0.6, skin)
    else:
        amount = v * (1 - smoothstep(0.2, 0.8, vivid))
    return np.where((top - low < 0.02)[:, None], c, mix(y, c, 1 + amount[:, None]))


def hue_shift(c: np.ndarray, degrees: float) -> np.ndarray:
    if abs(degrees) < 0.01:
        return c
    hsv = to_hsv(to_srgb(c))
    hsv[:, 0] = (hsv[:, 0] + degrees) % 360
    return to_linear(from_hsv(hsv))


# Centre and width, in degrees, of the bands of the mixer.
HSL_BANDS = {"reds": (358.0, 35.0), "oranges": (25.0, 45.0), "yellows": (60.0, 40.0), "greens": (115.0, 90.0), "aquas": (180.0, 60.0), "blues": (225.0, 60.0), "purples": (280.0, 55.0), "magentas": (330.0, 50.0)}
# How strongly saturation and luminance of each wheel act.
WHEELS = {"shadows": (0.1, 0.5), "midtones": (0.6, 0.8), "highlights": (0.8, 1.0), "global": (1.0, 1.0)}


def hsl_mixer(c: np.ndarray, bands: dict[str, tuple[float, float, float]]) -> np.ndarray:
    """bands: by name hue, saturation and luminance; a pixel takes from all bands by nearness of hue."""
    c = np.maximum(c, 0)
    hsv, y = to_hsv(c), luma(c)
    away = np.abs(hsv[:, :1] - np.array([b[0] for b in HSL_BANDS.values()]))
    away = np.minimum(away, 360 - away)
    near = np.exp(-1.5 * (away / (0.5 * np.array([b[1] for b in HSL_BANDS.values()]))) ** 2)
    near /= near.sum(1, keepdims=True)
    hue, sat, lum = (near @ np.array([bands.get(n, (0, 0, 0))[k] for n in HSL_BANDS]) for k in range(3))
    strong, weight = smoothstep(0.05, 0.20, hsv[:, 1]), smoothstep(0.0, 1.0, hsv[:, 1])
    target = y * (1 + lum * weight)
    turned = np.stack([(hsv[:, 0] + 2 * hue * strong) % 360, np.clip(hsv[:, 1] * (1 + sat * strong), 0, 1), hsv[:, 2]], 1)
    mixed = from_hsv(turned)
    own = luma(mixed)
    grey = (hsv[:, 1] * (1 + sat * strong) < 0.0001) | (own < 0.0001)
    out = np.where(grey[:, None], np.maximum(target, 0)[:, None], mixed * (target / np.where(own > 0, own, 1))[:, None])
    still = (np.abs(c[:, 0] - c[:, 1]) < 0.001) & (np.abs(c[:, 1] - c[:, 2]) < 0.001) | (strong < 0.001) & (weight < 0.001)
    return np.where(still[:, None], c, out)


def color_grade(c: np.ndarray, wheels: dict[str, tuple[float, float, float]], blending: float = 0.5, balance: float = 0.0) -> np.ndarray:
    """wheels: by range hue, saturation and luminance."""
    y = luma(np.maximum(c, 0))
    high = 0.5 - 0.5 * max(0.0, balance)
    low = min(0.1 + 0.5 * max(0.0, -balance), high - 0.01)
    feather = max(0.2 * blending, 1e-6)
    dark, light = 1 - smoothstep(low - feather, low + feather, y), smoothstep(high - feather, high + feather, y)
    masks = {"shadows": dark, "midtones": np.maximum(0, 1 - dark - light), "highlights": light, "global": np.ones_like(y)}
    for name, (hue, s, lum) in wheels.items():
        by_s, by_l = WHEELS[name]
        if s > 0.001:
            c = c + (from_hsv(np.array([[hue, 1.0, 1.0]])) - 0.5) * s * by_s * masks[name][:, None]
        c = c + (lum * by_l * masks[name])[:, None]
    return c


def curve(x: np.ndarray, points: list[tuple[float, float]]) -> np.ndarray:
    """Monotone cubic through points on 0..255, for values 0..1."""
    if len(points) < 2:
        return x
    px, py = (np.array(v, float) for v in zip(*points[:16], strict=True))
    slope = np.diff(py) / np.maximum(np.diff(px), 0.001)
    tangent = np.concatenate([[slope[0]], np.where(slope[:-1] * slope[1:] <= 0, 0, (slope[:-1] + slope[1:]) / 2), [slope[-1]]])
    k = np.clip(np.searchsorted(px, x * 255, side="left") - 1, 0, len(px) - 2)
    m1, m2, s = tangent[k], tangent[k + 1], slope[k]
    steep = np.hypot(m1, m2) > 3 * np.abs(s)
    shrink = np.where(steep & (s != 0), 3 * np.abs(s) / np.maximum(np.hypot(m1, m2), 1e-12), 1)
    width = px[k + 1] - px[k]
    t = np.clip((x * 255 - px[k]) / np.where(width > 0, width, 1), 0, 1)
    y = (2 * t**3 - 3 * t**2 + 1) * py[k] + (t**3 - 2 * t**2 + t) * m1 * shrink * width + (3 * t**2 - 2 * t**3) * py[k + 1] + (t**3 - t**2) * m2 * shrink * width
    y = np.where(x * 255 <= px[0], py[0], np.where(x * 255 >= px[-1], py[-1], np.clip(y, 0, 255)))
    return y / 255


def _straight(points) -> bool:
    return len(points) >= 2 and all(abs(x - y) <= 0.5 for x, y in points) and abs(points[0][0]) < 0.1 and abs(points[-1][0] - 255) < 0.1


LINE = [(0.0, 0.0), (255.0, 255.0)]


def tone_curve(c: np.ndarray, luma_points=LINE, red=LINE, green=LINE, blue=LINE) -> np.ndarray:
    """The luma curve on each channel; with channel curves, those first and then luma set to what its curve wants."""
    if all(map(_straight, (red, green, blue))):
        return curve(c, luma_points)
    graded = np.stack([curve(c[:, k], p) for k, p in enumerate((red, green, blue))], 1)
    want = curve(luma(c), luma_points)[:, None]
    out = graded + want - luma(graded)[:, None]
    low = out.min(1, keepdims=True)
    out = np.where(low < 0, want + (out - want) * want / np.maximum(want - low, 1e-6), out)
    top = out.max(1, keepdims=True)
    out = np.where(top > 1, want + (out - want) * (1 - want) / np.maximum(top - want, 1e-6), out)
    return np.clip(out, 0, 1)


def lut_lookup(c: np.ndarray, lut: np.ndarray, intensity: float = 1.0) -> np.ndarray:
    """Tetrahedral lookup in an (n, n, n, 3) table indexed [blue, green, red]; from corner to corner along the sorted fractions."""
    n = lut.shape[0]
    at = np.clip(c, 0, 1) * (n - 1)
    base = np.minimum(np.floor(at).astype(int), n - 1)
    frac = at - base
    order = np.argsort(-frac, axis=1, kind="stable")
    ranked = np.take_along_axis(frac, order, 1)
    corner, rows = base.copy(), np.arange(len(c))
    look = lambda p: lut[p[:, 2], p[:, 1], p[:, 0]]
    out = look(corner) * (1 - ranked[:, :1])
    for k in range(3):
        corner[rows, order[:, k]] = np.minimum(corner[rows, order[:, k]] + 1, n - 1)
        out = out + look(corner) * (ranked[:, k] - (ranked[:, k + 1] if k < 2 else 0))[:, None]
    return mix(c, out, intensity)


def vignette(c: np.ndarray, w: int, h: int, amount: float, mid: float = 0.5, round_: float = 0.0, feather: float = 0.5) -> np.ndarray:
    if not amount:
        return c
    x, y = np.arange(len(c)) % w, np.arange(len(c)) // w
    u = (np.stack([x / w, y / h], 1) - 0.5) * 2
    u = np.sign(u) * np.abs(u) ** (1 - round_)
    d = np.hypot(u[:, 0], u[:, 1] * h / w) * 0.5
    mask = smoothstep(mid - feather * 0.5 - 1e-9, mid + feather * 0.5 + 1e-9, d)[:, None]
    return c * (1 + amount * mask) if amount < 0 else mix(c, 1.0, amount * mask)


def tone_map_basic(c: np.ndarray, is_raw: bool) -> np.ndarray:
    s = to_srgb(c)
    if not is_raw:
        return s
    s = s ** (1 / 1.1)
    return mix(s, s * s * (3 - 2 * s), 0.75)


def invert_negative(c: np.ndarray, w: int, h: int, contrast_: float = 1.0, exposure_: float = 0.0, weights=(1.0, 1.0, 1.0)) -> np.ndarray:
    """Density of a negative, stretched between its bounds inside a margin, through a sigmoid, to a positive."""
    density = -np.log10(np.clip(c, 1e-6, 1))
    mx, my = int(w * 0.12), int(h * 0.12)
    step = max(1, (w - 2 * mx) * (h - 2 * my) // 40_000)
    inner = density.reshape(h, w, 3)[my : h - my : 3, mx : w - mx : step].reshape(-1, 3)
    n = len(inner)
    if n:
        low, high = (np.partition(inner, k, axis=0)[k] for k in (min(int(n * 0.001), n - 1), min(int(n * 0.999), n - 1)))
        high = np.where(high <= low + 0.0001, low + 1, high)
    else:
        low, high = np.zeros(3), np.ones(3)
    x = np.maximum((density - low) / (high - low), 0) * np.asarray(weights)
    k, x0 = 4 * max(contrast_, 0.1), 0.6 - exposure_ * 0.25
    bend = lambda v: 1 / (1 + np.exp(-k * (v - x0)))
    out = np.clip((bend(x) - bend(0.0)) / (bend(1.0) - bend(0.0)), 0, 1)
    over = np.clip((out.max(1, keepdims=True) - 0.9) * 10, 0, 1) ** 2
    return np.clip(mix(out, luma(out)[:, None], over), 0, 1) ** (1 / 2.2)


def range_mask_values(c: np.ndarray, target: tuple, tolerance: float, by: str = "color") -> np.ndarray:
    """255 at the target, falling evenly to 0 at the tolerance (0..100) in colour distance or in luma."""
    reach = max(tolerance * 2.55, 1.0) * (np.sqrt(3) if by == "color" else 1.0)
    aim = np.asarray(target, float)
    away = 255 * (np.linalg.norm(c - aim, axis=1) if by == "color" else np.abs(luma(c) - luma(aim)))
    return (255 * np.maximum(0, 1 - away / reach)).astype(np.int32)


def apply(images: DataFrame, step: Callable[..., np.ndarray], with_size: bool = False, column: str = "pixels", kind: str = "array<float>") -> DataFrame:
    """``images`` with what the step makes of the pixels, in their place or as another column instead of them."""
    configured(images.sparkSession)
    rest = [c for c in images.columns if c not in ("pixels", column)]
    arrow = pa.list_(pa.float32()) if kind == "array<float>" else pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
            out = []
            for p, w, h in zip(batch.column(at["pixels"]), batch.column(at["width"]).to_pylist(), batch.column(at["height"]).to_pylist(), strict=True):
                c = p.values.to_numpy().astype(np.float64).reshape(-1, 3) if p.is_valid else None
                out.append(None if c is None else np.ravel(step(c, w, h) if with_size else step(c)))
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in rest), pa.array([None if o is None else o.astype(np.float32 if kind == "array<float>" else np.int32) for o in out], arrow)], [*rest, column])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name in rest)
    return images.mapInArrow(run, f"{schema}, {column} {kind}").select(*[c for c in images.columns if c != "pixels" or column == "pixels"], *([column] if column not in images.columns else []))


def downscale(images: DataFrame, max_dim: int) -> DataFrame:
    """Images of at most ``max_dim`` a side, by means of blocks; smaller ones stay as they are."""
    configured(images.sparkSession)
    rest = [c for c in images.columns if c not in ("pixels", "width", "height")]

    def shrink(c: np.ndarray, w: int, h: int) -> tuple[np.ndarray, int, int]:
        scale = min(1.0, max_dim / max(w, h))
        nw, nh = max(1, round(w * scale)), max(1, round(h * scale))
        if (nw, nh) == (w, h):
            return c, w, h
        rows, columns = np.linspace(0, h, nh + 1).astype(int)[:-1], np.linspace(0, w, nw + 1).astype(int)[:-1]
        sums = np.add.reduceat(np.add.reduceat(c.reshape(h, w, 3), rows, axis=0), columns, axis=1)
        size = np.diff(np.append(rows, h))[:, None] * np.diff(np.append(columns, w))[None]
        return sums / size[..., None], nw, nh

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: batch.schema.get_field_index(n) for n in batch.schema.names}
            done = [shrink(p.values.to_numpy().astype(np.float64), w, h) for p, w, h in zip(batch.column(at["pixels"]), batch.column(at["width"]).to_pylist(), batch.column(at["height"]).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(at[n]) for n in rest), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int32()), pa.array([np.ravel(d[0]).astype(np.float32) for d in done], pa.list_(pa.float32()))], [*rest, "width", "height", "pixels"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in images.schema if f.name in rest)
    return images.mapInArrow(run, f"{schema}, width int, height int, pixels array<float>").select(*images.columns)


def combine_masks(masks: DataFrame, key: str = "path") -> DataFrame:
    """key and values: masks (pos, mode, inverted, opacity, values) folded in order by add, subtract or intersect."""
    rows = masks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "mode", "inverted", "opacity", "values"))).alias("m"))
    ready = F.transform("m", lambda m: F.struct(m["mode"].alias("mode"), F.transform(m["values"], lambda v: F.round(F.when(m["inverted"], 255 - v).otherwise(v) * m["opacity"], 0).cast("int")).alias("v")))
    start = F.transform(F.element_at("m", 1)["values"], lambda _: F.lit(0))
    fold = lambda acc, m: F.zip_with(acc, m["v"], lambda a, b: F.when(m["mode"] == "subtract", F.greatest(a - b, F.lit(0))).when(m["mode"] == "intersect", F.least(a, b)).otherwise(F.greatest(a, b)))
    return rows.select(key, F.aggregate(ready, start, fold).alias("values"))


def focus_stack(frames: DataFrame, tile: int = 8) -> DataFrame:
    """stack, y, x and pixels of each tile from the frame that is sharpest there; frames are aligned already.

    Scores go ahead of pixels: the best frame of each (stack, tile) is found from small rows, then the
    winners' pixels alone are joined back.
    """
    configured(frames.sparkSession)
    schema = "stack string, frame int, y int, x int, score double, pixels array<float>"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for stack, frame, w, h, p in zip(*(batch.column(k).to_pylist() if k < 4 else batch.column(k) for k in range(5)), strict=True):
                image = p.values.to_numpy().astype(np.float64).reshape(h, w, 3)
                y = np.pad(image @ LUMA, 1, mode="edge")
                score = np.abs(4 * y[1:-1, 1:-1] - y[:-2, 1:-1] - y[2:, 1:-1] - y[1:-1, :-2] - y[1:-1, 2:])
                for a in range(0, h, tile):
                    for b in range(0, w, tile):
                        out.append((stack, frame, a, b, float(score[a : a + tile, b : b + tile].mean()), np.ravel(image[a : a + tile, b : b + tile]).astype(np.float32)))
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["stack", "frame", "y", "x", "score", "pixels"])

    tiles = frames.select(F.col("stack").cast("string"), F.col("frame").cast("int"), "width", "height", "pixels").mapInArrow(cut, schema)
    best = tiles.groupBy("stack", "y", "x").agg(F.max_by("frame", F.struct("score", -F.col("frame"))).alias("frame"))
    return tiles.drop("score").join(best, ["stack", "y", "x", "frame"]).select("stack", "y", "x", "frame", "pixels")


def steps_of(document: dict, is_raw: bool, w: int, h: int, lut: np.ndarray | None = None) -> list[Step]:
    """The steps that an edit document asks for, in their order; hidden sections ask for nothing."""
    shown = document.get("sectionVisibility") or {}
    section = {k: s for s, (_, keys) in SECTIONS.items() for k in keys.split()}

    def on(name: str) -> bool:
        return bool(shown.get(name, shown.get(SECTIONS.get(name, (name, ""))[0], True)))

    def v(key: str) -> float:
        base = DEFAULTS.get(key, 0.0)
        raw = document.get(key, base) if on(section.get(key, "basic")) else base
        return float(raw if isinstance(raw, int | float) else base) / SCALES.get(key, 1.0)

    out: list[Step] = []
    add = lambda value, step: out.append(step) if value else None
    if not is_raw:
        out.append(to_linear)
    add(v("exposure"), lambda c: exposure(c, v("exposure")))
    add(v("temperature") or v("tint"), lambda c: white_balance(c, v("temperature"), v("tint")))
    add(v("brightness"), lambda c: brightness(c, v("brightness")))
    add(v("whites"), lambda c: whites(c, v("whites")))
    add(v("contrast"), lambda c: contrast(c, v("contrast")))
    cal = document.get("colorCalibration") or {}
    if cal and on("calibration"):
        out.append(lambda c: calibration(c, tuple(cal.get(k + "Hue", 0) / 400 for k in ("red", "green", "blue")), tuple(cal.get(k + "Saturation", 0) / 120 for k in ("red", "green", "blue")), cal.get("shadowsTint", 0) / 400))
    hsl = document.get("hsl") or {}
    if hsl and on("colorMixer"):
        out.append(lambda c: hsl_mixer(c, {n: (b.get("hue", 0) * 0.3, b.get("saturation", 0) / 100, b.get("luminance", 0) / 100) for n, b in hsl.items()}))
    add(v("hue"), lambda c: hue_shift(c, v("hue")))
    add(v("saturation") or v("vibrance"), lambda c: saturation_vibrance(c, v("saturation"), v("vibrance")))
    wheels = document.get("colorGrading") or {}
    if wheels and on("colorGrading"):
        out.append(lambda c: color_grade(c, {n: (g.get("hue", 0), g.get("saturation", 0) / 500, g.get("luminance", 0) / 500) for n, g in wheels.items() if n in WHEELS}, wheels.get("blending", 50) / 100, wheels.get("balance", 0) / 200))
    add(v("vignetteAmount"), lambda c: vignette(c, w, h, v("vignetteAmount"), v("vignetteMidpoint"), v("vignetteRoundness"), v("vignetteFeather")))
    out.append(lambda c: tone_map_basic(c, is_raw))
    curves = document.get("curves") or {}
    if curves and on("curves"):
        points = {k: [(p["x"], p["y"]) for p in curves.get(k) or []] or LINE for k in ("luma", "red", "green", "blue")}
        out.append(lambda c: tone_curve(c, points["luma"], points["red"], points["green"], points["blue"]))
    if lut is not None and document.get("lutPath") and on("effects"):
        out.append(lambda c: lut_lookup(c, lut, v("lutIntensity")))
    return out


def grade(images: DataFrame, documents: DataFrame, lut: np.ndarray | None = None, key: str = "path") -> DataFrame:
    """``images`` (path, width, height, pixels, is_raw) after their documents (path, doc: JSON of adjustments)."""
    joined = images.join(documents.select(key, F.col("doc").alias("_doc")), key, "left")
    configured(joined.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for w, h, raw, doc, p in zip(*(batch.column(k).to_pylist() if k < 5 else batch.column(k) for k in range(1, 6)), strict=True):
                c = p.values.to_numpy().astype(np.float64).reshape(-1, 3)
                try:
                    document = json.loads(doc) if doc else {}
                except ValueError:
                    document = {}
                for step in steps_of(document if isinstance(document, dict) else {}, bool(raw), w, h, lut):
                    c = step(c)
                out.append(np.ravel(c).astype(np.float32))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(out, pa.list_(pa.float32()))], [key, "width", "height", "is_raw", "pixels"])

    kind = images.schema[key].dataType.simpleString()
    return joined.select(key, "width", "height", "is_raw", "_doc", "pixels").mapInArrow(run, f"{key} {kind}, width int, height int, is_raw boolean, pixels array<float>")


def srgb_to_linear(images: DataFrame) -> DataFrame:
    return apply(images, to_linear)


def linear_to_srgb(images: DataFrame) -> DataFrame:
    return apply(images, to_srgb)


def range_mask(images: DataFrame, target: tuple, tolerance: float, by: str = "color") -> DataFrame:
    return apply(images, lambda c: range_mask_values(c, target, tolerance, by), column="mask", kind="array<int>")
