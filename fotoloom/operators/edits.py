"""Edit documents in bulk: patches, presets, fingerprints, virtual copies.

Adjustments are maps from name to JSON text, so values of any kind merge by name without being
understood; numbers are read where a rule needs them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAP = "map<string,string>"

# Sections of the editor, their keys, and the legacy name of a section.
SECTIONS = {
    "basic": ("basic", "exposure brightness contrast highlights shadows whites blacks"),
    "color": ("color", "saturation temperature tint vibrance"),
    "colorMixer": ("color", "hue"),
    "calibration": ("color", "shadowsTint redHue greenHue blueHue redSaturation greenSaturation blueSaturation"),
    "details": ("details", "sharpness lumaNoiseReduction colorNoiseReduction sharpnessThreshold"),
    "effects": ("effects", "clarity dehaze structure centré vignetteAmount vignetteMidpoint vignetteRoundness vignetteFeather grainAmount grainSize grainRoughness glowAmount halationAmount flareAmount lutIntensity"),
    "optics": ("details", "chromaticAberrationRedCyan chromaticAberrationBlueYellow transformDistortion lensDistortionAmount lensVignetteAmount lensTcaAmount"),
    "geometry": ("geometry", "transformProjection transformVertical transformHorizontal transformRotate transformAspect transformXOffset transformYOffset transformScale"),
}
# Defaults other than 0.
DEFAULTS = {"sharpnessThreshold": 15.0, "vignetteMidpoint": 50.0, "vignetteFeather": 50.0, "grainSize": 25.0, "grainRoughness": 50.0, "lutIntensity": 100.0, "lensDistortionAmount": 100.0, "lensVignetteAmount": 100.0, "lensTcaAmount": 100.0, "transformScale": 100.0}
# What a slider is divided by before it is used.
SCALES = {"exposure": 0.8, "brightness": 0.8, "contrast": 100.0, "highlights": 120.0, "shadows": 120.0, "whites": 30.0, "blacks": 40.0, "saturation": 100.0, "temperature": 25.0, "tint": 100.0, "vibrance": 100.0, "vignetteAmount": 100.0, "vignetteMidpoint": 100.0, "vignetteRoundness": 100.0, "vignetteFeather": 100.0, "lutIntensity": 100.0}
GEOMETRY = {*SECTIONS["geometry"][1].split(), "transformDistortion", "lensDistortionAmount", "crop", "rotation", "orientationSteps", "flipHorizontal", "flipVertical"}
ALWAYS = ("rotation", "orientationSteps", "crop", "flipHorizontal", "flipVertical", "masks", "aiPatches")


def as_map(json: Column) -> Column:
    """A JSON object as a map from name to JSON text; null for anything else."""
    return F.from_json(json, MAP)


def number(adjustments: Column, key: str) -> Column:
    return F.coalesce(F.element_at(adjustments, key).try_cast("double"), F.lit(DEFAULTS.get(key, 0.0)))


def _visible(adjustments: Column, section: str) -> Column:
    shown = F.from_json(F.element_at(adjustments, "sectionVisibility"), "map<string,boolean>")
    legacy = SECTIONS[section][0]
    return F.coalesce(F.element_at(shown, section), F.element_at(shown, legacy), F.lit(True))


def is_edited(adjustments: Column) -> Column:
    """Whether a document changes the picture; a hidden section counts as unchanged."""
    has = lambda key: ~F.coalesce(F.element_at(adjustments, key), F.lit("[]")).isin("[]", "null", "")
    crop = F.from_json(F.element_at(adjustments, "crop"), "struct<x:double,y:double>")
    flags = [F.coalesce(F.element_at(adjustments, k) == "true", F.lit(False)) for k in ("flipHorizontal", "flipVertical")]
    own = [
        has("masks"), has("aiPatches"),
        F.coalesce((F.abs(crop["x"]) > 0.1) | (F.abs(crop["y"]) > 0.1), F.lit(False)),
        number(adjustments, "orientationSteps") != 0, F.abs(number(adjustments, "rotation")) > 0.001, *flags,
    ]
    for section, (_, keys) in SECTIONS.items():
        differs = reduce(lambda a, b: a | b, [number(adjustments, k) != DEFAULTS.get(k, 0.0) for k in keys.split()])
        own.append(_visible(adjustments, section) & differs)
    return F.coalesce(reduce(lambda a, b: a | b, own), F.lit(False))


def normalize_adjustments(adjustments: Column, defaults: dict[str, str] | None = None) -> Column:
    """Fills in defaults, splits legacy sections, and says how white balance was set."""
    base = {k: str(DEFAULTS.get(k, 0.0)) for _, keys in SECTIONS.values() for k in keys.split()} | (defaults or {})
    filled = F.map_concat(F.create_map(*[F.lit(x) for kv in sorted(base.items()) for x in kv]), F.coalesce(adjustments, F.create_map().cast(MAP)))
    shown = F.coalesce(F.from_json(F.element_at(adjustments, "sectionVisibility"), "map<string,boolean>"), F.create_map().cast("map<string,boolean>"))
    sections = F.create_map(*[x for s, (legacy, _) in SECTIONS.items() for x in (F.lit(s), F.coalesce(F.element_at(shown, s), F.element_at(shown, legacy), F.lit(True)))])
    custom = (number(adjustments, "temperature") != 0) | (number(adjustments, "tint") != 0)
    mode = F.coalesce(F.element_at(adjustments, "whiteBalanceMode"), F.when(custom, "custom").otherwise("asShot"))
    return F.map_concat(filled, F.create_map(F.lit("sectionVisibility"), F.to_json(sections), F.lit("whiteBalanceMode"), mode))


def legacy_temperature(kelvin: Column) -> Column:
    """Slider value of a colour temperature in an old document; halves go up."""
    return F.greatest(F.lit(-100.0), F.least(F.lit(100.0), F.floor((kelvin - 5500) / 35 + 0.5).cast("double")))


def legacy_kelvin(temperature: Column) -> Column:
    return temperature * 35 + 5500


def legacy_curve(points: Column) -> Column:
    """Curve points of 0..1 on 0..255, sorted by x; points are structs x, y."""
    return F.array_sort(F.transform(points, lambda p: F.struct((p["x"] * 255).alias("x"), (p["y"] * 255).alias("y"))))


def fingerprint(adjustments: Column, kind: str = "full") -> Column:
    """Hash of what matters: geometry, visual (all else), transform (crop, rotation, flips) or full."""
    transform = {"crop", "rotation", "orientationSteps", "flipHorizontal", "flipVertical"}
    keep = {"geometry": lambda k, _: k.isin(*sorted(GEOMETRY - transform)), "transform": lambda k, _: k.isin(*sorted(transform)), "visual": lambda k, _: ~k.isin(*sorted(GEOMETRY)), "full": lambda k, _: F.lit(True)}[kind]
    entries = F.array_sort(F.map_entries(F.map_filter(adjustments, keep)))
    return F.xxhash64(F.to_json(entries))


def thumbnail_key(path: Column, modified: Column, adjustments: Column) -> Column:
    return F.sha2(F.concat_ws("\0", path, modified.cast("string"), F.coalesce(adjustments, F.lit(""))), 256)


def apply_adjustments(documents: DataFrame, targets: DataFrame, patch: dict[str, str]) -> DataFrame:
    """Shallow merge of a patch, whose values win; a document without adjustments starts empty."""
    new = F.create_map(*[F.lit(x) for kv in patch.items() for x in kv]).cast(MAP) if patch else F.create_map().cast(MAP)
    hit = documents.join(targets.select("path").distinct().withColumn("_hit", F.lit(True)), "path", "left")
    merged = F.map_concat(F.coalesce("adjustments", F.create_map().cast(MAP)), new)
    return hit.withColumn("adjustments", F.when(F.col("_hit").isNotNull(), merged).otherwise(F.col("adjustments"))).select(*documents.columns)


def reset_adjustments(documents: DataFrame, targets: DataFrame) -> DataFrame:
    hit = documents.join(targets.select("path").distinct().withColumn("_hit", F.lit(True)), "path", "left")
    return hit.withColumn("adjustments", F.when(F.col("_hit").isNotNull(), F.create_map().cast(MAP)).otherwise(F.col("adjustments"))).select(*documents.columns)


def apply_auto(documents: DataFrame, auto: DataFrame) -> DataFrame:
    """Merges results of auto_adjust by path; sectionVisibility is merged one level deeper, brightness is left out."""
    joined = documents.join(auto.select("path", F.map_filter("patch", lambda k, _: k != "brightness").alias("_p")), "path", "left")
    base = F.coalesce("adjustments", F.create_map().cast(MAP))
    deep = lambda m: F.from_json(F.element_at(m, "sectionVisibility"), "map<string,boolean>")
    shown = F.when(deep(base).isNotNull() & deep(F.col("_p")).isNotNull(), F.to_json(F.map_concat(deep(base), deep(F.col("_p")))))
    merged = F.map_concat(base, F.col("_p"))
    merged = F.when(shown.isNull(), merged).otherwise(F.map_concat(merged, F.create_map(F.lit("sectionVisibility"), shown)))
    return joined.withColumn("adjustments", F.when(F.col("_p").isNull(), F.col("adjustments")).otherwise(merged)).select(*documents.columns)


def copyable_keys() -> list[str]:
    return sorted({k for _, keys in SECTIONS.values() for k in keys.split()} | {"curves", "hsl", "colorGrading", "lensMaker", "lensModel", "lutPath", "masks", "crop", "rotation"})


def copy_settings(adjustments: Column) -> Column:
    return F.map_filter(adjustments, lambda k, _: k.isin(*copyable_keys()))


def paste_settings(documents: DataFrame, targets: DataFrame, copied: dict[str, str], included: list[str], mode: str = "merge") -> DataFrame:
    """replace: all included values; merge: only those that differ from the default."""
    chosen = {k: v for k, v in copied.items() if k in included}
    if mode == "merge":
        chosen = {k: v for k, v in chosen.items() if v not in (str(DEFAULTS.get(k, 0.0)), f"{DEFAULTS.get(k, 0.0):g}", "null", "[]")}
    if "lensMaker" in chosen and chosen["lensMaker"] in ("", "null", '""'):
        chosen |= {"lensDistortionParams": "null"}
    return apply_adjustments(documents, targets, chosen)


def create_virtual_copies(documents: DataFrame, targets: DataFrame, salt: str) -> DataFrame:
    """Adds, for each target, a copy of its document under a new id that path and salt decide."""
    new = documents.join(targets.select("path").distinct(), "path", "left_semi")
    fresh = F.substring(F.sha2(F.concat(F.col("path"), F.lit(salt)), 256), 1, 6)
    new = new.withColumn("copy_id", fresh).withColumn("path", F.concat(F.col("source_path"), F.lit("?vc="), fresh))
    return documents.unionByName(new)


def move_sidecars(sidecars: DataFrame, renames: DataFrame) -> DataFrame:
    """All documents of a renamed source go with it."""
    joined = sidecars.join(renames.select(F.col("old").alias("source_path"), "new"), "source_path", "left")
    return joined.withColumn("source_path", F.coalesce("new", "source_path")).select(*sidecars.columns)


def copy_sidecars(sidecars: DataFrame, renames: DataFrame) -> DataFrame:
    new = sidecars.join(renames.select(F.col("old").alias("source_path"), "new"), "source_path").withColumn("source_path", F.col("new")).select(*sidecars.columns)
    return sidecars.unionByName(new)
