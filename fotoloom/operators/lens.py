"""Lenses: names to database entries, and correction values by focal length, aperture and distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEAR = 1e-5
DEFAULT_APERTURE, DEFAULT_DISTANCE, DEFAULT_FOCAL = 3.5, 1000.0, 50.0
LEAST_SCORE = 24


def _plain(c: Column) -> Column:
    """Letters and digits in lower case, single blanks between."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def _tokens(c: Column) -> Column:
    return F.filter(F.split(c, " "), lambda t: F.length(t) >= 2)


def _in_order(query: str, name: str) -> str:
    """Characters of the query that occur in the name in the same order, 0 if one of them doesn't: our stand-in for a fuzzy score."""
    step = f"if(s.at < 0, s, if(locate(c, lower({name}), s.at) > 0, named_struct('at', locate(c, lower({name}), s.at) + 1, 'n', s.n + 1), named_struct('at', -1, 'n', 0)))"
    return f"aggregate(filter(split(lower({query}), ''), c -> c <> ''), named_struct('at', 1, 'n', 0), (s, c) -> {step}, s -> s.n)"


def match_lenses(photos: DataFrame, lenses: DataFrame) -> DataFrame:
    """make, lens, lens_id and score of the best entry for each distinct pair of names; of equal scores the last in the list.

    A name is scored against an entry's English name (``model``) and its ``canonical`` one, and the
    better counts.  ``lenses`` is a lens database, which its makers' catalogs bound (some thousand
    rows); ``pos`` is the place in it, else lens_id.  Names of under 3 characters have no match.
    """
    entries = lenses.select("lens_id", "maker", "model", (F.col("canonical") if "canonical" in lenses.columns else F.col("model")).alias("canonical"), (F.col("pos") if "pos" in lenses.columns else F.col("lens_id")).alias("pos"))
    clean = lambda c: F.trim(F.regexp_replace(F.trim(F.col(c)), '^"+|"+$', ""))
    pairs = photos.select("make", "lens").distinct().withColumns({"_make": clean("make"), "_lens": clean("lens")}).where(F.length("_lens") >= 3)
    both = pairs.join(F.broadcast(entries)).withColumns({"_a": F.expr(_in_order("_lens", "model")), "_b": F.expr(_in_order("_lens", "canonical"))})
    both = both.withColumns({"_fuzzy": F.greatest("_a", "_b"), "_own": _plain(F.col("_lens")), "_other": _plain(F.when(F.col("_b") > F.col("_a"), F.col("canonical")).otherwise(F.col("model"))), "_m1": _plain(F.coalesce("_make", F.lit(""))), "_m2": _plain(F.coalesce("maker", F.lit("")))})
    shared = F.filter(_tokens(F.col("_own")), lambda t: F.array_contains(_tokens(F.col("_other")), t))
    inside = F.contains(F.col("_own"), F.col("_other")) | F.contains(F.col("_other"), F.col("_own"))
    makers = (F.col("_m1") != "") & (F.col("_m2") != "") & (F.contains("_m1", "_m2") | F.contains("_m2", "_m1"))
    long_ones = F.size(F.filter(shared, lambda t: F.length(t) >= 4))
    score = F.col("_fuzzy") - F.floor(F.abs(F.length("_other") - F.length("_own")) / 3) + 12 * F.size(shared) + 40 * long_ones + F.when(inside, 25).otherwise(0) + F.when(makers, 14).otherwise(0)
    evidence = (F.size(shared) >= 2) | inside | ((F.col("_fuzzy") > 0) & (F.size(shared) > 0))
    scored = both.withColumn("score", score.cast("long")).where((F.col("score") >= LEAST_SCORE) & evidence)
    best = scored.groupBy("make", "lens").agg(F.max_by(F.struct("lens_id", "score"), F.struct("score", "pos")).alias("b"))
    return best.select("make", "lens", "b.lens_id", "b.score")


def interval_params(photos: DataFrame, calib: DataFrame, kind: str) -> DataFrame:
    """p1, p2 and p3 at a photo's focal length: the entry there, between two entries a mixture, beyond them the last.

    Entries of different models don't mix: the lower one holds.  ``photos`` has lens_id and focal,
    ``calib`` lens_id, kind, model, focal, p1..p3.  The table of lenses is small and is sent to all tasks.
    """
    own = Window.partitionBy("lens_id").orderBy("focal")
    rows = calib.where(F.col("kind") == kind).select("lens_id", "model", F.col("focal").alias("f0"), "p1", "p2", "p3").withColumnRenamed("f0", "focal")
    rows = rows.select(
        "lens_id", "model", *[F.col(c).alias(c + "_a") for c in ("focal", "p1", "p2", "p3")], F.lead("model").over(own).alias("model_b"),
        *[F.lead(c).over(own).alias(c + "_b") for c in ("focal", "p1", "p2", "p3")], (F.row_number().over(own) == 1).alias("lowest"),
    ).withColumnRenamed("lens_id", "_lens")
    f = F.col("focal")
    low = F.when(F.col("lowest"), F.lit(float("-inf"))).otherwise(F.col("focal_a") - NEAR)
    high = F.coalesce(F.col("focal_b") - NEAR, F.lit(float("inf")))
    joined = photos.join(F.broadcast(rows), (F.col("lens_id") == F.col("_lens")) & (f >= low) & (f < high), "left")
    t = F.when((f <= F.col("focal_a") + NEAR) | F.col("focal_b").isNull() | (F.col("model") != F.col("model_b")), 0.0).otherwise((f - F.col("focal_a")) / (F.col("focal_b") - F.col("focal_a")))
    rest = {"distortion": 0.0, "tca": 1.0}.get(kind, 0.0)
    mixed = [F.coalesce(F.col(p + "_a") + t * (F.coalesce(p + "_b", p + "_a") - F.col(p + "_a")), F.lit(rest)).alias(f"{kind}_{p}") for p in ("p1", "p2", "p3")]
    return joined.select(*photos.columns, *mixed)


def nearest_params(photos: DataFrame, calib: DataFrame) -> DataFrame:
    """Vignetting: at each of the two focal lengths around, the entry of nearest aperture, then nearest distance; then a mixture."""
    entries = calib.where("kind = 'vignetting'").select(F.col("lens_id").alias("_lens"), F.col("focal").alias("_f"), F.col("aperture").alias("_a"), F.col("distance").alias("_d"), "p1", "p2", "p3")
    spans = entries.select("_lens", "_f").distinct()
    order = Window.partitionBy("_lens").orderBy("_f")
    spans = spans.select("_lens", F.col("_f").alias("lo"), F.coalesce(F.lead("_f").over(order), F.col("_f")).alias("hi"), (F.row_number().over(order) == 1).alias("lowest"), F.lead("_f").over(order).isNull().alias("highest"))
    f = F.col("focal")
    inside = ((f >= F.col("lo")) | F.col("lowest")) & ((f < F.col("hi")) | F.col("highest"))
    asks = photos.select("idx", "lens_id", "focal", "aperture", "distance").join(F.broadcast(spans), (F.col("lens_id") == F.col("_lens")) & inside)
    asks = asks.withColumn("lo", F.when(F.col("lowest") & (f < F.col("lo")), F.col("lo")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("lowest") & (f < F.col("lo")), F.col("lo")).otherwise(F.col("hi"))).drop("_lens")
    ends = asks.select("*", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("at"))
    found = ends.join(F.broadcast(entries), (F.col("lens_id") == F.col("_lens")) & (F.col("at") == F.col("_f")))
    by_aperture = F.abs(F.col("_a") - F.coalesce("aperture", F.lit(DEFAULT_APERTURE)))
    nearest = found.withColumn("_gap", by_aperture).withColumn("_least", F.min("_gap").over(Window.partitionBy("idx", "at"))).where(F.col("_gap") <= F.col("_least") + 0.01)
    by_distance = Window.partitionBy("idx", "at").orderBy(F.abs(F.col("_d") - F.coalesce("distance", F.lit(DEFAULT_DISTANCE))), "_gap", "_a", "_d")
    chosen = nearest.withColumn("_n", F.row_number().over(by_distance)).where("_n = 1")
    t = F.when(F.col("hi") > F.col("lo"), (f - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    weight = F.when(F.col("hi") == F.col("lo"), 1.0).when(F.col("at") == F.col("lo"), 1 - t).otherwise(t)
    sums = chosen.withColumn("_w", weight).groupBy("idx").agg(*[F.sum(F.col("_w") * F.col(p)).alias(f"vignetting_{p}") for p in ("p1", "p2", "p3")])
    return photos.join(sums, "idx", "left").select(*photos.columns, *[F.coalesce(f"vignetting_{p}", F.lit(0.0)).alias(f"vignetting_{p}") for p in ("p1", "p2", "p3")])


def lens_params(photos: DataFrame, calib: DataFrame) -> DataFrame:
    return nearest_params(interval_params(interval_params(photos, calib, "distortion"), calib, "tca"), calib)


def resolve_lens_for_edits(photos: DataFrame, lenses: DataFrame, calib: DataFrame) -> DataFrame:
    """``photos`` with the lens entries of ``adjustments``, a map from name to JSON text, set or dropped.

    ``photos`` has idx, adjustments, has_exif, make, lens, focal, aperture and distance.  The mode is
    lensCorrectionMode, or manual where both lensMaker and lensModel are set, else auto.  With auto,
    maker and model are those of the best match, and go where nothing matches or no EXIF is known.
    Then lensDistortionParams holds the lens's values at this focal length (50 if unknown), aperture
    and distance, or goes where there is no such lens.  Documents that are null stay null.
    """
    text = lambda key: F.get_json_object(F.concat(F.lit('{"v":'), F.element_at("adjustments", key), F.lit("}")), "$.v")
    known = text("lensMaker").isNotNull() & text("lensModel").isNotNull()
    rows = photos.withColumn("_auto", F.coalesce(text("lensCorrectionMode"), F.when(known, "manual").otherwise("auto")) == "auto")
    shown = disambiguate_lens_names(lenses).select(F.col("lens_id").alias("_id"), F.col("maker").alias("_maker"), F.col("shown").alias("_shown"))
    found = match_lenses(rows.where("_auto and has_exif"), lenses).join(shown, F.col("lens_id") == F.col("_id")).select(F.col("make").alias("_mk"), F.col("lens").alias("_ln"), F.col("_maker").alias("_found_maker"), F.col("_shown").alias("_found_model"))
    rows = rows.join(found, F.col("_auto") & F.col("has_exif") & F.col("make").eqNullSafe(F.col("_mk")) & (F.col("lens") == F.col("_ln")), "left")
    rows = rows.withColumn("_use_maker", F.when(F.col("_auto"), F.col("_found_maker")).otherwise(text("lensMaker"))).withColumn("_use_model", F.when(F.col("_auto"), F.col("_found_model")).otherwise(text("lensModel")))
    first = shown.groupBy("_maker", "_shown").agg(F.min("_id").alias("lens_id"))
    asked = rows.join(first, (F.col("_use_maker") == F.col("_maker")) & (F.col("_use_model") == F.col("_shown")), "left").withColumn("focal", F.coalesce("focal", F.lit(DEFAULT_FOCAL)))
    found = lens_params(asked, calib)
    names = [f"{k}_{p}" for k in ("distortion", "tca", "vignetting") for p in ("p1", "p2", "p3")]
    new = F.map_from_arrays(
        F.array(F.lit("lensMaker"), F.lit("lensModel"), F.lit("lensDistortionParams")),
        F.array(*[F.when(F.col("_auto"), F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)) for c in ("_use_maker", "_use_model")], F.when(F.col("lens_id").isNotNull(), F.to_json(F.struct(*[F.round(n, 6).alias(n) for n in names])))),
    )
    gone = F.when(F.col("_auto"), F.array(F.lit("lensMaker"), F.lit("lensModel"), F.lit("lensDistortionParams"))).otherwise(F.array(F.lit("lensDistortionParams")))
    rest = F.map_filter("adjustments", lambda k, _: ~F.array_contains(gone, k))
    edited = F.map_concat(rest, F.map_filter(new, lambda _, v: v.isNotNull()))
    return found.withColumn("adjustments", F.when(F.col("adjustments").isNotNull(), edited)).select(*photos.columns)


def disambiguate_lens_names(lenses: DataFrame) -> DataFrame:
    """Adds ``shown``: the short name if one of a maker has it, else its canonical one, else with the crop factor."""
    canon_short = F.regexp_replace("canonical", r"^\S+\s+", "")
    rows = lenses.withColumn("_cs", canon_short)
    n = lambda *c: F.count(F.lit(1)).over(Window.partitionBy("maker", *c))
    with_crop = F.concat("canonical", F.lit(" (crop "), F.format_string("%.1f", "cropfactor"), F.lit("x)"))
    return rows.withColumn("shown", F.when(n("short") == 1, F.col("short")).when(n("_cs") == 1, F.col("_cs")).when(n("canonical") == 1, F.col("canonical")).otherwise(with_crop)).drop("_cs")
