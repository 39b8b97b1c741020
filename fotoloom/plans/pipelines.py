"""Whole workloads: browse, cull and tag, edit and export, benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import benchmark, catalog, imaging, search, similar, tags
from ..operators.edits import apply_adjustments
from . import planning


def browse(rows: DataFrame, terms: list[str], text: str = "", rating: int = 0, prefer: str = "raw") -> DataFrame:
    """Groups first, then filters on what is shown, then the search, which any member of a group can meet."""
    grouped = catalog.stem_groups(rows)
    shown = search.filter_catalog(catalog.hide_grouped(catalog.pick_primary(grouped, prefer)), rating)
    return catalog.expand_group_search(shown, grouped, search.condition(terms, text))


def cull_and_tag(images: DataFrame, scores: DataFrame, hierarchy: DataFrame, t: int = 28) -> tuple[DataFrame, DataFrame]:
    """(verdicts, tags): what to keep of similar pictures, and a tagger's picks with their parents."""
    picked = tags.softmax_tags(scores).groupBy("path").agg(F.collect_list("tag").alias("tags"))
    return similar.cull(images, t), tags.expand_hierarchy(picked, hierarchy)


def edit_and_plan(documents: DataFrame, targets: DataFrame, patch: dict[str, str], items: DataFrame, existing: DataFrame, bases: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(documents after a bulk edit, export plan)."""
    return apply_adjustments(documents, targets, patch), planning.export_plan(items, existing, bases, root)


def benchmark_report(frames: DataFrame, phases: DataFrame) -> DataFrame:
    return benchmark.bench_stats(benchmark.frame_metrics(benchmark.frame_durations(frames), phases))


def image_measures(images: DataFrame, key: str = "img_id") -> DataFrame:
    m = imaging.focus_measures(images, key)
    return m.withColumn("quality", imaging.quality_score(F.col("sharpness"), F.col("center_focus"), F.col("exposure")))
