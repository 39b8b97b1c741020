"""Plans of file work: names, clashes, imports and exports.  Nothing here touches a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import paths

IMPORT_FOLDERS = "{YYYY}/{MM}/{DD}"
EXPORT_NAME = "{original_filename}_edited"


def numbered(items: DataFrame, column: str = "sequence", order: str = "idx") -> DataFrame:
    """Adds 1, 2, ... in the order of ``order``; no task sorts everything."""
    rows = storage.numbered(items.withColumn("_all", F.lit(0)), "_all", [order], column)
    return rows.withColumn(column, F.col(column) + 1).drop("_all")


def filled(template: Column, values: dict[str, Column]) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value)
    return template


def date_parts(ts: Column) -> dict[str, Column]:
    return {name: F.coalesce(F.date_format(ts, form), F.lit("")) for name, form in (("YYYY", "yyyy"), ("MM", "MM"), ("DD", "dd"), ("hh", "HH"), ("mm", "mm"))}


def plan_filenames(items: DataFrame, template: str) -> DataFrame:
    """Adds ``new_name``; items have idx, source_path and taken.  Sequences get as many digits as the total has."""
    total = items.agg(F.count(F.lit(1)).alias("_total"))
    rows = numbered(items).join(F.broadcast(total))
    sequence = F.lpad(F.col("sequence").cast("string"), F.length(F.col("_total").cast("string")), F.lit("0"))
    path = F.col("source_path")
    return rows.withColumn("new_name", filled(F.lit(template), {"original_filename": paths.stem(path), "sequence": sequence, **date_parts(F.col("taken"))})).drop("_total")


def virtual_copy_suffix(items: DataFrame) -> DataFrame:
    """Adds ``suffix``: an id given as vc=<n> or _vc<n>, else _VC01 for the second photo of a source, and so on."""
    n = F.row_number().over(Window.partitionBy("source_path").orderBy("idx"))
    given = F.nullif(F.regexp_extract(F.col("path"), r"(?i)(?:[?&]vc=|_vc)([0-9]+)$", 1), F.lit(""))
    two = lambda k: F.concat(F.lit("_VC"), F.lpad(k.cast("string"), F.greatest(F.length(k.cast("string")), F.lit(2)), F.lit("0")))
    return items.withColumn("suffix", F.when(given.isNotNull(), two(given.cast("long"))).when(n > 1, two(n - 1)).otherwise(""))


def collisions(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``clash``: exists (a file other than the row's own has the target), shared (two rows do), or null."""
    there = existing.select(F.col("source_path").alias("target")).distinct().withColumn("_there", F.lit(True))
    rows = plan.join(there, "target", "left").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("target")))
    taken = F.col("_there").isNotNull() & (F.col("target") != F.col("source_path"))
    return rows.withColumn("clash", F.when(taken, "exists").when(F.col("_n") > 1, "shared")).drop("_there", "_n")


def copy_names(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds ``copy_name``: <stem>_copy_<k>.<ext>, with the first numbers that no file of the folder has.

    Behind each used number a run of free ones begins: the one of place r (from 0) at k has k - r - 1 free
    numbers before it.  Items and runs are sorted by that count together, and an item takes the last run that begins
    no later than its own place, so work grows with the rows and one name may have most of them.
    """
    path, ext = F.col("source_path"), r"\.([^./]+)$"
    keys = ["_base", "_ext"]
    used = existing.select(F.regexp_extract(path, r"^(.+)_copy_([0-9]{1,9})\.[^./]+$", 1).alias("_base"), F.regexp_extract(path, ext, 1).alias("_ext"), F.nullif(F.regexp_extract(path, r"_copy_([0-9]{1,9})\.[^./]+$", 1), F.lit("")).cast("long").alias("_k"))
    used = storage.ordered(used.where("_k > 0").distinct(), keys, ["_k"])
    runs = storage.scan(used, keys, {"_r": ("number", None)}).select(*keys, (F.col("_k") - F.col("_r") - 1).alias("_n"), (F.col("_r") + 2).alias("_shift"), F.lit(True).alias("_run"))
    rows = items.withColumns({"_base": F.concat(paths.folder(path), F.lit("/"), paths.stem(path)), "_ext": F.regexp_extract(path, ext, 1)})
    placed = storage.scan(storage.ordered(rows, keys, ["idx"]), keys, {"_n": ("number", None)}).drop("_row").withColumn("_run", F.lit(False))
    both = storage.ordered(placed.unionByName(runs, allowMissingColumns=True), keys, ["_n", (F.col("_run"), True), "_shift"])
    found = storage.scan(both, keys, {"_last": ("last", "_shift")}).where(~F.col("_run"))
    number = (F.col("_n") + F.coalesce("_last", F.lit(1))).cast("string")
    return found.withColumn("copy_name", F.concat("_base", F.lit("_copy_"), number, F.lit("."), "_ext")).select(*items.columns, "copy_name")


def relative_export_dir(items: DataFrame, bases: DataFrame) -> DataFrame:
    """Adds ``relative``: the folder below the longest base that is above the file; null if none, or if a part is ``..``."""
    base = bases.select(F.col("base").alias("_up"), F.lit(True).alias("_is")).distinct()
    up = items.select("source_path").distinct().select("source_path", F.explode(paths.folders_above(F.col("source_path"))).alias("_up"))
    best = up.join(F.broadcast(base), "_up").groupBy("source_path").agg(F.max_by("_up", F.length("_up")).alias("_base"))
    rest = F.ltrim(F.substring(paths.folder(F.col("source_path")), F.length("_base") + 1, F.lit(1 << 20)), F.lit("/"))
    safe = ~F.array_contains(F.split(rest, "/"), "..")
    return items.join(best, "source_path", "left").withColumn("relative", F.when(F.col("_base").isNotNull() & safe, rest)).drop("_base")


def export_summary(results: DataFrame) -> DataFrame:
    """One row: how many ended (failures too), how many failed, and the errors in order."""
    failed = storage.ordered(results.where("error is not null").select("idx", "error"), ["idx"], ["error"])
    # ranges are put together first, so the task that makes the whole text reads no more than its characters
    part = F.shiftright("_row", 33).alias("part")
    texts = failed.groupBy(part).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_row", "error"))), lambda x: x["error"]), "\n").alias("text"))
    whole = texts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), "\n").alias("errors"))
    return results.agg(F.count(F.lit(1)).alias("completed"), F.count("error").alias("failed")).crossJoin(whole)


def export_errors(results: DataFrame) -> DataFrame:
    """place, idx and error of every failure, numbered from 0 in order: the summary's text as rows, whatever its length."""
    failed = results.where("error is not null").select("idx", "error", F.lit(0).alias("_all"))
    return storage.numbered(failed, "_all", ["idx", "error"], "place").select("place", "idx", "error")


def estimate_export_size(samples: DataFrame, plan: DataFrame) -> DataFrame:
    """Bytes by format: mean bytes a pixel of the samples times the pixels planned; LUT files have one size."""
    rate = samples.groupBy("format").agg(F.avg(F.col("bytes") / F.col("preview_px")).alias("rate"))
    size = F.when(F.col("format") == "cube", F.lit(1050000.0)).otherwise(F.col("rate") * F.col("target_px"))
    return plan.join(F.broadcast(rate), "format", "left").groupBy("format").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))


def import_plan(files: DataFrame, existing: DataFrame, root: str, template: str = "{original_filename}", by_date: bool = True, folders: str = IMPORT_FOLDERS) -> DataFrame:
    """Where each file goes, and what stands in the way; all rows are planned, none stops the others."""
    rows = plan_filenames(files, template)
    folder = F.concat(F.lit(root + "/"), filled(F.lit(folders), date_parts(F.col("taken")))) if by_date else F.lit(root)
    target = F.concat(folder, F.lit("/"), F.col("new_name"), F.lit("."), F.regexp_extract("source_path", r"\.([^./]+)$", 1))
    return collisions(rows.withColumn("target", target), existing)


def export_plan(items: DataFrame, existing: DataFrame, bases: DataFrame, root: str, fmt: str = "jpg", template: str = EXPORT_NAME, mode: str = "long", value: int = 2048, dont_enlarge: bool = True) -> DataFrame:
    """Target, size and clashes of an export; items have idx, path, source_path, taken, width and height."""
    rows = relative_export_dir(virtual_copy_suffix(plan_filenames(items, template)), bases)
    sub = F.when(F.coalesce("relative", F.lit("")) != "", F.concat(F.lit("/"), F.col("relative"))).otherwise("")
    w, h = paths.resize_target(F.col("width"), F.col("height"), mode, value, dont_enlarge)
    target = F.concat(F.lit(root), sub, F.lit("/"), F.col("new_name"), F.col("suffix"), F.lit("." + fmt))
    return collisions(rows.withColumns({"target": target, "out_width": w, "out_height": h}), existing)
