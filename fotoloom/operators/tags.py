"""Tags of photos: colour tags (``color:``), the user's (``user:``) and those of a tagger (no prefix)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COLOR, USER = "color:", "user:"
_NONE = "array<string>"


def _own(tags: str = "tags") -> Column:
    return F.coalesce(F.col(tags), F.array().cast(_NONE))


def _or_null(tags: Column) -> Column:
    return F.when(F.size(tags) > 0, tags)


def _is_ai(t: Column) -> Column:
    return ~t.startswith(COLOR) & ~t.startswith(USER)


def _chosen(catalog: DataFrame, paths: DataFrame) -> DataFrame:
    return catalog.join(paths.select("path").distinct().withColumn("_chosen", F.lit(True)), "path", "left")


def _set(catalog: DataFrame, paths: DataFrame, column: str, value: Column) -> DataFrame:
    return _chosen(catalog, paths).withColumn(column, F.when(F.col("_chosen").isNotNull(), value).otherwise(F.col(column))).select(*catalog.columns)


def add_tag(catalog: DataFrame, paths: DataFrame, tag: str) -> DataFrame:
    return _set(catalog, paths, "tags", F.array_sort(F.array_distinct(F.concat(_own(), F.array(F.lit(tag))))))


def remove_tag(catalog: DataFrame, paths: DataFrame, tag: str) -> DataFrame:
    return _set(catalog, paths, "tags", _or_null(F.array_sort(F.array_distinct(F.array_remove(_own(), tag)))))


def _clear(catalog: DataFrame, root: str, keep) -> DataFrame:
    inside = F.col("path").startswith(root)
    left = F.filter(_own(), keep)
    changed = inside & (F.size(left) != F.size(_own()))
    return catalog.withColumn("changed", changed).withColumn("tags", F.when(changed, _or_null(left)).otherwise(F.col("tags")))


def clear_ai_tags(catalog: DataFrame, root: str) -> DataFrame:
    """Below a root only colour and user tags stay; ``changed`` says where something went."""
    return _clear(catalog, root, lambda t: ~_is_ai(t))


def clear_all_tags(catalog: DataFrame, root: str) -> DataFrame:
    return _clear(catalog, root, lambda t: t.startswith(COLOR))


def merge_ai_tags(catalog: DataFrame, new_tags: DataFrame) -> DataFrame:
    """Adds a tagger's tags to photos that have none of its kind yet."""
    joined = catalog.join(new_tags.select("path", F.col("tags").alias("_new")), "path", "left")
    waits = F.forall(_own(), lambda t: ~_is_ai(t)) & F.col("_new").isNotNull()
    return joined.withColumn("tags", F.when(waits, F.array_sort(F.array_union(_own(), F.col("_new")))).otherwise(F.col("tags"))).select(*catalog.columns)


def expand_hierarchy(picked: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """path and tags: the picked ones and the parents of each, one level up."""
    long = picked.select("path", F.explode("tags").alias("tag"))
    up = long.join(F.broadcast(hierarchy.select(F.col("child").alias("tag"), "parent")), "tag").select("path", F.col("parent").alias("tag"))
    return long.unionByName(up).groupBy("path").agg(F.array_sort(F.collect_set("tag")).alias("tags"))


def set_color_label(catalog: DataFrame, paths: DataFrame, color: str | None) -> DataFrame:
    """Replaces the colour tag; the rest keeps its order."""
    rest = F.filter(_own(), lambda t: ~t.startswith(COLOR))
    return _set(catalog, paths, "tags", _or_null(F.concat(rest, F.array(F.lit(COLOR + color))) if color else rest))


def set_rating(catalog: DataFrame, paths: DataFrame, rating: int) -> DataFrame:
    if not 0 <= rating <= 5:
        raise ValueError("a rating is 0 to 5")
    return _set(catalog, paths, "rating", F.lit(rating))


def replace_tags(catalog: DataFrame, paths: DataFrame, tags: list[str], user: list[str]) -> DataFrame:
    """Colour tags stay; all others become the given ones."""
    new = F.array(*[F.lit(t) for t in [*tags, *(USER + u for u in user)]]).cast(_NONE)
    return _set(catalog, paths, "tags", _or_null(F.array_sort(F.concat(F.filter(_own(), lambda t: t.startswith(COLOR)), new))))


def tag_counts(catalog: DataFrame, kind: str = "all") -> DataFrame:
    """kind (color, user or ai), tag without prefix, and how many photos have it."""
    long = catalog.select("path", F.explode("tags").alias("t"))
    which = F.when(F.col("t").startswith(COLOR), "color").when(F.col("t").startswith(USER), "user").otherwise("ai")
    rows = long.select("path", which.alias("kind"), F.regexp_replace("t", "^(color|user):", "").alias("tag"))
    rows = rows if kind == "all" else rows.where(F.col("kind") == kind)
    return rows.groupBy("kind", "tag").agg(F.count(F.lit(1)).alias("uses"), F.countDistinct("path").alias("photos"))


def update_exif(catalog: DataFrame, updates: DataFrame) -> DataFrame:
    """Trimmed values go into the exif map; an empty one takes its key out.  ``updates`` has path and changes, a map."""
    none = F.create_map().cast("map<string,string>")
    joined = catalog.join(updates.select("path", F.transform_values("changes", lambda _, v: F.trim(v)).alias("_c")), "path", "left")
    merged = F.map_filter(F.map_concat(F.coalesce("exif", none), F.coalesce("_c", none)), lambda _, v: v != "")
    return joined.withColumn("exif", F.when(F.col("_c").isNull(), F.col("exif")).otherwise(merged)).select(*catalog.columns)


def softmax_tags(scores: DataFrame, k: int = 10, least: float = 0.005) -> DataFrame:
    """path, tag, p and place: softmax over a photo's candidates, the best k above ``least``."""
    own = Window.partitionBy("path")
    e = F.exp(F.col("score") - F.max("score").over(own))
    rows = scores.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(own)).where(F.col("p") > least)
    return rows.withColumn("place", F.row_number().over(own.orderBy(F.desc("p"), "tag"))).where(F.col("place") <= k).select("path", "tag", "p", "place")
