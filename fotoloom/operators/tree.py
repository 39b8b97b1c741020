"""Folders and albums: counts up the tree, renames, deletions, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import storage
from ..functions import paths

#: Rounds of pointer jumping: trees of 2**40 levels; more are a circle.
MAX_ROUNDS = 40


def folder_counts(files: DataFrame, root: str = "") -> DataFrame:
    """folder, image_count of it and all below, own_count and has_subdirs; hidden folders are left out.

    Files are counted by folder before anything is spread to the folders above, so the rows that go
    up the tree are folders, not files.
    """
    own = files.where(paths.is_supported(F.col("source_path"))).groupBy(paths.folder(F.col("source_path")).alias("folder")).agg(F.count(F.lit(1)).alias("n"))
    own = own.where(~F.col("folder").rlike(r"/\.")).where(F.col("folder").startswith(root))
    up = F.explode(F.concat(paths.folders_above(F.col("folder")), F.array("folder")))
    spread = own.select(up.alias("up"), "folder", "n").where(F.length("up") >= len(root))
    return spread.groupBy(F.col("up").alias("folder")).agg(F.sum("n").alias("image_count"), F.sum(F.when(F.col("up") == F.col("folder"), F.col("n")).otherwise(0)).alias("own_count"), F.bool_or(F.col("up") != F.col("folder")).alias("has_subdirs"))


def folder_groups(catalog: DataFrame, base: str) -> DataFrame:
    """Photos per folder with the place of the folder: the base first, then by name."""
    groups = catalog.groupBy("folder").agg(F.count(F.lit(1)).alias("photos")).withColumns({"_all": F.lit(0), "_other": F.col("folder") != base})
    return storage.numbered(groups, "_all", ["_other", "folder"], "place").select("folder", "photos", (F.col("place") + 1).alias("place"))


def subtree_sums(nodes: DataFrame, value: str) -> DataFrame:
    """id and ``value`` summed over the node and all below it; ``nodes`` has id, parent_id and ``value``.

    Pointer jumping: after round k a node has the sum of what lies less than 2**k levels below, and points 2**k levels
    up, so rounds are the logarithm of the depth and tables stay as long as ``nodes``.  Rounds are written.
    """
    now = storage.written(nodes.select("id", F.col("parent_id").alias("up"), F.coalesce(value, F.lit(0)).alias("sum")), "subtrees")
    for _ in range(MAX_ROUNDS):
        if now.where("up is not null").isEmpty():
            return now.select("id", F.col("sum").alias(value))
        given = now.where("up is not null").groupBy(F.col("up").alias("id")).agg(F.sum("sum").alias("more"))
        next_up = now.select(F.col("id").alias("up"), F.col("up").alias("far"))
        after = now.join(given, "id", "left").join(next_up, "up", "left").select("id", F.col("far").alias("up"), (F.col("sum") + F.coalesce("more", F.lit(0))).alias("sum"))
        before, now = now, storage.written(after, "subtrees")
        storage.discard(before)
    raise ValueError("nodes are their own ancestors")


def album_counts(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """id and count: members of an album, for groups those of all albums below."""
    own = members.groupBy(F.col("album_id").alias("id")).agg(F.count(F.lit(1)).alias("count"))
    return subtree_sums(nodes.select("id", "parent_id").join(own, "id", "left"), "count")


def rewrite_paths(members: DataFrame, renames: DataFrame, old_folder: str | None = None, new_folder: str | None = None) -> DataFrame:
    """Member paths after a folder was renamed and files were; virtual copies follow their file."""
    path = F.col("path")
    if old_folder is not None:
        inside = (path == old_folder) | path.startswith(old_folder + "/")
        members = members.withColumn("path", F.when(inside, F.concat(F.lit(new_folder), F.substring(path, len(old_folder) + 1, 1 << 20))).otherwise(path))
    joined = members.withColumn("_source", paths.source_path(path)).join(renames.select(F.col("old").alias("_source"), "new"), "_source", "left")
    moved = F.when(F.col("new").isNull(), path).otherwise(paths.photo_path(F.col("new"), paths.copy_id(path)))
    return joined.withColumn("path", moved).select(*members.columns)


def drop_deleted(members: DataFrame, deletions: DataFrame) -> DataFrame:
    """Members without those that are deleted themselves, by their file, or by any folder above."""
    path, gone = F.col("path"), F.col("_gone")
    # folders are few beside the members, so only they are spread to the folders above
    places = members.select(paths.folder(path).alias("_folder")).distinct()
    above = places.select("_folder", F.explode(paths.folders_above(F.concat("_folder", F.lit("/x")))).alias("path")).join(deletions.select("path"), "path", "left_semi").select("_folder").distinct()
    # by the file, which a virtual copy and its file share, members move once
    by_file = deletions.select(F.explode(F.array_distinct(F.array(path, paths.source_path(path)))).alias("_file"), path.alias("_gone"))
    rows = members.withColumns({"_folder": paths.folder(path), "_source": paths.source_path(path)}).join(above, "_folder", "left_anti")
    return rows.join(by_file, (F.col("_source") == F.col("_file")) & ((gone == path) | (gone == F.col("_source"))), "left_anti").select(*members.columns)


def add_to_album(members: DataFrame, album_id: int, added: DataFrame) -> DataFrame:
    """Appends paths (with their order idx) that the album doesn't have yet."""
    own = members.where(F.col("album_id") == album_id)
    new = added.groupBy("path").agg(F.min("idx").alias("idx")).join(own.select("path"), "path", "left_anti")
    last = own.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("last"))
    placed = storage.numbered(new.withColumn("_all", F.lit(0)), "_all", ["idx", "path"], "n")
    rows = placed.withColumn("n", F.col("n") + 1).join(F.broadcast(last)).select(F.lit(album_id).cast(dict(members.dtypes)["album_id"]).alias("album_id"), (F.col("last") + F.col("n")).cast(dict(members.dtypes)["pos"]).alias("pos"), "path")
    return members.select("album_id", "pos", "path").unionByName(rows)


def sort_album_tree(nodes: DataFrame) -> DataFrame:
    """Place of each node among its siblings: groups before albums, then by name."""
    order = Window.partitionBy("parent_id").orderBy(F.when(F.col("kind") == "group", 0).otherwise(1), F.lower("name"), "id")
    return nodes.withColumn("place", F.row_number().over(order))


def sort_folders(folders: DataFrame, key: str = "name", descending: bool = False) -> DataFrame:
    """Place of each folder within its parent, by name, created, modified or image_count."""
    column = F.lower("name") if key == "name" else F.col(key)
    order = Window.partitionBy("parent").orderBy(column.desc() if descending else column.asc(), F.lower("name"), "path")
    return folders.withColumn("place", F.row_number().over(order))
