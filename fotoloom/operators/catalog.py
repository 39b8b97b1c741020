"""The catalog: sidecar documents, virtual copies, EXIF, groups of one shot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths

VERSION = 1
MAX_RATING = 5
LONG_EXIF = 500


def shortened(value: Column) -> Column:
    """EXIF values of over 500 bytes keep their first and last 200 characters."""
    return F.when(F.octet_length(value) > LONG_EXIF, F.concat(F.left(value, F.lit(200)), F.lit("..."), F.right(value, F.lit(200)))).otherwise(value)


def parsed_sidecars(docs: DataFrame, doc: str = "doc") -> DataFrame:
    """Adds version, rating, adjustments, tags, extra, migrated and error to documents.

    A missing version is 0 and is migrated to 1.  ``error`` names what makes a document unusable:
    malformed, not_an_object, bad_version, future_version or bad_rating; it is null for good ones.
    Fields that aren't known stay in ``extra``, as JSON text by name.
    """
    # each step reads columns of the one before, so that a document is parsed once, not once for each field
    rows = docs.withColumn("_v", F.try_parse_json(F.col(doc)))
    rows = rows.withColumn("_object", F.schema_of_variant("_v").startswith("OBJECT"))
    v = F.col("_v")
    rows = rows.withColumns({
        "_fields": F.from_json(F.when(F.col("_object"), F.col(doc)), "map<string,string>"), "_kind": F.schema_of_variant(F.try_variant_get(v, "$.version", "variant")),
        "_version": F.try_variant_get(v, "$.version", "int"), "_rating": F.try_variant_get(v, "$.rating", "int"),
    })
    fields = F.col("_fields")
    raw_version, raw_rating = F.element_at(fields, "version"), F.element_at(fields, "rating")
    rows = rows.withColumns({"_has_version": raw_version.isNotNull(), "_version": F.when(raw_version.isNull(), 0).otherwise(F.col("_version")), "_rating": F.coalesce(F.when(raw_rating.isNotNull(), F.col("_rating")), F.lit(0))})
    version, rating = F.col("_version"), F.col("_rating")
    error = (
        F.when(v.isNull(), "malformed")
        .when(~F.col("_object"), "not_an_object")
        .when(F.col("_has_version") & ((F.col("_kind") != "BIGINT") | version.isNull() | (version < 0)), "bad_version")
        .when(version > VERSION, "future_version")
        .when((rating > MAX_RATING) | (rating < 0), "bad_rating")
    )
    known = ("version", "rating", "adjustments", "tags", "exif")
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        version.alias("version"),
        rating.alias("doc_rating"),
        F.try_variant_get(v, "$.adjustments", "variant").alias("adjustments"),
        F.try_variant_get(v, "$.tags", "array<string>").alias("doc_tags"),
        F.transform_values(F.from_json(F.element_at(fields, "exif"), "map<string,string>"), lambda _, x: shortened(x)).alias("doc_exif"),
        F.map_filter(fields, lambda k, _: ~k.isin(*known)).alias("extra"),
        (version == 0).alias("migrated"),
        error.alias("error"),
    )


def read_sidecars(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable documents at version 1, quarantined ones with the reason)."""
    rows = parsed_sidecars(docs)
    return rows.where("error is null").drop("error").withColumn("version", F.lit(VERSION)), rows.where("error is not null").select(*docs.columns, "error")


def recover_from_backup(documents: DataFrame) -> DataFrame:
    """Per document with ``doc`` and ``bak``: which text holds, and from where.

    A bad primary gives way to a good backup; one of a future version is never replaced; if both are
    bad the error stays.
    """
    first = parsed_sidecars(documents.select("*")).select(*documents.columns, F.col("error").alias("primary_error"), F.col("doc_rating").alias("_r1"))
    both = parsed_sidecars(first, "bak").select(*first.columns, F.col("error").alias("backup_error"), F.col("doc_rating").alias("_r2"), F.col("bak").isNotNull().alias("_has"))
    use = F.col("primary_error").isNotNull() & (F.col("primary_error") != "future_version") & F.col("_has") & F.col("backup_error").isNull()
    return both.select(
        *documents.columns,
        F.when(F.col("primary_error").isNull(), "primary").when(use, "backup").otherwise("none").alias("origin"),
        F.when(F.col("primary_error").isNull(), F.col("_r1")).when(use, F.col("_r2")).alias("recovered_rating"),
        F.when(F.col("primary_error").isNotNull() & ~use, F.col("primary_error")).alias("error"),
    )


def newest_sidecar(legacy: DataFrame, private: DataFrame) -> DataFrame:
    """One document a photo: the legacy one only if it is newer than the private one."""
    rows = private.withColumn("is_private", F.lit(True)).unionByName(legacy.withColumn("is_private", F.lit(False)))
    order = Window.partitionBy("source_path", F.coalesce("copy_id", F.lit(""))).orderBy(F.desc("modified"), F.desc("is_private"))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def build_catalog(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """A row for each file and each virtual copy, with rating, tags and edits of its document.

    ``files`` has source_path and modified, ``sidecars`` source_path, copy_id, rating, tags and
    is_edited.  Without a document: rating 0, no tags, not edited.
    """
    copies = sidecars.where("copy_id is not null").select("source_path", "copy_id").distinct()
    rows = files.withColumn("copy_id", F.lit(None).cast("string")).unionByName(files.join(copies, "source_path").select(*files.columns, "copy_id"))
    keyed = rows.withColumn("_copy", F.coalesce("copy_id", F.lit("")))
    own = sidecars.select("source_path", F.coalesce("copy_id", F.lit("")).alias("_copy"), "rating", "tags", "is_edited")
    out = keyed.join(own, ["source_path", "_copy"], "left").drop("_copy")
    return out.select(
        paths.photo_path(F.col("source_path"), F.col("copy_id")).alias("path"), "source_path", "copy_id", *[c for c in files.columns if c != "source_path"],
        F.coalesce("rating", F.lit(0)).alias("rating"), "tags", F.coalesce("is_edited", F.lit(False)).alias("is_edited"),
        F.col("copy_id").isNotNull().alias("is_virtual_copy"), paths.is_raw(F.col("source_path")).alias("is_raw"),
    )


def attach_exif(catalog: DataFrame, exif: DataFrame) -> DataFrame:
    """``exif`` of the file, over which the document's own values win; both are maps."""
    joined = catalog.join(exif.select("source_path", F.col("exif").alias("_file_exif")), "source_path", "left")
    none = F.create_map().cast("map<string,string>")
    return joined.withColumn("exif", F.map_concat(F.coalesce("_file_exif", none), F.coalesce("doc_exif", none))).drop("_file_exif", "doc_exif")


def sync_from_xmp(catalog: DataFrame, xmp: DataFrame) -> DataFrame:
    """Takes rating and tags from side files; the result keeps the order of tags and says what changed.

    The rating comes over only where there is none yet.  A new colour replaces the old one.  Whether
    tags changed is told from their number alone, so a swap of colours of one photo isn't taken.
    """
    own = F.coalesce("tags", F.array().cast("array<string>"))
    joined = catalog.join(xmp.select("source_path", "xmp_rating", "xmp_label", "xmp_tags"), "source_path", "left")
    colour = F.when(F.coalesce("xmp_label", F.lit("")) != "", F.concat(F.lit("color:"), F.lower("xmp_label")))
    plain = F.when(colour.isNull() | F.array_contains(own, colour), own).otherwise(F.concat(F.filter(own, lambda t: ~t.startswith("color:")), F.array(colour)))
    merged = F.concat(plain, F.array_except(F.coalesce("xmp_tags", F.array().cast("array<string>")), plain))
    takes = (F.col("rating") == 0) & (F.coalesce("xmp_rating", F.lit(0)) != 0)
    more = F.size(merged) != F.size(own)
    return joined.select(
        *[c for c in catalog.columns if c not in ("rating", "tags")],
        F.when(takes, F.col("xmp_rating")).otherwise(F.col("rating")).alias("rating"), F.when(more, merged).otherwise(F.col("tags")).alias("tags"), (takes | more).alias("changed"),
    )


def stem_groups(catalog: DataFrame, require_exif: bool = False, group_edited: bool = True) -> DataFrame:
    """Adds group_id, folder/stem of two or more real files; with ``require_exif`` their dates must agree."""
    path = F.col("source_path")
    key = F.when(F.col("copy_id").isNull() & (F.lit(True) if group_edited else ~F.col("is_edited")), F.concat(paths.folder(path), F.lit("/"), paths.stem(path)))
    rows = catalog.withColumn("_key", key)
    # rows of no group are dealt by path, so that they don't meet under one null key
    own = Window.partitionBy(F.coalesce("_key", F.concat(F.lit("\0"), "path")))
    n, dated = F.count(F.lit(1)).over(own), F.count("date_original").over(own)
    same = (n == dated) & (F.min("date_original").over(own) == F.max("date_original").over(own)) if require_exif else F.lit(True)
    return rows.withColumn("group_id", F.when(F.col("_key").isNotNull() & (n >= 2) & same, F.col("_key"))).drop("_key")


def group_badges(grouped: DataFrame) -> DataFrame:
    """Per group: how many, and the kinds of file, as ARW+JPG."""
    rows = grouped.where("group_id is not null")
    return rows.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set(paths.file_label(F.col("source_path")))), "+").alias("label"))


def pick_primary(grouped: DataFrame, prefer: str = "raw") -> DataFrame:
    """Adds is_primary: the first RAW (or first other file) of a group in list order, else its first."""
    wanted = F.col("is_raw") if prefer == "raw" else ~F.col("is_raw")
    order = Window.partitionBy(F.coalesce("group_id", F.concat(F.lit("\0"), "path"))).orderBy(wanted.desc(), "idx")
    return grouped.withColumn("is_primary", F.col("group_id").isNull() | (F.row_number().over(order) == 1))


def hide_grouped(with_primary: DataFrame) -> DataFrame:
    return with_primary.where("is_primary")


def expand_group_search(shown: DataFrame, catalog: DataFrame, hit: Column) -> DataFrame:
    """Rows that match, and rows of a group of which any member in ``catalog`` matches."""
    groups = catalog.where(hit & F.col("group_id").isNotNull()).select("group_id").distinct().withColumn("_hit", F.lit(True))
    return shown.join(groups, "group_id", "left").where(hit | F.col("_hit").isNotNull()).drop("_hit")


def album_images(members: DataFrame, catalog: DataFrame) -> DataFrame:
    """Supported photos of albums, in album order."""
    return members.join(catalog, "path").where(paths.is_supported(F.col("source_path"))).orderBy("album_id", "pos")


def orphan_sidecars(sidecars: DataFrame, files: DataFrame) -> DataFrame:
    return sidecars.join(files.select("source_path"), "source_path", "left_anti")


def associated_files(selected: DataFrame, files: DataFrame) -> DataFrame:
    """Files whose stem and whose folder are among those of the selected ones."""
    path = F.col("source_path")
    keyed = files.withColumns({"_stem": paths.stem(path), "_folder": paths.folder(path)})
    stems, folders = selected.select(paths.stem(path).alias("_stem")).distinct(), selected.select(paths.folder(path).alias("_folder")).distinct()
    return keyed.join(stems, "_stem", "left_semi").join(folders, "_folder", "left_semi").drop("_stem", "_folder")


def stale_derivatives(catalog: DataFrame, known: DataFrame) -> DataFrame:
    """Photos whose content key has no derived image yet."""
    return catalog.join(known.select("thumbnail_key"), "thumbnail_key", "left_anti")


def distinct_sources(catalog: DataFrame) -> DataFrame:
    return catalog.select(paths.source_path(F.col("path")).alias("source_path")).distinct()
