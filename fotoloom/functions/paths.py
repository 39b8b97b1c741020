"""Paths of photos: virtual copies, folders, names, extensions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions that count as RAW, and other image files.
RAW_EXTENSIONS = "dng pro ari crw cr2 cr3 bay raw erf raf 3fr fff iiq kdc k25 dcs dcr mos rwl mef mrw nef nrw orf rw2 pef ptx srw x3f arw srf sr2".split()
OTHER_EXTENSIONS = "jpg jpeg png gif bmp tiff tif webp jxl exr hdr tga ico dds qoi ff pnm pbm pgm ppm pam".split()


def source_path(path: Column) -> Column:
    """The file of a photo: the path up to the last ``?vc=``."""
    return F.when(F.contains(path, F.lit("?vc=")), F.regexp_extract(path, r"^(.*)\?vc=(.*)$", 1)).otherwise(path)


def copy_id(path: Column) -> Column:
    """The id of a virtual copy; null for the photo itself."""
    return F.when(F.contains(path, F.lit("?vc=")), F.regexp_extract(path, r"^(.*)\?vc=(.*)$", 2))


def photo_path(source: Column, copy: Column) -> Column:
    return F.when(copy.isNull(), source).otherwise(F.concat(source, F.lit("?vc="), copy))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The file name without its last extension."""
    return F.regexp_replace(file_name(path), r"^(.+)\.[^.]*$", "$1")


def extension(path: Column) -> Column:
    """Lower-cased, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def is_raw(path: Column) -> Column:
    return extension(path).isin(*RAW_EXTENSIONS)


def is_supported(path: Column) -> Column:
    return extension(path).isin(*RAW_EXTENSIONS, *OTHER_EXTENSIONS)


def file_label(path: Column) -> Column:
    """The extension in upper case, or FILE."""
    return F.coalesce(F.nullif(F.upper(extension(path)), F.lit("")), F.lit("FILE"))


def legacy_sidecar_image(name: Column) -> Column:
    """Image name of ``img.ext[.<6 hex>].rrdata``; null for other names."""
    base = F.regexp_extract(name, r"^(.+)\.rrdata$", 1)
    return F.when(base != "", F.regexp_replace(base, r"^(.+)\.[0-9a-fA-F]{6}$", "$1"))


def legacy_sidecar_copy(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"^.+\.([0-9a-fA-F]{6})\.rrdata$", 1), F.lit(""))


def ancestors(path: Column) -> Column:
    """All folders above a path, nearest last: ``/a/b/c.jpg`` has /a and /a/b."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def folders_above(path: Column) -> Column:
    """As ancestors, but empty for paths right under the root."""
    return F.when(F.size(F.split(path, "/")) > 2, ancestors(path)).otherwise(F.array().cast("array<string>"))


def resize_target(width: Column, height: Column, mode: str, value: int, dont_enlarge: bool) -> tuple[Column, Column]:
    """Size after a resize by long edge, short edge, width or height; ratios are 32-bit, as sizes depend on it."""
    if mode == "long":
        by_width = width >= height
    elif mode == "short":
        by_width = width <= height
    else:
        by_width = F.lit(mode == "width")
    v = F.lit(value)
    ratio_h = (height.cast("float") / width.cast("float")).cast("float")
    ratio_w = (width.cast("float") / height.cast("float")).cast("float")
    scaled = lambda r: F.round((v.cast("float") * r).cast("float"), 0).cast("int")
    keep = F.when(by_width, width <= v).otherwise(height <= v) if dont_enlarge else F.lit(False)
    w = F.when(keep, width).when(by_width, v).otherwise(scaled(ratio_w))
    h = F.when(keep, height).when(by_width, scaled(ratio_h)).otherwise(v)
    return w.cast("int"), h.cast("int")
