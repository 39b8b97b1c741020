"""Filters, search terms, sorting and paging of the catalog."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import storage
from ..functions import exif, paths

# Fixed value: fields of a search term, in the order in which they are tried.  As `f` and `s` come
# before `focal`, and colon and sign may be missing, `focal>50` is the field `f` with the value
# `ocal>50`, and the word `sunset` the field `s` with the value `unset`.
FIELDS = "iso aperture f shutter s focal mm rating color camera make model lens".split()
TERM = re.compile(r"^(" + "|".join(FIELDS) + r")\s*:?\s*(>=|<=|>|<|=)?\s*(.+)$", re.I)
#: The same fields, longest first and only with a colon or a sign.
STRICT_TERM = re.compile(r"^(" + "|".join(sorted(FIELDS, key=len, reverse=True)) + r")\s*(?::\s*(>=|<=|>|<|=)?|(>=|<=|>|<|=))\s*(.+)$", re.I)
NUMERIC = {"iso", "aperture", "f", "shutter", "s", "focal", "mm", "rating"}


def numbers(catalog: DataFrame) -> DataFrame:
    """Adds the numbers in EXIF texts that terms and sorting read; 0 where there is none."""
    return catalog.withColumns({
        "iso_n": F.coalesce(exif.first_number(F.col("iso")), F.lit(0.0)), "aperture_n": exif.aperture(F.col("fnumber")),
        "focal_n": exif.focal(F.col("focal_length")), "shutter_n": exif.shutter(F.col("exposure_time")),
    })


def _parse_float(text: str) -> float | None:
    m = re.match(r"\s*([+-]?(?:\d+\.?\d*|\.\d+))", text)
    return float(m[1]) if m else None


def _parse_shutter(text: str) -> float:
    parts = re.sub("s", "", text, count=1, flags=re.I).strip().split("/")
    if len(parts) == 2:
        a, b = _parse_float(parts[0]), _parse_float(parts[1])
        return a / b if a is not None and b else 0.0
    return _parse_float(parts[0]) or 0.0


def numeric_term(field: str, op: str, value: str) -> Column:
    column = F.col({"iso": "iso_n", "aperture": "aperture_n", "f": "aperture_n", "shutter": "shutter_n", "s": "shutter_n", "focal": "focal_n", "mm": "focal_n", "rating": "rating"}[field]).cast("double")
    number = _parse_shutter(value) if field in ("shutter", "s") else _parse_float(value)
    if number is None:  # nothing compares with what is no number
        return F.lit(False)
    return {">": column > number, "<": column < number, ">=": column >= number, "<=": column <= number, "=": column == number}[op]


def colour(tags: Column) -> Column:
    """The first colour tag, without its prefix; empty if none."""
    return F.coalesce(F.substring(F.try_element_at(F.filter(tags, lambda t: t.startswith("color:")), F.lit(1)), 7, 1 << 20), F.lit(""))


def text_term(field: str, op: str, value: str) -> Column:
    if op != "=":
        return F.lit(False)
    if field == "color":
        own = colour(F.col("tags"))
    elif field == "lens":
        own = F.lower(F.coalesce(F.col("lens"), F.lit("")))
    else:
        own = F.lower(F.concat_ws(" ", F.coalesce("make", F.lit("")), F.coalesce("model", F.lit(""))))
    return F.contains(own, F.lit(value))


def term(text: str, strict_fields: bool = False) -> Column:
    m = (STRICT_TERM if strict_fields else TERM).match(text)
    if m:
        field, value = m[1].lower(), m[m.lastindex].lower()
        op = (m[2] or (m[3] if strict_fields else None)) or "="
        return numeric_term(field, op, value) if field in NUMERIC else text_term(field, op, value)
    return F.exists(plain_tags(), lambda t: F.contains(t, F.lit(text.lower())))


def plain_tags() -> Column:
    """Lower-cased tags, each without its first ``user:``."""
    return F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.regexp_replace(F.lower(t), "^(.*?)user:", "$1"))


def condition(tags: list[str], text: str = "", mode: str = "AND", strict_fields: bool = False) -> Column:
    """One boolean column for a search; the catalog must have the columns of ``numbers``."""
    terms = [term(t, strict_fields) for t in tags]
    by_tags = reduce((lambda a, b: a | b) if mode == "OR" else (lambda a, b: a & b), terms) if terms else F.lit(True)
    words = text.strip().lower()
    by_text = (F.contains(F.lower(paths.file_name(F.col("path"))), F.lit(words)) | F.exists(plain_tags(), lambda t: F.contains(t, F.lit(words)))) if words else F.lit(True)
    return by_tags & by_text


def search(catalog: DataFrame, tags: list[str], text: str = "", mode: str = "AND", strict_fields: bool = False) -> DataFrame:
    return catalog.where(condition(tags, text, mode, strict_fields))


def filter_catalog(catalog: DataFrame, rating: int = 0, raw: str = "all", edited: str = "all", colors: list[str] | None = None) -> DataFrame:
    """rating 0: all, -1: none given, 5: just 5, else at least; raw and edited: all, only or not."""
    where = {0: F.lit(True), -1: F.col("rating") == 0, 5: F.col("rating") == 5}.get(rating, F.col("rating") >= rating)
    for flag, column in ((raw, F.col("is_raw")), (edited, F.col("is_edited"))):
        where = where & (column if flag == "only" else ~column if flag == "not" else F.lit(True))
    if colors:
        own = F.nullif(colour(F.col("tags")), F.lit(""))
        where = where & (own.isin(*[c for c in colors if c != "none"]) | (F.lit("none" in colors) & own.isNull()))
    return catalog.where(where)


def sort_keys(key: str, descending: bool = False) -> list[tuple[Column, bool]]:
    """Order of a list as (expression, downwards); ties go by name upwards in either direction, then by path."""
    name = F.collate(paths.file_name(F.col("path")), "UNICODE")
    date = F.coalesce("date_original", F.lit(""))
    main = {
        "name": [], "date": [F.col("modified")], "date_taken": [date, F.col("modified")], "iso": [F.col("iso_n")], "shutter_speed": [F.col("shutter_n")],
        "aperture": [F.col("aperture_n")], "focal_length": [F.col("focal_n")], "rating": [F.col("rating")], "edited": [F.col("is_edited")],
    }[key]
    main = main or [name]
    return [*((c, descending) for c in main), (name, False), (F.col("path"), False)]


def sort_catalog(catalog: DataFrame, key: str = "name", descending: bool = False) -> DataFrame:
    return catalog.orderBy(*(c.desc() if down else c.asc() for c, down in sort_keys(key, descending)))


def ranked_catalog(catalog: DataFrame, key: str = "name", descending: bool = False, slot: str = "rank") -> DataFrame:
    """Adds the place in the order of ``sort_catalog``, from 1, without one task that sorts everything."""
    rows = storage.numbered(catalog.withColumn("_all", F.lit(0)), "_all", sort_keys(key, descending), slot)
    return rows.withColumn(slot, F.col(slot) + 1).drop("_all")


def page(sorted_catalog: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return sorted_catalog.offset(offset).limit(limit)


def filter_tree(nodes: DataFrame, query: str) -> DataFrame:
    """Folders whose name contains the query, and all folders above them."""
    hits = nodes.where(F.contains(F.lower(paths.file_name(F.col("path"))), F.lit(query.lower())))
    wanted = hits.select(F.explode(F.concat(paths.folders_above(F.col("path")), F.array("path"))).alias("path")).distinct()
    return nodes.join(wanted, "path", "left_semi")
