"""Photo-like views over the given tables, and the same views as SQL for comparison runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Expressions of the catalog; {s} is the string type, {epoch} and {fmt} depend on the engine.
_CATALOG = [
    "o_orderkey as idx",
    "'/lib/f' || cast(cast(floor(o_orderkey/3) as bigint) % 97 as {s}) || '/IMG_' || lpad(cast(cast(floor(o_orderkey/3) as bigint) as {s}), 8, '0') || '.' || case o_orderkey % 3 when 0 then 'ARW' when 1 then 'jpg' else 'tif' end as source_path",
    "case when o_orderkey % 11 = 0 then substr(md5(cast(o_orderkey as {s})), 1, 6) end as copy_id",
    "{epoch} as modified",
    "cast(o_orderkey % 6 as int) as rating",
    "o_orderstatus = 'P' as is_edited",
    "case when o_orderkey % 9 = 0 then null else cast(100 * (1 + o_custkey % 7) as {s}) end as iso",
    "case when o_orderkey % 5 = 0 then null else '1/' || cast(10 * (1 + o_custkey % 40) as {s}) || ' s' end as exposure_time",
    "'f/' || cast(1 + o_custkey % 8 as {s}) || '.' || cast(o_orderkey % 10 as {s}) as fnumber",
    "cast(20 + o_custkey % 180 as {s}) || ' mm' as focal_length",
    "case when o_orderkey % 13 = 0 then null else {fmt} end as date_original",
    "case o_custkey % 3 when 0 then 'SONY' when 1 then 'NIKON' else 'Canon' end as make",
    "case o_custkey % 3 when 0 then 'ILCE-7RM5' when 1 then 'Z 8' else 'EOS R5' end as model",
    "case when o_custkey % 4 = 0 then null else 'FE ' || cast(20 + o_custkey % 5 * 15 as {s}) || 'mm F1.8' end as lens",
    "nullif(concat_ws('|', case when o_orderkey % 8 <> 7 then lower(substr(o_orderpriority, 3)) end, case when o_orderkey % 4 = 0 and o_orderkey % 8 <> 7 then 'color:' || case o_custkey % 5 when 0 then 'red' when 1 then 'green' when 2 then 'blue' when 3 then 'yellow' else 'purple' end end, case when o_orderkey % 3 = 0 and o_orderkey % 8 <> 7 then 'user:trip' || cast(o_orderkey % 10 as {s}) end), '') as tag_text",
]
_SPARK = {"s": "string", "epoch": "unix_timestamp(o_orderdate)", "fmt": "date_format(o_orderdate, 'yyyy:MM:dd HH:mm:ss')"}
_DUCK = {"s": "varchar", "epoch": "cast(epoch(o_orderdate) as bigint)", "fmt": "strftime(o_orderdate, '%Y:%m:%d %H:%M:%S')"}
PATH = "case when copy_id is null then source_path else source_path || '?vc=' || copy_id end as path"

CATALOG_SQL = (
    "cat0 as (select " + ", ".join(e.format(**_DUCK) for e in _CATALOG) + " from orders), "
    f"catalog as (select *, {PATH}, case when tag_text is null then null else string_split(tag_text, '|') end as tags, "
    "regexp_extract(source_path, '^(.*)/[^/]*$', 1) as folder, regexp_extract(source_path, '([^/]*)$', 1) as name, source_path like '%.ARW' as is_raw from cat0)"
)
#: Numbers in EXIF text, as search and sorting read them.
NUMBERS_SQL = (
    "numbers as (select *, coalesce(cast(iso as double), 0) as iso_n, "
    "coalesce(cast(nullif(regexp_extract(fnumber, '([0-9]+(\\.[0-9]+)?)', 1), '') as double), 0) as aperture_n, "
    "coalesce(cast(nullif(regexp_extract(focal_length, '([0-9]+(\\.[0-9]+)?)', 1), '') as double), 0) as focal_n, "
    "coalesce(1.0 / cast(nullif(regexp_extract(exposure_time, '/([0-9]+)', 1), '') as double), 0) as shutter_n from catalog)"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a photo: idx, paths, times, rating, EXIF texts and tags."""
    base = table(spark, sf_dir, "orders").selectExpr(*[e.format(**_SPARK) for e in _CATALOG])
    return base.selectExpr(
        "*", PATH, "split(tag_text, '[|]') as tags", "regexp_extract(source_path, '^(.*)/[^/]*$', 1) as folder", "substring_index(source_path, '/', -1) as name", "endswith(source_path, '.ARW') as is_raw",
    )


#: One edit document a photo, some without a version, some of version 2, with rating 6, or cut short.
_DOC = (
    "'{' || case when o_orderkey % 17 = 0 then '' else '\"version\":' || case when o_orderkey % 19 = 0 then '2' else '1' end || ',' end || '\"rating\":' || "
    "case when o_orderkey % 23 = 0 then '6' else cast(o_orderkey % 6 as {s}) end || ',\"adjustments\":{{\"exposure\":' || cast(o_orderkey % 5 as {s}) || '.5,\"contrast\":' || cast(o_custkey % 3 as {s}) || "
    "',\"rotation\":' || cast(o_orderkey % 2 as {s}) || '}},\"tags\":[\"color:red\",\"t' || cast(o_orderkey % 4 as {s}) || '\"],\"futureUi\":{{\"p\":' || cast(o_orderkey % 3 as {s}) || '}}' || case when o_orderkey % 29 = 0 then '' else '}' end"
)


def _doc(kind: dict) -> str:
    # the braces of the text itself stand alone, those doubled are for format()
    return _DOC.replace("'{' ||", "'{{' ||").replace("else '}' end", "else '}}' end").format(**kind)


SIDECARS_SQL = CATALOG_SQL + f", sidecars as (select c.idx, c.source_path, c.copy_id, c.modified, {_doc(_DUCK)} as doc from catalog c join orders on o_orderkey = idx)"


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """idx, source_path, copy_id, modified and doc, JSON text in good and bad forms."""
    docs = table(spark, sf_dir, "orders").selectExpr("o_orderkey as idx", f"{_doc(_SPARK)} as doc")
    return catalog(spark, sf_dir).select("idx", "source_path", "copy_id", "modified").join(docs, "idx")


TILES_SQL = "tiles as (select vec_id as img_id, cast(unnest(range(1, 65)) as int) as pos, unnest(list_transform(embedding, lambda x: cast(least(255, greatest(0, floor(128 + 400 * cast(x as double)))) as int))) as luma from embeddings)"
TILES_DUP_SQL = TILES_SQL + ", tiles_dup as (select * from tiles union all select img_id + 1000000, pos, cast(least(255, luma + case when (pos * 7 + img_id) % 11 = 0 then 6 else 0 end) as int) from tiles where img_id % 4 = 0 union all select img_id + 2000000, pos, luma from tiles where img_id % 10 < 2)"


def images(spark: SparkSession, sf_dir: str, copies: bool = False) -> DataFrame:
    """img_id, width, height and luma: grey 8x8 images, one row each; ``copies`` adds near copies and equal ones."""
    own = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("img_id"), F.transform("embedding", lambda x: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 400 * x.cast("double"))).cast("int")).cast("int")).alias("luma"))
    if copies:
        step = lambda v, i: F.least(F.lit(255), v + F.when(((i + 1) * 7 + F.col("img_id")) % 11 == 0, 6).otherwise(0)).cast("int")
        near = own.where("img_id % 4 = 0").withColumn("luma", F.transform("luma", step)).withColumn("img_id", F.col("img_id") + 1000000)
        own = own.unionByName(near).unionByName(own.where("img_id % 10 < 2").withColumn("img_id", F.col("img_id") + 2000000))
    return own.select("img_id", F.lit(8).alias("width"), F.lit(8).alias("height"), "luma")


def rgb_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, width, height and pixels: colour 4x4 images of the first 48 numbers of each vector, 0..1."""
    near = F.transform(F.slice("embedding", 1, 48), lambda x: (F.least(F.lit(255), F.greatest(F.lit(0), F.floor(128 + 400 * x.cast("double")))).cast("double") / 255).cast("float"))
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("/img/"), F.col("vec_id")).alias("path"), F.lit(4).alias("width"), F.lit(4).alias("height"), near.alias("pixels"))


RGB_SQL = (
    "rgb_long as (select '/img/' || vec_id as path, cast(unnest(range(0, 48)) as int) as k, unnest(list_transform(embedding[1:48], lambda x: cast(least(255, greatest(0, floor(128 + 400 * cast(x as double)))) as int))) as v from embeddings), "
    "rgb as (select path, cast(k // 3 as int) as pos, max(case when k % 3 = 0 then v end) as r, max(case when k % 3 = 1 then v end) as g, max(case when k % 3 = 2 then v end) as b from rgb_long group by 1, 2)"
)
