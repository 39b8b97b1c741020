"""Reading listings, lens databases, albums and logs; writing catalogs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..operators.benchmark import bench_json
from ..storage import partitions_for, written
from .versions import Table


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of folders: (path, modified, size) of what is in them; size is null for a folder."""
    for batch in batches:
        out: list[tuple] = []
        for folder in batch.column(0).to_pylist():
            store, path = fs.FileSystem.from_uri(folder)
            for x in store.get_file_info(fs.FileSelector(path)):
                out.append((folder.rstrip("/") + "/" + x.base_name, None if x.mtime_ns is None else x.mtime_ns // 1_000_000_000, x.size if x.type == fs.FileType.File else None))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "modified", "size"])


def list_images(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """source_path, modified (epoch seconds) and size of image files; no content is read.

    Folders are listed by tasks, a level at a time, and each level is written, so no list of all files is held
    anywhere.  ``root`` is a path or a URI that Arrow's file systems know.  As in Spark's own listings, what begins with
    a dot or an underscore is left out.
    """
    start = root if "://" in root else "file://" + root
    level = spark.createDataFrame(pa.table({"path": [start.rstrip("/")]}))
    levels: list[DataFrame] = []
    while True:
        many = partitions_for(level, mb_each=1, least=1)
        found = level.repartition(max(many, spark.sparkContext.defaultParallelism)).mapInArrow(_listed, "path string, modified long, size long")
        found = written(found.where(~F.substring_index("path", "/", -1).rlike("^[._]")), "listed")
        levels.append(found.where("size is not null"))
        level = found.where("size is null").select("path")
        if not recursive or level.isEmpty():
            break
    every = reduce(DataFrame.unionByName, levels)
    return every.select(F.regexp_replace("path", "^file://", "").alias("source_path"), "modified", "size").where(paths.is_supported(F.col("source_path")))


LENS_SCHEMA = "maker array<struct<_VALUE string, _lang string>>, model array<struct<_VALUE string, _lang string>>, mount array<string>, cropfactor double, calibration struct<distortion array<struct<_model string, _focal double, _a double, _b double, _c double, _k1 double, _k2 double, _k3 double>>, tca array<struct<_model string, _focal double, _vr double, _vb double>>, vignetting array<struct<_model string, _focal double, _aperture double, _distance double, _k1 double, _k2 double, _k3 double>>>"


def read_lens_db(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(lenses, long calibration table) of a folder of lens XML files."""
    raw = spark.read.format("xml").option("rowTag", "lens").schema(LENS_SCHEMA).load(folder)
    named = lambda c, lang: F.try_element_at(F.filter(c, lambda x: x["_lang"].isNotNull() == F.lit(lang)), F.lit(1))["_VALUE"]
    rows = raw.select(named("maker", False).alias("maker"), F.coalesce(named("model", True), named("model", False)).alias("model"), named("model", False).alias("canonical"), "cropfactor", "calibration").where("maker is not null and model is not null")
    rows = rows.withColumn("lens_id", F.xxhash64("maker", "canonical", "cropfactor")).withColumn("pos", F.monotonically_increasing_id())
    parts = []
    for kind in ("distortion", "tca", "vignetting"):
        e = rows.select("lens_id", F.explode(f"calibration.{kind}").alias("c"))
        zero, model = F.lit(0.0), F.col("c._model")
        if kind == "distortion":
            p = [F.when(model == "ptlens", F.coalesce(f"c._{a}", zero)).when(model.isin("poly3", "poly5"), F.coalesce(f"c._{k}", zero)).otherwise(0.0) for a, k in (("a", "k1"), ("b", "k2"), ("c", "k3"))]
            more = [F.lit(None).cast("double")] * 2
        elif kind == "tca":
            p, more = [F.coalesce("c._vr", F.lit(1.0)), F.coalesce("c._vb", F.lit(1.0)), F.lit(0.0)], [F.lit(None).cast("double")] * 2
        else:
            p, more = [F.coalesce(f"c._{k}", zero) for k in ("k1", "k2", "k3")], [F.col("c._aperture"), F.col("c._distance")]
        parts.append(e.select("lens_id", F.lit(kind).alias("kind"), model.alias("model"), F.col("c._focal").alias("focal"), more[0].alias("aperture"), more[1].alias("distance"), *[x.alias(f"p{k}") for k, x in enumerate(p, 1)]))
    return rows.drop("calibration"), parts[0].unionByName(parts[1]).unionByName(parts[2])


#: at and first are in documents in parts only: the node's place among its siblings, and the place of the first path.
NODE_SCHEMA = "array<struct<id string, name string, images array<string>, children string, at int, first long>>"
#: Paths in a part of an album.
PART = 5000


def albums(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members) of nested album documents, JSON texts in column ``tree``; one pass a level of nesting.

    nodes has id, parent_id, kind, name and pos among its siblings; members album_id, pos and path.
    """
    level = documents.select(F.lit(None).cast("string").alias("parent_id"), F.col("tree").alias("below"))
    levels: list[DataFrame] = []
    while True:
        found = level.select("parent_id", F.posexplode(F.from_json("below", NODE_SCHEMA)).alias("at", "n")).select("parent_id", F.coalesce("n.at", F.col("at") + 1).alias("pos"), "n.*").drop("at")
        found = written(found, "album-level")
        levels.append(found)
        level = found.where("children is not null").select(F.col("id").alias("parent_id"), F.col("children").alias("below"))
        if level.isEmpty():
            break
    every = reduce(DataFrame.unionByName, levels)
    nodes = every.select("id", "parent_id", F.when(F.col("children").isNull(), "album").otherwise("group").alias("kind"), "name", "pos")
    members = every.where("children is null").select(F.col("id").alias("album_id"), (F.coalesce("first", F.lit(1)) - 1).alias("before"), F.posexplode("images").alias("at", "path"))
    return nodes, members.select("album_id", (F.col("before") + F.col("at") + 1).cast("int").alias("pos"), "path")


def read_albums(spark: SparkSession, tree: str) -> tuple[DataFrame, DataFrame]:
    """As ``albums``, of one document."""
    return albums(spark.createDataFrame([(tree,)], "tree string"))


def album_documents(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """id, pos and doc: JSON of each node without a parent, put together from the leaves up, a pass a level.

    An album's paths and a group's parts are one JSON text by the format.  Siblings are in the order
    of pos, where nodes have it, then of id.
    """
    text = lambda c: F.regexp_extract(F.to_json(F.array(F.col(c))), r"(?s)^\[(.*)\]$", 1)
    nodes = nodes if "pos" in nodes.columns else nodes.withColumn("pos", F.lit(0))
    images = members.groupBy("album_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text("path").alias("p")))), lambda x: x["p"]), ", ").alias("images"))
    head = F.concat(F.lit('{"id": '), text("id"), F.lit(', "name": '), text("name"))
    rows = nodes.join(images, F.col("id") == F.col("album_id"), "left").select("id", "parent_id", "kind", "pos", head.alias("head"), F.coalesce("images", F.lit("")).alias("images"))
    album = F.concat("head", F.lit(', "images": ['), "images", F.lit("]}"))
    # open groups wait for all of their parts
    now = written(rows.select("id", "parent_id", "pos", "head", F.when(F.col("kind") != "group", album).alias("doc")), "album-docs")
    while not now.where("doc is null").isEmpty():
        parts = now.where("parent_id is not null").groupBy(F.col("parent_id").alias("_up")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "doc"))), lambda x: x["doc"]), ", ").alias("_in"), F.bool_and(F.col("doc").isNotNull()).alias("_all"))
        joined = now.join(parts, F.col("id") == F.col("_up"), "left")
        group = F.when(F.coalesce("_all", F.lit(True)), F.concat("head", F.lit(', "children": ['), F.coalesce("_in", F.lit("")), F.lit("]}")))
        now = written(joined.select("id", "parent_id", "pos", "head", F.coalesce("doc", group).alias("doc")), "album-docs")
    return now.where("parent_id is null").select("id", "pos", "doc")


def album_parts(nodes: DataFrame, members: DataFrame, most: int = PART) -> DataFrame:
    """doc: JSON documents in parts, each with ``most`` paths of one album at most and the groups above it.

    Whatever the size of an album or a library, no row is longer than that.  ``albums_of_parts`` puts them together;
    places of paths are from 1 and have no gaps, as ``albums`` gives them.
    """
    nodes = nodes if "pos" in nodes.columns else nodes.withColumn("pos", F.lit(1))
    # the head of a node's text, open for its paths or children
    head = F.regexp_replace(F.to_json(F.struct("id", "name", F.col("pos").cast("int").alias("at"))), r"\}$", ", ")
    heads = nodes.select("id", "parent_id", "kind", head.alias("head"))
    first = F.floor((F.col("pos") - 1) / most).cast("long") * most + 1
    paths_of = members.groupBy(F.col("album_id").alias("id"), first.alias("first")).agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"])).alias("images"))
    album = F.concat("head", F.lit('"first": '), F.coalesce("first", F.lit(1)).cast("string"), F.lit(', "images": '), F.coalesce("images", F.lit("[]")), F.lit("}"))
    own = heads.where("kind <> 'group'").join(paths_of, "id", "left").select("parent_id", album.alias("doc"))
    empty = heads.where("kind = 'group'").join(nodes.select(F.col("parent_id").alias("id")), "id", "left_anti").select("parent_id", F.concat("head", F.lit('"children": []}')).alias("doc"))
    now, done = written(own.unionByName(empty), "album-parts"), []
    while True:
        done.append(now.where("parent_id is null").select("doc"))
        open_parts = now.where("parent_id is not null")
        if open_parts.isEmpty():
            return reduce(DataFrame.unionByName, done)
        above = heads.select(F.col("id").alias("_up"), F.col("parent_id").alias("_far"), "head")
        now = written(open_parts.join(above, F.col("parent_id") == F.col("_up")).select(F.col("_far").alias("parent_id"), F.concat("head", F.lit('"children": ['), "doc", F.lit("]}")).alias("doc")), "album-parts")


def albums_of_parts(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``albums``, of what ``album_parts`` gave."""
    nodes, members = albums(parts.select(F.concat(F.lit("["), "doc", F.lit("]")).alias("tree")))
    return nodes.distinct(), members


def write_albums(nodes: DataFrame, members: DataFrame) -> str:
    """The nested document of one library again, a text by the format."""
    found = album_documents(nodes, members).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "doc"))), lambda x: x["doc"]), ", ").alias("doc")).first()
    return f"[{found['doc'] or ''}]"


def read_bench_log(spark: SparkSession, path: str) -> DataFrame:
    """One row a pasted log: run_json between its markers."""
    return bench_json(spark.read.text(path, wholetext=True))


def write_catalog(catalog: DataFrame, folder: str, buckets: int = 64, order: str = "path", stats: tuple[str, ...] = ()) -> Table:
    """The catalog as a table in versions: hash buckets of the source path, cut by ranges of ``order`` into files of bounded size.

    Only the buckets at hand are replaced.  ``Table.read`` leaves files out by ``order`` and ``stats``.
    """
    table = Table(catalog.sparkSession, folder, key="source_path", order=order if order in catalog.columns else "source_path", stats=stats, buckets=buckets)
    if table.manifest() is None:
        table.replace(catalog)
    else:
        table.merge(catalog, lambda _, rows: rows)
    return table
