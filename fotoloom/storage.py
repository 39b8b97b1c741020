"""Tables written between stages, and numbering of rows without one big sort task."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_owners: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Owns the tables that are written inside, and drops them at the end: what was made of them must be stored by then."""
    made: list[DataFrame] = []
    _owners.append(made)
    try:
        yield
    finally:
        _owners.remove(made)
        for table in made:
            discard(table)


def _owned(table: DataFrame) -> DataFrame:
    if _owners:
        _owners[-1].append(table)
    return table


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between stages: what spark.checkpoint.dir names.

    A folder of this machine is used only where that is unset and Spark runs in one process.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it is computed once and outlives executors.

    The shuffle files of the job go when it ends; nothing else reads them.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return _owned(out)


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``df`` as a table in ``buckets`` buckets of ``key``: joins on the key don't shuffle it again.

    A bucket is what a partition of ``repartition(buckets, key)`` is, so a task writes one file.
    """
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
    path = f"{shared_folder(spark)}/{own}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        df.repartition(buckets, key).write.bucketBy(buckets, key).option("compression", "zstd").option("path", path).saveAsTable(own)
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.table(own)
    out._written_to, out._table = path, own
    return _owned(out)


def discard(table: DataFrame) -> None:
    """Deletes a table that written() or bucketed() made and that no frame will read again."""
    spark = table.sparkSession
    if hasattr(table, "_table"):
        spark.sql(f"drop table if exists {table._table}")
    path = spark._jvm.org.apache.hadoop.fs.Path(table._written_to)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def size_of(df: DataFrame) -> int:
    """Bytes of the files that a frame reads, by the leaves of its optimized plan; leaves of unknown size count as none."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(n for n in sizes if n < 1 << 56)


def partitions_for(df: DataFrame, mb_each: int = 24, least: int = 8, most: int = 50_000) -> int:
    """Partitions that hold about ``mb_each`` MB of the files that a frame reads, spark.sql.shuffle.partitions at least.

    With fewer than that, a join would shuffle a table in buckets again.
    Shuffles have a block for each pair of tasks, so there are ``most`` partitions from about 1 TB on;
    larger ones are sorted with spills and streamed to Python in batches.
    """
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, -(-size_of(df) // (mb_each << 20))))


Order = str | Column | tuple[Column, bool]


def ordered(rows: DataFrame, keys: list[str], order: list[Order], row: str = "_row") -> DataFrame:
    """Rows range-partitioned and sorted by (keys, order) and written, with a number ``row`` that grows in that order.

    The high bits of ``row`` are those of the partition.  ``order`` has columns, or (expression, descending),
    which is worked out once a row.
    """
    tag = f"_{uuid.uuid4().hex[:8]}_by"  # the names of helping columns clash with none of the caller's
    made = {f"{tag}{k}": c[0] for k, c in enumerate(order) if isinstance(c, tuple)}
    by = [(F.col(f"{tag}{k}").desc() if c[1] else F.col(f"{tag}{k}").asc()) if isinstance(c, tuple) else c for k, c in enumerate(order)]
    n = partitions_for(rows)
    if size_of(rows) < 1 << 30:  # small inputs: four tasks a core do, whatever the number of shuffle partitions
        n = min(n, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    rows = rows.withColumns(made) if made else rows
    return written(rows.repartitionByRange(n, *keys, *by).sortWithinPartitions(*keys, *by).withColumn(row, F.monotonically_increasing_id()).drop(*made), "ordered")


def scan(cut: DataFrame, keys: list[str], made: dict[str, tuple[str, str | None]], row: str = "_row") -> DataFrame:
    """Adds running columns within ``keys`` to what ``ordered`` gave, whatever share of the rows one key has.

    ``made`` has name: (kind, column).  Kinds: number (from 0), lag (the value of the row before), last (the last
    value before the row that isn't null) and sum (up to the row, which counts).  Each partition is scanned by
    itself; the first key of a partition takes up what the partitions before it left of that key, which
    is a row a partition.
    """
    spark, tag = cut.sparkSession, f"_{uuid.uuid4().hex[:8]}_"
    part, key_columns = F.shiftright(row, 33), F.struct(*[F.col(k) for k in keys])
    edges = cut.groupBy(part.alias("part")).agg(F.min_by(key_columns, row).alias("first"), F.max_by(key_columns, row).alias("final")).orderBy("part").collect()  # a row a partition
    ends: dict[tuple[int, tuple], tuple] = {}
    carried: list[tuple] = []
    if len(edges) > 1:
        wanted = sorted({(e["part"], tuple(k)) for e in edges for k in (e["first"], e["final"])}, key=repr)
        at = F.broadcast(_small(spark, wanted, f"{tag}p", [f"{tag}k{i}" for i in range(len(keys))], cut, keys))
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{tag}k{i}")) for i, k in enumerate(keys)], part == F.col(f"{tag}p"))
        sums = []
        for kind, column in made.values():
            if kind == "number":
                sums.append(F.count(F.lit(1)))
            elif kind == "sum":
                sums.append(F.sum(column))
            else:
                sums.append(F.max_by(column, row if kind == "lag" else F.when(F.col(column).isNotNull(), F.col(row))))
        groups = cut.join(at, same).groupBy(f"{tag}p", *[f"{tag}k{i}" for i in range(len(keys))]).agg(*[x.alias(f"{tag}v{i}") for i, x in enumerate(sums)])
        ends = {(r[0], tuple(r[1 : 1 + len(keys)])): tuple(r[1 + len(keys) :]) for r in groups.collect()}  # two a partition at most
        kinds, now, left = [kind for kind, _ in made.values()], None, ()
        for e in edges:
            first, final = tuple(e["first"]), tuple(e["final"])
            if first == now:
                carried.append((e["part"], first, *left))
            mine = ends[e["part"], final]
            goes_on = first == final == now
            left = tuple(_joined(kind, a, b) for kind, a, b in zip(kinds, left, mine, strict=True)) if goes_on else mine
            now = final
    own = Window.partitionBy(part, *keys).orderBy(row)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    local = {"number": lambda c: F.row_number().over(own) - 1, "sum": lambda c: F.sum(c).over(own), "lag": lambda c: F.lag(c).over(own), "last": lambda c: F.last(c, ignorenulls=True).over(before)}
    out = cut.withColumns({name: local[kind](column) for name, (kind, column) in made.items()} | {f"{tag}n": F.row_number().over(own)})
    if carried:
        rows = [(p, k, *[x for x in values]) for p, k, *values in carried]
        columns = [f"{tag}v{i}" for i in range(len(made))]
        take = F.broadcast(_small(spark, [(p, k) for p, k, *_ in rows], f"{tag}p", [f"{tag}k{i}" for i in range(len(keys))], cut, keys, columns, [v for _, _, *v in rows], [out.schema[name].dataType for name in made]))
        same = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{tag}k{i}")) for i, k in enumerate(keys)], part == F.col(f"{tag}p"))
        out = out.join(take, same, "left")
        for column, (name, (kind, _)) in zip(columns, made.items(), strict=True):
            mine, more = F.col(name), F.col(column)
            if kind == "number":
                mine = mine + F.coalesce(more, F.lit(0))
            elif kind == "sum":
                mine = F.when(more.isNull(), mine).otherwise(F.coalesce(mine, F.lit(0)) + more)
            elif kind == "lag":
                mine = F.when(F.col(f"{tag}n") == 1, more).otherwise(mine)
            else:
                mine = F.coalesce(mine, more)
            out = out.withColumn(name, mine)
    return out.select(*cut.columns, *[F.col(name).cast("long").alias(name) if kind == "number" else F.col(name) for name, (kind, _) in made.items()])


def _joined(kind: str, before: Any, here: Any) -> Any:
    if kind in ("number", "sum"):
        return here if before is None else before if here is None else before + here
    return here if kind == "lag" or here is not None else before


def _small(spark: SparkSession, wanted: list[tuple], part: str, names: list[str], like: DataFrame, keys: list[str], more: list[str] = [], values: list[list] | None = None, types: list | None = None) -> DataFrame:  # noqa: B006
    """A few rows of (partition, keys, further values); an Arrow table needs no Python worker."""
    columns = {part: [p for p, _ in wanted]} | {n: [k[i] for _, k in wanted] for i, n in enumerate(names)} | {n: [v[i] for v in values or []] for i, n in enumerate(more)}
    kinds = ["long", *(like.schema[k].dataType for k in keys), *(types or [])]
    return spark.createDataFrame(pa.table(columns)).select(*[F.col(n).cast(t).alias(n) for n, t in zip(columns, kinds, strict=True)])


def numbered(rows: DataFrame, key: str, order: list[Order], slot: str) -> DataFrame:
    """Adds a gapless number from 0 within each of a few keys, without bringing a key to one task.

    Counts of (partition, key) come to the driver, so keys must be few; ``scan`` numbers within any keys.
    """
    row, part_name, shift_name, key_name = (f"_{uuid.uuid4().hex[:8]}_{x}" for x in ("row", "part", "shift", "key"))
    cut = ordered(rows, [key], order, row)
    part = F.shiftright(row, 33)
    counts = cut.groupBy(F.col(key).alias(key_name), part.alias(part_name)).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first"))
    found = sorted(map(tuple, counts.collect()), key=lambda r: (r[0] is not None, 0 if r[0] is None else r[0], r[1]))  # (partitions + keys) rows at most
    base, last, starts = 0, object(), []
    for k, p, n_rows, first in found:
        base = base if k == last else 0
        starts.append((k, p, base - first))
        base, last = base + n_rows, k
    spark = rows.sparkSession
    starts = pa.table({name: [s[k] for s in starts] for k, name in enumerate((key_name, part_name, shift_name))})  # an Arrow table needs no Python worker
    shift = F.broadcast(spark.createDataFrame(starts).select(F.col(key_name).cast(dict(rows.dtypes)[key]), F.col(part_name).cast("long"), F.col(shift_name).cast("long")))
    return cut.join(shift, F.col(key).eqNullSafe(F.col(key_name)) & (part == F.col(part_name))).withColumn(slot, F.col(row) + F.col(shift_name)).drop(row, key_name, part_name, shift_name)
