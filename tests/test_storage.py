"""Sizes, numbering, and tables that a job owns."""

import glob
import os

from pyspark.sql import functions as F

from fotoloom import storage


def test_size_of_a_join_is_the_sum_of_its_files(spark, tmp_path):
    spark.range(2000).withColumn("x", F.col("id") % 7).write.parquet(f"{tmp_path}/a")
    spark.range(2000).withColumn("y", F.col("id") % 5).write.parquet(f"{tmp_path}/b")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.read.parquet(f"{tmp_path}/b")
    files = sum(os.path.getsize(f) for f in glob.glob(f"{tmp_path}/*/part-*"))
    assert storage.size_of(a.join(b, "id")) == files
    assert storage.partitions_for(a.join(b, "id").join(a.withColumnRenamed("x", "z"), "id")) == 8
    assert storage.partitions_for(a, mb_each=1, least=1) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_numbered_with_one_hot_key_nulls_ties_and_clashing_names(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 1000 == 1, None).otherwise("hot").alias("k"), (F.col("id") % 50).alias("v"), "id", F.lit(1).alias("_row"), F.lit(2).alias("_part"), F.lit(3).alias("_shift"))
    out = storage.numbered(rows, "k", [(F.col("v") * 2, True), "id"], "at")
    assert out.columns == [*rows.columns, "at"]
    got = {}
    for r in out.collect():
        got.setdefault(r["k"], []).append((r["at"], -r["v"], r["id"]))
    for found in got.values():
        found.sort()
        assert [f[0] for f in found] == list(range(len(found))) and [f[1:] for f in found] == sorted(f[1:] for f in found)
    assert {k: len(v) for k, v in got.items()} == {"hot": 2998, None: 2}
    assert storage.numbered(rows.limit(0), "k", ["id"], "at").count() == 0


def test_scratch_drops_what_was_written_inside(spark, tmp_path):
    kept = storage.written(spark.range(3), "kept")
    with storage.scratch():
        gone = storage.written(spark.range(5), "gone")
        named = storage.bucketed(spark.range(5), "named", "id", 2)
        assert gone.count() == 5 and named.count() == 5
    assert kept.count() == 3
    assert not os.path.exists(gone._written_to.removeprefix("file://")) and not spark.catalog.tableExists(named._table)
    storage.discard(kept)


def _plain(rows, out):
    """Running columns by a loop over sorted rows."""
    want, now = [], {}
    for k, j, v, x in rows:
        n, total, before, last = now.get((k, j), (0, None, None, None))
        total = total if x is None else (total or 0) + x
        want.append((k, j, v, x, n, before, last, total))
        now[k, j] = (n + 1, total, v, x if x is not None else last)
    return sorted(want, key=repr)


def test_scan_takes_up_what_a_partition_left_of_a_key(spark, monkeypatch):
    for hot in (lambda i: True, lambda i: i % 10 > 0, lambda i: False):
        rows = sorted([(None if i % 97 == 5 else "hot" if hot(i) else f"k{i % 40:02}", 1, i, None if i % 3 else i) for i in range(900)], key=lambda r: (r[0] is not None, r[0] or "", r[2]))
        df = spark.createDataFrame(rows, "k string, j int, v long, x long").repartition(3)
        cut = storage.ordered(df, ["k", "j"], ["v"])
        assert cut.select(F.shiftright("_row", 33)).distinct().count() > 3
        out = storage.scan(cut, ["k", "j"], {"n": ("number", None), "before": ("lag", "v"), "last": ("last", "x"), "total": ("sum", "x")}).drop("_row")
        assert sorted(map(tuple, out.collect()), key=repr) == _plain(rows, out)
        widest = storage.scan(cut, ["k", "j"], {"n": ("number", None)})._jdf.queryExecution().optimizedPlan().toString()
        assert "shiftright" in widest  # windows are of a partition's part of a key
    assert storage.scan(storage.ordered(df.limit(0), ["k"], ["v"]), ["k"], {"n": ("number", None)}).count() == 0
