"""Frame-time benchmarks: pasted logs, gaps between frames, phases, statistics and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import storage

BUDGET_MS = 1000 / 60
SLACK_MS = 2.0
METRICS = ["duration_ms", "frame_count", "avg_fps", "worst_ms", "dropped_count", "dropped_ms"]
#: For these more is better.
RISING = ["frame_count", "avg_fps"]


def bench_json(logs: DataFrame, column: str = "value") -> DataFrame:
    """Adds ``json``: what stands between the markers of a pasted console log, without the console's own marks."""
    text = F.regexp_replace(column, r"(?m)^<.*\R?", "")
    text = F.regexp_replace(text, r"(?m)^\[[A-Za-z]+\] ", "")
    text = F.regexp_replace(text, r"(?m) \([^()\n]*, line \d+\)$", "")
    inner = F.regexp_extract(text, r"(?s)START[^\n]*\n(.*?)\n[^\n]*END", 1)
    return logs.withColumn("json", F.nullif(F.trim(inner), F.lit("")))


def frame_durations(frames: DataFrame) -> DataFrame:
    """Adds gap_ms, the time since the frame before in the run; a run may have most of the frames."""
    rows = storage.scan(storage.ordered(frames, ["run_id"], ["ts_ms"], "_row"), ["run_id"], {"_before": ("lag", "ts_ms")})
    return rows.withColumn("gap_ms", F.col("ts_ms") - F.col("_before")).drop("_row", "_before")


def assign_phases(gaps: DataFrame, phases: DataFrame) -> DataFrame:
    """Each gap with the phase in whose time, start excluded, it ends.

    Time is cut into buckets, for each phase of the power of two next to its length, so a phase is in three
    buckets at most and a gap looks in one bucket for each of the powers that there are: an equi-join of rows,
    whatever the number of runs and phases.
    """
    length = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(1.0))
    fine = phases.where("end_ms > start_ms").withColumn("_power", F.ceil(F.log2(length)).cast("int"))
    powers = [r[0] for r in fine.select("_power").distinct().collect()]  # as many as a double has exponents
    bucket = lambda at: F.floor(at / F.pow(F.lit(2.0), F.col("_power"))).cast("long")
    spread = fine.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("start_ms")), bucket(F.col("end_ms"))))).withColumnRenamed("run_id", "_run")
    probes = gaps.withColumn("_power", F.explode(F.array(*map(F.lit, powers)).cast("array<int>"))).withColumn("_bucket", bucket(F.col("ts_ms"))).alias("g")
    p = spread.alias("p")
    met = probes.join(p, (F.col("g.run_id") == F.col("p._run")) & (F.col("g._power") == F.col("p._power")) & (F.col("g._bucket") == F.col("p._bucket")) & (F.col("ts_ms") > F.col("start_ms")) & (F.col("ts_ms") <= F.col("end_ms")))
    return met.select(*[F.col(f"g.{c}") for c in gaps.columns], *[F.col(f"p.{c}") for c in phases.columns if c != "run_id"])


def frame_metrics(gaps: DataFrame, phases: DataFrame) -> DataFrame:
    late = F.col("gap_ms") > BUDGET_MS + SLACK_MS
    rows = assign_phases(gaps.where("gap_ms is not null"), phases)
    return rows.groupBy("run_id", "iteration", "warmup", "phase").agg(
        F.first(F.col("end_ms") - F.col("start_ms")).alias("duration_ms"), F.count(F.lit(1)).alias("frame_count"), (1000 / F.avg("gap_ms")).alias("avg_fps"),
        F.max("gap_ms").alias("worst_ms"), F.count_if(late).alias("dropped_count"), F.coalesce(F.sum(F.when(late, F.col("gap_ms"))), F.lit(0.0)).alias("dropped_ms"),
    )


def bench_stats(metrics: DataFrame) -> DataFrame:
    """median, p95 (nearest rank) and sample deviation by run, phase and metric, without warm-up."""
    stack = ", ".join(f"'{m}', cast({m} as double)" for m in METRICS)
    long = metrics.where(~F.col("warmup")).selectExpr("run_id", "phase", f"stack({len(METRICS)}, {stack}) as (metric, value)")
    return long.groupBy("run_id", "phase", "metric").agg(
        F.percentile("value", 0.5).alias("median"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("stdev")
    )


def bench_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of medians in percent, and whether that is better; null where there was nothing before."""
    both = before.select("phase", "metric", F.col("median").alias("before")).join(after.select("phase", "metric", F.col("median").alias("after")), ["phase", "metric"])
    change = F.when(F.col("before") != 0, (F.col("after") - F.col("before")) / F.col("before") * 100)
    better = F.when(change == 0, "same").when((change > 0) == F.col("metric").isin(*RISING), "better").otherwise("worse")
    return both.withColumn("change", change).withColumn("verdict", F.when(change.isNull(), "n/a").otherwise(better))


def bracket_sets(frames: DataFrame) -> DataFrame:
    """Sets for merging: error (of the first bad frame) or the reference frame at half the positions."""
    bad = F.when(F.col("iso").isNull(), "no ISO").when(F.col("exposure").isNull(), "no exposure")
    row = F.struct("pos", "path", bad.alias("bad"), "width", "height")
    sets = frames.groupBy("set_id").agg(F.array_sort(F.collect_list(row)).alias("f"))
    first = F.col("f")[0]
    odd = F.filter("f", lambda x: (x["width"] != first["width"]) | (x["height"] != first["height"]) | x["bad"].isNotNull())
    at = F.try_element_at(odd, F.lit(1))
    error = F.when(F.size("f") < 2, F.lit("fewer than 2 frames")).when(at.isNotNull(), F.concat(at["path"], F.lit(": "), F.coalesce(at["bad"], F.lit("size differs"))))
    return sets.select("set_id", F.size("f").alias("n"), error.alias("error"), F.when(error.isNull(), F.element_at("f", (F.floor(F.size("f") / 2) + 1).cast("int"))["path"]).alias("reference"))
