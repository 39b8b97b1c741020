"""Queries over images, similar pictures and streams."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from . import twins_pixels as twins
from .fixtures import RGB_SQL, TILES_DUP_SQL, TILES_SQL, images, rgb_images, table
from .operators import imaging, pixels, similar
from .queries_library import SCORES, tag_scores
from .registry import collector
from .sources.versions import Table
from .storage import shared_folder, written
from .streaming import streams

QUERIES, ORACLE_SQL, query = collector()
R = f"with {RGB_SQL} "
T = f"with {TILES_SQL} "
LUMA8 = "cast(least(255, (r * 218 + g * 732 + b * 74) >> 10) as int)"


@query("e10_histogram_bins", R + f", c as (select path, 'red' as channel, r as bin from rgb where pos % 2 = 0 union all select path, 'green', g from rgb where pos % 2 = 0 union all select path, 'blue', b from rgb where pos % 2 = 0 union all select path, 'luma', {LUMA8} from rgb where pos % 2 = 0) select path, channel, cast(bin as int) as bin, count(*) as n from c group by 1, 2, 3")
def e10(spark, d):
    return imaging.histogram_bins(_exact(spark, d))


def _exact(spark, d):
    """Pixels that give the 8-bit values back when they are scaled and cut: a bit is added to each."""
    return rgb_images(spark, d).withColumn("pixels", F.transform("pixels", lambda x: (x + F.lit(0.0005)).cast("float")))


@query("e10_library_histogram", R + f", c as (select path[:6] as folder, 'red' as channel, r as bin from rgb where pos % 2 = 0 union all select path[:6], 'green', g from rgb where pos % 2 = 0 union all select path[:6], 'blue', b from rgb where pos % 2 = 0 union all select path[:6], 'luma', {LUMA8} from rgb where pos % 2 = 0) select folder, channel, cast(bin as int) as bin, count(*) as n from c group by 1, 2, 3")
def e10l(spark, d):
    return imaging.library_histogram(_exact(spark, d).withColumn("folder", F.substring("path", 1, 6)))


@query("e10_histogram", twins.HISTOGRAM)
def e10h(spark, d):
    rows = imaging.histogram(_exact(spark, d)).select("path", "channel", F.posexplode("bins").alias("bin", "value"))
    return rows.withColumn("value", F.round("value", 6))


@query("e11_waveform", R + f", p as (select path, pos % 4 as x, r, g, b, {LUMA8} as l from rgb), c as (select path, 'red' as kind, 255 - r as y, x * 64 as x from p union all select path, 'green', 255 - g, x * 64 from p union all select path, 'blue', 255 - b, x * 64 from p union all select path, 'luma', 255 - l, x * 64 from p) select path, kind, cast(y as int) as y, cast(x as int) as x, count(*) as n from c group by 1, 2, 3, 4")
def e11(spark, d):
    return imaging.waveform(_exact(spark, d), "rgb")


@query("e11_parade", R + ", p as (select path, cast(floor((pos % 4) / 4.0 * 82) as int) as s, r, g, b from rgb), c as (select path, 255 - r as y, s as x from p union all select path, 255 - g, 87 + s from p union all select path, 255 - b, 174 + s from p) select path, 'parade' as kind, cast(y as int) as y, cast(x as int) as x, count(*) as n from c group by path, y, x")
def e11p(spark, d):
    return imaging.waveform(_exact(spark, d), "parade")


CHROMA = "cast(0.836 as double) * (cast({} as double) * r + cast({} as double) * g + cast({} as double) * b)"


@query("e11_vectorscope", R + f", c as (select path, {CHROMA.format(-0.1146, -0.3854, 0.5)} as cb, {CHROMA.format(0.5, -0.4542, -0.0458)} as cr from rgb), f as (select *, greatest(sqrt(cb * cb + cr * cr) / 127, 1) as far from c), "
    "v as (select path, cast(floor(least(255, greatest(0, round(128 - cr / far, 6)))) as int) as y, cast(floor(least(255, greatest(0, round(cb / far + 128, 6)))) as int) as x from f) select path, 'vectorscope' as kind, y, x, count(*) as n from v group by path, y, x")
def e11v(spark, d):
    return imaging.waveform(_exact(spark, d), "vectorscope")


@query("e12_exposure", T + "select img_id, round(greatest(0, 1 - 5 * count(*) filter (luma < 5 or luma >= 250) / 64.0), 6) as exposure from tiles group by 1")
def e12(spark, d):
    return imaging.exposure_metric(images(spark, d)).select("img_id", F.round("exposure", 6).alias("exposure"))


GRID = T + ", g as (select img_id, (pos - 1) // 8 as y, (pos - 1) % 8 as x, luma from tiles), lap as (select a.img_id, a.y, a.x, n.luma + s.luma + w.luma + e.luma - 4 * a.luma as v from g a join g n on n.img_id = a.img_id and n.y = a.y - 1 and n.x = a.x join g s on s.img_id = a.img_id and s.y = a.y + 1 and s.x = a.x join g w on w.img_id = a.img_id and w.y = a.y and w.x = a.x - 1 join g e on e.img_id = a.img_id and e.y = a.y and e.x = a.x + 1), m as (select img_id, var_pop(v) as sharpness, var_pop(v) filter (y between 3 and 4 and x between 3 and 4) as center_focus from lap group by 1)"


@query("e13_focus", GRID + " select img_id, round(sharpness, 6) as sharpness, round(center_focus, 6) as center_focus from m")
def e13(spark, d):
    return imaging.focus_measures(images(spark, d)).select("img_id", F.round("sharpness", 6).alias("sharpness"), F.round("center_focus", 6).alias("center_focus"))


QUALITY = GRID + ", x as (select img_id, greatest(0, 1 - 5 * count(*) filter (luma < 5 or luma >= 250) / 64.0) as exposure from tiles group by 1), q as (select img_id, sharpness, 0.4 * least(1, log10(sharpness + 1) / 3.5) + 0.35 * least(1, log10(center_focus + 1) / 3.5) + 0.25 * exposure as quality from m join x using (img_id))"


def _measures(spark, d, copies=False):
    from .plans.pipelines import image_measures

    return image_measures(images(spark, d, copies))


@query("e14_quality", QUALITY + " select img_id, round(quality, 6) as quality from q")
def e14(spark, d):
    return _measures(spark, d).select("img_id", F.round("quality", 6).alias("quality"))


HSV = R + ", h as (select path, pos, greatest(r, g, b) as mx, least(r, g, b) as mn, r, g, b from rgb), v as (select path, mx / 255.0 as v, case when mx = 0 then 0 else (mx - mn) / mx::double end as s, case when mx = mn then 0 when mx = r then 60 * case when g >= b then (g - b) / (mx - mn)::double else (g - b) / (mx - mn)::double + 6 end when mx = g then 60 * ((b - r) / (mx - mn)::double + 2) else 60 * ((r - g) / (mx - mn)::double + 4) end as h from h), n as (select path, v, s, case when v < 0.2 then 'black' when s < 0.1 then case when v > 0.8 then 'white' else 'gray' end when h < 20 or h >= 340 then 'red' when h < 45 then 'orange' when h < 70 then 'yellow' when h < 160 then 'green' when h < 260 then 'blue' else 'purple' end as name from v), b as (select path, case when name in ('red', 'orange') and v < 0.6 and s < 0.7 then 'brown' else name end as tag, count(*) as n from n group by 1, 2), k as (select *, tag in ('black', 'white', 'gray') as neutral, bool_or(tag not in ('black', 'white', 'gray')) over (partition by path) as colourful from b), p as (select path, tag, cast(row_number() over (partition by path order by n desc, tag) as int) as place, colourful from k where not neutral or not colourful)"


@query("e15_color_tags", HSV + " select path, tag, place from p where place <= case when colourful then 2 else 1 end")
def e15(spark, d):
    return imaging.color_tags(_exact(spark, d))


@query("e16_auto_adjust", twins.AUTO_ADJUST)
def e16(spark, d):
    return imaging.auto_adjust(_exact(spark, d)).select("path", "setting", F.round("value", 6).alias("value"))


@query("e17_auto_white_balance", twins.WHITE_BALANCE)
def e17(spark, d):
    return imaging.auto_white_balance(_exact(spark, d))


BITS = "bits as (select a.img_id, (a.y * 7 + a.x) as k, a.luma > b.luma as bit from gg a join gg b on b.img_id = a.img_id and b.y = a.y and b.x = a.x + 1 union all select a.img_id, 56 + a.y * 8 + a.x, a.luma > b.luma from gg a join gg b on b.img_id = a.img_id and b.y = a.y + 1 and b.x = a.x)"
HASH = "gg as (select img_id, (pos - 1) // 8 as y, (pos - 1) % 8 as x, luma from {t}), " + BITS + ", hashes as (select img_id, string_agg(cast(cast(bit as int) as varchar), '' order by k) as h from bits group by 1)"


@query("i1_hash", T + ", " + HASH.format(t="tiles") + " select img_id, h as hash from hashes")
def i1(spark, d):
    text = F.array_join(F.transform("words", lambda w: F.reverse(F.lpad(F.bin(w), 64, "0"))), "")
    return imaging.double_gradient_hash(images(spark, d)).select("img_id", F.substring(text, 1, 112).alias("hash"))


def _pairs_sql(t, tiles, cte):
    return f"with {cte}, " + HASH.format(t=tiles) + f", pairs as (select a.img_id as a, b.img_id as b, bit_count(cast(a.h as bit) # cast(b.h as bit)) as distance from hashes a join hashes b on a.img_id < b.img_id where bit_count(xor(cast(a.h as bit), cast(b.h as bit))) <= {t})"


def _near(t, tiles, cte):
    return _pairs_sql(t, tiles, cte).replace("bit_count(cast(a.h as bit) # cast(b.h as bit))", "bit_count(xor(cast(a.h as bit), cast(b.h as bit)))")


def _hashes(spark, d, copies):
    return imaging.double_gradient_hash(images(spark, d, copies)).select(F.col("img_id").alias("idx"), "words")


@query("i2_hamming", _near(112, "tiles", TILES_SQL) + " select a, b, cast(distance as int) as distance from pairs")
def i2(spark, d):
    return similar.similar_pairs(_hashes(spark, d, False), 112, every=True)


#: Pairs of the least index of each hash, and each copy with the one that stands for it.
BY_HASH = (
    ", firsts as (select min(img_id) as f, h from hashes group by h) "
    "select a, b, cast(distance as int) as distance from pairs where a in (select f from firsts) and b in (select f from firsts) "
    "union all select f, img_id, 0 from hashes join firsts using (h) where img_id > f"
)


@query("i3_pairs_banded", _near(6, "tiles_dup", TILES_DUP_SQL) + BY_HASH)
def i3(spark, d):
    return similar.similar_pairs(_hashes(spark, d, True), 6).withColumn("distance", F.col("distance").cast("int"))


@query("i3_pairs_blocked", _near(34, "tiles", TILES_SQL) + " select a, b, cast(distance as int) as distance from pairs")
def i3b(spark, d):
    return similar.similar_pairs(_hashes(spark, d, False), 34, every=True)


GROUPS = (
    ", up(idx, label) as (select b, a from pairs union select p.b, u.label from up u join pairs p on p.a = u.idx), "
    "every as (select idx, min(label) as label from (select idx, label from up union all select a, a from pairs union all select b, b from pairs) group by 1), "
    "labels as (select idx, label from every where label in (select label from every group by 1 having count(*) > 1))"
)


def _groups_sql(t, tiles, cte):
    return _near(t, tiles, cte).replace("with ", "with recursive ", 1) + GROUPS


@query("i4_groups", _groups_sql(34, "tiles", TILES_SQL) + " select idx, label from labels")
def i4(spark, d):
    return similar.similar_groups(similar.similar_pairs(_hashes(spark, d, False), 34))


@query("i4_groups_with_copies", _groups_sql(6, "tiles_dup", TILES_DUP_SQL) + " select idx, label from labels")
def i4c(spark, d):
    return similar.similar_groups(similar.similar_pairs(_hashes(spark, d, True), 6))


@query("f9_representative", _groups_sql(34, "tiles", TILES_SQL) + QUALITY.replace(T, "").replace(", g as", ", g as", 1) + " select idx, cast(row_number() over (partition by label order by round(quality, 9) desc, idx) as int) as place from labels join q on img_id = idx")
def f9(spark, d):
    groups = similar.similar_groups(similar.similar_pairs(_hashes(spark, d, False), 34))
    return similar.representative(groups, _measures(spark, d).select(F.col("img_id").alias("idx"), F.round("quality", 9).alias("quality"))).select("idx", F.col("place").cast("int").alias("place"))


@query("i5_blurry", GRID + " select img_id, round(sharpness, 6) as sharpness from m where sharpness < 60000")
def i5(spark, d):
    return imaging.blurry(_measures(spark, d), 60000).select("img_id", F.round("sharpness", 6).alias("sharpness"))


CULLED = (
    _groups_sql(28, "tiles_dup", TILES_DUP_SQL) + QUALITY.replace(T, "").replace("from tiles ", "from tiles_dup ").replace("from tiles)", "from tiles_dup)")
    + ", places as (select idx, label, row_number() over (partition by label order by round(quality, 9) desc, idx) as place from labels join q on img_id = idx) "
    "select img_id as idx, case when place > 1 then 'duplicate' else 'keep' end as verdict, label, round(quality, 6) as quality from q left join places on idx = img_id"
)


@query("i6_cull", CULLED)
def i6(spark, d):
    return similar.cull(images(spark, d, True)).select("idx", "verdict", "label", F.round("quality", 6).alias("quality"))


SCORED = "select path, tag, exp(score) / sum(exp(score)) over (partition by path) as p from s"
CULLED_AND_TAGGED = (
    CULLED.replace("select img_id as idx, case", ", verdicts as (select img_id as idx, case") + f"), scored as ({SCORES} {SCORED}), picked as (select path, tag from scored where p > 0.005 qualify row_number() over (partition by path order by p desc, tag) <= 10), "
    "parents as (select path, tag from picked union select path, 'first' from picked where tag = 'label1' union select path, 'second' from picked where tag = 'label2'), tagged as (select path, string_agg(tag, '|' order by tag) as tags from parents group by path) "
    "select idx, verdict, tags from verdicts left join tagged on path = '/img/' || idx"
)


@query("w2_cull_and_tag", CULLED_AND_TAGGED)
def w2(spark, d):
    from .plans.pipelines import cull_and_tag

    tree = spark.createDataFrame([("label1", "first"), ("label2", "second")], "child string, parent string")
    verdicts, picks = cull_and_tag(images(spark, d, True), tag_scores(spark, d), tree)
    return verdicts.join(picks.withColumn("idx", F.regexp_extract("path", "([0-9]+)$", 1).cast("long")), "idx", "left").select("idx", "verdict", F.array_join("tags", "|").alias("tags"))


def _f32(x):
    """Pixels are 32-bit on the way in and out, and so are the twin's."""
    return f"cast(cast({x} as float) as double)"


def _pixels_sql(r, g, b):
    base = ", ".join(f"{_f32(f'{c} / 255.0::double')} as {c}" for c in "rgb")
    r, g, b = map(_f32, (r, g, b))
    return R + f", p as (select path, pos, {base} from rgb) select path, cast(pos as int) as pos, round({r}, 4) as r, round({g}, 4) as g, round({b}, 4) as b from p"


def _rgb_rows(df):
    long = df.select("path", F.posexplode("pixels").alias("k", "v"))
    at = lambda n: F.round(F.max(F.when(F.col("k") % 3 == n, F.col("v").cast("double"))), 4)
    return long.groupBy("path", F.floor(F.col("k") / 3).cast("int").alias("pos")).agg(at(0).alias("r"), at(1).alias("g"), at(2).alias("b"))


def _linear(x):
    return f"case when {x} <= 0.04045 then {x} / 12.92 else power(({x} + 0.055) / 1.055, 2.4) end"


def _srgb(x):
    return f"case when {x} <= 0.0031308 then {x} * 12.92 else 1.055 * power({x}, 1 / 2.4::double) - 0.055 end"


@query("j1_to_linear", _pixels_sql(*map(_linear, "rgb")))
def j1(spark, d):
    return _rgb_rows(pixels.srgb_to_linear(rgb_images(spark, d)))


@query("j1_to_srgb", _pixels_sql(*map(_srgb, "rgb")))
def j1b(spark, d):
    return _rgb_rows(pixels.linear_to_srgb(rgb_images(spark, d)))


@query("j2_exposure_balance", _pixels_sql("r * power(2, 0.5) * 1.06 * 1.05", "g * power(2, 0.5) * 1.015 * 0.95", "b * power(2, 0.5) * 0.94 * 1.05"))
def j2(spark, d):
    return _rgb_rows(pixels.apply(rgb_images(spark, d), lambda c: pixels.white_balance(pixels.exposure(c, 0.5), 0.3, 0.2)))


@query("j2b_whites", _pixels_sql("r / 0.9", "g / 0.9", "b / 0.9"))
def j2w(spark, d):
    return _rgb_rows(pixels.apply(rgb_images(spark, d), lambda c: pixels.whites(c, 0.4)))


@query("j2b_tone", twins.TONE)
def j2b(spark, d):
    return _rgb_rows(pixels.apply(rgb_images(spark, d), lambda c: pixels.calibration(pixels.contrast(pixels.brightness(c, 0.4), 0.3), (0.1, -0.1, 0.05), (0.2, 0, -0.1), 0.1)))


Y = "(0.2126 * r + 0.7152 * g + 0.0722 * b)"


@query("j3_saturation", _pixels_sql(*[f"{Y} + ({c} - {Y}) * 1.3" for c in "rgb"]))
def j3(spark, d):
    return _rgb_rows(pixels.apply(rgb_images(spark, d), lambda c: pixels.saturation_vibrance(c, 0.3, 0.0)))


@query("j3_vibrance_hue", twins.VIBRANCE_HUE)
def j3v(spark, d):
    return _rgb_rows(pixels.apply(rgb_images(spark, d), lambda c: pixels.hue_shift(pixels.saturation_vibrance(c, 0.0, 0.4), 15.0)))


@query("j4_mixer_grading", twins.MIXER_GRADING)
def j4(spark, d):
    return _rgb_rows(pixels.apply(rgb_images(spark, d), lambda c: pixels.color_grade(pixels.hsl_mixer(c, {"reds": (10, 0.2, 0.1)}), {"shadows": (200, 0.3, 0.05)})))


@query("j5_tone_curve", twins.TONE_CURVE)
def j5(spark, d):
    return _rgb_rows(pixels.apply(rgb_images(spark, d), lambda c: pixels.tone_curve(c, [(0, 0), (64, 50), (192, 210), (255, 255)])))


@query("j6_lut", twins.LUT)
def j6(spark, d):
    n = 9
    axis = np.linspace(0, 1, n)
    lut = np.stack(np.meshgrid(axis, axis, axis, indexing="ij")[::-1], -1) ** 0.9
    return _rgb_rows(pixels.apply(rgb_images(spark, d), lambda c: pixels.lut_lookup(c, lut, 0.8)))


@query("j7_vignette", twins.VIGNETTE)
def j7(spark, d):
    return _rgb_rows(pixels.apply(rgb_images(spark, d), lambda c, w, h: pixels.vignette(c, w, h, -0.5), with_size=True))


@query("j7b_tone_map", _pixels_sql(*[_srgb(c) for c in "rgb"]))
def j7b(spark, d):
    return _rgb_rows(pixels.apply(rgb_images(spark, d), lambda c: pixels.tone_map_basic(c, False)))


@query("j8_grade", twins.GRADE)
def j8(spark, d):
    photos = rgb_images(spark, d).withColumn("is_raw", F.lit(True))
    docs = photos.select("path", F.expr("""'{"exposure":' || (length(path) % 3) / 10 || ',"contrast":20,"saturation":10,"vignetteAmount":-20}'""").alias("doc"))
    return _rgb_rows(pixels.grade(photos, docs))


@query("j9_negative", twins.NEGATIVE)
def j9(spark, d):
    return _rgb_rows(pixels.apply(rgb_images(spark, d), lambda c, w, h: pixels.invert_negative(c, w, h), with_size=True))


@query("j10_masks", twins.MASKS)
def j10(spark, d):
    base = pixels.range_mask(rgb_images(spark, d), (0.5, 0.5, 0.5), 30.0)
    other = pixels.range_mask(rgb_images(spark, d), (0.6, 0.4, 0.5), 20.0, "luma")
    one = lambda df, pos, mode, inverted: df.select("path", F.lit(pos).alias("pos"), F.lit(mode).alias("mode"), F.lit(inverted).alias("inverted"), F.lit(0.8).alias("opacity"), F.col("mask").alias("values"))
    masks = pixels.combine_masks(one(base, 1, "add", False).unionByName(one(other, 2, "subtract", True)))
    return masks.select("path", F.array_join(F.transform("values", lambda v: v.cast("string")), ",").alias("mask"))


@query("j11_focus_stack", twins.FOCUS_STACK)
def j11(spark, d):
    frames = rgb_images(spark, d).withColumn("n", F.regexp_extract("path", "([0-9]+)$", 1).cast("int")).select(F.floor(F.col("n") / 4).cast("string").alias("stack"), (F.col("n") % 4).alias("frame"), "width", "height", "pixels")
    return pixels.focus_stack(frames, 2).select("stack", "y", "x", "frame")


@query("j12_downscale", R + " select path, cast((pos // 8) * 2 + (pos % 4) // 2 as int) as pos, " + ", ".join(f"round({_f32('avg(' + _f32(c + ' / 255.0::double') + ')')}, 4) as {c}" for c in "rgb") + " from rgb group by path, (pos // 8) * 2 + (pos % 4) // 2")
def j12(spark, d):
    return _rgb_rows(pixels.downscale(rgb_images(spark, d), 2))


LOGS = "l as (select event_type as level, 'm' || event_id % 7 as message, cast(epoch_ms(ts) // 20000 as bigint) as ms from events)"


DEDUPED = f"with recursive {LOGS}, o as (select *, row_number() over (partition by level, message order by ms) as n from l), k(level, message, n, ms) as (select level, message, n, ms from o where n = 1 union all select o.level, o.message, o.n, o.ms from k join lateral (select * from o where o.level = k.level and o.message = k.message and o.ms >= k.ms + 1500 order by o.n limit 1) o on true) select level, message, ms from k"


def _log_lines(events):
    return events.select(F.col("event_type").alias("level"), F.concat(F.lit("m"), F.col("event_id") % 7).alias("message"), F.timestamp_millis(F.floor(F.unix_millis(F.col("ts").cast("timestamp")) / 20000)).alias("ts"))


@query("k1_dedupe_logs", DEDUPED)
def k1(spark, d):
    return streams.dedupe_logs_batch(_log_lines(table(spark, d, "events"))).select("level", "message", F.unix_millis("ts").alias("ms"))


@query("k1_dedupe_stream", DEDUPED)
def k1s(spark, d):
    lines = streams.Closing(_log_lines(streams.arriving(table(spark, d, "events"))), "ts")
    return streams.drained(streams.dedupe_logs(lines.stream), "log-lines", lines).select("level", "message", F.unix_millis("ts").alias("ms"))


def _job_events(events):
    return events.select(F.col("user_id").cast("long").alias("job_id"), F.col("event_id").cast("long").alias("at"), F.when(F.col("event_id") % 3 == 0, "add").otherwise("done").alias("kind"), F.when(F.col("event_id") % 3 == 0, 2).otherwise(1).cast("long").alias("n"))


@query("k2_job_progress", twins.JOB_PROGRESS)
def k2(spark, d):
    return streams.job_progress_batch(_job_events(table(spark, d, "events")))


@query("k2_progress_stream", twins.JOB_PROGRESS)
def k2s(spark, d):
    return streams.drained(streams.job_progress(_job_events(streams.arriving(table(spark, d, "events"))), None), "job-progress")


UPSERTED = "select o_orderkey as path, cast(epoch(o_orderdate) as bigint) + case when o_orderkey % 3 = 0 then 5 else 0 end as modified, case when o_orderkey % 3 = 0 then 'new' else 'old' end as state from orders where o_orderkey % 4 <> 1 union all select o_orderkey, cast(epoch(o_orderdate) as bigint) + case when o_orderkey % 3 = 0 then 5 else -5 end, 'new' from orders where o_orderkey % 4 = 1"


def _old_and_new(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.unix_timestamp("o_orderdate").alias("modified"))
    new = o.withColumn("modified", F.col("modified") + F.when(F.col("path") % 3 == 0, 5).otherwise(-5)).withColumn("state", F.lit("new"))
    return o.where("path % 4 <> 1").withColumn("state", F.lit("old")), new


@query("k4_catalog_upsert", UPSERTED)
def k4(spark, d):
    return streams.upsert(*_old_and_new(spark, d))


@query("k4_catalog_stream", UPSERTED)
def k4s(spark, d):
    """The catalog after a stream of old rows and then one of changes went into its table."""
    kept = Table(spark, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}", order="modified")
    for name, rows in zip(("old", "new"), _old_and_new(spark, d), strict=True):
        streams.finished(spark, streams.incremental_catalog(streams.arriving(written(rows, "catalog-changes")), kept, name))
    return kept.read()


TAGGED = "select o_orderkey as path, case when o_orderkey % 2 = 0 then 'color:red|sea' else 'dog' end as tags from orders"


def _untagged(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("path"))
    return o.withColumn("tags", F.when(F.col("path") % 2 == 0, F.array(F.lit("color:red"))).otherwise(F.array(F.lit("dog")))), o.withColumn("tags", F.array(F.lit("sea")))


@query("k5_tag_stream_batch", TAGGED)
def k5(spark, d):
    from .operators.tags import merge_ai_tags

    return merge_ai_tags(*_untagged(spark, d)).select("path", F.array_join("tags", "|").alias("tags"))


@query("k5_tag_stream", TAGGED)
def k5s(spark, d):
    """The catalog after a tagger's stream went into its table."""
    photos, found = _untagged(spark, d)
    kept = Table(spark, f"{shared_folder(spark)}/tagged-{uuid.uuid4().hex}")
    kept.replace(photos)
    streams.finished(spark, streams.incremental_tags(streams.arriving(written(found, "tagger")), kept))
    return kept.read().select("path", F.array_join("tags", "|").alias("tags"))
