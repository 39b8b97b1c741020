"""Queries over edit documents, plans, lenses and benchmarks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .fixtures import CATALOG_SQL as C
from .fixtures import catalog, table
from .functions import xmp
from .operators import benchmark, edits, lens
from .plans import planning
from .registry import collector
from .sources.files import write_catalog
from .storage import shared_folder

QUERIES, ORACLE_SQL, query = collector()
W = f"with {C} "


def _documents(spark, d):
    """path, source_path, copy_id and adjustments: name to JSON text, of several kinds."""
    c = catalog(spark, d)
    a = F.create_map(
        F.lit("exposure"), F.when(F.col("idx") % 4 == 0, "0").otherwise("0.5"), F.lit("contrast"), (F.col("idx") % 3).cast("string"),
        F.lit("crop"), F.when(F.col("idx") % 6 == 0, '{"x":0.2,"y":0}').otherwise("null"), F.lit("sectionVisibility"), F.when(F.col("idx") % 8 == 0, '{"basic":false}').otherwise("{}"),
    )
    return c.select("idx", "path", "source_path", "copy_id", "modified", F.when(F.col("idx") % 10 == 9, F.lit(None)).otherwise(a).alias("adjustments"))


DOCS = ", docs as (select *, idx % 10 = 9 as blank, case when idx % 4 = 0 then '0' else '0.5' end as exposure, cast(idx % 3 as varchar) as contrast from catalog)"


@query("b3_is_edited", W + DOCS + " select idx, not blank and (idx % 6 = 0 or (idx % 8 <> 0 and (idx % 4 <> 0 or idx % 3 <> 0))) as edited from docs")
def b3(spark, d):
    return _documents(spark, d).select("idx", edits.is_edited(F.col("adjustments")).alias("edited"))


@query("b4_normalize", W + DOCS + " select idx, case when blank then '0.0' else exposure end as exposure, '50.0' as vignette, 'asShot' as mode, case when idx % 8 = 0 and not blank then 'false' else 'true' end as basic, 'true' as optics from docs")
def b4(spark, d):
    n = edits.normalize_adjustments(F.col("adjustments"))
    shown = F.from_json(F.element_at(n, "sectionVisibility"), "map<string,string>")
    return _documents(spark, d).select("idx", F.element_at(n, "exposure").alias("exposure"), F.element_at(n, "vignetteMidpoint").alias("vignette"), F.element_at(n, "whiteBalanceMode").alias("mode"), F.element_at(shown, "basic").alias("basic"), F.element_at(shown, "optics").alias("optics"))


@query("b5_legacy_state", W + "select idx, cast(greatest(-100, least(100, floor((2000 + idx % 9000 - 5500) / 35.0 + 0.5))) as double) as temperature, cast((idx % 50) * 35 + 5500 as double) as kelvin, '0.0:0.0|127.5:' || cast(round((idx % 10) / 10.0 * 255, 1) as double) || '|255.0:255.0' as curve from catalog")
def b5(spark, d):
    p = lambda x, y: F.struct(F.lit(x).cast("double").alias("x"), y.cast("double").alias("y"))
    curve = edits.legacy_curve(F.array(p(1, F.lit(1)), p(0, F.lit(0)), p(0.5, F.col("idx") % 10 / 10.0)))
    text = F.array_join(F.transform(curve, lambda q: F.concat(F.round(q["x"], 1).cast("string"), F.lit(":"), F.round(q["y"], 1).cast("string"))), "|")
    return catalog(spark, d).select("idx", edits.legacy_temperature(2000 + F.col("idx") % 9000).alias("temperature"), edits.legacy_kelvin((F.col("idx") % 50).cast("double")).alias("kelvin"), text.alias("curve"))


@query("b17_fingerprints", W + DOCS + " select a.idx, true as same_geometry, coalesce(a.exposure = b.exposure and a.contrast = b.contrast and (a.idx % 8 = 0) = (b.idx % 8 = 0), false) as same_visual, (a.idx % 6 = 0) = (b.idx % 6 = 0) as same_transform from docs a join docs b on b.idx = a.idx + 4 where not a.blank and not b.blank")
def b17(spark, d):
    rows = _documents(spark, d).where("adjustments is not null").select("idx", *[edits.fingerprint(F.col("adjustments"), k).alias(k) for k in ("geometry", "visual", "transform")])
    b = rows.select((F.col("idx") - 4).alias("idx"), *[F.col(k).alias(k + "_b") for k in ("geometry", "visual", "transform")])
    return rows.join(b, "idx").select("idx", *[(F.col(k) == F.col(k + "_b")).alias("same_" + k) for k in ("geometry", "visual", "transform")])


@query("b18_thumbnail_keys", W + "select idx, sha256(path || chr(0) || cast(modified as varchar) || chr(0) || '{\"exposure\":' || idx % 3 || '}') as key from catalog")
def b18(spark, d):
    return catalog(spark, d).select("idx", edits.thumbnail_key(F.col("path"), F.col("modified"), F.expr("'{\"exposure\":' || idx % 3 || '}'")).alias("key"))


XMP = """case when idx % 3 = 0 then '<rdf:Description xmp:Rating="' || rating || '" xmp:Label="Red"/>' when idx % 3 = 1 then '<rdf:Description><xmp:Rating>' || rating || '</xmp:Rating><dc:subject><rdf:Bag><rdf:li>sea</rdf:li><rdf:li>dog' || idx % 5 || '</rdf:li></rdf:Bag></dc:subject></rdf:Description>' else '<rdf:Description></rdf:Description>' end"""


@query("b14_xmp_fields", W + "select idx, cast(case when idx % 3 < 2 then rating end as int) as rating, case when idx % 3 = 0 then 'Red' end as label, case when idx % 3 = 1 then 'sea|dog' || idx % 5 else '' end as subjects from catalog")
def b14(spark, d):
    return catalog(spark, d).withColumn("x", F.expr(XMP)).select("idx", xmp.rating(F.col("x")).alias("rating"), xmp.label(F.col("x")).alias("label"), F.array_join(xmp.subjects(F.col("x")), "|").alias("subjects"))


@query("b15_write_xmp", W + """select idx, '<rdf:Description xmp:Rating="' || (idx % 6) || '"' || case when coalesce(list_filter(coalesce(tags, []), lambda t: t like 'color:%')[1], '') = '' then '' else ' xmp:Label="' || upper(substr(list_filter(tags, lambda t: t like 'color:%')[1], 7, 1)) || substr(list_filter(tags, lambda t: t like 'color:%')[1], 8) || '"' end || '>' || case when len(list_filter(coalesce(tags, []), lambda t: t not like 'color:%')) > 0 then '<dc:subject><rdf:Bag>' || array_to_string(list_transform(list_filter(tags, lambda t: t not like 'color:%'), lambda t: '<rdf:li>' || regexp_replace(t, '^user:', '') || '</rdf:li>'), '') || '</rdf:Bag></dc:subject>' else '' end || '</rdf:Description>' as content from catalog""")
def b15(spark, d):
    return catalog(spark, d).select("idx", xmp.written(F.expr(XMP), (F.col("idx") % 6).cast("int"), F.col("tags")).alias("content"))


PRESET = """'<x crs:Exposure2012="+' || (idx % 5) || '.50" crs:Shadows2012="' || (idx % 90) || '" crs:Sharpness="' || (idx % 200) || '" crs:Temperature="' || (3000 + idx % 5000) || '" crs:HueAdjustmentRed="' || (idx % 40) || '"><crs:ToneCurvePV2012> <rdf:Seq><rdf:li>0, ' || (idx % 30) || '</rdf:li><rdf:li>255, 255</rdf:li></rdf:Seq> </crs:ToneCurvePV2012>'"""


@query("b16_presets", W + "select idx, cast((idx % 5) + 0.5 as double) as exposure, cast(least(100.0, (idx % 90) * 1.5) as double) as shadows, round(least(100.0, (idx % 200) / 150.0 * 100), 6) as sharpness, round(greatest(-100, least(100, -(1e6 / (3000 + idx % 5000) - 1e6 / 5500) / 150 * 100)), 6) as temperature, cast((idx % 40) * 0.75 as double) as red_hue, cast(round((idx % 30) * 0.8) as int) as first_y, 'Imported Preset' as name from catalog")
def b16(spark, d):
    m = F.col("m")
    rows = catalog(spark, d).withColumn("x", F.expr(PRESET)).withColumn("m", xmp.preset_adjustments(F.col("x")))
    return rows.select("idx", *[F.round(F.element_at(m, k), 6).alias(n) for k, n in (("exposure", "exposure"), ("shadows", "shadows"), ("sharpness", "sharpness"), ("temperature", "temperature"), ("hsl.reds.hue", "red_hue"))], F.element_at(xmp.preset_curve(F.col("x")), 1)["y"].alias("first_y"), xmp.preset_name(F.col("x")).alias("name"))


def _pairs(df, column="adjustments"):
    """A map as sorted text."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(column)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))), ";").alias(column)


CROP = "case when idx % 6 = 0 then '{\"x\":0.2,\"y\":0}' else 'null' end"
SEEN = "case when idx % 8 = 0 then '{\"basic\":false}' else '{}' end"


@query("h1_apply", W + DOCS + f" select idx, case when idx % 2 = 0 then case when blank then 'exposure=1.0;tint=3' else 'contrast=' || contrast || ';crop=' || {CROP} || ';exposure=1.0;sectionVisibility=' || {SEEN} || ';tint=3' end when blank then null else 'contrast=' || contrast || ';crop=' || {CROP} || ';exposure=' || exposure || ';sectionVisibility=' || {SEEN} end as adjustments from docs")
def h1(spark, d):
    docs = _documents(spark, d)
    return edits.apply_adjustments(docs, docs.where("idx % 2 = 0").select("path"), {"exposure": "1.0", "tint": "3"}).select("idx", _pairs(docs))


@query("h2_reset", W + DOCS + f" select idx, case when idx % 3 = 0 then '' when blank then null else 'contrast=' || contrast || ';crop=' || {CROP} || ';exposure=' || exposure || ';sectionVisibility=' || {SEEN} end as adjustments from docs")
def h2(spark, d):
    docs = _documents(spark, d)
    return edits.reset_adjustments(docs, docs.where("idx % 3 = 0").select("path")).select("idx", _pairs(docs))


@query("h3_apply_auto", W + DOCS + " select idx, case when idx % 4 = 1 then '0.7' when blank then null else exposure end as exposure, case when idx % 4 = 1 and blank then '{\"color\":true}' when idx % 4 = 1 then '{\"color\":true}' when blank then null else case when idx % 8 = 0 then '{\"basic\":false}' else '{}' end end as shown, false as has_brightness from docs")
def h3(spark, d):
    docs = _documents(spark, d)
    auto = docs.where("idx % 4 = 1").select("path", F.create_map(F.lit("exposure"), F.lit("0.7"), F.lit("brightness"), F.lit("9"), F.lit("sectionVisibility"), F.lit('{"color":true}')).alias("patch"))
    a = F.col("adjustments")
    return edits.apply_auto(docs, auto).select("idx", F.element_at(a, "exposure").alias("exposure"), F.element_at(a, "sectionVisibility").alias("shown"), F.coalesce(F.map_contains_key(a, "brightness"), F.lit(False)).alias("has_brightness"))


@query("h4_copy", W + DOCS + f" select idx, case when not blank then 'contrast=' || contrast || ';crop=' || {CROP} || ';exposure=' || exposure end as adjustments from docs")
def h4(spark, d):
    return _documents(spark, d).withColumn("adjustments", edits.copy_settings(F.col("adjustments"))).select("idx", _pairs(None))


@query("h5_paste", W + DOCS + " select idx, case when idx % 5 = 0 then '0.9' when blank then null else exposure end as exposure, case when blank and idx % 5 <> 0 then null when blank then null else contrast end as contrast from docs")
def h5(spark, d):
    docs = _documents(spark, d)
    out = edits.paste_settings(docs, docs.where("idx % 5 = 0").select("path"), {"exposure": "0.9", "contrast": "0", "tint": "4"}, ["exposure", "contrast"], "merge")
    return out.select("idx", F.element_at("adjustments", "exposure").alias("exposure"), F.element_at("adjustments", "contrast").alias("contrast"))


@query("h7_virtual_copies", W + "select path, copy_id from catalog union all select source_path || '?vc=' || substr(sha256(path || 's'), 1, 6), substr(sha256(path || 's'), 1, 6) from catalog where idx % 6 = 0")
def h7(spark, d):
    docs = _documents(spark, d)
    return edits.create_virtual_copies(docs, docs.where("idx % 6 = 0").select("path"), "s").select("path", "copy_id")


@query("h8_move", W + "select idx, case when idx % 4 = 0 then replace(source_path, '/lib', '/moved') else source_path end as source_path from catalog")
def h8(spark, d):
    c = catalog(spark, d)
    renames = c.where("idx % 4 = 0").select(F.col("source_path").alias("old"), F.replace(F.col("source_path"), F.lit("/lib"), F.lit("/moved")).alias("new"))
    return edits.move_sidecars(c.select("idx", "source_path"), renames)


@query("h8_copy", W + "select idx, source_path from catalog union all select idx, replace(source_path, '/lib', '/copied') from catalog where idx % 4 = 0")
def h8c(spark, d):
    c = catalog(spark, d)
    renames = c.where("idx % 4 = 0").select(F.col("source_path").alias("old"), F.replace(F.col("source_path"), F.lit("/lib"), F.lit("/copied")).alias("new"))
    return edits.copy_sidecars(c.select("idx", "source_path"), renames)


def _items(spark, d):
    c = catalog(spark, d)
    return c.select("idx", "path", "source_path", F.timestamp_seconds("modified").alias("taken"), (1500 + F.col("idx") % 3000).cast("int").alias("width"), (1200 + F.col("idx") % 3100).cast("int").alias("height"))


STEM = "regexp_replace(name, '\\.[^.]*$', '')"
SEQ = "lpad(cast(row_number() over (order by idx) as varchar), cast(length(cast(count(*) over () as varchar)) as int), '0')"


@query("f2_filenames", W + f"select idx, strftime(to_timestamp(modified) at time zone 'UTC', '%Y-%m-%d_') || {SEQ} || '_' || {STEM} as new_name from catalog")
def f2(spark, d):
    return planning.plan_filenames(_items(spark, d), "{YYYY}-{MM}-{DD}_{sequence}_{original_filename}").select("idx", "new_name")


@query("f3_copy_suffix", W + "select idx, case when regexp_matches(path, '[?]vc=[0-9]+$') then '_VC' || case when length(cast(cast(regexp_extract(path, '([0-9]+)$', 1) as bigint) as varchar)) < 2 then '0' else '' end || cast(cast(regexp_extract(path, '([0-9]+)$', 1) as bigint) as varchar) when n > 1 then '_VC' || lpad(cast(n - 1 as varchar), cast(greatest(2, length(cast(n - 1 as varchar))) as int), '0') else '' end as suffix from (select *, row_number() over (partition by folder order by idx) as n from catalog)")
def f3(spark, d):
    items = catalog(spark, d).select("idx", "path", F.col("folder").alias("source_path"))
    return planning.virtual_copy_suffix(items).select("idx", "suffix")


@query("f4_collisions", W + "select idx, case when exists (select 1 from catalog b where b.source_path = t.target) and target <> source_path then 'exists' when n > 1 then 'shared' end as clash from (select *, count(*) over (partition by target) as n from (select *, case when idx % 5 = 0 then replace(source_path, '.ARW', '.jpg') when idx % 5 = 1 then folder || '/x' || idx % 100 else source_path || '.new' end as target from catalog)) t")
def f4(spark, d):
    target = F.expr("case when idx % 5 = 0 then replace(source_path, '.ARW', '.jpg') when idx % 5 = 1 then folder || '/x' || idx % 100 else source_path || '.new' end")
    c = catalog(spark, d)
    return planning.collisions(c.withColumn("target", target), c.select("source_path")).select("idx", "clash")


@query("f5_copy_names", W + ", k as (select *, row_number() over (partition by source_path order by idx) as n from (select idx, '/lib/a/p' || idx % 500 || '.jpg' as source_path from catalog)) select idx, replace(source_path, '.jpg', '_copy_' || (n + case when n >= 2 and idx % 500 % 3 = 0 then 1 else 0 end) || '.jpg') as copy_name from k")
def f5(spark, d):
    items = catalog(spark, d).select("idx", F.expr("'/lib/a/p' || idx % 500 || '.jpg'").alias("source_path"))
    there = items.select("source_path").union(items.where("idx % 500 % 3 = 0").select(F.replace(F.col("source_path"), F.lit(".jpg"), F.lit("_copy_2.jpg"))))
    return planning.copy_names(items, there).select("idx", "copy_name")


@query("d15_export_dirs", W + "select idx, case when folder = '/lib/f3' or folder like '/lib/f3/%' then '' when folder like '/lib/%' then substr(folder, 6) end as relative from catalog")
def d15(spark, d):
    bases = spark.createDataFrame([("/lib",), ("/lib/f3",), ("/other",)], "base string")
    return planning.relative_export_dir(catalog(spark, d), bases).select("idx", "relative")


@query("e8_export_summary", "select count(*) as completed, count(case when l_returnflag = 'R' then 1 end) as failed, string_agg(case when l_returnflag = 'R' then l_orderkey || ' failed' end, chr(10) order by l_orderkey, l_linenumber) as errors from lineitem")
def e8(spark, d):
    return planning.export_summary(_results(spark, d))


def _results(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("idx"), F.when(F.col("l_returnflag") == "R", F.concat("l_orderkey", F.lit(" failed"))).alias("error"))


@query("e8_export_errors", "select row_number() over (order by l_orderkey, l_linenumber) - 1 as place, l_orderkey * 100 + l_linenumber as idx, l_orderkey || ' failed' as error from lineitem where l_returnflag = 'R'")
def e8r(spark, d):
    """The errors of the summary as rows, for exports whose errors no single text can hold."""
    return planning.export_errors(_results(spark, d))


@query("e9_export_size", W + ", s as (select case idx % 3 when 0 then 'jpg' when 1 then 'png' else 'cube' end as format, 100000 + idx % 777 as bytes, 1000000 + idx % 1000 as px from catalog) select format, count(*) as n, round(sum(case when format = 'cube' then 1050000.0 else rate * px * 4 end), 3) as bytes from s join (select format, avg(bytes / cast(px as double)) as rate from s group by 1) r using (format) group by 1")
def e9(spark, d):
    s = catalog(spark, d).select(F.expr("case idx % 3 when 0 then 'jpg' when 1 then 'png' else 'cube' end").alias("format"), (100000 + F.col("idx") % 777).alias("bytes"), (1000000 + F.col("idx") % 1000).alias("preview_px"))
    return planning.estimate_export_size(s, s.select("format", (F.col("preview_px") * 4).alias("target_px"))).select("format", "n", F.round("bytes", 3).alias("bytes"))


@query("h9_import_plan", W + f"select idx, '/in/' || strftime(to_timestamp(modified) at time zone 'UTC', '%Y/%m/%d') || '/' || {STEM} || '_' || {SEQ} || '.' || regexp_extract(name, '\\.([^.]*)$', 1) as target, null::varchar as clash from catalog")
def h9(spark, d):
    return planning.import_plan(_items(spark, d), catalog(spark, d).select("source_path"), "/in", "{original_filename}_{sequence}").select("idx", "target", "clash")


@query("h10_export_plan", W + f", p as (select *, '/out/' || substr(folder, 6) || '/' || {STEM} || '_edited' || case when regexp_matches(path, '[?]vc=[0-9]+$') then '_VC' || case when length(cast(cast(regexp_extract(path, '([0-9]+)$', 1) as bigint) as varchar)) < 2 then '0' else '' end || cast(cast(regexp_extract(path, '([0-9]+)$', 1) as bigint) as varchar) else '' end || '.jpg' as target from catalog) select idx, target, case when count(*) over (partition by target) > 1 then 'shared' end as clash from p")
def h10(spark, d):
    bases = spark.createDataFrame([("/lib",)], "base string")
    return planning.export_plan(_items(spark, d), catalog(spark, d).select("source_path"), bases, "/out").select("idx", "target", "clash")


CALIB = """calib as (select cast(p_partkey % 40 as bigint) as lens_id, case p_partkey % 3 when 0 then 'distortion' when 1 then 'tca' else 'vignetting' end as kind, case when p_partkey % 7 = 0 then 'poly3' else 'ptlens' end as model, cast(p_size * 4 as double) as focal, 1.4 + p_partkey % 6 as aperture, cast(1 + p_partkey % 20 as double) as distance, min(p_partkey) as k from part group by 1, 2, 3, 4, 5, 6), one as (select *, row_number() over (partition by lens_id, kind, focal, case when kind = 'vignetting' then aperture end, case when kind = 'vignetting' then distance end order by k) as n from calib), lenses as (select lens_id, kind, model, focal, aperture, distance, (k % 100) / 997.0::double as p1, (k % 37) / 997.0::double as p2, (k % 11) / 997.0::double as p3 from one where n = 1), photos as (select idx, cast(idx % 40 as bigint) as lens_id, cast(20 + idx % 180 as double) as focal, case when idx % 9 = 0 then null else 1.0 + idx % 8 end as aperture, case when idx % 5 = 0 then null else cast(idx % 25 as double) end as distance from catalog)"""


def _calib(spark, d):
    from pyspark.sql import Window

    c = table(spark, d, "part").selectExpr("cast(p_partkey % 40 as bigint) as lens_id", "case p_partkey % 3 when 0 then 'distortion' when 1 then 'tca' else 'vignetting' end as kind", "case when p_partkey % 7 = 0 then 'poly3' else 'ptlens' end as model", "cast(p_size * 4 as double) as focal", "cast(1.4 + p_partkey % 6 as double) as aperture", "cast(1 + p_partkey % 20 as double) as distance", "p_partkey as k")
    v = F.col("kind") == "vignetting"
    own = Window.partitionBy("lens_id", "kind", "focal", F.when(v, F.col("aperture")), F.when(v, F.col("distance"))).orderBy("k")
    c = c.withColumn("n", F.row_number().over(own)).where("n = 1")
    return c.select("lens_id", "kind", "model", "focal", "aperture", "distance", *[(F.col("k") % m / 997.0).cast("double").alias(p) for m, p in ((100, "p1"), (37, "p2"), (11, "p3"))])


def _photos_lens(spark, d):
    return catalog(spark, d).selectExpr("idx", "cast(idx % 40 as bigint) as lens_id", "cast(20 + idx % 180 as double) as focal", "cast(case when idx % 9 = 0 then null else 1.0 + idx % 8 end as double) as aperture", "case when idx % 5 = 0 then null else cast(idx % 25 as double) end as distance")


def _interval_sql(kind, rest):
    lo = "select p.idx, max(l.focal) as f from photos p join lenses l on l.lens_id = p.lens_id and l.kind = '%s' and l.focal <= p.focal + 1e-5 group by 1" % kind
    hi = "select p.idx, min(l.focal) as f from photos p join lenses l on l.lens_id = p.lens_id and l.kind = '%s' and l.focal > p.focal + 1e-5 group by 1" % kind
    mixed = ", ".join(f"round(coalesce(case when a.focal is null then b.{p} when b.focal is null or a.model <> b.model or abs(a.focal - p.focal) <= 1e-5 then a.{p} else a.{p} + (p.focal - a.focal) / (b.focal - a.focal) * (b.{p} - a.{p}) end, {rest}), 6) as {p}" for p in ("p1", "p2", "p3"))
    return f"with {C}, {CALIB}, lo as ({lo}), hi as ({hi}) select p.idx, {mixed} from photos p left join lo on lo.idx = p.idx left join lenses a on a.lens_id = p.lens_id and a.kind = '{kind}' and a.focal = lo.f left join hi on hi.idx = p.idx left join lenses b on b.lens_id = p.lens_id and b.kind = '{kind}' and b.focal = hi.f"


@query("d11_distortion", _interval_sql("distortion", "0.0"))
def d11(spark, d):
    rows = lens.interval_params(_photos_lens(spark, d), _calib(spark, d), "distortion")
    return rows.select("idx", *[F.round(f"distortion_{p}", 6).alias(p) for p in ("p1", "p2", "p3")])


@query("d11_tca", _interval_sql("tca", "1.0"))
def d11t(spark, d):
    rows = lens.interval_params(_photos_lens(spark, d), _calib(spark, d), "tca")
    return rows.select("idx", *[F.round(f"tca_{p}", 6).alias(p) for p in ("p1", "p2", "p3")])


VIGN = f"""with {C}, {CALIB}, v as (select * from lenses where kind = 'vignetting'), f as (select distinct lens_id, focal from v), ends as (select p.*, coalesce((select max(f.focal) from f where f.lens_id = p.lens_id and f.focal <= p.focal), (select min(f.focal) from f where f.lens_id = p.lens_id)) as lo, coalesce((select min(f.focal) from f where f.lens_id = p.lens_id and f.focal > p.focal), (select max(f.focal) from f where f.lens_id = p.lens_id)) as hi0 from photos p), e as (select *, case when focal < lo then lo else hi0 end as hi from ends), asks as (select *, lo as pt from e union select *, hi as pt from e), gaps as (select a.idx, a.pt, a.lo, a.hi, a.focal, v.p1, v.p2, v.p3, v.aperture as va, v.distance as vd, abs(v.aperture - coalesce(a.aperture, 3.5)) as gap, abs(v.distance - coalesce(a.distance, 1000)) as dd from asks a join v on v.lens_id = a.lens_id and v.focal = a.pt), near as (select *, min(gap) over (partition by idx, pt) as g0 from gaps), pick as (select *, row_number() over (partition by idx, pt order by dd, gap, va, vd) as n from near where gap <= g0 + 0.01), w as (select *, case when hi = lo then 1.0 when pt = lo then 1 - (focal - lo) / (hi - lo) else (focal - lo) / (hi - lo) end as w from pick where n = 1), s as (select idx, sum(w * p1) as p1, sum(w * p2) as p2, sum(w * p3) as p3 from w group by 1) select p.idx, round(coalesce(s.p1, 0), 6) as p1, round(coalesce(s.p2, 0), 6) as p2, round(coalesce(s.p3, 0), 6) as p3 from photos p left join s using (idx)"""


@query("d12_vignetting", VIGN)
def d12(spark, d):
    rows = lens.nearest_params(_photos_lens(spark, d), _calib(spark, d))
    return rows.select("idx", *[F.round(f"vignetting_{p}", 6).alias(p) for p in ("p1", "p2", "p3")])


def _lens_names(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey % 40 as lens_id", "case p_partkey % 3 when 0 then 'Sony' when 1 then 'Nikon' else 'Canon' end as maker", "'FE ' || (20 + p_partkey % 8 * 15) || 'mm F1.8 v' || p_partkey % 40 as model").groupBy("lens_id").agg(F.min("maker").alias("maker"), F.min("model").alias("model"))


LENS_NAMES = "names as (select lens_id, min(maker) as maker, min(model) as model from (select p_partkey % 40 as lens_id, case p_partkey % 3 when 0 then 'Sony' when 1 then 'Nikon' else 'Canon' end as maker, 'FE ' || (20 + p_partkey % 8 * 15) || 'mm F1.8 v' || p_partkey % 40 as model from part) group by 1)"
PLAIN = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
#: Letters in order are a LIKE pattern here.
MATCHED = (
    W + f", {LENS_NAMES}, asked as (select distinct make, lens from catalog where length(trim(lens)) >= 3), "
    f"both_ as (select *, {PLAIN.format('lens')} as own, {PLAIN.format('model')} as other, {PLAIN.format('make')} as m1, {PLAIN.format('maker')} as m2, case when lower(model) like '%' || array_to_string(string_split(lower(lens), ''), '%') || '%' then length(lens) else 0 end as fuzzy from asked cross join names), "
    "shared as (select *, list_filter(string_split(own, ' '), lambda t: length(t) >= 2 and list_contains(string_split(other, ' '), t)) as words, contains(own, other) or contains(other, own) as inside from both_), "
    "scored as (select *, cast(fuzzy - floor(abs(length(other) - length(own)) / 3) + 12 * len(words) + 40 * len(list_filter(words, lambda t: length(t) >= 4)) + case when inside then 25 else 0 end + case when contains(m1, m2) or contains(m2, m1) then 14 else 0 end as bigint) as score from shared) "
    "select make, lens, lens_id, score from scored where score >= 24 and (len(words) >= 2 or inside or fuzzy > 0 and len(words) > 0) qualify row_number() over (partition by make, lens order by score desc, lens_id desc) = 1"
)


@query("d10_match_lenses", MATCHED)
def d10(spark, d):
    return lens.match_lenses(catalog(spark, d), _lens_names(spark, d))


def _lens_edits(spark, d):
    i = F.col("idx")
    photos = catalog(spark, d).select("idx", "make", "lens", F.col("focal_length").substr(1, 3).try_cast("double").alias("focal"), F.lit(2.8).alias("aperture"), F.lit(5.0).alias("distance"), (i % 6 != 0).alias("has_exif"))
    mode = F.when(i % 4 == 0, F.create_map(F.lit("lensCorrectionMode"), F.lit('"manual"'), F.lit("lensMaker"), F.lit('"Sony"'))).otherwise(F.create_map(F.lit("exposure"), F.lit("1.0"), F.lit("lensDistortionParams"), F.lit("{}")))
    lenses = _lens_names(spark, d).selectExpr("*", "model as short", "model as canonical", "1.0D as cropfactor")
    return photos, lens.resolve_lens_for_edits(photos.withColumn("adjustments", mode), lenses, _calib(spark, d))


@query("d13_resolve_lenses")
def d13(spark, d):
    photos, rows = _lens_edits(spark, d)
    return rows.select("idx", _pairs(photos))


LENS_ENTRIES = [f"{k}_{p}" for k in ("distortion", "tca", "vignetting") for p in ("p1", "p2", "p3")]
_ASKED = "photos as (select idx, lens_id, try_cast(substr(focal_length, 1, 3) as double) as focal, 2.8::double as aperture, 5.0::double as distance from catalog join best using (make, lens) where idx % 4 <> 0 and idx % 6 <> 0)"


def _of_asked(sql):
    return sql.replace("photos as (" + CALIB.split(", photos as (")[1], _ASKED)


#: The entries of D13 as columns: those of the best match where the mode is automatic, and what was there before.
RESOLVED = (
    f"with best as ({MATCHED}), di as ({_of_asked(_interval_sql('distortion', '0.0'))}), tc as ({_of_asked(_interval_sql('tca', '1.0'))}), vg as ({_of_asked(VIGN)}), every as ({W} select idx, make, lens from catalog), {LENS_NAMES}, "
    "found as (select e.idx, n.maker, n.model from every e join best b using (make, lens) join names n on n.lens_id = b.lens_id where idx % 4 <> 0 and idx % 6 <> 0) "
    "select e.idx, case when e.idx % 4 = 0 then 'manual' end as mode, case when e.idx % 4 <> 0 then '1.0' end as exposure, case when e.idx % 4 = 0 then 'Sony' else f.maker end as maker, f.model, "
    + ", ".join(f"{t}.{p} as {k}_{p}" for t, k in (("di", "distortion"), ("tc", "tca"), ("vg", "vignetting")) for p in ("p1", "p2", "p3"))
    + " from every e left join found f using (idx) left join di on di.idx = e.idx left join tc on tc.idx = e.idx left join vg on vg.idx = e.idx"
)


@query("d13_lens_entries", RESOLVED)
def d13e(spark, d):
    """The edited documents entry by entry, the lens's values as numbers."""
    _, rows = _lens_edits(spark, d)
    own = lambda key: F.element_at("adjustments", key)
    text = lambda key: F.get_json_object(F.concat(F.lit('{"v":'), own(key), F.lit("}")), "$.v")
    values = F.from_json(own("lensDistortionParams"), ", ".join(f"{n} double" for n in LENS_ENTRIES))
    return rows.withColumn("_v", values).select("idx", text("lensCorrectionMode").alias("mode"), own("exposure").alias("exposure"), text("lensMaker").alias("maker"), text("lensModel").alias("model"), *[F.col(f"_v.{n}").alias(n) for n in LENS_ENTRIES])


LENS_FILES = """l as (select p_partkey % 60 as lens, min(p_size) as focal, max(p_partkey % 90) as k from part group by 1)"""


@query("a7_lens_files", f"with {LENS_FILES} select case lens % 3 when 0 then 'Sony' when 1 then 'Nikon' else 'Canon' end as maker, 'FE ' || lens || 'mm' as model, t.kind, cast(focal + 1 as double) as focal, case t.kind when 'distortion' then round(k / 997.0::double, 6) else 1.001 end as p1 from l, (values ('distortion'), ('tca')) t(kind)")
def a7(spark, d):
    """Lens files are written as XML, one lens an element, and read as a database."""
    from .sources.files import read_lens_db

    l = table(spark, d, "part").groupBy((F.col("p_partkey") % 60).alias("lens")).agg(F.min("p_size").alias("focal"), F.max(F.col("p_partkey") % 90).alias("k"))
    maker = F.when(F.col("lens") % 3 == 0, "Sony").when(F.col("lens") % 3 == 1, "Nikon").otherwise("Canon")
    name = lambda c, lang=None: F.struct(c.alias("_VALUE"), F.lit(lang).cast("string").alias("_lang"))
    focal = (F.col("focal") + 1).cast("double").alias("_focal")
    bend = F.array(F.struct(F.lit("ptlens").alias("_model"), focal, (F.col("k") / 997.0).alias("_a"), F.lit(0.0).alias("_b"), F.lit(0.0).alias("_c")))
    tca = F.array(F.struct(F.lit("linear").alias("_model"), focal, F.lit(1.001).alias("_vr"), F.lit(0.999).alias("_vb")))
    files = l.select(F.array(name(maker)).alias("maker"), F.array(name(F.concat(F.lit("C "), F.col("lens"))), name(F.concat(F.lit("FE "), F.col("lens"), F.lit("mm")), "en")).alias("model"), F.lit(1.0).alias("cropfactor"), F.struct(bend.alias("distortion"), tca.alias("tca")).alias("calibration"))
    folder = f"{shared_folder(spark)}/lens-files-{uuid.uuid4().hex}"
    files.write.format("xml").option("rowTag", "lens").option("rootTag", "lensdatabase").save(folder)
    lenses, calib = read_lens_db(spark, folder)
    return lenses.join(calib, "lens_id").select("maker", lenses["model"], "kind", "focal", F.round("p1", 6).alias("p1"))


NAMES = "l as (select p_partkey as lens_id, 'm' || p_partkey % 5 as maker, 's' || p_partkey % 300 as short, 'Maker c' || p_partkey % 700 as canonical, 1.0 + p_partkey % 3 * 0.3 as crop from part)"


@query("f10_lens_names", f"with {NAMES}, n as (select *, count(*) over (partition by maker, short) as a, count(*) over (partition by maker, regexp_replace(canonical, '^\\S+\\s+', '')) as b, count(*) over (partition by maker, canonical) as c from l) select lens_id, case when a = 1 then short when b = 1 then regexp_replace(canonical, '^\\S+\\s+', '') when c = 1 then canonical else canonical || ' (crop ' || printf('%.1f', crop::double) || 'x)' end as shown from n")
def f10(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey as lens_id", "'m' || p_partkey % 5 as maker", "'s' || p_partkey % 300 as short", "'Maker c' || p_partkey % 700 as canonical", "cast(1.0 + p_partkey % 3 * 0.3 as double) as cropfactor")
    return lens.disambiguate_lens_names(rows).select("lens_id", "shown")


FRAMES = "ev as (select user_id % 10 as run_id, event_id, 8 + value / 5 as gap from events), frames as (select run_id, event_id, sum(gap) over (partition by run_id order by event_id rows unbounded preceding) as ts_ms from ev), span as (select run_id, max(ts_ms) as top from frames group by 1), phases as (select run_id, i as iteration, i < 2 as warmup, ['scroll', 'open', 'edit'][k + 1] as phase, top * (i * 3 + k) / 30 as start_ms, top * (i * 3 + k + 1) / 30 as end_ms from span, range(10) t(i), range(3) u(k))"
GAPS = FRAMES + ", gaps as (select *, ts_ms - lag(ts_ms) over (partition by run_id order by ts_ms) as gap_ms from frames)"
METRIC = GAPS + ", m as (select p.run_id, iteration, warmup, phase, end_ms - start_ms as duration_ms, count(*) as frame_count, 1000 / avg(gap_ms) as avg_fps, max(gap_ms) as worst_ms, count(*) filter (gap_ms > 1000.0::double / 60 + 2) as dropped_count, coalesce(sum(gap_ms) filter (gap_ms > 1000.0::double / 60 + 2), 0) as dropped_ms from gaps g join phases p on g.run_id = p.run_id and ts_ms > start_ms and ts_ms <= end_ms where gap_ms is not null group by p.run_id, iteration, warmup, phase, start_ms, end_ms)"


def _frames(spark, d):
    from pyspark.sql import Window

    own = Window.partitionBy("run_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    frames = table(spark, d, "events").select((F.col("user_id") % 10).alias("run_id"), "event_id", (8 + F.col("value") / 5).alias("gap")).select("run_id", "event_id", F.sum("gap").over(own).alias("ts_ms"))
    span = frames.groupBy("run_id").agg(F.max("ts_ms").alias("top"))
    cut = span.select("run_id", "top", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("n"))
    phases = cut.select("run_id", F.floor(F.col("n") / 3).cast("long").alias("iteration"), (F.col("n") < 6).alias("warmup"), F.element_at(F.array(F.lit("scroll"), F.lit("open"), F.lit("edit")), F.col("n") % 3 + 1).alias("phase"), (F.col("top") * F.col("n") / 30).alias("start_ms"), (F.col("top") * (F.col("n") + 1) / 30).alias("end_ms"))
    return frames, phases


@query("f7_frame_gaps", f"with {GAPS} select event_id, round(gap_ms, 6) as gap_ms from gaps")
def f7(spark, d):
    return benchmark.frame_durations(_frames(spark, d)[0]).select("event_id", F.round("gap_ms", 6).alias("gap_ms"))


@query("d14_phases", f"with {GAPS} select event_id, iteration, phase from gaps g join phases p on g.run_id = p.run_id and ts_ms > start_ms and ts_ms <= end_ms")
def d14(spark, d):
    frames, phases = _frames(spark, d)
    return benchmark.assign_phases(benchmark.frame_durations(frames), phases).select("event_id", "iteration", "phase")


@query("f8_frame_metrics", f"with {METRIC} select run_id, iteration, phase, round(duration_ms, 6) as duration_ms, frame_count, round(avg_fps, 6) as avg_fps, round(worst_ms, 6) as worst_ms, dropped_count, round(dropped_ms, 6) as dropped_ms from m")
def f8(spark, d):
    frames, phases = _frames(spark, d)
    m = benchmark.frame_metrics(benchmark.frame_durations(frames), phases)
    return m.select("run_id", "iteration", "phase", "frame_count", "dropped_count", *[F.round(c, 6).alias(c) for c in ("duration_ms", "avg_fps", "worst_ms", "dropped_ms")])


STATS = METRIC + ", long as (" + " union all ".join(f"select run_id, phase, '{c}' as metric, cast({c} as double) as value from m where not warmup" for c in benchmark.METRICS) + "), st as (select run_id, phase, metric, quantile_cont(value, 0.5) as median, quantile_disc(value, 0.95) as p95, coalesce(stddev_samp(value), 0) as stdev from long group by 1, 2, 3)"


@query("e18_bench_stats", f"with {STATS} select run_id, phase, metric, round(median, 6) as median, round(p95, 6) as p95, round(stdev, 6) as stdev from st")
def e18(spark, d):
    frames, phases = _frames(spark, d)
    s = benchmark.bench_stats(benchmark.frame_metrics(benchmark.frame_durations(frames), phases))
    return s.select("run_id", "phase", "metric", *[F.round(c, 6).alias(c) for c in ("median", "p95", "stdev")])


@query("e19_bench_diff", f"with {STATS} select a.phase, a.metric, round(case when a.median <> 0 then (b.median - a.median) / a.median * 100 end, 6) as change, case when a.median = 0 then 'n/a' when b.median = a.median then 'same' when (b.median > a.median) = (a.metric in ('frame_count', 'avg_fps')) then 'better' else 'worse' end as verdict from st a join st b using (phase, metric) where a.run_id = 1 and b.run_id = 2")
def e19(spark, d):
    frames, phases = _frames(spark, d)
    s = benchmark.bench_stats(benchmark.frame_metrics(benchmark.frame_durations(frames), phases))
    return benchmark.bench_diff(s.where("run_id = 1"), s.where("run_id = 2")).select("phase", "metric", F.round("change", 6).alias("change"), "verdict")


LOG = "'<echo>' || chr(10) || '[Log] BENCH START' || chr(10) || '[Log] {\"run\":' || event_id || ',\"fps\":' || user_id || '} (replay.js, line 10)' || chr(10) || '[Log] BENCH END'"


@query("a10_bench_log", "select event_id, '{\"run\":' || event_id || ',\"fps\":' || user_id || '}' as json from events")
def a10(spark, d):
    logs = table(spark, d, "events").select("event_id", F.expr(LOG.replace("chr(10)", "char(10)")).alias("value"))
    return benchmark.bench_json(logs).select("event_id", "json")


@query("e20_bracket_sets", W + ", f as (select floor(idx / 30)::bigint as set_id, idx as pos, path, case when idx % 97 = 0 then null else 100 end as iso, case when idx % 53 = 0 then null else 0.1 end as exposure, case when idx % 71 = 0 then 1 else 2 end as width from catalog), s as (select *, first_value(width) over (partition by set_id order by pos) as w0, count(*) over (partition by set_id) as n, row_number() over (partition by set_id order by pos) as k from f), bad as (select set_id, min_by(path || ': ' || case when iso is null then 'no ISO' when exposure is null then 'no exposure' else 'size differs' end, pos) as error from s where iso is null or exposure is null or width <> w0 group by 1) select s.set_id, max(s.n) as n, case when max(s.n) < 2 then 'fewer than 2 frames' else max(error) end as error, case when max(s.n) >= 2 and max(error) is null then max(case when k = floor(s.n / 2) + 1 then path end) end as reference from s left join bad using (set_id) group by 1")
def e20(spark, d):
    f = catalog(spark, d).select(F.floor(F.col("idx") / 30).alias("set_id"), F.col("idx").alias("pos"), "path", F.when(F.col("idx") % 97 != 0, 100).alias("iso"), F.when(F.col("idx") % 53 != 0, 0.1).alias("exposure"), F.when(F.col("idx") % 71 == 0, 1).otherwise(2).alias("width"), F.lit(3).alias("height"))
    return benchmark.bracket_sets(f).withColumn("n", F.col("n").cast("long"))


@query("a11_catalog_buckets")
def a11(spark, d):
    """The catalog as it is written: by hash bucket of the source path."""
    return catalog(spark, d).select(F.pmod(F.xxhash64("source_path"), F.lit(64)).cast("int").alias("bucket"), "path", "rating").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("rating").alias("ratings"))


@query("a11_catalog_written", W + "select idx, path, cast(case when idx % 2 = 0 then 5 else rating end as int) as rating from catalog")
def a11w(spark, d):
    """The catalog as it is read back: written once, then again with new ratings, which replace those of the same buckets."""
    rows, folder = catalog(spark, d).select("idx", "path", "source_path", "rating"), f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}"
    write_catalog(rows, folder)
    return write_catalog(rows.withColumn("rating", F.when(F.col("idx") % 2 == 0, 5).otherwise(F.col("rating"))), folder).read().select("idx", "path", "rating")


@query("a11_catalog_pruned", W + "select idx, path, rating from catalog where modified between 800000000 and 810000000 and rating >= 3")
def a11p(spark, d):
    """The catalog as it is read back for a range of times and ratings: files without such rows are left out."""
    rows = catalog(spark, d).select("idx", "path", "source_path", "rating", "modified")
    kept = write_catalog(rows, f"{shared_folder(spark)}/catalog-{uuid.uuid4().hex}", order="modified", stats=("rating",))
    return kept.read(modified=(800000000, 810000000), rating=(3, None)).select("idx", "path", "rating")


@query("w3_edit_and_plan", W + "select idx, '/out/' || substr(folder, 6) || '/' || " + STEM + " || '_edited.jpg' as target from catalog where copy_id is null and idx % 2 = 0")
def w3(spark, d):
    from .plans.pipelines import edit_and_plan

    docs = _documents(spark, d)
    chosen = docs.where("idx % 2 = 0 and copy_id is null").select("path")
    items = _items(spark, d).join(chosen, "path", "left_semi")
    _, plan = edit_and_plan(docs, chosen, {"exposure": "1.0"}, items, catalog(spark, d).select("source_path"), spark.createDataFrame([("/lib",)], "base string"), "/out")
    return plan.select("idx", "target")
