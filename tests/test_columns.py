from pyspark.sql import functions as F

from fotoloom.functions import exif, paths, xmp


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_virtual_paths_split_at_the_last_mark(spark):
    p = F.lit("/a/b.c.ARW?vc=b?vc=c12345")
    assert value(spark, paths.source_path(p)) == "/a/b.c.ARW?vc=b" and value(spark, paths.copy_id(p)) == "c12345"
    assert value(spark, paths.copy_id(F.lit("/a/b.jpg"))) is None
    assert value(spark, paths.stem(F.lit("/x/b.c.ARW"))) == "b.c" and value(spark, paths.extension(F.lit("/x/b.JPG"))) == "jpg"
    assert value(spark, paths.file_label(F.lit("/x/README"))) == "FILE"
    assert value(spark, paths.folders_above(F.lit("/a/b/c.jpg"))) == ["/a", "/a/b"] and value(spark, paths.folders_above(F.lit("/c.jpg"))) == []


def test_kinds(spark):
    assert value(spark, paths.is_raw(F.lit("/x/y.Cr3"))) and not value(spark, paths.is_raw(F.lit("/x/y.png")))
    assert value(spark, paths.is_supported(F.lit("y.PNG"))) and not value(spark, paths.is_supported(F.lit("y.txt")))


def test_legacy_names(spark):
    assert value(spark, paths.legacy_sidecar_image(F.lit("a.jpg.abc123.rrdata"))) == "a.jpg" and value(spark, paths.legacy_sidecar_copy(F.lit("a.jpg.abc123.rrdata"))) == "abc123"
    assert value(spark, paths.legacy_sidecar_image(F.lit("a.jpg.rrdata"))) == "a.jpg" and value(spark, paths.legacy_sidecar_copy(F.lit("a.jpg.rrdata"))) is None
    assert value(spark, paths.legacy_sidecar_image(F.lit("a.jpg"))) is None


def test_dates(spark):
    for text in ("2024:03:05 06:07:08", '"2024-03-05T06:07:08"', " 2024-03-05 06:07:08 ", "2024:03:05 06:07:08.25"):
        got = value(spark, F.date_format(exif.exif_date(F.lit(text)), "yyyy-MM-dd HH:mm:ss"))
        assert got == "2024-03-05 06:07:08", text
    assert value(spark, exif.exif_date(F.lit("soon"))) is None


def test_exposure(spark):
    assert value(spark, exif.shutter(F.lit("1/250 s"))) == 1 / 250 and value(spark, exif.shutter(F.lit("1/0 s"))) == 0 and value(spark, exif.shutter(F.lit("2.5"))) == 2.5
    assert value(spark, exif.aperture(F.lit("f/2.8"))) == 2.8 and value(spark, exif.aperture(F.lit(None).cast("string"))) == 0
    assert value(spark, exif.exposure_seconds(F.lit("x"), F.lit("1/10"))) == 0.1 and value(spark, exif.exposure_seconds(F.lit("x"), F.lit(None).cast("string"))) is None


def test_gps(spark):
    assert abs(value(spark, exif.gps_decimal(F.lit("48 deg 8 min 12.5 sec"), F.lit("S"))) + (48 + 8 / 60 + 12.5 / 3600)) < 1e-9
    assert value(spark, exif.gps_decimal(F.lit("48 deg 8 min"), F.lit("N"))) is None


def test_white_balance_there_and_back(spark):
    for k in (3200.0, 5500.0, 9000.0):
        r = exif.kelvin_to_relative(F.lit(k), F.lit(5500.0))
        assert abs(value(spark, exif.relative_to_kelvin(r, F.lit(5500.0))) - k) < 1e-6
    assert value(spark, exif.as_shot_kelvin([F.lit("12")], F.lit("21"))) == 6500 and value(spark, exif.as_shot_kelvin([F.lit("5200 K")], F.lit(None).cast("string"))) == 5200


def test_resize(spark):
    w, h = paths.resize_target(F.lit(4000), F.lit(3000), "long", 2048, True)
    assert (value(spark, w), value(spark, h)) == (2048, 1536)
    w, h = paths.resize_target(F.lit(400), F.lit(300), "long", 2048, True)
    assert (value(spark, w), value(spark, h)) == (400, 300)
    w, h = paths.resize_target(F.lit(400), F.lit(300), "height", 600, False)
    assert (value(spark, w), value(spark, h)) == (800, 600)


def test_xmp_written_and_read_again(spark):
    for content in (None, '<rdf:Description xmp:Rating="1"/>', "<rdf:Description><xmp:Rating>2</xmp:Rating><dc:subject>x</dc:subject></rdf:Description>"):
        text = xmp.written(F.lit(content).cast("string"), F.lit(4), F.array(F.lit("color:red"), F.lit("user:me"), F.lit("sea")), create=True)
        assert value(spark, xmp.rating(text)) == 4 and value(spark, xmp.label(text)) == "Red" and value(spark, xmp.subjects(text)) == ["me", "sea"]


def test_preset(spark):
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    text = '<x crs:Exposure2012="+1.50" crs:Shadows2012="80" crs:Tint="300"><crs:Name> <rdf:Alt><rdf:li xml:lang="x">Warm</rdf:li></rdf:Alt></crs:Name><crs:ToneCurvePV2012><rdf:Seq><rdf:li>0, 20</rdf:li><rdf:li>128, 140</rdf:li></rdf:Seq></crs:ToneCurvePV2012>'
    m = value(spark, xmp.preset_adjustments(F.lit(text)))
    assert m == {"exposure": 1.5, "shadows": 100.0, "tint": 100.0} and value(spark, xmp.preset_name(F.lit(text))) == "Warm"
    assert [tuple(p) for p in value(spark, xmp.preset_curve(F.lit(text)))] == [(0, 16), (128, 140)]


def test_a_preset_is_searched_for_attributes_once(spark):
    rows = spark.range(1).select(xmp.preset_adjustments(F.concat(F.lit("<x crs:Exposure2012='"), F.col("id"), F.lit("'/>"))).alias("m"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2  # names and values
    assert rows.first()["m"] == {"exposure": 0.0}
