"""Golden cases of the functions, through SQL and through columns."""

import pytest

from terrafold.functions import columns as C
from terrafold.functions import shapes, wkb, wkt
from terrafold.functions.registry import register_all


@pytest.fixture(scope="module")
def sql(spark):
    register_all(spark)
    return lambda e: spark.sql(f"SELECT {e} AS v").first().v


T = "st_astext(st_geomfromtext('{}'))"
CASES = [
    ("st_coorddim('POINT(1 1)')", 2), ("st_ndims('POINT(1 1)')", 2), ("geometrytype('LINESTRING(77.29 29.07,77.42 29.26)')", "LINESTRING"), ("geometrytype('POINT ZM(1 2 3 4)')", "POINTZM"),
    ("st_geometrytype('LINESTRING(77.29 29.07,77.42 29.26)')", "ST_LineString"), ("st_npoints('LINESTRING(77.29 29.07,77.42 29.26,77.27 29.31,77.29 29.07)')", 4), ("st_npoints('POINT EMPTY')", 0),
    ("st_x('POINT(1 2)')", 1.0), ("st_y('POINT(1 2)')", 2.0), ("st_x('POINT EMPTY')", None), ("st_x('LINESTRING(0 0,1 1)')", None), ("st_z(st_pointz(1, 2, 3))", 3.0), ("st_z(st_pointzm(1, 2, 3, 4))", 3.0),
    ("st_z(st_pointm(1, 2, 3))", None), ("st_m(st_pointm(1, 2, 3))", 3.0), ("st_m(st_pointzm(1, 2, 3, 4))", 4.0), ("st_m(st_point(1, 2))", None),
    ("st_isclosed('LINESTRING(0 0,1 1,0 1,0 0)')", True), ("st_isclosed('LINESTRING(0 0,1 1,1 0)')", False), ("st_isclosed('LINESTRING(0 0,0 0)')", True), ("st_isclosed('LINESTRING EMPTY')", False),
    ("st_isclosed('MULTILINESTRING((0 0,1 1,0 0),(2 2,3 3,2 2))')", True), ("st_isclosed('MULTILINESTRING((0 0,1 1,0 0),(2 2,3 3,2 3))')", False), ("st_isclosed('MULTILINESTRING EMPTY')", False),
    ("st_isclosed('POINT(0 0)')", True), ("st_isclosed('MULTIPOINT(0 0,1 1)')", True), ("st_isclosed('POLYGON((0 0,1 0,1 1,0 0))')", True), ("st_isclosed('GEOMETRYCOLLECTION(POINT(0 0))')", False),
    ("st_isempty('GEOMETRYCOLLECTION EMPTY')", True), ("st_isempty('POLYGON((1 2,3 4,5 6,1 2))')", False), ("st_isempty('GEOMETRYCOLLECTION(POINT EMPTY,POLYGON EMPTY)')", True), ("st_isempty('MULTILINESTRING(EMPTY,(0 0,1 1))')", False),
    ("st_isempty(X'010400000000000000')", True), ("st_isempty(X'0106000000020000000103000000000000000103000000010000000400000000000000000000000000000000000000000000000000f03f0000000000000000000000000000f03f000000000000f03f00000000000000000000000000000000')", False),
    ("st_isempty(X'0104000000020000000101000000000000000000f87f000000000000f87f010100000000000000000000000000000000000000')", False), ("st_isempty(CAST(NULL AS STRING))", None),
    ("st_astext(st_endpoint('LINESTRING EMPTY'))", None), ("st_astext(st_startpoint('LINESTRING M(0 1 5,2 3 6)'))", "POINT M(0 1 5)"), ("st_astext(st_pointn('LINESTRING(0 0,1 1,2 2)', -1))", "POINT(2 2)"),
    ("st_numinteriorrings('POLYGON((0 0,3 0,3 3,0 0),(1 1,2 1,2 2,1 1))')", 1), ("st_numinteriorring('POINT(1 1)')", None),
    (T.format("MULTIPOINT((0 0),(1 1))"), "MULTIPOINT(0 0,1 1)"), (T.format("point z (0 0 1)"), "POINT Z(0 0 1)"), (T.format("POLYGON EMPTY"), "POLYGON EMPTY"), (T.format("LINESTRING(0.1 1e-7,1e20 -2.50)"), "LINESTRING(0.1 0.0000001,100000000000000000000 -2.5)"),
    ("st_astext(X'000000000140000000000000004010000000000000')", "POINT(2 4)"), ("st_astext(X'0101000020E6100000000000000000F03F0000000000000040')", "POINT(1 2)"), ("st_astext(st_point(NULL, 1))", None), ("st_astext(st_makepoint(1, 2, 3, 4))", "POINT ZM(1 2 3 4)"),
    ("st_area('POLYGON((743238 2967416,743238 2967450,743265 2967450,743265.625 2967416,743238 2967416))')", 928.625), ("st_length('LINESTRING(0 0,3 4)')", 5.0), ("st_length('POINT(1 1)')", 0.0), ("st_length('MULTILINESTRING((0 0,3 4),(0 0,3 4))')", 10.0), ("st_length('POLYGON((0 0,1 0,1 1,0 0))')", 0.0),
    ("round(st_distance('POINT(-72.1235 42.3521)', 'LINESTRING(-72.1260 42.45,-72.123 42.1546)'), 12)", 0.001505677264), ("st_distance('POINT(1 1)', 'POLYGON((0 0,4 0,4 4,0 4,0 0))')", 0.0), ("st_distance('POINT(1 1)', 'POINT EMPTY')", None),
    ("st_astext(st_centroid('MULTIPOINT(-1 0,-1 2,-1 3,-1 4,-1 7,0 1,0 3,1 1,2 0,6 0,7 8,9 8,10 6)'))", "POINT(2.3076923076923075 3.3076923076923075)"), ("st_astext(st_centroid('POLYGON EMPTY'))", "POINT EMPTY"),
    ("st_astext(st_simplify('LINESTRING(0 0,5 4,11 5.5,17.3 3.2,27.8 0.1)', 1.0))", "LINESTRING(0 0,5 4,11 5.5,27.8 0.1)"), ("st_astext(st_simplifyvw('LINESTRING(5 2,3 8,6 20,7 25,10 10)', 30))", "LINESTRING(5 2,7 25,10 10)"), ("st_astext(st_simplify('POINT Z(1 2 3)', 1))", "POINT Z(1 2 3)"),
    ("st_geohash(st_point(-126, 48))", "c0w3hf1s70w3"), ("st_geohash('POINT EMPTY')", None), ("st_box2dfromgeohash('ww8p1r4t8').xmax", 112.5584077835083), ("st_box2dfromgeohash('ww8p1r4t8').ymin", 37.83236503601074), ("st_astext(st_pointfromgeohash('9qqj'))", "POINT(-115.13671875 36.123046875)"),
    ("st_intersects('POINT(0 0)', 'LINESTRING(0 0,0 2)')", True), ("st_intersects('POINT(0 0)', 'LINESTRING(2 0,0 2)')", False), ("st_intersects(CAST(NULL AS STRING), 'POINT(0 0)')", None), ("st_contains('POLYGON((0 0,4 0,4 4,0 4,0 0))', 'POINT(1 1)')", True),
    ("st_disjoint('POINT EMPTY', 'POINT(0 0)')", True), ("st_equals('POINT EMPTY', 'LINESTRING EMPTY')", True), ("st_touches('POLYGON((0 0,1 0,1 1,0 1,0 0))', 'POLYGON((1 0,2 0,2 1,1 1,1 0))')", True),
    ("st_isvalid('POLYGON((0 0,2 2,2 0,0 2,0 0))')", False), ("st_isvalidreason('POLYGON((0 0,2 2,2 0,0 2,0 0))')", "Self-intersection[1 1]"), ("st_isvalidreason('POINT(1 1)')", "Valid Geometry"),
    ("st_zmin('POINT(1 2)')", None), ("st_xmin(st_makebox2d(st_point(0, 5), st_point(10, 20)))", 0.0), ("box2d(box3d('LINESTRING Z(1 2 3,3 4 5,5 6 7)')).ymax", 6.0), ("box3d('LINESTRING Z(1 2 3,3 4 5,5 6 7)').zmax", 7.0), ("st_3dmakebox(st_pointz(0, 5, 1), st_pointz(10, 20, 30)).zmax", 30.0),
    ("st_expand(st_makebox2d(st_point(0, 5), st_point(10, 20)), 10, 20).ymin", -15.0), ("st_astext(st_envelope('LINESTRING(0 0,2 1)'))", "POLYGON((0 0,0 1,2 1,2 0,0 0))"), ("box2d('MULTIPOLYGON EMPTY').xmin", None),
    ("st_astext(st_convexhull('MULTIPOINT(0 0,1 1)'))", "LINESTRING(0 0,1 1)"), ("st_astext(st_convexhull('POINT(1 1)'))", "POINT(1 1)"),
]


@pytest.mark.parametrize(("e", "want"), CASES)
def test_golden(sql, e, want):
    assert sql(e) == want


def test_extent_in_sql(spark, sql):
    got = spark.sql("SELECT st_extent(st_geomfromtext(w)) AS e FROM VALUES ('POLYGON((743238 2967416,743238 2967450,743265 2967450,743265.625 2967416,743238 2967416))'), (NULL) AS t(w)").first().e
    assert tuple(got) == (743238.0, 2967416.0, 743265.625, 2967450.0)


def test_extent_over_nothing_and_nulls(spark):
    df = spark.createDataFrame([(1, None), (2, "POINT EMPTY")], "k int, w string")
    assert df.agg(C.st_extent(C.box2d("w")).alias("e")).first().e is None
    assert df.where("k > 5").agg(C.st_extent(C.box2d("w")).alias("e")).first().e is None


DUMPS = [
    ("POINT(1 2)", [([], "POINT(1 2)")]),
    ("MULTIPOINT ZM(0 0 1 5,1 1 2 6)", [([1], "POINT ZM(0 0 1 5)"), ([2], "POINT ZM(1 1 2 6)")]),
    ("GEOMETRYCOLLECTION(MULTIPOLYGON(((0 0,0 1,1 1,1 0,0 0)),((10 10,10 20,20 20,20 10,10 10))),POINT(5 5))", [([1, 1], "POLYGON((0 0,0 1,1 1,1 0,0 0))"), ([1, 2], "POLYGON((10 10,10 20,20 20,20 10,10 10))"), ([2], "POINT(5 5)")]),
    ("GEOMETRYCOLLECTION(POINT(0 0),POLYGON EMPTY)", [([1], "POINT(0 0)"), ([2], "POLYGON EMPTY")]),
    ("MULTIPOLYGON EMPTY", []),
    ("GEOMETRYCOLLECTION(POINT EMPTY,LINESTRING EMPTY)", []),
]


@pytest.mark.parametrize(("w", "want"), DUMPS)
def test_dump(spark, w, want):
    got = spark.createDataFrame([(w,)], "w string").select(C.st_dump(C.st_geomfromtext("w")).alias("d")).first().d
    assert [(p.path, wkt.format(wkb.read(bytes(p.geom)))) for p in got] == want


MERGES = [
    ("MULTILINESTRING((10 160,60 120),(120 140,60 120),(120 140,180 120))", False, "LINESTRING(10 160,60 120,120 140,180 120)"),
    ("MULTILINESTRING((10 160,60 120),(120 140,60 120),(120 140,180 120),(100 180,120 140))", False, "MULTILINESTRING((10 160,60 120,120 140),(100 180,120 140),(120 140,180 120))"),
    ("MULTILINESTRING((-29 -27,-30 -29.7,-36 -31,-45 -33),(-45.2 -33.2,-46 -32))", False, "MULTILINESTRING((-45.2 -33.2,-46 -32),(-29 -27,-30 -29.7,-36 -31,-45 -33))"),
    ("LINESTRING(0 0,1 1)", False, "LINESTRING(0 0,1 1)"),
    ("POINT(0 0)", False, "GEOMETRYCOLLECTION EMPTY"),
    ("POLYGON((0 0,1 0,1 1,0 1,0 0))", False, "LINESTRING(0 0,1 0,1 1,0 1,0 0)"),
    ("LINESTRING EMPTY", False, "LINESTRING EMPTY"),
    ("MULTILINESTRING((60 30,10 70),(120 50,60 30),(120 50,180 30))", True, "MULTILINESTRING((120 50,60 30,10 70),(120 50,180 30))"),
    ("MULTILINESTRING((60 30,10 70),(120 50,60 30),(120 50,180 30))", False, "LINESTRING(180 30,120 50,60 30,10 70)"),
]


@pytest.mark.parametrize(("w", "directed", "want"), MERGES)
def test_line_merge(w, directed, want):
    assert wkt.format(shapes.line_merge(wkt.parse(w), directed)) == want


@pytest.mark.parametrize("w", ["POIN(1 2)", "POINT(1)", "POINT(1 2", "LINESTRING(0 0,1)", "POINT(1 2) x", "", "POINT(a b)"])
def test_bad_text(w):
    with pytest.raises(ValueError):
        wkt.parse(w)


@pytest.mark.parametrize("b", [b"", b"\x01", b"\x02\x01\x00\x00\x00", b"\x01\x63\x00\x00\x00", b"\x01\x02\x00\x00\x00\xff\xff\xff\x7f"])
def test_bad_binary(b):
    with pytest.raises(ValueError):
        wkb.read(b)


def test_crs_is_column_metadata(spark):
    df = spark.range(1).select(C.st_point("id", "id", 4326).alias("g"))
    assert df.schema["g"].metadata == {"crs": "EPSG:4326", "crs_type": "authority_code"}


def test_native_points_need_no_python(spark):
    p = C.st_point("id", C.F.col("id") * 2)
    df = spark.range(5).select(C.st_x(p).alias("x"), C.st_geohash(p).alias("h"), C.st_distance(p, p).alias("d"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert df.first().x == 0.0


def test_mixed_layouts_in_one_column(spark):
    ws = ["POINT(1 2)", "POINT EMPTY", None, "LINESTRING(0 0,3 4)", "POLYGON((0 0,2 0,2 2,0 2,0 0))", "POINT Z(1 2 3)", "MULTIPOINT(1 1,EMPTY)"] * 3
    df = spark.createDataFrame([(i, w) for i, w in enumerate(ws)], "i int, w string").coalesce(1).withColumn("g", C.st_geomfromtext("w"))
    got = {r.i: r for r in df.select("i", C.st_npoints("g").alias("n"), C.st_length("g").alias("l"), C.st_area("g").alias("a"), C.st_astext("g").alias("t")).collect()}
    assert [got[i].n for i in range(7)] == [1, 0, None, 2, 5, 1, 1]
    assert [got[i].l for i in range(7)] == [0, 0, None, 5, 0, 0, 0] and got[4].a == 4
    assert [got[i].t for i in range(7)] == ws[:7] and all(got[i].t == ws[i] for i in range(21))


def test_every_name_is_registered(spark):
    from terrafold.functions.registry import GROUPS
    from terrafold.functions.udfs import ALIASES, TABLE

    assert sorted(register_all(spark)) == sorted([*TABLE, *ALIASES, "st_extent"])
    assert sorted(n for g in GROUPS.values() for n in g) == sorted(TABLE)
    for name in (*TABLE, *ALIASES):
        assert hasattr(C, name), name
