"""Round trips of the file formats, and what a reader may skip."""

import json

import numpy as np
import pytest

from terrafold.functions import columns as C
from terrafold.functions import wkb, wkt
from terrafold.sources import flatgeobuf, geojson, geoparquet

CASES = ["POINT(1 2)", "LINESTRING(0 0,1 1,2 0)", "POLYGON((0 0,4 0,4 4,0 4,0 0),(1 1,1 2,2 2,2 1,1 1))", "MULTIPOINT(0 0,1 1)", "MULTILINESTRING((0 0,1 1),(2 2,3 3))", "MULTIPOLYGON(((0 0,1 0,1 1,0 0)),((5 5,6 5,6 6,5 5)))", "POINT Z(1 2 3)", "GEOMETRYCOLLECTION(POINT(1 2),LINESTRING(0 0,1 1))"]


def table(spark, wkts=CASES):
    rows = [(i, f"name {i}" if i % 3 else None, i * 1.5, i % 2 == 0, w) for i, w in enumerate(wkts)]
    df = spark.createDataFrame(rows, "id int, name string, v double, flag boolean, w string")
    return df.withColumn("geometry", C.st_geomfromtext("w")).drop("w")


def texts(df):
    return {r.id: (r.name, r.v, r.flag, r.t) for r in df.withColumn("t", C.st_astext("geometry")).collect()}


def test_flatgeobuf_round_trip(spark, tmp_path):
    flatgeobuf.register(spark)
    df = table(spark)
    path = f"{tmp_path}/t"
    df.write.format("flatgeobuf").mode("append").save(path)
    back = spark.read.format("flatgeobuf").load(path)
    assert {f.name: f.dataType.simpleString() for f in back.schema} == {"id": "int", "name": "string", "v": "double", "flag": "boolean", "geometry": "binary"}
    assert texts(back) == texts(df)
    one = spark.read.format("flatgeobuf").option("columns", "v").load(path)
    assert one.columns == ["v"] and one.count() == len(CASES)


def test_flatgeobuf_box_option_reads_the_tree(spark, tmp_path):
    flatgeobuf.register(spark)
    pts = spark.range(2000).select("id", C.st_point(C.F.col("id") % 50, C.F.floor(C.F.col("id") / 50)).alias("geometry"))
    path = f"{tmp_path}/p"
    pts.coalesce(1).write.format("flatgeobuf").mode("append").save(path)
    got = spark.read.format("flatgeobuf").option("bbox", "10,5,12,7").load(path)
    want = {r.id for r in pts.collect() if 10 <= r.id % 50 <= 12 and 5 <= r.id // 50 <= 7}
    assert {r.id for r in got.collect()} == want and len(want) == 9
    assert spark.read.format("flatgeobuf").option("bbox", "1000,1000,1001,1001").load(path).count() == 0


@pytest.mark.parametrize("n", [1, 2, 16, 17, 300])
def test_tree_search_finds_what_a_scan_finds(n):
    rng = np.random.default_rng(n)
    lo = rng.integers(0, 100, (n, 2)).astype(float)
    boxes = np.column_stack([lo, lo + rng.integers(0, 9, (n, 2))])
    nodes, levels = flatgeobuf.build_tree(boxes, np.arange(n)), flatgeobuf.tree_levels(n)
    for box in ((10, 10, 30, 40), (0, 0, 200, 200), (500, 500, 501, 501)):
        want = np.flatnonzero((boxes[:, 0] <= box[2]) & (boxes[:, 2] >= box[0]) & (boxes[:, 1] <= box[3]) & (boxes[:, 3] >= box[1]))
        assert sorted(flatgeobuf.search_tree(nodes, levels, 16, box).tolist()) == want.tolist()


def test_flatgeobuf_empty_and_null_geometries(spark, tmp_path):
    flatgeobuf.register(spark)
    df = spark.createDataFrame([(1, None), (2, "POINT(1 2)")], "id int, w string").select("id", C.st_geomfromtext("w").alias("geometry"))
    df.coalesce(1).write.format("flatgeobuf").mode("append").save(f"{tmp_path}/n")
    back = {r.id: r.geometry for r in spark.read.format("flatgeobuf").load(f"{tmp_path}/n").collect()}
    assert back[1] is None and wkt.format(wkb.read(bytes(back[2]))) == "POINT(1 2)"


def test_geojson_lines(spark, tmp_path):
    df = table(spark)
    geojson.write(df.coalesce(1), f"{tmp_path}/j")
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/j").collect()]
    by = {x["id"]: x for x in lines}
    assert by[0] == {"type": "Feature", "id": 0, "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"name": None, "v": 0.0, "flag": True}}
    assert by[7]["geometry"]["type"] == "GeometryCollection" and by[6]["geometry"]["coordinates"] == [1, 2, 3]
    back = geojson.read(spark, f"{tmp_path}/j", "name string, v double, flag boolean")
    assert {int(k): v for k, v in texts(back).items()} == texts(df)


def test_geoparquet(spark, tmp_path):
    path = f"file://{tmp_path}/g"
    geoparquet.write(table(spark).repartition(2), path, crs={"id": {"authority": "EPSG", "code": 4326}})
    df = geoparquet.read(spark, path)
    assert texts(df) == texts(table(spark))
    about = geoparquet.metadata(df.inputFiles()[0])
    assert about["primary_column"] == "geometry" and about["columns"]["geometry"]["covering"]["bbox"]["xmin"] == ["bbox", "xmin"]
    assert df.schema["geometry"].metadata["encoding"] == "WKB" and "4326" in df.schema["geometry"].metadata["crs"]
    near = geoparquet.read_box(spark, path, 5, 5, 7, 7)
    assert [r.id for r in near.collect()] == [5]
    assert "PushedFilters" in near._jdf.queryExecution().executedPlan().toString() and "bbox.xmin" in near._jdf.queryExecution().executedPlan().toString()


def test_flatgeobuf_metadata_and_overwrite(spark, tmp_path):
    flatgeobuf.register(spark)
    path = f"{tmp_path}/m"
    pts = spark.range(5).select(C.F.col("id").cast("int").alias("id"), C.st_point(C.F.col("id"), C.F.lit(1.0)).alias("geometry"))
    pts.coalesce(1).write.format("flatgeobuf").mode("append").option("crs", "4326").save(path)
    assert spark.read.format("flatgeobuf").load(path).schema["geometry"].metadata["crs"] == "EPSG:4326"
    failing = pts.withColumn("id", C.F.when(C.F.col("id") == 3, C.F.raise_error(C.F.lit("no")).cast("int")).otherwise(C.F.col("id")))
    with pytest.raises(Exception):
        failing.write.format("flatgeobuf").mode("overwrite").save(path)
    assert spark.read.format("flatgeobuf").load(path).count() == 5  # what was there stays
    pts.where("id < 2").write.format("flatgeobuf").mode("overwrite").save(path)
    assert sorted(r.id for r in spark.read.format("flatgeobuf").load(path).collect()) == [0, 1]


def test_flatgeobuf_columns_of_features(spark, tmp_path):
    """A header without columns: features bring their own."""
    import struct

    flatgeobuf.register(spark)
    f = flatgeobuf
    body = f.MAGIC + f.Header([], 1, False, False, 0, 0).pack()
    for i, columns in enumerate(([("id", 5), ("name", 11)], [("name", 11)], [])):
        props = b"".join(struct.pack("<H", k) + (struct.pack("<i", i) if kind == 5 else struct.pack("<I", 2) + b"n%d" % i) for k, (_, kind) in enumerate(columns))
        fields = {0: f._Ref(one=f._pack_geometry(wkt.parse(f"POINT({i} 2)"))), 1: f._Ref(props, len(props), 1), 2: f._Ref(tables=[{0: f._string(n), 1: ("B", t)} for n, t in columns])}
        feature = f._Writer().finish(fields)
        body += struct.pack("<I", len(feature)) + feature
    (tmp_path / "h.fgb").write_bytes(body)
    df = spark.read.format("flatgeobuf").load(f"{tmp_path}/h.fgb")
    got = {(r.id, r.name, wkt.format(wkb.read(bytes(r.geometry)))) for r in df.collect()}
    assert got == {(0, "n0", "POINT(0 2)"), (None, "n1", "POINT(1 2)"), (None, None, "POINT(2 2)")}


def test_geoparquet_keeps_a_column_named_bbox_and_older_files(spark, tmp_path):
    path = f"file://{tmp_path}/b"
    with pytest.raises(ValueError):
        geoparquet.write(table(spark).withColumn("bbox", C.F.lit(1)), path)
    geoparquet.write(table(spark), path)
    old = {f: (tmp_path / "b" / f.rpartition("/")[2]).stat().st_mtime_ns for f in geoparquet.read(spark, path).inputFiles()}
    geoparquet.write(table(spark), path, mode="append")
    assert geoparquet.read(spark, path).count() == 2 * len(CASES)
    assert all((tmp_path / "b" / f.rpartition("/")[2]).stat().st_mtime_ns == t for f, t in old.items())
