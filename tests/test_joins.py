"""Grid joins against nested loops, with sizes of many levels, shared borders, nulls and empty sides."""

import random

import pytest
from pyspark.sql import functions as F

from terrafold.functions import columns as C
from terrafold.operators.spatial import distance_join, spatial_filter, spatial_join
from terrafold.plans import queries as Q
from terrafold.streaming.extents import windowed_extent

BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def boxes(spark, n, seed, key):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        x, y, s = r.randint(-40, 40) / 2, r.randint(-40, 40) / 2, r.choice([0.0, 0.5, 1.0, 4.0, 64.0, 1000.0])
        rows.append((i, (x, y, x + s, y + s) if i % 17 else None))
    return spark.createDataFrame(rows, f"{key} int, {key}_box {BOX}"), rows


def meet(a, b):
    return a is not None and b is not None and a[0] <= b[2] and a[2] >= b[0] and a[1] <= b[3] and a[3] >= b[1]


@pytest.mark.parametrize("cell", [None, 0.5, 100.0])
def test_boxes_of_many_sizes(spark, cell):
    (a, ra), (b, rb) = boxes(spark, 120, 1, "a"), boxes(spark, 90, 2, "b")
    want = sorted((i, j) for i, x in ra for j, y in rb if meet(x, y))
    got = spatial_join(a, b, "a_box", "b_box", left_box="a_box", right_box="b_box", cell=cell, exact=False)
    assert sorted((r.a, r.b) for r in got.collect()) == want
    exact = spatial_join(a, b, "a_box", "b_box", left_box="a_box", right_box="b_box", cell=cell)
    assert sorted((r.a, r.b) for r in exact.collect()) == want


@pytest.mark.parametrize("how", ["left", "left_semi", "left_anti"])
def test_outer_joins(spark, how):
    (a, ra), (b, rb) = boxes(spark, 60, 3, "a"), boxes(spark, 5, 4, "b")
    hits = {i for i, x in ra if any(meet(x, y) for _, y in rb)}
    got = spatial_join(a, b, "a_box", "b_box", how=how, left_box="a_box", right_box="b_box", exact=False)
    ids = [r.a for r in got.collect()]
    if how == "left":
        assert len(ids) == sum(max(1, sum(meet(x, y) for _, y in rb)) for _, x in ra)
    else:
        assert sorted(ids) == sorted(i for i, _ in ra if (i in hits) == (how == "left_semi"))


@pytest.mark.parametrize("name", ["spatial_join", "spatial_join_boxes", "spatial_join_left", "spatial_join_semi", "spatial_join_anti", "flagship"])
def test_registered_joins_take_all_orders(spark, tmp_path, name):
    orders = [(o, f"{o % 5}") for o in range(1, 3001)]
    customers = [(k,) for k in range(1, 301)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(customers, "c_custkey long").withColumn("c_acctbal", F.col("c_custkey").cast("double")).write.parquet(f"{tmp_path}/customer.parquet")
    points = [(r.k, r.x, r.y) for r in Q.base(spark, str(tmp_path)).collect()]
    rects = [(o, p, x, y, x + (o % 4 + 1) / 2, y + (o % 3 + 1) / 2) for o, p in orders for x, y in [((o * 41) % 23040 / 64 - 180, (o * 59) % 11520 / 64 - 90)]]
    pairs = [(k, x, y, r) for k, x, y in points for r in rects if r[2] <= x <= r[4] and r[3] <= y <= r[5]]
    assert len({r[0] % 4 for *_, r in pairs}) == 4
    hit, got = {k for k, *_ in pairs}, Q.QUERIES[name](spark, str(tmp_path)).collect()
    if name == "flagship":
        want = []
        for p in {r[1] for *_, r in pairs}:
            own = [(x, y, r) for _, x, y, r in pairs if r[1] == p]
            xs, ys = [x for x, _, _ in own], [y for _, y, _ in own]
            want.append((p, len(own), sum((r[4] - r[2]) * (r[5] - r[3]) for *_, r in own), min(xs), min(ys), max(xs), max(ys)))
        assert sorted(tuple(r) for r in got) == sorted(want)
    elif name in ("spatial_join_semi", "spatial_join_anti"):
        assert sorted(r.k for r in got) == sorted(k for k, *_ in points if (k in hit) == (name == "spatial_join_semi"))
    else:
        rest = [(k, -1) for k, *_ in points if k not in hit] if name == "spatial_join_left" else []
        assert sorted((r.k, r.o) for r in got) == sorted([(k, r[0]) for k, _, _, r in pairs] + rest)


def test_distance_and_empty_sides(spark):
    p = spark.range(100).select(F.col("id").alias("i"), C.st_point(F.col("id") % 10, F.floor(F.col("id") / 10)).alias("g"))
    q = p.select(F.col("i").alias("j"), F.col("g").alias("h"))
    got = distance_join(p, q, "g", "h", 1.0).where("i < j").count()
    assert got == 180
    assert distance_join(p, q.where("j < 0"), "g", "h", 1.0).count() == 0
    assert spatial_join(p.where("i < 0"), q, "g", "h").count() == 0


def test_filter_prunes_and_refines(spark, tmp_path):
    p = spark.range(400).select("id", C.st_point(F.col("id") % 20, F.floor(F.col("id") / 20)).alias("g"))
    p.withColumn("box", C.box2d("g")).write.parquet(f"{tmp_path}/p")
    got = spatial_filter(spark.read.parquet(f"{tmp_path}/p"), "g", "POLYGON((0 0,10 0,0 10,0 0))", box="box")
    assert got.count() == 66
    assert "box.xmin" in got._jdf.queryExecution().executedPlan().toString().split("PushedFilters", 1)[1]


def test_stream(spark, tmp_path):
    src = f"{tmp_path}/in"
    spark.createDataFrame([("2024-01-01 00:00:01", 1.0, 2.0), ("2024-01-01 00:00:05", 5.0, -1.0), ("2024-01-01 00:01:05", 7.0, 7.0)], "t string, x double, y double").select(F.to_timestamp("t").alias("t"), "x", "y").write.parquet(src)
    stream = spark.readStream.schema("t timestamp, x double, y double").parquet(src)
    out = windowed_extent(stream, "t", C.box2d(C.st_point("x", "y")), "1 minute", "10 seconds")
    q = out.writeStream.format("memory").queryName("extents").outputMode("complete").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = [(r.n, tuple(r.extent)) for r in spark.table("extents").orderBy("start").collect()]
    assert got == [(2, (1.0, -1.0, 5.0, 2.0)), (1, (7.0, 7.0, 7.0, 7.0))]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_rows_of_equal_geometry_are_joined_in_parts(spark, monkeypatch, how):
    """Distinct geometries meet once, whatever the rows; a pair of many rows is dealt to many tasks' parts."""
    from terrafold.operators import spatial
    from terrafold.session import made

    monkeypatch.setattr(spatial, "_PART", 1000)
    place = lambda c: F.when(F.col(c) % 10 < 7, 0).otherwise(F.col(c) % 10)
    a = spark.range(300).select(F.col("id").alias("i"), C.st_point(place("id"), place("id")).alias("g"))
    b = spark.range(200).select(F.col("id").alias("j"), C.st_point(place("id"), F.abs(place("id"))).alias("h")).where("j % 10 != 8")
    since = len(made())
    got = spatial_join(a, b, "g", "h", how=how).collect()
    at = lambda v: 0 if v % 10 < 7 else v % 10
    pairs = sorted((i, j) for i in range(300) for j in range(200) if j % 10 != 8 and at(i) == at(j))
    alone = [i for i in range(300) if i % 10 == 8]
    if how in ("inner", "left"):
        assert sorted((r.i, -1 if r.j is None else r.j) for r in got) == sorted(pairs + ([(i, -1) for i in alone] if how == "left" else []))
    else:
        assert sorted(r.i for r in got) == ([i for i, _ in {p[0]: p for p in pairs}.items()] if how == "left_semi" else alone)
    found = [p for p in made(since) if "/pairs-" in p]
    assert spark.read.parquet(*found).count() == 3


def test_sides_that_may_change_are_held(spark):
    from terrafold.operators import spatial

    p = spark.range(50).select("id", C.st_point("id", "id").alias("g"))
    assert spatial._repeatable(p) and not spatial._repeatable(p.where(F.rand() < 0.5)) and not spatial._repeatable(p.limit(5))
    a, b = p.where(F.rand() < 0.5), p.select(F.col("id").alias("j"), F.col("g").alias("h"))
    inner, anti = spatial_join(a, b, "g", "h"), spatial_join(a, b, "g", "h", how="left_anti")
    assert inner.count() == inner.where("id = j").count() and anti.count() == 0


def test_flagship_counts_rows_alike_without_their_pairs(spark, tmp_path):
    """9 customers and 16 orders at each place: 144 pairs of rows from one pair of counted rows."""
    spark.range(0, 9).selectExpr("id * 23040 + 5 AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0, 16).selectExpr("id * 23040 + 5 AS o_orderkey", "'a' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    place = 5 * 37 / 64 - 180, 5 * 53 / 64 - 90
    assert not (5 * 41 / 64 - 180 <= place[0])  # the key's own rectangle is not at its point
    moved = Q.base(spark, str(tmp_path)).select(F.lit(5 * 41 / 64 - 180).alias("x"), F.lit(5 * 59 / 64 - 90).alias("y"))
    points = lambda *_: moved.select(C.box2d(C.st_point("x", "y")).alias("box"))
    before, Q._points = Q._points, points
    try:
        out = Q.flagship(spark, str(tmp_path))
        got, plan = out.collect(), out._jdf.queryExecution().executedPlan()
    finally:
        Q._points = before
    assert [(r.priority, r.pairs, r.area) for r in got] == [("a", 144, 144 * 1.0 * 1.5)]
    import re

    def joined(node) -> list[int]:
        below = [node.executedPlan()] if node.nodeName().startswith("AdaptiveSparkPlan") else [node.plan()] if "QueryStage" in node.nodeName() else [node.children().apply(i) for i in range(node.children().size())]
        own = [int(node.metrics().apply("numOutputRows").value())] if re.search("Join", node.nodeName()) else []
        return own + [n for b in below for n in joined(b)]

    assert max(joined(plan)) == 1
