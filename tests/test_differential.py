"""Random geometries against the JTS library that Spark's own jars hold. Tests only: the library never uses it."""

import random

import pytest

from terrafold.functions import relate, shapes, wkb, wkt

NAMES = {"intersects": "intersects", "disjoint": "disjoint", "within": "within", "contains": "contains", "equals": "equalsTopo", "coveredby": "coveredBy", "covers": "covers", "touches": "touches", "crosses": "crosses", "overlaps": "overlaps"}


@pytest.fixture(scope="module")
def jts(spark):
    try:
        return spark._jvm.org.locationtech.jts.io.WKTReader()
    except TypeError:
        pytest.skip("no JTS in this Spark")


class Maker:
    def __init__(self, seed, jts):
        self.r, self.jts = random.Random(seed), jts

    def point(self):
        return f"{self.r.randint(0, 8)} {self.r.randint(0, 8)}"

    def ring(self):
        while True:
            t = self.r.random()
            if t < 0.5:
                x, y, w, h = self.r.randint(0, 5), self.r.randint(0, 5), self.r.randint(1, 4), self.r.randint(1, 4)
                body = f"(({x} {y},{x + w} {y},{x + w} {y + h},{x} {y + h},{x} {y}))"
            elif t < 0.65:
                body = "((0 0,8 0,8 8,0 8,0 0),(2 2,2 5,5 5,5 2,2 2))"
            else:
                p = [self.point() for _ in range(self.r.randint(3, 5))]
                body = "((" + ",".join([*p, p[0]]) + "))"
            g = self.jts.read("POLYGON" + body)
            if g.isValid() and g.getArea() > 0:
                return body

    def line(self):
        while True:
            p = [self.point() for _ in range(2)]
            if p[0] != p[1]:
                return "(" + ",".join(p) + ")"

    def any(self):
        k = self.r.randint(0, 5)
        return [lambda: f"POINT({self.point()})", lambda: f"MULTIPOINT(({self.point()}),({self.point()}))", lambda: "LINESTRING" + self.line(), lambda: "POLYGON" + self.ring(), lambda: "POLYGON" + self.ring(), self.multi][k]()

    def multi(self):
        while True:
            g = f"MULTIPOLYGON({self.ring()},{self.ring()})"
            if self.jts.read(g).isValid():
                return g


def test_relations_and_distance(jts):
    make = Maker(11, jts)
    for _ in range(150):
        a, b = make.any(), make.any()
        ja, jb, ga, gb = jts.read(a), jts.read(b), wkt.parse(a), wkt.parse(b)
        assert relate.relate(ga, gb) == ja.relate(jb).toString(), (a, b)
        pa, pb = relate.Parts(ga), relate.Parts(gb)
        for name, java in NAMES.items():
            assert relate.predicate(name, pa, pb) == getattr(ja, java)(jb), (name, a, b)
        assert abs(shapes.distance(ga, gb) - ja.distance(jb)) < 1e-9


def test_measures_hull_and_inner_point(jts):
    make = Maker(12, jts)
    for _ in range(80):
        w = make.any()
        j, g = jts.read(w), wkt.parse(w)
        hull, inner = shapes.convex_hull(g), shapes.point_on_surface(g)
        assert abs(jts.read(wkt.format(hull)).symDifference(j.convexHull()).getArea()) < 1e-9
        assert wkt.format(shapes.convex_hull(hull)) == wkt.format(hull) or hull[0] == wkb.POLYGON
        assert relate.intersects(inner, g)
        box = jts.read(wkt.format(shapes.oriented_envelope(g)))
        assert box.buffer(1e-6).contains(j)
        flat = shapes.simplify_preserve(g, 1.0)
        assert relate.invalid_reason(flat) is None, w


def test_validity(jts):
    make = Maker(13, jts)
    for _ in range(200):
        p = [make.point() for _ in range(make.r.randint(3, 6))]
        body = "((" + ",".join([*p, p[0]]) + ")"
        if make.r.random() < 0.5:
            q = [make.point() for _ in range(3)]
            body = "((0 0,8 0,8 8,0 8,0 0),(" + ",".join([*q, q[0]]) + ")"
        w = "POLYGON" + body + ")"
        assert (relate.invalid_reason(wkt.parse(w)) is None) == jts.read(w).isValid(), w


def test_codec_round_trips():
    make = random.Random(3)
    for _ in range(200):
        n = make.randint(1, 5)
        w = "LINESTRING ZM(" + ",".join(" ".join(str(make.uniform(-9, 9)) for _ in range(4)) for _ in range(n)) + ")"
        g = wkt.parse(w)
        assert wkt.format(wkb.read(wkb.write(g))) == w


def test_concave_hull(spark, jts):
    r = random.Random(9)
    tool = spark._jvm.org.locationtech.jts.algorithm.hull.ConcaveHull
    for k in range(40):
        n = r.randint(4, 60)
        points = [(r.uniform(0, 100), r.uniform(0, 100)) if k % 2 else (r.randint(0, 12), r.randint(0, 12)) for _ in range(n)]
        w = "MULTIPOINT(" + ",".join(f"({x} {y})" for x, y in points) + ")"
        g, ratio = wkt.parse(w), r.choice([0.0, 0.2, 0.5, 0.9])
        hull = shapes.concave_hull(g, ratio)
        if hull[0] != wkb.POLYGON:
            continue
        assert relate.invalid_reason(hull) is None
        j = jts.read(wkt.format(hull))
        assert j.buffer(1e-9).covers(jts.read(w))
        if k % 2:  # without ties the triangulation is the only one
            assert abs(j.getArea() - tool.concaveHullByLengthRatio(jts.read(w), ratio).getArea()) < 1e-6
    assert wkt.format(shapes.concave_hull(wkt.parse("MULTIPOINT(0 0,1 1,2 2)"), 0.3)) == "LINESTRING(0 0,2 2)"
