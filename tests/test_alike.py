"""Functions that deal rows to classes: the same as geometry by geometry, with few calls for many rows."""

import random
import re
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from terrafold.functions import relate, shapes, udfs, wkb, wkt
from terrafold.plans import queries as Q

R = random.Random(11)
_NUM = re.compile(r"-?[\d.]+")


def _text(points):
    return ",".join(f"{x} {y}" for x, y in points)


def _at(s=3):
    return R.randint(-s, s) / 2, R.randint(-s, s) / 2


def _rect(s=3):
    (x, y), w, h = _at(s), R.randint(1, 5) / 2, R.randint(1, 5) / 2
    return f"({_text([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)])})"


def _ring(n):
    c = [_at(2) for _ in range(n)]
    return f"({_text([*c, c[0]])})"


KINDS = [
    lambda: f"POLYGON({_rect()})",
    lambda: f"POLYGON({_ring(4)})",
    lambda: f"POLYGON((-2 -2,3 -2,3 3,-2 3,-2 -2),{_rect(2)})",
    lambda: f"MULTIPOLYGON(({_rect()}),({_rect()}))",
    lambda: f"LINESTRING({_text([_at() for _ in range(4)])})",
    lambda: f"MULTILINESTRING(({_text([_at(2), _at(2)])}),({_text([_at(2), _at(2), _at(2)])}))",
    lambda: f"MULTIPOINT({_text([_at(1) for _ in range(5)])})",
    lambda: "POINT({} {})".format(*_at(2)),
    lambda: "POLYGON((1 1,1 1,1 1,1 1,1 1))",
    lambda: "POLYGON((0 1,0 2,0 2,0 1,0 1))",
    lambda: "LINESTRING Z(0 0 1,1 1 2,2 0 3)",
]


def _moved(text, dx, dy, sx, sy, z):
    at = iter(range(10**6))
    return _NUM.sub(lambda m: repr(float(m[0]) * (sx, sy, 1)[k] + (dx, dy, 0)[k]) if (k := next(at) % (3 if z else 2)) < 3 else "", text)


def _copies(bases, times=25):
    """Each tuple of texts moved and stretched, by halves (exact) or by any numbers (rounded)."""
    out = []
    for texts in bases:
        for _ in range(times):
            m = (R.randint(-50, 50) / 4, R.randint(-50, 50) / 4, R.choice([0.5, 1, 2, 3]), R.choice([0.5, 1, 2, 3])) if R.random() < 0.8 else [R.random() * 9 + 0.5 for _ in range(4)]
            out.append(tuple(_moved(t, *m, " Z(" in t) for t in texts))
    R.shuffle(out)
    return out


def _wkb(texts):
    return pa.array([None if t is None else wkb.write(wkt.parse(t)) for t in texts], pa.binary())


def test_relations_as_pair_by_pair():
    a, b = zip(*_copies([(R.choice(KINDS)(), R.choice(KINDS)()) for _ in range(60)]), strict=True)
    pairs = [(relate.Parts(wkt.parse(x)), relate.Parts(wkt.parse(y))) for x, y in zip(a, b, strict=True)]
    for name in udfs.RELATIONS:
        got = udfs.TABLE[f"st_{name}"][0](_wkb(a), pa.array(b)).to_pylist()
        assert got == [relate.predicate(name, x, y) for x, y in pairs], name


@pytest.mark.parametrize("name", ["st_isvalid", "st_isvalidreason", "st_convexhull", "st_concavehull", "st_simplify", "st_simplifypreservetopology"])
def test_functions_as_one_by_one(name):
    texts = [None] + [t for (t,) in _copies([(R.choice(KINDS)(),) for _ in range(60)])]
    numbers = [R.choice([0.0, 0.2, 0.5, 1.0, 1.5, None]) for _ in texts]
    one = {
        "st_isvalid": lambda g, _: relate.invalid_reason(g) is None,
        "st_isvalidreason": lambda g, _: relate.invalid_reason(g) or "Valid Geometry",
        "st_convexhull": lambda g, _: wkb.write(shapes.convex_hull(g)),
        "st_concavehull": lambda g, v: wkb.write(shapes.concave_hull(g, v)),
        "st_simplify": lambda g, v: wkb.write(shapes.simplify(g, v)),
        "st_simplifypreservetopology": lambda g, v: wkb.write(shapes.simplify_preserve(g, v)),
    }[name]
    fn, _, least, _ = udfs.TABLE[name]
    want = [None if t is None or (least == 2 and v is None) else one(wkt.parse(t), v) for t, v in zip(texts, numbers, strict=True)]
    assert fn(_wkb(texts), *([pa.array(numbers)] if least == 2 else [])).to_pylist() == want


@pytest.mark.parametrize(
    "name, module, inner, args",
    [(f"st_{n}", relate, "predicate", ()) for n in udfs.RELATIONS]
    + [("st_isvalid", relate, "invalid_reason", ()), ("st_isvalidreason", relate, "invalid_reason", ())]
    + [("st_convexhull", shapes, "convex_hull", ()), ("st_concavehull", shapes, "concave_hull", (0.0,)), ("st_simplify", shapes, "simplify", (0.001,)), ("st_simplifypreservetopology", shapes, "simplify_preserve", (0.001,))],
)
def test_few_calls_for_rows_alike(monkeypatch, name, module, inner, args):
    texts = [f"POLYGON(({x} {y},{x + 2} {y},{x + 4} {y},{x + 4} {y + 4},{x} {y + 4},{x} {y}))" for x, y in ((k % 90, k % 80) for k in range(600))]
    calls, real = [], getattr(module, inner)
    monkeypatch.setattr(module, inner, lambda *a: calls.append(1) or real(*a))
    column = _wkb(texts)
    others = [_wkb([t.replace("POLYGON((", "LINESTRING(").replace("))", ")") for t in texts])] if inner == "predicate" else [pa.array([v] * 600) for v in args]
    got = udfs.TABLE[name][0](column, *others)
    assert not got.null_count and len(calls) < 10


def test_texts_of_one_form_are_parsed_and_formatted_once(monkeypatch):
    texts = [f"GEOMETRYCOLLECTION(POINT({k / 8} -{k}.5e0),MULTIPOINT(EMPTY,{k} 2),LINESTRING Z(0 0 {k},1 1 +.5))" if k % 2 else f"POLYGON(({k} 0,{k + 1} 0,{k} 1e-7,{k} 0), EMPTY)" for k in range(400)]
    texts += ["POINT EMPTY", "POINT(1e400 0)", "POINT(-0.0 12345678901234567890)", None, "LINESTRING M(1 2 3,4 5 6)"]
    calls, parse = [], wkt.parse
    plain = [t for t in texts if t is None or "Z" not in t]
    want = [None if t is None else wkb.write(parse(t)) for t in plain]
    shown = [None if t is None else wkt.format(parse(t)) for t in plain]
    monkeypatch.setattr(wkt, "parse", lambda t: calls.append(1) or parse(t))
    got = udfs.TABLE["st_geomfromtext"][0](pa.array(plain))
    assert got.to_pylist() == want and len(calls) < 10
    assert udfs.TABLE["st_astext"][0](got).to_pylist() == shown
    mixed = udfs.TABLE["st_geomfromtext"][0](pa.array(texts))
    assert mixed.to_pylist() == [None if t is None else wkb.write(parse(t)) for t in texts]
    assert udfs.TABLE["st_astext"][0](mixed).to_pylist() == [None if t is None else wkt.format(parse(t)) for t in texts]
    for bad in ("POINT(1 2", "POINT(# 1)", "POLYGON((1 2,3 4,5 6 7,1 2))"):
        with pytest.raises(ValueError):
            udfs.TABLE["st_geomfromtext"][0](pa.array(["POINT(1 2)", bad]))


def test_signs_are_exact():
    from terrafold.functions import alike

    rows = []
    for _ in range(200):
        s = 10.0 ** R.randint(-3, 8)
        a, b = np.array([R.random() * s, R.random() * s]), np.array([R.random() * s, R.random() * s])
        rows.append([a, b, a + (b - a) * 0.5, a + (b - a) * R.random(), a])
    xy = np.array(rows)
    threes = np.array([(0, 1, 2), (0, 1, 3), (1, 2, 3), (0, 4, 2)])
    want = [[shapes.orient(*(tuple(r[v]) for v in t)) for t in threes.tolist()] for r in xy.tolist()]
    assert alike.turns(xy, threes).tolist() == want
    square = np.array([[(0.1, 0.1), (0.4, 0.1), (0.4, 0.4), (0.1, 0.4)], [(0, 0), (3, 0), (3, 3), (0, 3)], [(0, 0), (3, 0), (3, 3), (0, 3 + 2**-50)]], dtype=float)

    def circle(p):
        (ax, ay), (bx, by), (cx, cy) = ((Fraction(x) - Fraction(p[3][0]), Fraction(y) - Fraction(p[3][1])) for x, y in p[:3])
        d = (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay)
        return (d > 0) - (d < 0)

    assert alike.circles(square, np.array([(0, 1, 2, 3)]))[:, 0].tolist() == [circle(p) for p in square.tolist()]


def test_a_small_file_is_spread_over_all_cores(spark, tmp_path):
    spark.range(1, 2001).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    sizes = [len(p) for p in Q.base(spark, str(tmp_path)).select("k").rdd.glom().collect()]
    assert sum(sizes) == 2000 and max(sizes) < 2 * 2000 / spark.sparkContext.defaultParallelism
