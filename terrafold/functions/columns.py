"""The Column API. Points and boxes stay Catalyst expressions as long as they can; the rest are Arrow UDFs.

Geo holds a point's coordinates as columns and becomes WKB only where WKB is asked for, so reading a coordinate of
a built point, its GeoHash, the distance of two points or the extent of points runs without Python.
Functions take Geo, or columns (or their names) of WKB, WKT, box structs or point structs; literal() makes constants.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrafold.functions import geohash as _gh
from terrafold.functions import wkb as _wkb
from terrafold.functions import wkt as _wkt
from terrafold.functions.udfs import ALIASES, RELATIONS, TABLE, make_udf


@lru_cache(maxsize=None)
def _udf(name: str):
    return make_udf(name)


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c)


@dataclass(frozen=True)
class Geo:
    """A point by its coordinates. crs is column metadata that alias() attaches."""

    x: Column
    y: Column
    z: Column | None = None
    m: Column | None = None
    srid: int | None = None

    @property
    def dims(self) -> int:
        return (self.z is not None) + 2 * (self.m is not None)

    @property
    def _parts(self) -> list[Column]:
        return [c for c in (self.x, self.y, self.z, self.m) if c is not None]

    @property
    def valid(self) -> Column:
        ok = self.x.isNotNull()
        for c in self._parts[1:]:
            ok = ok & c.isNotNull()
        return ok

    @property
    def wkb(self) -> Column:
        name = ("st_point", "st_pointz", "st_pointm", "st_pointzm")[self.dims]
        return _udf(name)(*self._parts)

    def only(self, c: Column) -> Column:
        """c where the point is not null."""
        return F.when(self.valid, c)

    def struct(self) -> Column:
        names = [n for n, c in (("x", self.x), ("y", self.y), ("z", self.z), ("m", self.m)) if c is not None]
        return F.when(self.valid, F.struct(*(c.alias(n) for n, c in zip(names, self._parts, strict=True))))

    def alias(self, name: str) -> Column:
        return self.wkb.alias(name, metadata=crs(self.srid)) if self.srid is not None else self.wkb.alias(name)


def crs(srid: int) -> dict[str, str]:
    """Column metadata for an EPSG code."""
    return {"crs": f"EPSG:{srid}", "crs_type": "authority_code"}


def geom(g) -> Column:
    """Whatever stands for a geometry, as a column."""
    return g.wkb if isinstance(g, Geo) else _col(g)


def literal(wkt: str) -> Column:
    """A constant geometry, parsed on the driver."""
    return F.lit(bytearray(_wkb.write(_wkt.parse(wkt))))


def _num(c) -> Column:
    return _col(c).cast("double")


def st_point(x, y, srid: int | None = None) -> Geo:
    return Geo(_num(x), _num(y), srid=srid)


def st_pointz(x, y, z, srid: int | None = None) -> Geo:
    return Geo(_num(x), _num(y), z=_num(z), srid=srid)


def st_pointm(x, y, m, srid: int | None = None) -> Geo:
    return Geo(_num(x), _num(y), m=_num(m), srid=srid)


def st_pointzm(x, y, z, m, srid: int | None = None) -> Geo:
    return Geo(_num(x), _num(y), z=_num(z), m=_num(m), srid=srid)


def st_makepoint(*c) -> Geo:
    if len(c) not in (2, 3, 4):
        raise ValueError("st_makepoint takes two to four numbers")
    return (st_point, st_pointz, st_pointzm)[len(c) - 2](*c)


def st_makepointm(x, y, m) -> Geo:
    return st_pointm(x, y, m)


def _ordinate(name: str):
    def run(g) -> Column:
        if isinstance(g, Geo):
            c = getattr(g, name)
            return g.only(c) if c is not None else F.lit(None).cast("double")
        return _udf(f"st_{name}")(geom(g))

    return run


st_x, st_y, st_z, st_m = map(_ordinate, "xyzm")

BOX2 = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def _point_box(g: Geo) -> Column:
    return g.only(F.struct(g.x.alias("xmin"), g.y.alias("ymin"), g.x.alias("xmax"), g.y.alias("ymax")))


def box2d(g) -> Column:
    return _point_box(g) if isinstance(g, Geo) else _udf("box2d")(geom(g))


def box3d(g) -> Column:
    return _udf("box3d")(geom(g))


def st_makebox2d(low, high) -> Column:
    if isinstance(low, Geo) and isinstance(high, Geo):
        return F.when(low.valid & high.valid, F.struct(low.x.alias("xmin"), low.y.alias("ymin"), high.x.alias("xmax"), high.y.alias("ymax")))
    return _udf("st_makebox2d")(geom(low), geom(high))


def st_3dmakebox(low, high) -> Column:
    if isinstance(low, Geo) and isinstance(high, Geo) and low.z is not None and high.z is not None:
        parts = (low.x, low.y, low.z, high.x, high.y, high.z)
        return F.when(low.valid & high.valid, F.struct(*(c.alias(n) for c, n in zip(parts, ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"), strict=True))))
    return _udf("st_3dmakebox")(geom(low), geom(high))


def _field(box: Column, name: str) -> Column:
    return box.getField(name)


def st_extreme(name: str, g) -> Column:
    """One of xmin, ymin, zmin, xmax, ymax, zmax. For a box column its field() is cheaper."""
    if isinstance(g, Geo):
        return _ordinate(name[0])(g)
    return _udf(f"st_{name}")(geom(g))


st_xmin, st_ymin, st_zmin, st_xmax, st_ymax, st_zmax = ((lambda g, n=n: st_extreme(n, g)) for n in ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax"))


def st_expand(box: Column, dx, dy=None) -> Column:
    """A box struct grown on all sides; for other geometries take box2d() first."""
    x, y = _num(dx), _num(dy if dy is not None else dx)
    return F.when(box.isNotNull(), F.struct((box["xmin"] - x).alias("xmin"), (box["ymin"] - y).alias("ymin"), (box["xmax"] + x).alias("xmax"), (box["ymax"] + y).alias("ymax")))


def st_extent(g) -> Column:
    """The aggregate: min and max of the boxes, partial before the shuffle. Also a window function by over_extent()."""
    box = box2d(g) if isinstance(g, Geo) else _col(g)
    lo, hi = (lambda n: F.min(box.getField(n))), (lambda n: F.max(box.getField(n)))
    return F.when(lo("xmin").isNotNull(), F.struct(lo("xmin").alias("xmin"), lo("ymin").alias("ymin"), hi("xmax").alias("xmax"), hi("ymax").alias("ymax")))


def over_extent(box: Column, window) -> Column:
    """st_extent over a window."""
    lo, hi = (lambda n: F.min(box.getField(n)).over(window)), (lambda n: F.max(box.getField(n)).over(window))
    return F.struct(lo("xmin").alias("xmin"), lo("ymin").alias("ymin"), hi("xmax").alias("xmax"), hi("ymax").alias("ymax"))


def st_distance(a, b) -> Column:
    if isinstance(a, Geo) and isinstance(b, Geo):
        return F.when(a.valid & b.valid, F.hypot(a.x - b.x, a.y - b.y))
    return _udf("st_distance")(geom(a), geom(b))


def st_geohash(g) -> Column:
    return g.only(_gh.encode(g.x, g.y)) if isinstance(g, Geo) else _udf("st_geohash")(geom(g))


def st_box2dfromgeohash(h) -> Column:
    return _gh.decode_box(_col(h))


def st_pointfromgeohash(h) -> Geo:
    box = _gh.decode_box(_col(h))
    return Geo((box["xmin"] + box["xmax"]) / 2, (box["ymin"] + box["ymax"]) / 2)


def _within_box(p: Geo, box: Column) -> Column:
    return p.valid & (p.x >= box["xmin"]) & (p.x <= box["xmax"]) & (p.y >= box["ymin"]) & (p.y <= box["ymax"])


def boxes_meet(a: Column, b: Column) -> Column:
    """Whether two box structs have a common point."""
    return (a["xmin"] <= b["xmax"]) & (a["xmax"] >= b["xmin"]) & (a["ymin"] <= b["ymax"]) & (a["ymax"] >= b["ymin"])


def _make(name: str):
    def run(*args) -> Column:
        first, *rest = args
        most = TABLE[ALIASES.get(name, name)][3]
        rest = [geom(r) if name[3:] in RELATIONS else _col(r) for r in rest]
        if len(args) > most:
            raise ValueError(f"{name} takes at most {most} arguments")
        return _udf(name)(geom(first), *rest)

    run.__name__ = name
    return run


#: Functions without a native form, by name.
for _name in [*TABLE, *ALIASES]:
    if _name not in globals():
        globals()[_name] = _make(_name)


def to_arrow(values: list[str]) -> pa.Array:
    """WKT strings as a WKB array, for kernels called directly."""
    return pa.array([None if v is None else _wkb.write(_wkt.parse(v)) for v in values], pa.binary())
