"""One query for each function, join and aggregate, with the same in SQL.

Geometries come from keys by arithmetic in 64ths, so doubles are exact on both sides: a customer's key gives a
corner (x, y), a width w and a height h. xa = x + w, xb = x + 2w, xd = x + 4w, xm = x + w / 2, and likewise for y.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.functions import columns as C
from terrafold.functions.registry import register_all
from terrafold.operators.spatial import distance_join, spatial_filter, spatial_join
from terrafold.session import fresh_path, ship, spread
from terrafold.sources import flatgeobuf, geojson, geoparquet
from terrafold.streaming.extents import windowed_extent

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_MORE = ("x + w AS xa", "y + h AS ya", "x + 2 * w AS xb", "y + 2 * h AS yb", "x + 4 * w AS xd", "y + 4 * h AS yd", "x + w / 2 AS xm", "y + h / 2 AS ym", "x + 3 * w AS xc", "y + 3 * h AS yc")
_CTE = f"""WITH a AS (SELECT c_custkey AS k, CAST((c_custkey * 37) % 23040 AS DOUBLE) / 64 - 180 AS x, CAST((c_custkey * 53) % 11520 AS DOUBLE) / 64 - 90 AS y,
CAST(c_custkey % 16 + 1 AS DOUBLE) / 4 AS w, CAST(c_custkey % 8 + 1 AS DOUBLE) / 4 AS h FROM customer), b AS (SELECT *, {", ".join(_MORE)} FROM a)
"""


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    k = F.col("c_custkey")
    a = spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(k)).select(
        k.alias("k"), (((k * 37) % 23040).cast("double") / 64 - 180).alias("x"), (((k * 53) % 11520).cast("double") / 64 - 90).alias("y"),
        ((k % 16 + 1).cast("double") / 4).alias("w"), ((k % 8 + 1).cast("double") / 4).alias("h"),
    )
    return a.selectExpr("*", *_MORE)


def text(template: str) -> Column:
    """WKT with a row's numbers: {x} and so on."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(F.col(p).cast("string") if i % 2 else F.lit(p) for i, p in enumerate(parts) if p))


def num(c: str) -> str:
    """A double in SQL as WKT prints it."""
    return f"regexp_replace(CAST({c} AS VARCHAR), '\\.0$', '')"


def sql_text(template: str) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    return " || ".join(num(p) if i % 2 else f"'{p}'" for i, p in enumerate(parts) if p)


def query(name: str, select: dict[str, Callable[[], Column]], sql: dict[str, str], where: str = "") -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = base(spark, sf_dir)
        return (b.where(where) if where else b).select("k", *(fn().alias(c) for c, fn in select.items()))

    QUERIES[name] = run
    ORACLES[name] = _CTE + "SELECT k, " + ", ".join(f"{e} AS {c}" for c, e in sql.items()) + " FROM b" + (f" WHERE {where}" if where else "")


RECT = "POLYGON(({x} {y},{xa} {y},{xa} {ya},{x} {ya},{x} {y}))"
TRI = "POLYGON(({x} {y},{xa} {y},{x} {ya},{x} {y}))"
HOLED = "POLYGON(({x} {y},{xd} {y},{xd} {yd},{x} {yd},{x} {y}),({xa} {ya},{xa} {yb},{xb} {yb},{xb} {ya},{xa} {ya}))"
LINE = "LINESTRING({x} {y},{xa} {y},{xa} {ya})"
LINE_Z = "LINESTRING Z({x} {y} {w},{xa} {ya} {h})"
MPOINT = "MULTIPOINT({x} {y},{xa} {ya})"
MLINE = "MULTILINESTRING(({x} {y},{xa} {y}),({xb} {y},{xb} {yb}))"
MPOLY = "MULTIPOLYGON((({x} {y},{xa} {y},{xa} {ya},{x} {ya},{x} {y})),(({xb} {y},{xd} {y},{xd} {yd},{xb} {yd},{xb} {y})))"
COLL = "GEOMETRYCOLLECTION(POINT({x} {y}),LINESTRING({x} {y},{xa} {ya}))"
_G = lambda t: C.st_geomfromtext(text(t))
_T = lambda g: C.st_astext(g)
_pt = lambda x="x", y="y": C.st_point(x, y)
_one = lambda v, e: ({"v": v}, {"v": e})

# constructors
query("st_point", {"v": lambda: _T(_pt()), "px": lambda: C.st_x(_pt().wkb)}, {"v": sql_text("POINT({x} {y})"), "px": "x"})
query("st_pointz", *_one(lambda: _T(C.st_pointz("x", "y", "w")), sql_text("POINT Z({x} {y} {w})")))
query("st_pointm", *_one(lambda: _T(C.st_pointm("x", "y", "w")), sql_text("POINT M({x} {y} {w})")))
query("st_pointzm", *_one(lambda: _T(C.st_pointzm("x", "y", "w", "h")), sql_text("POINT ZM({x} {y} {w} {h})")))
query("st_makepoint", {"a": lambda: _T(C.st_makepoint("x", "y")), "b": lambda: _T(C.st_makepoint("x", "y", "w")), "c": lambda: _T(C.st_makepoint("x", "y", "w", "h"))}, {"a": sql_text("POINT({x} {y})"), "b": sql_text("POINT Z({x} {y} {w})"), "c": sql_text("POINT ZM({x} {y} {w} {h})")})
query("st_makepointm", *_one(lambda: _T(C.st_makepointm("x", "y", "h")), sql_text("POINT M({x} {y} {h})")))
# accessors
query("st_coorddim", {"a": lambda: C.st_coorddim(_G(LINE)), "b": lambda: C.st_coorddim(_G(LINE_Z)), "c": lambda: C.st_coorddim(C.st_pointzm("x", "y", "w", "h"))}, {"a": "CAST(2 AS INTEGER)", "b": "CAST(3 AS INTEGER)", "c": "CAST(4 AS INTEGER)"})
query("st_ndims", *_one(lambda: C.st_ndims(_G(LINE_Z)), "CAST(3 AS INTEGER)"))
query("geometrytype", {"a": lambda: C.geometrytype(_G(MPOLY)), "b": lambda: C.geometrytype(_G(LINE_Z))}, {"a": "'MULTIPOLYGON'", "b": "'LINESTRINGZ'"})
query("st_geometrytype", {"a": lambda: C.st_geometrytype(_G(MLINE)), "b": lambda: C.st_geometrytype(_pt())}, {"a": "'ST_MultiLineString'", "b": "'ST_Point'"})
query("st_isclosed", {"a": lambda: C.st_isclosed(F.when(F.col("k") % 2 == 0, text(LINE)).otherwise(text("LINESTRING({x} {y},{xa} {y},{xa} {ya},{x} {y})"))), "b": lambda: C.st_isclosed(_G(RECT))}, {"a": "k % 2 = 1", "b": "true"})
query("st_isempty", *_one(lambda: C.st_isempty(F.when(F.col("k") % 3 == 0, F.lit("POLYGON EMPTY")).otherwise(text(RECT))), "k % 3 = 0"))
query("st_startpoint", *_one(lambda: _T(C.st_startpoint(_G(LINE))), sql_text("POINT({x} {y})")))
query("st_endpoint", *_one(lambda: _T(C.st_endpoint(_G(LINE_Z))), sql_text("POINT Z({xa} {ya} {h})")))
query("st_pointn", *_one(lambda: _T(C.st_pointn(_G(LINE), F.lit(-2))), sql_text("POINT({xa} {y})")))
query("st_npoints", {"a": lambda: C.st_npoints(_G(HOLED)), "b": lambda: C.st_numpoints(_G(COLL))}, {"a": "CAST(10 AS INTEGER)", "b": "CAST(3 AS INTEGER)"})
query("st_numinteriorrings", {"a": lambda: C.st_numinteriorrings(_G(HOLED)), "b": lambda: C.st_numinteriorring(_G(RECT)), "c": lambda: C.st_numinteriorrings(_G(LINE)).isNull()}, {"a": "CAST(1 AS INTEGER)", "b": "CAST(0 AS INTEGER)", "c": "true"})
query("st_x", {"a": lambda: C.st_x(_pt()), "b": lambda: C.st_x(_G("POINT({xa} {y})"))}, {"a": "x", "b": "xa"})
query("st_y", {"a": lambda: C.st_y(_pt()), "b": lambda: C.st_y(_G("POINT({xa} {ya})"))}, {"a": "y", "b": "ya"})
query("st_z", {"a": lambda: C.st_z(C.st_pointz("x", "y", "w")), "b": lambda: C.st_z(_G("POINT Z({x} {y} {h})")), "c": lambda: C.st_z(_G("POINT M({x} {y} {h})")).isNull()}, {"a": "w", "b": "h", "c": "true"})
query("st_m", {"a": lambda: C.st_m(C.st_pointm("x", "y", "w")), "b": lambda: C.st_m(_G("POINT ZM({x} {y} {w} {h})"))}, {"a": "w", "b": "h"})


def _dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = base(spark, sf_dir).select("k", F.explode(C.st_dump(_G("GEOMETRYCOLLECTION(MULTIPOINT({x} {y},{xa} {ya}),LINESTRING({x} {y},{xa} {y}))"))).alias("p"))
    return parts.select("k", F.array_join(F.col("p.path").cast("array<string>"), ".").alias("path"), C.st_astext(F.col("p.geom")).alias("v"))


QUERIES["st_dump"] = _dump
ORACLES["st_dump"] = _CTE + " UNION ALL ".join(f"SELECT k, '{path}' AS path, {sql_text(t)} AS v FROM b" for path, t in (("1.1", "POINT({x} {y})"), ("1.2", "POINT({xa} {ya})"), ("2", "LINESTRING({x} {y},{xa} {y})")))


# boxes
def _fields(box: Callable[[], Column], names: str) -> dict[str, Callable[[], Column]]:
    return {n: (lambda n=n: box().getField(n)) for n in names.split()}


_B4, _B6 = "xmin ymin xmax ymax", "xmin ymin zmin xmax ymax zmax"
query("box2d", _fields(lambda: C.box2d(_G(HOLED)), _B4), {"xmin": "x", "ymin": "y", "xmax": "xd", "ymax": "yd"})
query("box3d", _fields(lambda: C.box3d(_G(LINE_Z)), _B6), {"xmin": "x", "ymin": "y", "zmin": "least(w, h)", "xmax": "xa", "ymax": "ya", "zmax": "greatest(w, h)"})
for _n, _e in (("xmin", "x"), ("ymin", "y"), ("zmin", "least(w, h)"), ("xmax", "xa"), ("ymax", "ya"), ("zmax", "greatest(w, h)")):
    query(f"st_{_n}", *_one(lambda n=_n: getattr(C, f"st_{n}")(_G(LINE_Z)), _e))
query("st_makebox2d", _fields(lambda: C.st_makebox2d(_pt(), _pt("xa", "ya")), _B4), {"xmin": "x", "ymin": "y", "xmax": "xa", "ymax": "ya"})
query("st_3dmakebox", _fields(lambda: C.st_3dmakebox(C.st_pointz("x", "y", "w"), C.st_pointz("xa", "ya", "h")), _B6), {"xmin": "x", "ymin": "y", "zmin": "w", "xmax": "xa", "ymax": "ya", "zmax": "h"})
query("st_expand", _fields(lambda: C.st_expand(C.st_makebox2d(_pt(), _pt("xa", "ya")), 10, 20), _B4), {"xmin": "x - 10", "ymin": "y - 20", "xmax": "xa + 10", "ymax": "ya + 20"})
query("st_envelope", *_one(lambda: _T(C.st_envelope(_G(TRI))), sql_text("POLYGON(({x} {y},{x} {ya},{xa} {ya},{xa} {y},{x} {y}))")))


def _extent(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select((F.col("k") % 7).alias("g"), C.box2d(_G(RECT)).alias("box"))
    return b.groupBy("g").agg(C.st_extent("box").alias("e"), F.count(F.lit(1)).alias("n")).select("g", "n", "e.*")


def _extent_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).groupBy((F.col("k") % 7).alias("g")).agg(C.st_extent(_pt()).alias("e")).select("g", "e.*")


def _extent_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = base(spark, sf_dir).select("k", C.box2d(_pt()).alias("box"))
    w = Window.partitionBy(F.col("k") % 5).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return b.select("k", C.over_extent(F.col("box"), w).alias("e")).select("k", "e.*")


def _extent_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_all(spark)
    base(spark, sf_dir).select("k", "x", "y").createOrReplaceTempView("terrafold_points")
    return spark.sql("SELECT g, e.xmin, e.ymin, e.xmax, e.ymax FROM (SELECT k % 7 AS g, st_extent(st_point(x, y)) AS e FROM terrafold_points GROUP BY k % 7)")


_EXT = "SELECT k % 7 AS g, {n} min(x) AS xmin, min(y) AS ymin, max({x}) AS xmax, max({y}) AS ymax FROM b GROUP BY k % 7"
QUERIES |= {"st_extent": _extent, "st_extent_points": _extent_points, "st_extent_window": _extent_window, "st_extent_sql": _extent_sql}
ORACLES["st_extent"] = _CTE + _EXT.format(n="count(*) AS n,", x="xa", y="ya")
ORACLES["st_extent_points"] = ORACLES["st_extent_sql"] = _CTE + _EXT.format(n="", x="x", y="y")
ORACLES["st_extent_window"] = _CTE + "SELECT k, min(x) OVER p AS xmin, min(y) OVER p AS ymin, max(x) OVER p AS xmax, max(y) OVER p AS ymax FROM b WINDOW p AS (PARTITION BY k % 5 ORDER BY k ROWS UNBOUNDED PRECEDING)"
# input and output
query("st_geomfromtext", {"a": lambda: _T(_G(HOLED)), "b": lambda: _T(C.st_geometryfromtext(text(MPOLY))), "c": lambda: _T(C.st_wkttosql(text(COLL)))}, {"a": sql_text(HOLED), "b": sql_text(MPOLY), "c": sql_text(COLL)})
query("st_astext", {"a": lambda: _T(_G(MPOINT)), "b": lambda: _T(_G(LINE_Z)), "c": lambda: _T(_G("POLYGON EMPTY"))}, {"a": sql_text(MPOINT), "b": sql_text(LINE_Z), "c": "'POLYGON EMPTY'"})
query("st_geomfromwkb", *_one(lambda: _T(C.st_geomfromwkb(C.st_asbinary(_G(MLINE)))), sql_text(MLINE)))
query("st_wkbtosql", *_one(lambda: _T(C.st_wkbtosql(_G(RECT))), sql_text(RECT)))
query("st_asbinary", *_one(lambda: F.hex(C.st_asbinary(_G(HOLED))), f"hex(st_asbinary(CAST({sql_text(HOLED)} AS GEOMETRY)))"))
# measures
query("st_area", {"a": lambda: C.st_area(_G(TRI)), "b": lambda: C.st_area(_G(HOLED)), "c": lambda: C.st_area(_G(MPOLY)), "d": lambda: C.st_area(_G(LINE))}, {"a": "w * h / 2", "b": "15 * w * h", "c": "w * h + 2 * w * 4 * h", "d": "CAST(0 AS DOUBLE)"})
query("st_length", {"a": lambda: C.st_length(_G(LINE)), "b": lambda: C.st_length2d(_G(MLINE)), "c": lambda: C.st_length(_G(RECT))}, {"a": "w + h", "b": "w + 2 * h", "c": "CAST(0 AS DOUBLE)"})
query("st_distance", {"a": lambda: F.round(C.st_distance(_pt(), _pt("xa", "ya")), 6), "b": lambda: F.round(C.st_distance(_pt().wkb, _pt("xa", "ya").wkb), 6), "c": lambda: C.st_distance(_G(RECT), _G("POLYGON(({xb} {y},{xd} {y},{xd} {yd},{xb} {y}))")), "d": lambda: C.st_distance(_G("POINT({xm} {yb})"), _G(RECT))}, {"a": "round(sqrt(w * w + h * h), 6)", "b": "round(sqrt(w * w + h * h), 6)", "c": "w", "d": "h"})
# processing
query("st_centroid", {"px": lambda: C.st_x(C.st_centroid(_G(RECT))), "py": lambda: C.st_y(C.st_centroid(_G(RECT))), "l": lambda: _T(C.st_centroid(_G("LINESTRING({x} {y},{xb} {y})"))), "m": lambda: _T(C.st_centroid(_G(MPOINT)))}, {"px": "xm", "py": "ym", "l": sql_text("POINT({xa} {y})"), "m": sql_text("POINT({xm} {ym})")})
query("st_convexhull", {"a": lambda: C.st_area(C.st_convexhull(_G("MULTIPOINT({x} {y},{xd} {y},{xd} {yd},{x} {yd},{xa} {yb},{xb} {ya},{xa} {ya})"))), "n": lambda: C.st_npoints(C.st_convexhull(_G(HOLED)))}, {"a": "16 * w * h", "n": "CAST(5 AS INTEGER)"})
query("st_concavehull", {"a": lambda: C.st_area(C.st_concavehull(_G("MULTIPOINT({x} {y},{xa} {y},{xb} {y},{x} {ya},{xa} {ya},{x} {yb})"), F.lit(0.0))), "n": lambda: C.st_npoints(C.st_concavehull(_G("MULTIPOINT({x} {y},{xa} {ya},{xa} {y},{x} {ya})"), F.lit(1.0)))}, {"a": "2 * w * h", "n": "CAST(5 AS INTEGER)"})
query("st_orientedenvelope", {"a": lambda: F.round(C.st_area(C.st_orientedenvelope(_G("POLYGON(({x} {ya},{xa} {y},{xb} {ya},{xa} {yb},{x} {ya}))"))), 6)}, {"a": "round(4 * w * h * greatest(w, h) * greatest(w, h) / (w * w + h * h), 6)"})
query("st_pointonsurface", {"a": lambda: C.st_within(C.st_pointonsurface(_G(HOLED)), _G(HOLED)), "b": lambda: C.st_intersects(C.st_pointonsurface(_G(LINE)), _G(LINE))}, {"a": "true", "b": "true"})
query("st_simplify", {"a": lambda: _T(C.st_simplify(_G("LINESTRING({x} {y},{xa} {y},{xb} {y},{xc} {y},{xd} {yd})"), F.lit(0.001))), "b": lambda: C.st_npoints(C.st_simplify(_G("POLYGON(({x} {y},{xa} {y},{xd} {y},{xd} {yd},{x} {yd},{x} {y}))"), F.lit(0.001)))}, {"a": sql_text("LINESTRING({x} {y},{xc} {y},{xd} {yd})"), "b": "CAST(5 AS INTEGER)"})
query("st_simplifyvw", *_one(lambda: _T(C.st_simplifyvw(_G("LINESTRING({x} {y},{xa} {y},{xb} {y},{xd} {yd})"), F.lit(0.001))), sql_text("LINESTRING({x} {y},{xb} {y},{xd} {yd})")))
query("st_simplifypreservetopology", {"a": lambda: C.st_area(C.st_simplifypreservetopology(_G("POLYGON(({x} {y},{xa} {y},{xb} {y},{xd} {y},{xd} {yd},{x} {yd},{x} {y}))"), F.lit(0.001))), "n": lambda: C.st_npoints(C.st_simplifypreservetopology(_G(RECT), F.lit(1000.0)))}, {"a": "16 * w * h", "n": "CAST(4 AS INTEGER)"})
query("st_linemerge", {"a": lambda: _T(C.st_linemerge(_G("MULTILINESTRING(({x} {y},{xa} {y}),({xb} {ya},{xa} {y}))"))), "b": lambda: C.st_geometrytype(C.st_linemerge(_G("MULTILINESTRING(({x} {y},{xa} {y}),({xb} {ya},{xa} {y}))"), F.lit(True)))}, {"a": sql_text("LINESTRING({x} {y},{xa} {y},{xb} {ya})"), "b": "'ST_MultiLineString'"})
# relations: the row's rectangle against one that depends on k % 6
_OTHER = {0: ("x", "y", "xa", "ya"), 1: ("xa", "y", "xb", "ya"), 2: ("xb", "y", "xd", "ya"), 3: ("xm", "ym", "xb", "yb"), 4: ("x", "y", "xd", "yd"), 5: ("x", "y", "xm", "ym")}


def _other() -> Column:
    out = F.lit(None).cast("string")
    for i, (a, b, c, d) in _OTHER.items():
        out = F.when(F.col("k") % 6 == i, text(f"POLYGON(({{{a}}} {{{b}}},{{{c}}} {{{b}}},{{{c}}} {{{d}}},{{{a}}} {{{d}}},{{{a}}} {{{b}}}))")).otherwise(out)
    return out


_HOLDS = {"intersects": "0 1 3 4 5", "disjoint": "2", "within": "0 4", "contains": "0 5", "equals": "0", "coveredby": "0 4", "covers": "0 5", "touches": "1", "overlaps": "3", "crosses": ""}
for _r, _ks in _HOLDS.items():
    _yes = "k % 6 IN (" + ", ".join(_ks.split()) + ")" if _ks else "false"
    _more = ({"l": lambda r=_r: getattr(C, f"st_{r}")(_G("LINESTRING({x} {ym},{xb} {ym})"), _G(RECT))}, {"l": "true" if _r in ("intersects", "crosses") else "false"})
    query(f"st_{_r}", {"v": lambda r=_r: getattr(C, f"st_{r}")(_G(RECT), C.st_geomfromtext(_other()))} | _more[0], {"v": _yes} | _more[1])
query("st_isvalid", *_one(lambda: C.st_isvalid(F.when(F.col("k") % 2 == 0, text(HOLED)).otherwise(text("POLYGON(({x} {y},{xa} {ya},{xa} {y},{x} {ya},{x} {y}))"))), "k % 2 = 0"))
query("st_isvalidreason", *_one(lambda: C.st_isvalidreason(F.when(F.col("k") % 2 == 0, text(HOLED)).otherwise(text("POLYGON(({x} {y},{xa} {ya},{xa} {y},{x} {ya},{x} {y}))"))), f"CASE WHEN k % 2 = 0 THEN 'Valid Geometry' ELSE {sql_text('Self-intersection[{xm} {ym}]')} END"))
# GeoHash
_ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"
_LON, _LAT = "least(CAST(floor((x / 360 + 0.5) * 1073741824) AS BIGINT), 1073741823)", "least(CAST(floor((y / 180 + 0.5) * 1073741824) AS BIGINT), 1073741823)"
_BIT = lambda i: f"((({_LON if i % 2 == 0 else _LAT}) >> {29 - i // 2}) & 1)"
_HASH = " || ".join(f"substr('{_ALPHABET}', CAST(1 + {' + '.join(f'{16 >> j} * {_BIT(5 * c + j)}' for j in range(5))} AS BIGINT), 1)" for c in range(12))
query("st_geohash", {"a": lambda: C.st_geohash(_pt()), "b": lambda: C.st_geohash(_pt().wkb)}, {"a": _HASH, "b": _HASH})
_CELL = lambda v, span, bits: f"floor(({v} / {span} + 0.5) * {1 << bits}) * ({span}.0 / {1 << bits}) - {span // 2}"
query("st_box2dfromgeohash", {n: (lambda n=n: C.st_box2dfromgeohash(F.substring(C.st_geohash(_pt()), 1, 8)).getField(n)) for n in _B4.split()}, {"xmin": _CELL("x", 360, 20), "ymin": _CELL("y", 180, 20), "xmax": _CELL("x", 360, 20) + " + 360.0 / 1048576", "ymax": _CELL("y", 180, 20) + " + 180.0 / 1048576"})
query("st_pointfromgeohash", {"px": lambda: C.st_x(C.st_pointfromgeohash(F.substring(C.st_geohash(_pt()), 1, 8))), "py": lambda: C.st_y(C.st_pointfromgeohash(F.substring(C.st_geohash(_pt()), 1, 8)))}, {"px": _CELL("x", 360, 20) + " + 180.0 / 1048576", "py": _CELL("y", 180, 20) + " + 90.0 / 1048576"})


# SQL with every kind of call in one statement
def _sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    register_all(spark)
    base(spark, sf_dir).createOrReplaceTempView("terrafold_base")
    return spark.sql(
        """WITH t AS (SELECT k, st_point(x, y) AS p, box2d(st_point(x, y)) AS box, w FROM terrafold_base)
        SELECT k, st_astext(p) AS v, st_x(p) AS px, box.ymax AS top, st_geohash(p) AS h FROM t WHERE st_intersects(p, 'POLYGON((0 0,90 0,90 45,0 45,0 0))') ORDER BY k"""
    )


QUERIES["sql_surface"] = _sql
ORACLES["sql_surface"] = _CTE + f"SELECT k, {sql_text('POINT({x} {y})')} AS v, x AS px, y AS top, {_HASH} AS h FROM b WHERE x BETWEEN 0 AND 90 AND y BETWEEN 0 AND 45"


# filters and joins
def _rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of orders."""
    ship(spark)
    o, k = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    rx, ry = ((k * 41) % 23040).cast("double") / 64 - 180, ((k * 59) % 11520).cast("double") / 64 - 90
    box = F.struct(rx.alias("xmin"), ry.alias("ymin"), (rx + (k % 4 + 1).cast("double") / 2).alias("xmax"), (ry + (k % 3 + 1).cast("double") / 2).alias("ymax"))
    return o.select(k.alias("o"), F.col("o_orderpriority").alias("priority"), box.alias("rect"))


_RECTS = """, r0 AS (SELECT o_orderkey AS o, o_orderpriority AS priority, CAST((o_orderkey * 41) % 23040 AS DOUBLE) / 64 - 180 AS x0, CAST((o_orderkey * 59) % 11520 AS DOUBLE) / 64 - 90 AS y0 FROM orders),
r AS (SELECT *, x0 + CAST(o % 4 + 1 AS DOUBLE) / 2 AS x1, y0 + CAST(o % 3 + 1 AS DOUBLE) / 2 AS y1 FROM r0)
"""


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return base(spark, sf_dir).select("k", _pt().alias("g"), C.box2d(_pt()).alias("box"))


def _join(how: str, exact: bool = True) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = spatial_join(_points(spark, sf_dir), _rects(spark, sf_dir), "g", "rect", how=how, left_box="box", right_box="rect", exact=exact)
        return out.select("k", F.coalesce("o", F.lit(-1)).alias("o")) if how in ("inner", "left") else out.select("k")

    return run


_ON = "x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"
QUERIES |= {"spatial_join": _join("inner"), "spatial_join_boxes": _join("inner", False), "spatial_join_left": _join("left"), "spatial_join_semi": _join("left_semi"), "spatial_join_anti": _join("left_anti")}
ORACLES["spatial_join"] = ORACLES["spatial_join_boxes"] = _CTE + _RECTS + f"SELECT k, o FROM b JOIN r ON {_ON}"
ORACLES["spatial_join_left"] = _CTE + _RECTS + f"SELECT k, coalesce(o, -1) AS o FROM b LEFT JOIN r ON {_ON}"
ORACLES["spatial_join_semi"] = _CTE + _RECTS + f"SELECT k FROM b WHERE EXISTS (SELECT 1 FROM r WHERE {_ON})"
ORACLES["spatial_join_anti"] = _CTE + _RECTS + f"SELECT k FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE {_ON})"


def _near(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _points(spark, sf_dir)
    b = a.select(F.col("k").alias("k2"), F.col("g").alias("g2"), F.col("box").alias("box2"))
    return distance_join(a, b, "g", "g2", 2.0, left_box="box", right_box="box2", cell=2.0).where("k < k2").select("k", "k2")


QUERIES["distance_join"] = _near
ORACLES["distance_join"] = _CTE + "SELECT p.k, q.k AS k2 FROM b p JOIN b q ON p.k < q.k AND p.x BETWEEN q.x - 2 AND q.x + 2 AND (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) <= 4"


def _filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial_filter(_points(spark, sf_dir), "g", "POLYGON((0 0,64 0,0 64,0 0))", box="box").select("k")


QUERIES["spatial_filter"] = _filter
ORACLES["spatial_filter"] = _CTE + "SELECT k FROM b WHERE x >= 0 AND y >= 0 AND x + y <= 64"


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' points in orders' rectangles: pairs, extent and total area by priority.

    Equal rows of a side count as one with a number, so pairs of rows are never made.
    """
    points = _points(spark, sf_dir).groupBy("box").agg(F.count(F.lit(1)).alias("n"))
    rects = _rects(spark, sf_dir).groupBy("priority", "rect").agg(F.count(F.lit(1)).alias("m"))
    pairs = spatial_join(points, rects, "box", "rect", left_box="box", right_box="rect", exact=False).withColumn("nm", F.col("n") * F.col("m"))
    area = (F.col("rect.xmax") - F.col("rect.xmin")) * (F.col("rect.ymax") - F.col("rect.ymin"))
    out = pairs.groupBy("priority").agg(F.sum("nm").alias("pairs"), C.st_extent("box").alias("e"), F.sum(area * F.col("nm")).alias("area"))
    return out.select("priority", "pairs", "area", "e.*")


QUERIES["flagship"] = flagship
ORACLES["flagship"] = _CTE + _RECTS + f"SELECT priority, count(*) AS pairs, sum((x1 - x0) * (y1 - y0)) AS area, min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax FROM b JOIN r ON {_ON} GROUP BY priority"


# sources: written below the shared folder, then read
def _source(write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        flatgeobuf.register(spark)
        path = fresh_path(spark, "source")
        write(base(spark, sf_dir).select("k", F.concat(F.lit("n"), F.col("k") % 9).alias("name"), "w", _pt().alias("geometry")).repartition(3), path)
        back = read(spark, path)
        return back.select(F.col("k").cast("long").alias("k"), "name", "w", C.st_x("geometry").alias("px"), C.st_y("geometry").alias("py"))

    return run


_BOX = "0,0,90,45"
_to_fgb = lambda df, path: df.write.format("flatgeobuf").mode("append").option("crs", "4326").save(path)
_to_json = lambda df, path: geojson.write(df.withColumnRenamed("k", "id"), path)
_of_json = lambda spark, path: geojson.read(spark, path, "name string, w double").withColumnRenamed("id", "k")
QUERIES |= {
    "source_flatgeobuf": _source(_to_fgb, lambda spark, path: spark.read.format("flatgeobuf").load(path)),
    "source_flatgeobuf_box": _source(_to_fgb, lambda spark, path: spark.read.format("flatgeobuf").option("bbox", _BOX).load(path)),
    "source_geoparquet": _source(geoparquet.write, geoparquet.read),
    "source_geoparquet_box": _source(geoparquet.write, lambda spark, path: geoparquet.read_box(spark, path, *(float(v) for v in _BOX.split(",")))),
    "source_geojson": _source(_to_json, _of_json),
}
_ROWS = _CTE + "SELECT k, 'n' || CAST(k % 9 AS VARCHAR) AS name, w, x AS px, y AS py FROM b"
ORACLES |= {f"source_{n}": _ROWS for n in ("flatgeobuf", "geoparquet", "geojson")}
ORACLES |= {f"source_{n}_box": _ROWS + " WHERE x BETWEEN 0 AND 90 AND y BETWEEN 0 AND 45" for n in ("flatgeobuf", "geoparquet")}


# a stream of orders: extents of four weeks
def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    path, k = fresh_path(spark, "stream"), F.col("o_orderkey")
    orders = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/orders.parquet").schema).parquet(f"{sf_dir}/orders.parquet*")  # a file or a folder
    p = C.st_point(((k * 41) % 23040).cast("double") / 64 - 180, ((k * 59) % 11520).cast("double") / 64 - 90)
    when = F.timestamp_seconds(F.unix_date(F.to_date("o_orderdate")).cast("long") * 86400)
    out = windowed_extent(orders.select(when.alias("t"), C.box2d(p).alias("box")), "t", F.col("box"), "28 days", "1 day")
    out = out.select(F.floor(F.unix_seconds("start") / 86400).cast("long").alias("day"), "n", "extent.*")
    sink = lambda df, _: df.write.mode("overwrite").parquet(f"{path}/out")
    out.writeStream.foreachBatch(sink).outputMode("complete").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


QUERIES["stream_extent"] = _stream
ORACLES["stream_extent"] = """SELECT CAST(floor(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) / 28) * 28 AS BIGINT) AS day, count(*) AS n,
  min(x) AS xmin, min(y) AS ymin, max(x) AS xmax, max(y) AS ymax
FROM (SELECT o_orderdate, CAST((o_orderkey * 41) % 23040 AS DOUBLE) / 64 - 180 AS x, CAST((o_orderkey * 59) % 11520 AS DOUBLE) / 64 - 90 AS y FROM orders) GROUP BY 1"""
