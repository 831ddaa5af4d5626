"""GeoJSON Lines: one Feature a line. A column named id becomes the Feature's id, the others are its properties."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, StringType

from terrafold.functions import columns as C
from terrafold.functions import wkb
from terrafold.session import ship


def _coordinates(g: wkb.Geometry):
    kind, dims, data = g
    cut = lambda c: [[v if v != int(v) or abs(v) > 2**53 else int(v) for v in p] for p in (c[:, :3] if dims in (1, 3) else c[:, :2]).tolist()]
    if kind == wkb.POINT:
        return cut(data)[0] if len(data) else []
    if kind == wkb.LINE:
        return cut(data)
    if kind == wkb.POLYGON:
        return [cut(r) for r in data]
    return [_coordinates(p) for p in data]


def geometry_json(g: wkb.Geometry) -> str:
    """A geometry as GeoJSON; M values have no place in it and are left out."""

    def build(g: wkb.Geometry) -> dict:
        name = wkb.NAMES[g[0]]
        return {"type": name, "geometries": [build(p) for p in g[2]]} if g[0] == wkb.COLLECTION else {"type": name, "coordinates": _coordinates(g)}

    return json.dumps(build(g), separators=(",", ":"))


@arrow_udf(StringType())
def st_asgeojson(column: pa.Array) -> pa.Array:
    return pa.array([None if g is None else geometry_json(g) for g in wkb.as_geometries(column)], pa.string())


def features(df: DataFrame, geometry: str = "geometry", id_col: str = "id") -> DataFrame:
    """One column, value: the Feature of each row. Null properties are written as null."""
    ship(df.sparkSession)
    names = [c for c in df.columns if c not in (geometry, id_col)]
    properties = F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), {"ignoreNullFields": "false"}) if names else F.lit("{}")
    shape = F.coalesce(st_asgeojson(C.geom(F.col(f"`{geometry}`"))), F.lit("null"))
    parts = [F.lit('{"type":"Feature",')]
    if id_col in df.columns:
        body = F.to_json(F.struct(F.col(f"`{id_col}`").alias("id")))
        parts.append(F.when(F.col(f"`{id_col}`").isNull(), F.lit("")).otherwise(F.concat(F.substring(body, 2, 1 << 30).substr(F.lit(1), F.length(body) - 2), F.lit(","))))
    return df.select(F.concat(*parts, F.lit('"geometry":'), shape, F.lit(',"properties":'), properties, F.lit("}")).alias("value"))


def write(df: DataFrame, path: str, geometry: str = "geometry", id_col: str = "id", mode: str = "errorifexists") -> None:
    """A folder of GeoJSON Lines files, written by Spark's text writer."""
    features(df, geometry, id_col).write.mode(mode).text(path)


def _parse(v: dict | None) -> wkb.Geometry | None:
    if v is None:
        return None
    kind = {n: k for k, n in wkb.NAMES.items()}[v["type"]]
    if kind == wkb.COLLECTION:
        parts = [_parse(p) for p in v["geometries"]]
        return (kind, parts[0][1] if parts else 0, parts)
    c = v["coordinates"]

    def flat(x) -> bool:
        return not x or not isinstance(x[0], list)

    def depth(x) -> int:
        while x and not flat(x):
            x = x[0]
        return len(x) if x else 2

    dims = 1 if depth(c) >= 3 else 0
    arr = lambda p: np.array(p, dtype=np.float64).reshape(-1, max(depth(p), 2) if p else wkb.WIDTH[dims])[:, : wkb.WIDTH[dims]]
    if kind == wkb.POINT:
        return (kind, dims, arr([c]) if c else np.zeros((0, wkb.WIDTH[dims])))
    if kind == wkb.LINE:
        return (kind, dims, arr(c))
    if kind == wkb.POLYGON:
        return (kind, dims, [arr(r) for r in c])
    child = {wkb.MULTIPOINT: wkb.POINT, wkb.MULTILINE: wkb.LINE, wkb.MULTIPOLYGON: wkb.POLYGON}[kind]
    make = {wkb.POINT: lambda p: arr([p]), wkb.LINE: arr, wkb.POLYGON: lambda p: [arr(r) for r in p]}[child]
    return (kind, dims, [(child, dims, make(p)) for p in c])


@arrow_udf(BinaryType())
def st_geomfromgeojson(column: pa.Array) -> pa.Array:
    got = [None if v is None else _parse(json.loads(v)) for v in column.to_pylist()]
    return pa.array([None if g is None else wkb.write(g) for g in got], pa.binary())


def read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Features of GeoJSON Lines files; schema is that of the properties, with id (a string) and geometry added."""
    ship(spark)
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    parsed = rows.select(F.get_json_object("value", "$.id").alias("id"), F.from_json(F.get_json_object("value", "$.properties"), schema).alias("p"), F.get_json_object("value", "$.geometry").alias("g"))
    return parsed.select("id", "p.*", st_geomfromgeojson(F.col("g")).alias("geometry"))
