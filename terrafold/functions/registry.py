"""Registration of all functions for SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import SparkSession

from terrafold.functions.udfs import ALIASES, RELATIONS, TABLE, extent_udf, make_udf
from terrafold.session import ship

_GEOHASH = ("st_geohash", "st_box2dfromgeohash", "st_pointfromgeohash")
_GEO = (
    "st_area", "st_distance", "st_length", "st_centroid", "st_convexhull", "st_concavehull", "st_orientedenvelope", "st_pointonsurface", "st_simplify", "st_simplifyvw",
    "st_simplifypreservetopology", "st_linemerge", "st_isvalid", "st_isvalidreason", *(f"st_{r}" for r in RELATIONS),
)
#: Functions by what they do: measures, processing and relations; GeoHash; constructors, accessors, boxes, input and output.
GROUPS = {"geo": _GEO, "geohash": _GEOHASH, "native": tuple(n for n in TABLE if n not in _GEO and n not in _GEOHASH)}


def register(spark: SparkSession, names: Iterable[str]) -> list[str]:
    """Register functions with their aliases; the registered names."""
    ship(spark)
    wanted = set(names)
    own = [n for n in [*TABLE, *ALIASES] if n in wanted or ALIASES.get(n) in wanted]
    for name in own:
        spark.udf.register(name, make_udf(name))
    return own


def register_all_geo(spark: SparkSession) -> list[str]:
    return register(spark, GROUPS["geo"])


def register_all_geohash(spark: SparkSession) -> list[str]:
    return register(spark, GROUPS["geohash"])


def register_all_native(spark: SparkSession) -> list[str]:
    spark.udf.register("st_extent", extent_udf)
    return [*register(spark, GROUPS["native"]), "st_extent"]


def register_all(spark: SparkSession) -> list[str]:
    """Register every function and alias; the registered names."""
    return [*register_all_geo(spark), *register_all_geohash(spark), *register_all_native(spark)]
