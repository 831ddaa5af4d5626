"""Spatial filters and joins.

Joins deal boxes to grid cells and meet by cell: an equi-join that Catalyst can shuffle, split and spill. A pair is
kept in one cell only, the one that holds the lower left corner of the boxes' common part, so no distinct
follows. Cells hold distinct geometries; the rows that have them are joined to the pairs. Grids come in levels,
each STEP times as wide as the one below. A box has the first level on which it spans at most two cells each way,
so that no box has many cells; two boxes meet on the coarser of their levels.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions import columns as C
from terrafold.functions import wkb as _wkb
from terrafold.functions import wkt as _wkt
from terrafold.session import materialize, ship

#: A level's cells are this many times as wide as those of the level below.
STEP, LEVELS = 8.0, 12
#: Pairs of rows in a part of a join.
_PART = 1_000_000
_P = "__sj_"


def spatial_filter(df: DataFrame, geom: str, constant: str, relation: str = "intersects", box: str | None = None) -> DataFrame:
    """Rows whose geometry has the relation to a constant WKT geometry.

    box names a box struct column (or a struct of xmin, ymin, xmax, ymax as GeoParquet's covering has), whose
    comparisons reach the scan; the exact predicate follows always.
    """
    if relation == "disjoint":
        return df.where(C.st_disjoint(F.col(geom), C.literal(constant)))
    xy = _wkb.coords(_wkt.parse(constant))
    if not len(xy):
        return df.where(F.lit(False))
    (x0, y0), (x1, y1) = xy.min(axis=0).tolist(), xy.max(axis=0).tolist()
    if box is not None:
        b = F.col(box)
        df = df.where((b["xmin"] <= x1) & (b["xmax"] >= x0) & (b["ymin"] <= y1) & (b["ymax"] >= y0))
    return df.where(getattr(C, f"st_{relation}")(F.col(geom), C.literal(constant)))


def _boxed(df: DataFrame, box: Column, grow: float = 0.0) -> DataFrame:
    """df with its box and its width's binary exponent (the least for points); rows without a box go."""
    b = C.st_expand(box, grow) if grow else box
    df = df.withColumn(f"{_P}box", b).where(F.col(f"{_P}box").isNotNull())
    b = F.col(f"{_P}box")
    exponent = F.ceil(F.log2(F.greatest(b["xmax"] - b["xmin"], b["ymax"] - b["ymin"])))
    return df.withColumn(f"{_P}wide", F.least(F.greatest(exponent, F.lit(-1100)), F.lit(1100)).cast("int"))


def _level(exponent: Column, size: float) -> Column:
    """The first level on which a box of that exponent spans at most two cells each way."""
    up = F.ceil((exponent - F.lit(math.log2(size))) / F.lit(math.log2(STEP))).cast("int")
    return F.least(F.greatest(up, F.lit(0)), F.lit(LEVELS))


def _grid(a: DataFrame, b: DataFrame, cell: float | None) -> tuple[float, list[int]]:
    """The least cells' width and the levels in use, from one aggregate over both sides' boxes.

    The width is the mean width or height of b's boxes, whichever is larger; exponents are at most some 2,100 numbers.
    """
    box = F.col(f"{_P}box")
    side = lambda df, right: df.select(F.lit(right).alias("right"), (box["xmax"] - box["xmin"]).alias("w"), (box["ymax"] - box["ymin"]).alias("h"), box["xmin"].alias("x0"), box["xmax"].alias("x1"), F.col(f"{_P}wide").alias("e"))
    mine = lambda c: F.when(F.col("right"), F.col(c))
    r = side(a, False).unionAll(side(b, True)).agg(F.avg(mine("w")).alias("w"), F.avg(mine("h")).alias("h"), F.min(mine("x0")).alias("a"), F.max(mine("x1")).alias("b"), F.collect_set("e").alias("e")).first()
    mean = max(r.w or 0.0, r.h or 0.0)
    size = cell or (mean if mean > 0 else max(((r.b or 0.0) - (r.a or 0.0)) / 1024, 1e-9))
    spark = a.sparkSession
    found = spark.range(1).select(F.transform(F.array(*[F.lit(e) for e in sorted(r.e)]), lambda e: _level(e, size)).alias("k")).first().k if r.e else []
    return size, sorted({0, *found})


def _repeatable(df: DataFrame) -> bool:
    """Whether every reading of df gives the same rows, as far as its plan tells (not aggregates: sums of doubles vary with the order of rows)."""
    plain = {"Project", "Filter", "SubqueryAlias", "View", "Range", "LocalRelation", "LogicalRelation", "DataSourceV2Relation", "LogicalRDD", "Union", "Join", "Generate"}

    def walk(plan) -> bool:
        below = plan.children()
        return plan.nodeName().split(" ")[0] in plain and all(walk(below.apply(i)) for i in range(below.size()))

    plan = df._jdf.queryExecution().analyzed()
    return bool(plan.deterministic()) and walk(plan)


def _keyed(df: DataFrame, side: str, geom: str, box: str | None, exact: bool) -> tuple[DataFrame, list[str]]:
    """df with what a pair is decided by (its geometry, its box or both) as columns of their own, and their names."""
    own = [box] if box and (not exact or box == geom) else [geom, box] if box else [geom]
    names = [f"{_P}{side}{i}" for i in range(len(own))]
    return df.select("*", *(F.col(c).alias(n) for c, n in zip(own, names, strict=True))), names


def _same(names: list[str]) -> Column:
    """Rows of a keyed table and of its distinct keys (their names end with _) that belong together."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"{n}_"))
    return out


def _shapes(rows: DataFrame, side: str, names: list[str], box: str | None, grow: float) -> DataFrame:
    """The distinct keys of a table with a number, how many rows have them, and their boxes."""
    first, last = F.col(f"{names[0]}_"), F.col(f"{names[-1]}_")
    found = rows.groupBy(*(F.col(n).alias(f"{n}_") for n in names)).agg(F.count(F.lit(1)).alias(f"{_P}n{side}"))
    return materialize(_boxed(found.withColumn(f"{_P}{side}", F.monotonically_increasing_id()), last if box else C.box2d(first), grow), "shapes")


def spatial_join(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, relation: str = "intersects", how: str = "inner", left_box: str | None = None, right_box: str | None = None, within: float | None = None, cell: float | None = None, exact: bool = True) -> DataFrame:
    """Pairs of rows whose geometries have the relation, or lie within a distance.

    left_box and right_box name box struct columns if there are any; exact=False stops at the boxes (right for boxes
    and points). how: inner, left, left_semi or left_anti. Column names of both sides must differ.
    Pairs are found among distinct geometries, then rows are joined to them: semi and anti joins never make pairs of rows.
    """
    if relation == "disjoint":
        raise ValueError("disjoint pairs can't be found by cells: use an anti join, or a nested loop on purpose")
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how={how!r} is not supported")
    if within is not None and not exact:
        raise ValueError("a distance join is exact")
    ship(left.sparkSession)
    # rows are read more than once: a side that may not come out the same is held in a table
    held_left, held_right = (df if _repeatable(df) else materialize(df, "rows") for df in (left, right))
    a, an = _keyed(held_left, "a", left_geom, left_box, exact)
    b, bn = _keyed(held_right, "b", right_geom, right_box, exact)
    sa, sb = _shapes(a, "a", an, left_box, within or 0.0), _shapes(b, "b", bn, right_box, 0.0)
    size, levels = _grid(sa, sb, cell)
    own = lambda df: df.withColumn(f"{_P}level", _level(F.col(f"{_P}wide"), size)).drop(f"{_P}wide")
    pairs = _meet(own(sa), own(sb), size, levels)
    if exact:
        l, r = F.col(f"{an[0]}_"), F.col(f"{bn[0]}_")
        pairs = pairs.where(C.st_distance(l, r) <= within if within is not None else getattr(C, f"st_{relation}")(l, r))
    pairs = materialize(pairs.select(*(f"{_P}{c}" for c in ("a", "b", "na", "nb"))), "pairs")
    if how in ("left_semi", "left_anti"):
        return _having(a, sa, an, pairs, how).select(*left.columns)
    met = _rows(a, sa, an, b, sb, bn, pairs).select(*left.columns, *right.columns)
    if how == "inner":
        return met
    alone = _having(a, sa, an, pairs, "left_anti").select(*left.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema))
    return met.unionAll(alone)


def _having(rows: DataFrame, shapes: DataFrame, names: list[str], pairs: DataFrame, how: str) -> DataFrame:
    """Left rows with (left_semi) or without (left_anti) a pair."""
    return rows.join(shapes.join(pairs.select(f"{_P}a").distinct(), f"{_P}a").select(*(f"{n}_" for n in names)), _same(names), how)


def _rows(a: DataFrame, sa: DataFrame, an: list[str], b: DataFrame, sb: DataFrame, bn: list[str], pairs: DataFrame) -> DataFrame:
    """Pairs of rows from pairs of distinct geometries.

    The rows of a right geometry meet in a part of their own. Where there would be more than _PART pairs of rows, its left
    rows go to so many parts (1,000 in each at least) and then its right rows, and the other side is repeated for them.
    """
    na, nb = F.col(f"{_P}na"), F.col(f"{_P}nb")
    total = pairs.agg(F.sum(na.cast("double") * nb)).first()[0] or 0.0
    # tables are small against what their join gives, so the number of tasks comes from the latter
    tasks = int(min(max(total / _PART, min(total / 1e5, a.sparkSession.sparkContext.defaultParallelism)), 20_000)) + 1
    many = lambda c: F.greatest(F.ceil(c), F.lit(1)).cast("int")
    split = pairs.groupBy(f"{_P}b").agg(F.sum(na).alias(f"{_P}all"), F.first(nb).alias(f"{_P}nb"))
    parts = F.col(f"{_P}all").cast("double") * F.col(f"{_P}nb") / _PART
    split = split.withColumn(f"{_P}sa", many(F.least(parts, F.col(f"{_P}all") / 1000))).withColumn(f"{_P}sb", many(parts / F.col(f"{_P}sa"))).select(*(f"{_P}{c}" for c in ("b", "sa", "sb")))
    mates = sa.select(f"{_P}a", *(f"{n}_" for n in an)).join(pairs.select(f"{_P}a", f"{_P}b"), f"{_P}a").join(split, f"{_P}b").drop(f"{_P}a")

    def deal(rows: DataFrame, shapes: DataFrame, names: list[str], mine: str, other: str) -> DataFrame:
        known = [f.name for f in rows.schema if f.name not in names and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        draw = F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in known)), F.col(f"{_P}{mine}").cast("long")).cast("int") if known else F.lit(0)
        out = rows.join(shapes, _same(names)).drop(*names, *(f"{n}_" for n in names))
        return out.withColumn(f"{_P}{mine}", draw).withColumn(f"{_P}{other}", F.explode(F.sequence(F.lit(0), F.col(f"{_P}{other}") - 1)))

    keys = [f"{_P}b", f"{_P}sa", f"{_P}sb"]
    x = deal(a, mates, an, "sa", "sb").repartition(tasks, *keys)
    y = deal(b, sb.select(f"{_P}b", *(f"{n}_" for n in bn)).join(split, f"{_P}b"), bn, "sb", "sa").repartition(tasks, *keys)
    return x.join(y, keys)


def _meet(a: DataFrame, b: DataFrame, size: float, levels: list[int]) -> DataFrame:
    """Pairs of rows whose boxes meet. Every row has cells on its own level; on the coarser levels in use it has its few cells there."""
    def on_levels(df: DataFrame, side: str) -> DataFrame:
        up = F.array(*[F.lit(k) for k in levels])
        df = df.withColumnRenamed(f"{_P}level", f"{_P}own{side}").withColumnRenamed(f"{_P}box", f"{_P}box{side}")
        df = df.withColumn(f"{_P}level", F.explode(F.filter(up, lambda k: k >= F.col(f"{_P}own{side}"))))
        box, wide = F.col(f"{_P}box{side}"), F.lit(size) * F.pow(F.lit(STEP), F.col(f"{_P}level").cast("double"))
        cell = lambda v: F.floor(v / wide).cast("long")
        df = df.withColumn(f"{_P}cx", F.explode(F.sequence(cell(box["xmin"]), cell(box["xmax"]))))
        return df.withColumn(f"{_P}cy", F.explode(F.sequence(cell(box["ymin"]), cell(box["ymax"]))))

    keys = [f"{_P}level", f"{_P}cx", f"{_P}cy"]
    both = on_levels(a, "a").join(on_levels(b, "b"), keys)
    x, y, wide = F.col(f"{_P}boxa"), F.col(f"{_P}boxb"), F.lit(size) * F.pow(F.lit(STEP), F.col(f"{_P}level").cast("double"))
    here = (F.floor(F.greatest(x["xmin"], y["xmin"]) / wide) == F.col(f"{_P}cx")) & (F.floor(F.greatest(x["ymin"], y["ymin"]) / wide) == F.col(f"{_P}cy"))
    top = F.greatest(f"{_P}owna", f"{_P}ownb") == F.col(f"{_P}level")
    return both.where(top & C.boxes_meet(x, y) & here)


def distance_join(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, distance: float, **more) -> DataFrame:
    """Pairs of rows whose geometries lie within a distance of each other."""
    return spatial_join(left, right, left_geom, right_geom, within=distance, **more)
