"""Spatial columns: boxes, distances, geohashes and projections in the JVM; exact predicates over well-known text by Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import geometry as G

_BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"
_EXTENT = 20037508.342789244
_MAX_LAT = 85.05112878


def encode_geohash(lat: Column, lon: Column, precision: int = 12) -> Column:
    """Base-32 cells, the longitude's bit first: both are scaled to whole numbers, whose bits alternate."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2

    def scaled(c: Column, low: float, span: float, n: int) -> Column:
        return F.least(F.greatest(F.floor((c.cast("double") - low) / span * float(1 << n)).cast("bigint"), F.lit(0)), F.lit((1 << n) - 1))

    x, y = scaled(lon, -180, 360, nx), scaled(lat, -90, 180, ny)
    out = []
    for i in range(precision):
        digit = F.lit(0).cast("bigint")
        for k in range(5 * i, 5 * i + 5):
            source, left = (x, nx - 1 - k // 2) if k % 2 == 0 else (y, ny - 1 - k // 2)
            digit = digit + F.shiftright(source, left).bitwiseAND(F.lit(1).cast("bigint")) * (1 << (4 - (k - 5 * i)))
        out.append(F.substring(F.lit(_BASE32), digit.cast("int") + 1, F.lit(1)))
    return F.concat(*out)


def decode_geohash(code: Column) -> Column:
    """The cell's centre and bounds (lat, lon, min_lat, min_lon, max_lat, max_lon); a sign that is none counts as 0."""
    signs = F.filter(F.split(F.lower(code), ""), lambda c: c != "")
    bits = F.array_join(F.transform(signs, lambda c: F.lpad(F.bin(F.greatest(F.instr(F.lit(_BASE32), c) - 1, F.lit(0)).cast("bigint")), 5, "0")), "")
    x, y = F.regexp_replace(bits, "(.)(.)?", "$1"), F.regexp_replace(bits, "(.)(.)?", "$2")

    def side(b: Column, low: float, span: float) -> tuple[Column, Column]:
        cell = span / F.pow(F.lit(2.0), F.length(b))
        start = low + F.when(F.length(b) == 0, 0).otherwise(F.conv(b, 2, 10).cast("bigint")) * cell
        return start, start + cell

    (lon0, lon1), (lat0, lat1) = side(x, -180.0, 360.0), side(y, -90.0, 180.0)
    cell = F.struct(((lat0 + lat1) / 2).alias("lat"), ((lon0 + lon1) / 2).alias("lon"), lat0.alias("min_lat"), lon0.alias("min_lon"), lat1.alias("max_lat"), lon1.alias("max_lon"))
    return F.when(code.isNotNull(), cell)


def geohash_bounds(code: Column) -> Column:
    """(min_lat, min_lon, max_lat, max_lon) of a cell."""
    d = decode_geohash(code)
    return F.when(code.isNotNull(), F.struct(*[d[n].alias(n) for n in ("min_lat", "min_lon", "max_lat", "max_lon")]))


def _doubles(*names: str) -> T.StructType:
    """As an object: a type in words would need a session at import."""
    return T.StructType([T.StructField(n, T.DoubleType()) for n in names])


def to_web_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    clamped = F.least(F.greatest(lat, F.lit(-_MAX_LAT)), F.lit(_MAX_LAT))
    return lon * (_EXTENT / 180), F.ln(F.tan(F.radians((clamped + 90) / 2))) / math.pi * _EXTENT


def from_web_mercator(x: Column, y: Column) -> tuple[Column, Column]:
    return x * (180 / _EXTENT), F.degrees(2 * F.atan(F.exp(y / _EXTENT * math.pi)) - math.pi / 2)


def within_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Edges are within."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def box_contains(a: Column, b: Column) -> Column:
    """Whether box b is within box a, edges included."""
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def box_intersects(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x1"]) & (b["x0"] <= a["x1"]) & (a["y0"] <= b["y1"]) & (b["y0"] <= a["y1"])


def box_union(a: Column, b: Column) -> Column:
    return box(F.least(a["x0"], b["x0"]), F.least(a["y0"], b["y0"]), F.greatest(a["x1"], b["x1"]), F.greatest(a["y1"], b["y1"]))


def box_area(a: Column) -> Column:
    return F.greatest(a["x1"] - a["x0"], F.lit(0.0)) * F.greatest(a["y1"] - a["y0"], F.lit(0.0))


def box_distance(a: Column, b: Column) -> Column:
    """0 where they meet."""
    gap = lambda n: F.greatest(a[f"{n}0"] - b[f"{n}1"], b[f"{n}0"] - a[f"{n}1"], F.lit(0.0))
    return F.hypot(gap("x"), gap("y"))


def nearest_boxes(df: DataFrame, geom: str, px: float, py: float, k: int, tie: str) -> DataFrame:
    """The k geometries whose boxes' centres are nearest to a point, with `distance`."""
    b = df.withColumn("__b", st_bounds(geom)).filter("__b.x0 is not null")
    at = F.hypot((F.col("__b.x0") + F.col("__b.x1")) / 2 - px, (F.col("__b.y0") + F.col("__b.y1")) / 2 - py)
    return b.withColumn("distance", at).drop("__b").orderBy("distance", tie).limit(k)


def nearest(df: DataFrame, x: str, y: str, px: float, py: float, k: int, tie: str) -> DataFrame:
    return df.withColumn("distance", F.hypot(F.col(x) - px, F.col(y) - py)).orderBy("distance", tie).limit(k)


def classes(df: DataFrame, id_column: str, *place: str) -> tuple[DataFrame, DataFrame]:
    """Rows at the same place (none of its columns null) make a class, whose least id stands for it: (id_column, *place) of each class, and (representative, member) of each row.

    A join of representatives, with the members, says as much as one of all rows, whose pairs grow with the square of a place's rows.
    """
    there = df.select(id_column, *place).dropna(subset=list(place))
    alone = there.groupBy(*place).agg(F.min(id_column).alias(id_column)).select(id_column, *place)
    return alone, there.withColumnRenamed(id_column, "member").join(alone.withColumnRenamed(id_column, "representative"), list(place)).select("representative", "member")


def distance_join(left: DataFrame, right: DataFrame, lx: str, ly: str, rx: str, ry: str, radius: float) -> DataFrame:
    """Pairs within radius, with `distance`.

    Both sides meet by grid cells as wide as the radius, an equality that
    hashes; each left row is sent to the nine cells about it, right rows once.
    """
    near = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    cells = left.withColumn("__dx", F.explode(near)).withColumn("__dy", F.explode(near))
    cells = cells.withColumn("__cx", F.floor(F.col(lx) / radius) + F.col("__dx")).withColumn("__cy", F.floor(F.col(ly) / radius) + F.col("__dy"))
    other = right.withColumn("__rx", F.floor(F.col(rx) / radius)).withColumn("__ry", F.floor(F.col(ry) / radius))
    both = cells.join(other, (F.col("__cx") == F.col("__rx")) & (F.col("__cy") == F.col("__ry")))
    return both.withColumn("distance", F.hypot(F.col(lx) - F.col(rx), F.col(ly) - F.col(ry))).filter(F.col("distance") <= radius).drop("__dx", "__dy", "__cx", "__cy", "__rx", "__ry")


def _parsed(*columns: pd.Series) -> list[list]:
    """Parts of each text; each distinct text of a batch is parsed once."""
    held = {t: G.parse(t) for c in columns for t in c.dropna().unique()}
    return [[None if t is None or t != t else held[t] for t in c] for c in columns]


def _boxes(parts: list) -> np.ndarray:
    """(n, 4) of x0, y0, x1, y1; NaN where there is none."""
    known = {id(p): G.bounds(p) for p in parts if p and G.valid(p)}
    return np.array([known.get(id(p)) or (np.nan,) * 4 for p in parts], np.float64).reshape(-1, 4)


def _binary(f: Callable, kind: T.DataType, apart: object = None):
    """A predicate of two geometries; pairs whose boxes are apart get `apart` at once, if that is known."""
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        x, y = _parsed(a, b)
        far = np.zeros(len(x), bool)
        if apart is not None and len(x):
            u, v = _boxes(x), _boxes(y)
            far = ~((u[:, 0] <= v[:, 2] + G.EPS) & (v[:, 0] <= u[:, 2] + G.EPS) & (u[:, 1] <= v[:, 3] + G.EPS) & (v[:, 1] <= u[:, 3] + G.EPS))
        return pd.Series([None if p is None or q is None else apart if z else f(p, q) for p, q, z in zip(x, y, far)], dtype=object)

    return run


st_intersects = _binary(G.intersects, T.BooleanType(), False)
st_disjoint = _binary(lambda a, b: not G.intersects(a, b), T.BooleanType(), True)
st_contains = _binary(G.contains, T.BooleanType(), False)
st_within = _binary(lambda a, b: G.contains(b, a), T.BooleanType(), False)
st_equals = _binary(G.equals, T.BooleanType())
st_touches = _binary(G.touches, T.BooleanType(), False)
st_crosses = _binary(G.crosses, T.BooleanType(), False)
st_overlaps = _binary(G.overlaps, T.BooleanType(), False)
st_distance = _binary(G.distance, T.DoubleType())


def _unary(f: Callable, kind: T.DataType):
    @F.pandas_udf(kind)
    def run(a: pd.Series) -> pd.Series:
        held = {t if not isinstance(t, (bytearray, memoryview)) else bytes(t): None for t in a if t is not None}
        for t in held:
            try:
                held[t] = f(t)
            except G.GeometryError:
                held[t] = None
        return pd.Series([None if t is None else held[t if not isinstance(t, (bytearray, memoryview)) else bytes(t)] for t in a], dtype=object)

    return run


#: Between well-known text and bytes and GeoJSON; null where something isn't a geometry.
wkt_to_wkb = _unary(lambda t: G.to_wkb(G.parse(t)), T.BinaryType())
wkb_to_wkt = _unary(lambda b: G.to_wkt(G.from_wkb(b)), T.StringType())
wkt_to_geojson = _unary(lambda t: G.to_geojson(G.parse(t)), T.StringType())
geojson_to_wkt = _unary(lambda t: G.to_wkt(G.from_geojson(t)), T.StringType())


@F.pandas_udf(T.StringType())
def st_buffer(geom: pd.Series, d: pd.Series) -> pd.Series:
    return pd.Series([None if g is None else G.buffer(g, r) for g, r in zip(geom, d)])


@F.pandas_udf(_doubles("x0", "y0", "x1", "y1"))
def st_bounds(geom: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(None if g is None else G.bounds(G.parse(g))) or (None,) * 4 for g in geom], columns=["x0", "y0", "x1", "y1"], dtype="float64")


def geometry_join(left: DataFrame, right: DataFrame, left_geom: str, right_geom: str, predicate, cell: float) -> DataFrame:
    """Pairs for which predicate(left, right) holds; it must imply that they meet.

    Boxes are laid on a grid; a pair is tried once, in the first cell that both
    boxes share, and exactly only if the boxes meet.
    """
    def gridded(df: DataFrame, geom: str, n: str) -> DataFrame:
        df = df.withColumn(f"__b{n}", st_bounds(geom)).filter(f"__b{n}.x0 is not null")
        for axis in "xy":
            df = df.withColumn(f"__{axis}{n}", F.explode(F.sequence(F.floor(F.col(f"__b{n}.{axis}0") / cell), F.floor(F.col(f"__b{n}.{axis}1") / cell))))
        return df

    a, b = gridded(left, left_geom, "a"), gridded(right, right_geom, "b")
    on = (F.col("__xa") == F.col("__xb")) & (F.col("__ya") == F.col("__yb"))
    for axis in "xy":
        low = F.greatest(f"__ba.{axis}0", f"__bb.{axis}0")
        on = on & (low <= F.least(f"__ba.{axis}1", f"__bb.{axis}1")) & (F.col(f"__{axis}a") == F.floor(low / cell))
    return a.join(b, on).filter(predicate(left_geom, right_geom)).select(*left.columns, *right.columns)
