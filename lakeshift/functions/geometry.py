"""Polygon expressions over ``rings ARRAY<ARRAY<ARRAY<STRUCT<x,y>>>>``.

Layout: polygon -> ring (first = shell, others = holes) -> closed vertex list.
Most functions are higher-order SQL expressions. Centroids and areas of whole
tables come from a numpy kernel that reads Arrow batches (``shape_of``).
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _all_rings(rings: Column) -> Column:
    """Rings flattened with a sign: +1 shell, -1 hole."""
    return F.flatten(F.transform(
        rings, lambda poly: F.transform(
            poly, lambda ring, i: F.struct(ring.alias("ring"),
                                           F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("sign")))))


def _first_vertex(rings: Column) -> Column:
    return F.element_at(F.element_at(F.element_at(rings, 1), 1), 1)


def _ring_moments(ring: Column, ox: Column, oy: Column) -> Column:
    """One pass over a ring: twice the signed area and the two first moments,
    about the origin (ox, oy)."""
    pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"),
                         F.slice(ring, 2, F.size(ring) - 1).alias("q"))
    zero = F.struct(F.lit(0.0).alias("a2"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def step(acc, pq):
        px, py = pq["p"]["x"] - ox, pq["p"]["y"] - oy
        qx, qy = pq["q"]["x"] - ox, pq["q"]["y"] - oy
        c = px * qy - qx * py
        return F.struct((acc["a2"] + c).alias("a2"), (acc["mx"] + (px + qx) * c).alias("mx"),
                        (acc["my"] + (py + qy) * c).alias("my"))

    return F.aggregate(pairs, zero, step)


def _moments(rings: Column) -> Column:
    """Signed totals over all rings: area (holes negative) and moments,
    each ring normalised to its orientation. Origin = first vertex: with raw
    coordinates (|x| ~ 165) the cross products of a small lake cancel."""
    first = _first_vertex(rings)
    ox, oy = first["x"], first["y"]
    per_ring = F.transform(_all_rings(rings), lambda r: F.struct(
        r["sign"].alias("sign"), _ring_moments(r["ring"], ox, oy).alias("m")))
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("mx"), F.lit(0.0).alias("my"))

    def add(acc, r):
        o = r["sign"] * F.signum(r["m"]["a2"])
        return F.struct((acc["a"] + r["sign"] * F.abs(r["m"]["a2"]) / F.lit(2.0)).alias("a"),
                        (acc["mx"] + o * r["m"]["mx"]).alias("mx"),
                        (acc["my"] + o * r["m"]["my"]).alias("my"))

    tot = F.aggregate(per_ring, zero, add)
    return F.struct(tot.alias("t"), ox.alias("ox"), oy.alias("oy"))


def polygon_area(rings: Column) -> Column:
    """Planar area in squared coordinate units; holes subtract."""
    return _moments(rings)["t"]["a"]


def centroid(rings: Column) -> Column:
    """Area-weighted centroid as ``struct(x, y)``; holes weigh negative.

    Zero area falls back to the mean of the vertices.
    """
    m = _moments(rings)
    a, mx, my = m["t"]["a"], m["t"]["mx"], m["t"]["my"]
    verts = F.flatten(F.flatten(rings))
    n = F.size(verts).cast("double")
    vx = F.aggregate(verts, F.lit(0.0), lambda acc, v: acc + (v["x"] - m["ox"])) / n
    vy = F.aggregate(verts, F.lit(0.0), lambda acc, v: acc + (v["y"] - m["oy"])) / n
    nonzero = F.abs(a) > F.lit(0.0)
    cx = F.when(nonzero, mx / (F.lit(6.0) * a)).otherwise(vx)
    cy = F.when(nonzero, my / (F.lit(6.0) * a)).otherwise(vy)
    return F.struct((m["ox"] + cx).alias("x"), (m["oy"] + cy).alias("y"))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Point-in-polygon by ray casting (even-odd over all rings of each polygon)."""
    def crossings(ring: Column) -> Column:
        def hit(p, q):
            straddles = (p["y"] > y) != (q["y"] > y)
            x_at = (q["x"] - p["x"]) * (y - p["y"]) / F.when(straddles, q["y"] - p["y"]) + p["x"]
            return F.when(straddles & (x < x_at), F.lit(1)).otherwise(F.lit(0))
        pairs = F.arrays_zip(F.slice(ring, 1, F.size(ring) - 1).alias("p"),
                             F.slice(ring, 2, F.size(ring) - 1).alias("q"))
        return F.aggregate(pairs, F.lit(0), lambda acc, pq: acc + hit(pq["p"], pq["q"]))

    per_poly = F.transform(rings, lambda poly: F.aggregate(poly, F.lit(0), lambda acc, r: acc + crossings(r)) % 2 == 1)
    return F.exists(per_poly, lambda b: b)


def vertices(rings: Column) -> Column:
    return F.flatten(F.flatten(rings))


def bounds(rings: Column) -> Column:
    """``struct(minx, miny, maxx, maxy)`` of one geometry."""
    v = vertices(rings)
    xs = F.transform(v, lambda p: p["x"])
    ys = F.transform(v, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"),
                    F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def drop_z(rings: Column) -> Column:
    """Keep x and y of each vertex (drops z/m fields)."""
    return F.transform(rings, lambda poly: F.transform(
        poly, lambda ring: F.transform(ring, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))))


# WGS84 ellipsoid and the EPSG:3995 Arctic polar
# stereographic projection (standard parallel 71 N, central meridian 0).
WGS84_A = 6378137.0
WGS84_F = 1.0 / 298.257223563
POLAR_LAT_TS = 71.0


def polar_xy(lon: Column, lat: Column) -> Column:
    """Closed-form north polar stereographic coordinates in metres (EPSG:3995)."""
    e2 = WGS84_F * (2 - WGS84_F)
    e = math.sqrt(e2)

    def t_of(phi_rad):
        s = F.sin(phi_rad)
        return F.tan(F.lit(math.pi / 4) - phi_rad / 2) / F.pow((1 - F.lit(e) * s) / (1 + F.lit(e) * s), F.lit(e / 2))

    phic = math.radians(POLAR_LAT_TS)
    tc = math.tan(math.pi / 4 - phic / 2) / ((1 - e * math.sin(phic)) / (1 + e * math.sin(phic))) ** (e / 2)
    mc = math.cos(phic) / math.sqrt(1 - e2 * math.sin(phic) ** 2)
    phi = F.radians(lat)
    lam = F.radians(lon)
    rho = F.lit(WGS84_A * mc / tc) * t_of(phi)
    return F.struct((rho * F.sin(lam)).alias("x"), (-rho * F.cos(lam)).alias("y"))


# --------------------------------------------------------------------------- vectorised kernel

def _ring_arrays(rings_arr):
    """Flatten a pyarrow ``rings`` column to vertex arrays and ring bookkeeping."""
    import numpy as np
    import pyarrow.compute as pc
    rings_arr = rings_arr.combine_chunks() if isinstance(rings_arr, pa.ChunkedArray) else rings_arr
    rings_arr = pc.fill_null(rings_arr, pa.scalar([], type=rings_arr.type)) if rings_arr.null_count else rings_arr
    polys = rings_arr.flatten()                      # one entry per polygon
    rings = polys.flatten()                          # one entry per ring
    verts = rings.flatten()                          # one entry per vertex
    x = verts.field("x").to_numpy(zero_copy_only=False).astype(float)
    y = verts.field("y").to_numpy(zero_copy_only=False).astype(float)
    poly_off = np.asarray(rings_arr.offsets)         # row -> polygons
    ring_off = np.asarray(polys.offsets)             # polygon -> rings
    vert_off = np.asarray(rings.offsets)             # ring -> vertices
    n_rows, n_polys, n_rings = len(rings_arr), len(polys), len(rings)
    poly_row = np.repeat(np.arange(n_rows), np.diff(poly_off))
    ring_poly = np.repeat(np.arange(n_polys), np.diff(ring_off))
    ring_row = poly_row[ring_poly] if n_rings else np.zeros(0, dtype=int)
    ring_is_shell = (np.arange(n_rings) - ring_off[ring_poly]) == 0 if n_rings else np.zeros(0, dtype=bool)
    return x, y, vert_off, ring_row, ring_is_shell, n_rows


def centroid_area_arrays(rings_arr):
    """Vectorised (cx, cy, area) for a pyarrow ``rings`` column (NaN when empty)."""
    import numpy as np
    x, y, vert_off, ring_row, shell, n_rows = _ring_arrays(rings_arr)
    cx = np.full(n_rows, np.nan)
    cy = np.full(n_rows, np.nan)
    area = np.full(n_rows, np.nan)
    if len(x) == 0:
        return cx, cy, area
    n_ring = len(vert_off) - 1
    vert_ring = np.repeat(np.arange(n_ring), np.diff(vert_off))
    # origin per row: its first vertex (small lakes far from 0 lose digits otherwise)
    row_first = np.full(n_rows, -1)
    first_vert_of_ring = vert_off[:-1]
    for_row = ring_row[::-1], first_vert_of_ring[::-1]
    row_first[for_row[0]] = for_row[1]  # last write wins -> the first ring of the row
    has = row_first >= 0
    vrow = ring_row[vert_ring]
    ox = np.where(has, x[np.maximum(row_first, 0)], 0.0)
    oy = np.where(has, y[np.maximum(row_first, 0)], 0.0)
    lx, ly = x - ox[vrow], y - oy[vrow]
    nxt = np.arange(1, len(x) + 1)
    last_of_ring = np.zeros(len(x), dtype=bool)
    last_of_ring[vert_off[1:][np.diff(vert_off) > 0] - 1] = True
    nxt = np.minimum(nxt, len(x) - 1)
    c = np.where(last_of_ring, 0.0, lx * ly[nxt] - lx[nxt] * ly)
    mx = np.where(last_of_ring, 0.0, (lx + lx[nxt]) * c)
    my = np.where(last_of_ring, 0.0, (ly + ly[nxt]) * c)
    a2_ring = np.bincount(vert_ring, weights=c, minlength=n_ring)
    mx_ring = np.bincount(vert_ring, weights=mx, minlength=n_ring)
    my_ring = np.bincount(vert_ring, weights=my, minlength=n_ring)
    sign = np.where(shell, 1.0, -1.0)
    orient = sign * np.sign(a2_ring)
    a_row = np.bincount(ring_row, weights=sign * np.abs(a2_ring) / 2.0, minlength=n_rows)
    mx_row = np.bincount(ring_row, weights=orient * mx_ring, minlength=n_rows)
    my_row = np.bincount(ring_row, weights=orient * my_ring, minlength=n_rows)
    nv_row = np.bincount(vrow, minlength=n_rows)
    mean_x = np.bincount(vrow, weights=lx, minlength=n_rows) / np.maximum(nv_row, 1)
    mean_y = np.bincount(vrow, weights=ly, minlength=n_rows) / np.maximum(nv_row, 1)
    nz = a_row != 0
    with np.errstate(divide="ignore", invalid="ignore"):
        cx = np.where(nz, mx_row / (6.0 * a_row), mean_x) + ox
        cy = np.where(nz, my_row / (6.0 * a_row), mean_y) + oy
    area = np.where(has, a_row, np.nan)
    cx = np.where(has, cx, np.nan)
    cy = np.where(has, cy, np.nan)
    return cx, cy, area


def box_arrays(rings_arr):
    """Vectorised (minx, miny, maxx, maxy) for a pyarrow ``rings`` column (NaN when empty)."""
    import numpy as np
    x, y, vert_off, ring_row, _, n_rows = _ring_arrays(rings_arr)
    vrow = ring_row[np.repeat(np.arange(len(vert_off) - 1), np.diff(vert_off))]  # ascending
    rows, start = np.unique(vrow, return_index=True)
    out = np.full((4, n_rows), np.nan)
    if len(rows):
        out[:, rows] = [np.minimum.reduceat(x, start), np.minimum.reduceat(y, start),
                        np.maximum.reduceat(x, start), np.maximum.reduceat(y, start)]
    return out


_SHAPE: dict = {}


def box_of(rings: Column) -> Column:
    """``struct(minx, miny, maxx, maxy)`` as ``bounds``, through an Arrow UDF: evaluated once
    however many expressions read it, where the SQL form would be repeated in each."""
    import numpy as np
    from ..session import ship_to_active
    ship_to_active()
    if "box" not in _SHAPE:
        @F.arrow_udf("minx double, miny double, maxx double, maxy double")
        def box(arr: pa.Array) -> pa.Array:
            found = [pa.array(np.where(np.isnan(v), None, v), type=pa.float64()) for v in box_arrays(arr)]
            return pa.StructArray.from_arrays(found, names=["minx", "miny", "maxx", "maxy"])
        _SHAPE["box"] = box
    return _SHAPE["box"](rings)


def shape_of(rings: Column) -> Column:
    """``struct(cx, cy, area_deg2)`` through an Arrow UDF: vectorised numpy over the
    flattened vertex buffers of each batch. Only ``rings`` travels to Python, and
    Catalyst prunes columns and pushes filters past it."""
    import numpy as np
    from ..session import ship_to_active
    ship_to_active()
    if "udf" not in _SHAPE:  # built lazily: it needs a live session
        @F.arrow_udf("cx double, cy double, area_deg2 double")
        def shape(arr: pa.Array) -> pa.Array:
            found = [pa.array(np.where(np.isnan(v), None, v), type=pa.float64()) for v in centroid_area_arrays(arr)]
            return pa.StructArray.from_arrays(found, names=["cx", "cy", "area_deg2"])
        _SHAPE["udf"] = shape
    return _SHAPE["udf"](rings)


def with_shape_columns(lakes, rings_col: str = "rings"):
    """Add ``cx, cy, area_deg2``: no shuffle, partitioning kept."""
    shaped = lakes.withColumn("_shape", shape_of(F.col(rings_col)))
    return shaped.select(*lakes.columns, *[F.col("_shape")[c].alias(c) for c in ("cx", "cy", "area_deg2")])
