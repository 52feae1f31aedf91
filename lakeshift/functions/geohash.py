"""Geohash encode/decode/neighbours for lake ids.

Encode/decode are Arrow-batched pandas UDFs over numpy bit arithmetic;
the neighbourhood and label around them are plain Catalyst expressions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .numeric import nan_to_null

# Fixed value: the standard geohash base-32 alphabet.
ALPHABET = "0123456789bcdefghjkmnpqrstuvwxyz"


def _bits(precision: int) -> tuple[int, int]:
    total = 5 * precision
    return (total + 1) // 2, total // 2  # lon bits, lat bits


_ALPHA_BYTES = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)
_CHAR_INDEX = np.full(256, -1, dtype=np.int64)
_CHAR_INDEX[_ALPHA_BYTES] = np.arange(32)


def encode_arrays(lat: np.ndarray, lon: np.ndarray, precision: int) -> np.ndarray:
    """Vectorised geohash text of coordinate arrays (NaN or out of range -> None)."""
    lon_bits, lat_bits = _bits(precision)
    bad = ~((np.abs(lat) <= 90.0) & (np.abs(lon) <= 180.0))
    la = np.where(bad, 0.0, lat)
    lo = np.where(bad, 0.0, lon)
    qlon = np.clip(np.floor((lo + 180.0) / 360.0 * float(1 << lon_bits)), 0, (1 << lon_bits) - 1).astype(np.int64)
    qlat = np.clip(np.floor((la + 90.0) / 180.0 * float(1 << lat_bits)), 0, (1 << lat_bits) - 1).astype(np.int64)
    code = np.zeros(len(la), dtype=np.int64)
    for i in range(5 * precision):  # interleave, longitude first
        b = (qlon >> (lon_bits - 1 - i // 2)) & 1 if i % 2 == 0 else (qlat >> (lat_bits - 1 - i // 2)) & 1
        code = (code << 1) | b
    shifts = 5 * np.arange(precision - 1, -1, -1, dtype=np.int64)
    chars = _ALPHA_BYTES[(code[:, None] >> shifts[None, :]) & 31]
    text = np.ascontiguousarray(chars).view(f"S{precision}").ravel().astype(str).astype(object)
    text[bad] = None
    return text


def decode_arrays(gh: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectorised cell centres (lat, lon) of geohash texts (None, or longer than 12 characters -> NaN)."""
    valid = gh.notna().to_numpy() & (gh.fillna("").str.len() <= 12).to_numpy()
    s = gh.fillna("").where(valid, "").str.lower()
    n = s.str.len().to_numpy()
    padded = s.str.ljust(12, "0")
    raw = np.frombuffer("".join(padded).encode("ascii", "replace"), dtype=np.uint8).reshape(-1, 12)
    idx = _CHAR_INDEX[raw]
    valid &= (idx >= 0).all(axis=1) & (n > 0)
    idx = np.where(idx < 0, 0, idx)
    qlon = np.zeros(len(s), dtype=np.int64)
    qlat = np.zeros(len(s), dtype=np.int64)
    for i in range(60):
        b = (idx[:, i // 5] >> (4 - i % 5)) & 1
        if i % 2 == 0:
            qlon = (qlon << 1) | b
        else:
            qlat = (qlat << 1) | b
    lon_bits = (5 * n + 1) // 2
    lat_bits = (5 * n) // 2
    qlon >>= (30 - lon_bits)
    qlat >>= (30 - lat_bits)
    lon = -180.0 + (qlon + 0.5) * (360.0 / np.exp2(lon_bits))
    lat = -90.0 + (qlat + 0.5) * (180.0 / np.exp2(lat_bits))
    return np.where(valid, lat, np.nan), np.where(valid, lon, np.nan)


_ENCODERS: dict = {}


def geohash_encode(lat: Column, lon: Column, precision: int = 12) -> Column:
    """Standard geohash of (lat, lon) with ``precision`` characters (1..12).

    Arrow-batched pandas UDF over numpy bit arithmetic: geohash is no Spark
    built-in, and as a SQL expression the 60-bit interleave exceeds the
    generated-code method size and runs interpreted.
    """
    if not 1 <= precision <= 12:
        raise ValueError("precision must be 1..12")
    from ..session import ship_to_active
    ship_to_active()
    if precision not in _ENCODERS:
        @F.pandas_udf("string")
        def enc(la: pd.Series, lo: pd.Series) -> pd.Series:
            return pd.Series(encode_arrays(la.to_numpy(dtype=float, na_value=np.nan),
                                           lo.to_numpy(dtype=float, na_value=np.nan), precision))
        _ENCODERS[precision] = enc
    return _ENCODERS[precision](lat.cast("double"), lon.cast("double"))


def _decode(gh: pd.Series) -> pd.DataFrame:
    lat, lon = decode_arrays(gh)
    return pd.DataFrame({"lat": lat, "lon": lon})


def geohash_decode(gh: Column) -> Column:
    """Centre of the geohash cell (1..12 characters) as ``struct(lat, lon)``."""
    from ..session import ship_to_active
    ship_to_active()
    if "decode" not in _ENCODERS:  # UDFs are built lazily: they need a live session
        _ENCODERS["decode"] = F.pandas_udf(_decode, "lat double, lon double")
    d = _ENCODERS["decode"](gh)
    return F.struct(nan_to_null(d["lat"]).alias("lat"), nan_to_null(d["lon"]).alias("lon"))


def geohash_neighbour_prefixes(lat: Column, lon: Column, precision: int = 4) -> Column:
    """Cells of the point and its 8 neighbours at ``precision`` (distinct array).

    Neighbours come from the cell index +-1 (encoded at the neighbour's cell
    centre), not from fixed degree offsets: offsets of 0.352/0.176 degrees
    exceed the precision-4 cell (0.3515625 x 0.17578125) and skip the
    adjacent cell for points near an edge. Latitude clamps at the poles,
    longitude wraps at the antimeridian.
    """
    lon_bits, lat_bits = _bits(precision)
    w, h = 360.0 / (1 << lon_bits), 180.0 / (1 << lat_bits)
    qlon = F.floor((lon + F.lit(180.0)) / F.lit(w))
    qlat = F.floor((lat + F.lit(90.0)) / F.lit(h))
    cells = []
    for dj in (-1, 0, 1):
        for di in (-1, 0, 1):
            c_lon = F.pmod(qlon + F.lit(di), F.lit(1 << lon_bits))
            c_lat = F.least(F.greatest(qlat + F.lit(dj), F.lit(0)), F.lit((1 << lat_bits) - 1))
            cells.append(geohash_encode(F.lit(-90.0) + (c_lat + F.lit(0.5)) * F.lit(h),
                                        F.lit(-180.0) + (c_lon + F.lit(0.5)) * F.lit(w), precision))
    return F.array_distinct(F.array(*cells))


def geohash_label(gh: Column) -> Column:
    """``'<geohash> | <lat> : <lon>'`` with three decimals.

    Java's ``%.3f`` rounds the shortest decimal text half-up; Python rounds
    the exact binary value. ``bround`` on the exact value first makes the
    Java text equal Python's.
    """
    c = geohash_decode(gh)
    return F.format_string("%s | %.3f : %.3f", gh, F.bround(c["lat"], 3), F.bround(c["lon"], 3))


def geohash_from_label(label: Column) -> Column:
    return F.split(label, r" \| ").getItem(0)
