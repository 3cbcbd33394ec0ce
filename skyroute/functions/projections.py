"""Map projections as columns: EPSG 4326 (longitude, latitude in degrees), 3035 (metres) and 31370 (metres).

Formulas of the public EPSG guidance note; latitudes are found by a fixed number of iterations.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ellipsoids (semi-major axis, inverse flattening).
GRS80, INTERNATIONAL_1924 = (6378137.0, 298.257222101), (6378388.0, 297.0)
#: Fixed values of EPSG 3035: latitude and longitude of the origin, false easting and northing.
LAEA = (52.0, 10.0, 4321000.0, 3210000.0)
#: Fixed values of EPSG 31370: standard parallels, origin, false easting and northing.
LAMBERT = (51.16666723333333, 49.8333339, 90.0, 4.367486666666666, 150000.013, 5400088.438)
#: Shift from Belge 1972 to ETRS89 (metres, arc seconds, parts per million; position vector).
SHIFT = (-106.8686, 52.2978, -103.7239, 0.3366, -0.457, 1.8422, -1.2747)


def _ellipsoid(e: tuple[float, float]) -> tuple[float, float]:
    f = 1 / e[1]
    return e[0], math.sqrt(f * (2 - f))


def _q(sine, e: float, log, ratio) -> Column | float:
    return (1 - e * e) * (sine / (1 - e * e * sine * sine) - 1 / (2 * e) * log(ratio(1 - e * sine, 1 + e * sine)))


def _laea_constants():
    a, e = _ellipsoid(GRS80)
    q = lambda s: _q(s, e, math.log, lambda x, y: x / y)
    lat0 = math.radians(LAEA[0])
    qp, q0 = q(1.0), q(math.sin(lat0))
    beta0 = math.asin(q0 / qp)
    rq = a * math.sqrt(qp / 2)
    d = a * (math.cos(lat0) / math.sqrt(1 - e * e * math.sin(lat0) ** 2)) / (rq * math.cos(beta0))
    return a, e, qp, beta0, rq, d


def to_internal(lng: Column, lat: Column) -> tuple[Column, Column]:
    """4326 to 3035."""
    _, e, qp, beta0, rq, d = _laea_constants()
    q = _q(F.sin(F.radians(lat)), e, F.log, lambda x, y: x / y)
    beta = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / qp)))
    dl = F.radians(lng - LAEA[1])
    b = rq * F.sqrt(2 / (1 + math.sin(beta0) * F.sin(beta) + math.cos(beta0) * F.cos(beta) * F.cos(dl)))
    x = LAEA[2] + b * d * F.cos(beta) * F.sin(dl)
    y = LAEA[3] + b / d * (math.cos(beta0) * F.sin(beta) - math.sin(beta0) * F.cos(beta) * F.cos(dl))
    return x, y


def to_external(x: Column, y: Column) -> tuple[Column, Column]:
    """3035 to 4326."""
    _, e, qp, beta0, rq, d = _laea_constants()
    dx, dy = (x - LAEA[2]) / d, d * (y - LAEA[3])
    rho = F.sqrt(dx * dx + dy * dy)
    c = 2 * F.asin(rho / (2 * rq))
    safe = F.nullif(rho, F.lit(0.0))
    beta = F.asin(F.cos(c) * math.sin(beta0) + F.coalesce(dy * F.sin(c) * math.cos(beta0) / safe, F.lit(0.0)))
    lng = LAEA[1] + F.degrees(F.atan2(dx * F.sin(c), rho * math.cos(beta0) * F.cos(c) - dy * math.sin(beta0) * F.sin(c)))
    e2, e4, e6 = e**2, e**4, e**6
    lat = (
        beta + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + (761 * e6 / 45360) * F.sin(6 * beta)
    )
    return F.when(rho == 0, F.lit(LAEA[1])).otherwise(lng), F.degrees(lat)


def _lambert_constants():
    a, e = _ellipsoid(INTERNATIONAL_1924)
    p1, p2, p0 = (math.radians(v) for v in LAMBERT[:3])
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    f = m(p1) / (n * t(p1) ** n)
    return a, e, n, f, 0.0 if abs(p0 - math.pi / 2) < 1e-12 else a * f * t(p0) ** n


def grb_to_internal(df: DataFrame, x: str, y: str, to_x: str = "x", to_y: str = "y") -> DataFrame:
    """31370 to 3035: ``df`` with the columns ``to_x`` and ``to_y``.

    Each step is a column of its own, so that iterations don't multiply the size of one expression.
    """
    a, e, n, f, r0 = _lambert_constants()
    ratio = lambda p: F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))
    df = df.withColumns({"_dx": F.col(x) - LAMBERT[4], "_dy": r0 - (F.col(y) - LAMBERT[5])})
    df = df.withColumn("_t", F.pow(F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy")) / (a * f), F.lit(1 / n)))
    df = df.withColumn("_la", math.pi / 2 - 2 * F.atan("_t"))
    for _ in range(5):
        df = df.withColumn("_la", math.pi / 2 - 2 * F.atan(F.col("_t") * ratio(F.col("_la"))))
    df = df.withColumn("_lo", F.atan2("_dx", "_dy") / n + math.radians(LAMBERT[3]))
    # shift from Belge 1972 to ETRS89, height 0
    df = df.withColumn("_n", a / F.sqrt(1 - e * e * F.sin("_la") * F.sin("_la")))
    df = df.withColumns({"_x": F.col("_n") * F.cos("_la") * F.cos("_lo"), "_y": F.col("_n") * F.cos("_la") * F.sin("_lo"), "_z": F.col("_n") * (1 - e * e) * F.sin("_la")})
    rx, ry, rz = (math.radians(s / 3600) for s in SHIFT[3:6])
    m, (tx, ty, tz) = 1 + SHIFT[6] * 1e-6, SHIFT[:3]
    gx, gy, gz = F.col("_x"), F.col("_y"), F.col("_z")
    df = df.withColumns({"_x": tx + m * (gx - rz * gy + ry * gz), "_y": ty + m * (rz * gx + gy - rx * gz), "_z": tz + m * (-ry * gx + rx * gy + gz)})
    a, e = _ellipsoid(GRS80)
    df = df.withColumn("_p", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y")))
    df = df.withColumn("_la", F.atan2(F.col("_z"), F.col("_p") * (1 - e * e)))
    for _ in range(3):
        df = df.withColumn("_la", F.atan2(F.col("_z") + e * e * a / F.sqrt(1 - e * e * F.sin("_la") * F.sin("_la")) * F.sin("_la"), F.col("_p")))
    df = df.withColumns({"_lng": F.degrees(F.atan2("_y", "_x")), "_lat": F.degrees("_la")})
    px, py = to_internal(F.col("_lng"), F.col("_lat"))
    return df.withColumns({to_x: px, to_y: py}).drop("_dx", "_dy", "_t", "_la", "_lo", "_n", "_x", "_y", "_z", "_p", "_lng", "_lat")
