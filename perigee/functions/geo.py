"""Orbit metrics, Earth rotation, geodesy and view angles as columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed constants: gravitational parameter (km^3/s^2), equatorial radius (km), WGS84 flattening terms.
MU, RADIUS = 398600.4418, 6378.137
WGS84_A, WGS84_F = 6378.137, 1 / 298.257223563


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def mean_motion(mm) -> Column:
    """Revolutions a day; values that can't be are read as 15."""
    return F.when(_c(mm) > 0, _c(mm)).otherwise(F.lit(15.0))


def period_minutes(mm) -> Column:
    return 1440.0 / mean_motion(mm)


def semi_major_km(mm) -> Column:
    n = mean_motion(mm) * (2 * math.pi / 86400)
    return F.pow(F.lit(MU) / (n * n), F.lit(1 / 3))


def apogee_km(mm, ecc) -> Column:
    e = F.least(F.greatest(_c(ecc), F.lit(0.0)), F.lit(0.99))
    return F.greatest(semi_major_km(mm) * (1 + e) - RADIUS, F.lit(0.0))


def perigee_km(mm, ecc) -> Column:
    e = F.least(F.greatest(_c(ecc), F.lit(0.0)), F.lit(0.99))
    return F.greatest(semi_major_km(mm) * (1 - e) - RADIUS, F.lit(0.0))


def regime(mm) -> Column:
    return F.when(_c(mm) < 1.5, "GEO").when(_c(mm) < 10, "MEO").otherwise("LEO")


def gmst_degrees(jd) -> Column:
    """Greenwich mean sidereal time of a Julian date."""
    d = _c(jd) - 2451545.0
    t = d / 36525.0
    return F.pmod(280.46061837 + 360.98564736629 * d + 0.000387933 * t * t - t * t * t / 38710000.0, F.lit(360.0))


def sub_point(x, y, z, jd) -> dict[str, Column]:
    """Geocentric latitude, longitude and spherical altitude of an inertial position in km."""
    x, y, z = _c(x), _c(y), _c(z)
    lon = F.degrees(F.atan2(y, x)) - gmst_degrees(jd)
    return {"lat": F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), "lon": F.pmod(lon + 180.0, F.lit(360.0)) - 180.0, "alt_km": F.sqrt(x * x + y * y + z * z) - RADIUS}


def ecef(lat, lon, alt_km) -> tuple[Column, Column, Column]:
    """WGS84 geodetic to Earth-fixed km."""
    la, lo, h = F.radians(_c(lat)), F.radians(_c(lon)), _c(alt_km)
    e2 = WGS84_F * (2 - WGS84_F)
    n = WGS84_A / F.sqrt(1 - e2 * F.sin(la) * F.sin(la))
    return (n + h) * F.cos(la) * F.cos(lo), (n + h) * F.cos(la) * F.sin(lo), (n * (1 - e2) + h) * F.sin(la)


def view(station: tuple[float, float, float], lat, lon, alt_km) -> dict[str, Column]:
    """Range, elevation and azimuth of a target from a station (latitude, longitude, km)."""
    sx, sy, sz = ecef(*station)
    tx, ty, tz = ecef(lat, lon, alt_km)
    dx, dy, dz = tx - sx, ty - sy, tz - sz
    la, lo = math.radians(station[0]), math.radians(station[1])
    east = -math.sin(lo) * dx + math.cos(lo) * dy
    north = -math.sin(la) * math.cos(lo) * dx - math.sin(la) * math.sin(lo) * dy + math.cos(la) * dz
    up = math.cos(la) * math.cos(lo) * dx + math.cos(la) * math.sin(lo) * dy + math.sin(la) * dz
    far = F.sqrt(dx * dx + dy * dy + dz * dz)
    sine = F.least(F.greatest(F.coalesce(F.try_divide(up, far), F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))
    return {"range_km": far, "elevation_deg": F.degrees(F.asin(sine)), "azimuth_deg": F.pmod(F.degrees(F.atan2(east, north)) + 360.0, F.lit(360.0))}


def age_hours(epoch_ns, now_ns) -> Column:
    return F.greatest((_c(now_ns) - _c(epoch_ns)) / 3.6e12, F.lit(0.0))
