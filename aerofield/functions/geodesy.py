"""Earth geometry and calendar expressions (row-local Columns)."""
from pyspark.sql import Column, functions as F

# fixed values: WGS-84 radius [m], first eccentricity, gravity [m/s^2], rotation rate [rad/s]
EARTH_RADIUS = 6378137.0
EARTH_ECCENTRICITY = 0.0818191908426
GRAVITY = 9.80665
EARTH_RATE = 7.2921151467e-5


def _flattening(lat: Column) -> Column:
    s = F.lit(EARTH_ECCENTRICITY) * F.sin(lat)
    return F.sqrt(F.lit(1.0) - s * s)


def north_to_lat(dn: Column, lat: Column) -> Column:
    """Northing difference [m] to latitude difference [rad]."""
    return dn * _flattening(lat) / F.lit(EARTH_RADIUS)


def east_to_lon(de: Column, lat: Column) -> Column:
    """Easting difference [m] to longitude difference [rad]."""
    return de * _flattening(lat) / F.lit(EARTH_RADIUS) / F.cos(lat)


def lat_to_north(dlat: Column, lat: Column) -> Column:
    """Latitude difference [rad] to northing difference [m]."""
    return dlat / _flattening(lat) * F.lit(EARTH_RADIUS)


def lon_to_east(dlon: Column, lat: Column) -> Column:
    """Longitude difference [rad] to easting difference [m]."""
    return dlon / _flattening(lat) * F.lit(EARTH_RADIUS) * F.cos(lat)


def days_in_year(year: Column) -> Column:
    y = F.floor(year).cast("long")
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    return F.when(leap, F.lit(366)).otherwise(F.lit(365)).cast("int")


def decimal_year(year: Column, doy: Column, mode: str = "true_days") -> Column:
    """Year plus day of year as a fractional year.

    ``true_days`` divides by the year's own length and rejects a day outside it
    (day 0 stands for the start of the year); ``julian`` divides by 365.25.
    """
    if mode == "julian":
        return year + (doy - 1) / F.lit(365.25)
    if mode != "true_days":
        raise ValueError(f"unknown decimal year mode {mode!r}")
    length = days_in_year(year)
    bad = (doy < 0) | (doy > length)
    frac = F.greatest(doy - 1, F.lit(0)) / length
    return F.when(bad, F.raise_error(F.lit("day of year out of range")).cast("double")).otherwise(
        F.floor(year) + frac)


def decimal_year_of(ts: Column) -> Column:
    """Fractional year of a calendar timestamp."""
    start = F.date_trunc("year", ts).cast("timestamp")
    stop = F.add_months(start.cast("date"), 12).cast("timestamp")
    sec = lambda t: F.unix_micros(t.cast("timestamp")) / F.lit(1e6)
    return F.year(ts) + (sec(ts) - sec(start)) / (sec(stop) - sec(start))


def utm_zone(lon_deg: Column) -> Column:
    return (F.floor((lon_deg + 180) / 6) + 1).cast("int")


def is_north(lat_deg: Column) -> Column:
    return lat_deg >= 0


def magnitude(*parts: Column) -> Column:
    """Length of a vector given by its components."""
    total = parts[0] * parts[0]
    for p in parts[1:]:
        total = total + p * p
    return F.sqrt(total)
