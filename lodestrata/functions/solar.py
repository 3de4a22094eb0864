"""Position of the sun, its events and the exposure of slopes, as Column expressions (UTC times).

The series are the low-precision ones of Meeus, Astronomical Algorithms, chapter 25, in the form in which the NOAA solar
calculator publishes them; their coefficients are fixed values.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Zenith of sunrise and sunset with refraction, and of civil twilight.
SUNRISE_ZENITH, CIVIL_ZENITH = 90.833, 96.0


def _century(at: Column) -> Column:
    """Julian centuries from 2000."""
    return (F.unix_micros(at.cast("timestamp")) / 86_400_000_000.0 + 2440587.5 - 2451545.0) / 36525.0


def _sun(t: Column) -> tuple[Column, Column]:
    """Declination in degrees and equation of time in minutes."""
    mean_long = F.pmod(280.46646 + t * (36000.76983 + t * 0.0003032), F.lit(360.0))
    anomaly = F.radians(357.52911 + t * (35999.05029 - 0.0001537 * t))
    ecc = 0.016708634 - t * (0.000042037 + 0.0000001267 * t)
    centre = F.sin(anomaly) * (1.914602 - t * (0.004817 + 0.000014 * t)) + F.sin(2 * anomaly) * (0.019993 - 0.000101 * t) + F.sin(3 * anomaly) * 0.000289
    omega = F.radians(125.04 - 1934.136 * t)
    apparent = F.radians(mean_long + centre - 0.00569 - 0.00478 * F.sin(omega))
    obliquity = F.radians(23.439291 - t * (0.0130042 + t * (0.00000016 - t * 0.000000504)) + 0.00256 * F.cos(omega))
    declination = F.degrees(F.asin(F.sin(obliquity) * F.sin(apparent)))
    y = F.pow(F.tan(obliquity / 2), 2)
    long = F.radians(mean_long)
    minutes = 4 * F.degrees(y * F.sin(2 * long) - 2 * ecc * F.sin(anomaly) + 4 * ecc * y * F.sin(anomaly) * F.cos(2 * long) - 0.5 * y * y * F.sin(4 * long) - 1.25 * ecc * ecc * F.sin(2 * anomaly))
    return declination, minutes


def position(at: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Zenith and azimuth (from north) in degrees."""
    declination, equation = _sun(_century(at))
    minute = F.pmod(F.unix_micros(at.cast("timestamp")) / 60_000_000.0, F.lit(1440.0))
    hour = F.radians(F.pmod(minute + equation + 4 * lon, F.lit(1440.0)) / 4 - 180)
    phi, d = F.radians(lat), F.radians(declination)
    cosine = F.sin(phi) * F.sin(d) + F.cos(phi) * F.cos(d) * F.cos(hour)
    zenith = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))))
    azimuth = F.pmod(F.degrees(F.atan2(F.sin(hour), F.cos(hour) * F.sin(phi) - F.tan(d) * F.cos(phi))) + 180, F.lit(360.0))
    return zenith, azimuth


def events(day: Column, lat: Column, lon: Column, zenith: float = SUNRISE_ZENITH) -> tuple[Column, Column, Column]:
    """Minutes of the UTC day of the rise and the set at a zenith, and hours between; null in polar day and night."""
    declination, equation = _sun(_century(day.cast("timestamp") + F.expr("interval 12 hours")))
    phi, d = F.radians(lat), F.radians(declination)
    cosine = F.cos(F.radians(F.lit(zenith))) / (F.cos(phi) * F.cos(d)) - F.tan(phi) * F.tan(d)
    half = F.when(F.abs(cosine) <= 1, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))
    noon = 720 - 4 * lon - equation
    return noon - 4 * half, noon + 4 * half, half * 8 / 60


def phase(minute: Column, rise: Column, set_: Column, dawn: Column, dusk: Column) -> Column:
    return F.when(minute.between(rise, set_), "day").when(minute.between(dawn, rise), "dawn").when(minute.between(set_, dusk), "dusk").otherwise("night")


def incidence(zenith: Column, azimuth: Column, slope: Column, aspect: Column, horizon: Column) -> Column:
    """Direct beam on a slope (0 to 1), none below the horizon angle."""
    z, s = F.radians(zenith), F.radians(slope)
    cosine = F.cos(z) * F.cos(s) + F.sin(z) * F.sin(s) * F.cos(F.radians(azimuth - aspect))
    return F.when((zenith < 90) & (90 - zenith > horizon), F.greatest(F.lit(0.0), cosine)).otherwise(0.0)


def horizon_at(sectors: Column, azimuth: Column) -> Column:
    """Horizon angle between the two nearest of evenly spaced sectors, wrapping round."""
    n = F.size(sectors)
    place = F.pmod(azimuth, F.lit(360.0)) / (360.0 / n)
    low = F.floor(place).cast("int")
    share = place - low
    return F.get(sectors, F.pmod(low, n)) * (1 - share) + F.get(sectors, F.pmod(low + 1, n)) * share


def exposure_factor(beam: Column, cloud: Column, canopy: Column) -> Column:
    """Beam left after cloud and canopy shares; null where one is unknown."""
    return beam * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), cloud))) * (1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), canopy)))
