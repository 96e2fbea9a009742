"""Sunrise, sunset and civil twilight as clock times of a place's day, by the sun's position.

The mean anomaly gives the ecliptic longitude and so the declination and the
transit; the hour angle at which the sun stands at an event's height gives the
times before and after it. Good to about three minutes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Heights of the sun in degrees, and whether before or after its transit.
EVENTS = {"sunrise": (-0.833, -1), "sunset": (-0.833, 1), "dawn": (-6.0, -1), "dusk": (-6.0, 1)}
# Orbit and axis of the earth, degrees and days.
ANOMALY, ANOMALY_A_DAY, PERIHELION, OBLIQUITY = 357.5291, 0.98560028, 102.9372, 23.4397
CENTRE = (1.9148, 0.02, 0.0003)
TRANSIT, BY_ANOMALY, BY_LONGITUDE = 0.0009, 0.0053, 0.0069
#: Noon of 2000-01-01 in seconds since 1970.
EPOCH_S = 946_728_000
CLOCKS = "struct<" + ",".join(f"{e}:int" for e in EVENTS) + ">"


def with_sun(rows: DataFrame, day: Column, lat: str = "lat", lon: str = "lon", zone: str = "zone", name: str = "sun") -> DataFrame:
    """The rows with a struct of the minutes of the clock at which each event of EVENTS is on that day.

    A place is read to 0.01 degrees. An event that does not occur that day, as in
    polar day or night, is null, and so are all of a place without coordinates.
    """
    s = lambda c: F.col(f"{name}.{c}")
    noon = F.unix_seconds(F.to_utc_timestamp(day.cast("timestamp") + F.expr("interval 12 hours"), F.col(zone)))
    rows = rows.withColumn(name, F.struct(F.radians(F.round(lat, 2)).alias("phi"), F.radians(-F.round(lon, 2)).alias("west"), ((noon - EPOCH_S) / 86400.0).alias("d"), F.col(zone).alias("zone")))
    rows = rows.withColumn(name, F.struct(s("phi"), s("west"), s("zone"), F.floor(s("d") - TRANSIT - s("west") / (2 * math.pi) + 0.5).alias("n")))
    rows = rows.withColumn(name, F.struct(s("phi"), s("west"), s("zone"), s("n"), F.radians(F.lit(ANOMALY) + F.lit(ANOMALY_A_DAY) * (F.lit(TRANSIT) + s("west") / (2 * math.pi) + s("n"))).alias("m")))
    centre = sum((F.lit(c) * F.sin((i + 1) * s("m")) for i, c in enumerate(CENTRE)), F.lit(0.0))
    rows = rows.withColumn(name, F.struct(s("phi"), s("west"), s("zone"), s("n"), s("m"), (s("m") + F.radians(centre + PERIHELION) + math.pi).alias("l")))
    rows = rows.withColumn(name, F.struct(s("phi"), s("west"), s("zone"), s("n"), (F.lit(BY_ANOMALY) * F.sin(s("m")) - F.lit(BY_LONGITUDE) * F.sin(2 * s("l"))).alias("shift"), F.asin(F.sin(s("l")) * math.sin(math.radians(OBLIQUITY))).alias("dec")))

    def clock(height: float, side: int) -> Column:
        angle = F.acos((math.sin(math.radians(height)) - F.sin(s("phi")) * F.sin(s("dec"))) / (F.cos(s("phi")) * F.cos(s("dec"))))
        # the later event follows from its hour angle, the earlier one mirrors it at the transit
        late = F.lit(TRANSIT) + (angle + s("west")) / (2 * math.pi) + s("n") + s("shift")
        transit = F.lit(TRANSIT) + s("west") / (2 * math.pi) + s("n") + s("shift")
        at = late if side > 0 else 2 * transit - late
        local = F.from_utc_timestamp(F.timestamp_seconds((F.floor(at * 1440.0 + EPOCH_S / 60 + 0.5) * 60).cast("long")), s("zone"))
        return F.when(~F.isnan(angle), F.hour(local) * 60 + F.minute(local))

    return rows.withColumn(name, F.struct(*(clock(*how).cast("int").alias(e) for e, how in EVENTS.items())))


def sun_sql(rows: str, day: str, keys: str = "*") -> str:
    """DuckDB SQL for the rows (with lat, lon, zone) and a column for each event."""
    events = ", ".join(
        f"CASE WHEN abs(({math.sin(math.radians(h))!r}::DOUBLE - sin(phi) * sin(dec)) / (cos(phi) * cos(dec))) <= 1 THEN floor(({'late' if side > 0 else '2 * transit - late'}) * 1440.0::DOUBLE + {EPOCH_S / 60!r}::DOUBLE + 0.5::DOUBLE) * 60 END AS at_{e}".replace(
            "late", f"({TRANSIT}::DOUBLE + (acos(greatest(-1, least(1, ({math.sin(math.radians(h))!r}::DOUBLE - sin(phi) * sin(dec)) / (cos(phi) * cos(dec))))) + west) / (2 * pi()) + n + shift)"
        ).replace("transit", f"({TRANSIT}::DOUBLE + west / (2 * pi()) + n + shift)")
        for e, (h, side) in EVENTS.items()
    )
    centre = " + ".join(f"{c}::DOUBLE * sin({i + 1} * m)" for i, c in enumerate(CENTRE))
    minute = ", ".join(f"(hour(timezone(zone, to_timestamp(at_{e}))) * 60 + minute(timezone(zone, to_timestamp(at_{e}))))::INT AS {e}" for e in EVENTS)
    cut = "EXCLUDE (phi, west, n, shift, dec, " + ", ".join(f"at_{e}" for e in EVENTS) + ")"
    return f"""(SELECT {keys} {cut}, {minute} FROM (SELECT *, {events} FROM (
      SELECT * EXCLUDE (m, l), {BY_ANOMALY}::DOUBLE * sin(m) - {BY_LONGITUDE}::DOUBLE * sin(2 * l) AS shift, asin(sin(l) * {math.sin(math.radians(OBLIQUITY))!r}::DOUBLE) AS dec FROM (
      SELECT *, m + radians({centre} + {PERIHELION}::DOUBLE) + pi() AS l FROM (
      SELECT *, radians({ANOMALY}::DOUBLE + {ANOMALY_A_DAY}::DOUBLE * ({TRANSIT}::DOUBLE + west / (2 * pi()) + n)) AS m FROM (
      SELECT * EXCLUDE d, floor(d - {TRANSIT}::DOUBLE - west / (2 * pi()) + 0.5::DOUBLE) AS n FROM (
      SELECT *, radians(round(lat, 2)) AS phi, radians(-round(lon, 2)) AS west, (epoch(timezone(zone, ({day})::TIMESTAMP + INTERVAL 12 HOUR)) - {EPOCH_S}) / 86400.0::DOUBLE AS d FROM {rows})))))))"""
