"""Distances, travel times and their inverse, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0

# Travel policy.
WALK_M_PER_MIN = 80.0
WALK_DETOUR = 1.3
TRANSIT_DETOUR = 1.3
TRANSIT_M_PER_MIN = 300.0
TRANSIT_WAIT_MIN = 8.0
DRIVE_NEAR_M = 5000.0
DRIVE_NEAR_DETOUR = 1.4
DRIVE_FAR_DETOUR = 1.25
DRIVE_TOWN_ROAD_M = 4000.0
PARKING_MIN = 8.0
TOWN_KMH = {"peak": 25.0, "night": 45.0, "day": 35.0}
ROAD_KMH = {"peak": 40.0, "night": 70.0, "day": 60.0}
MAX_TRAVEL_MIN = {"walk": 25, "drive": 30, "transit": 35}


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """The squared sine of half the angle between two points; it grows with their distance."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    return F.pow(F.sin(dlat / 2), 2.0) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2.0)


def distance_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle metres on a sphere."""
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(haversine(lat1, lon1, lat2, lon2))))


def on_sphere(lat: Column, lon: Column) -> list[Column]:
    """x, y and z of a point on a sphere of radius 1."""
    a, b = F.radians(lat), F.radians(lon)
    return [(F.cos(a) * F.cos(b)).alias("x"), (F.cos(a) * F.sin(b)).alias("y"), F.sin(a).alias("z")]


def degrees_lat(metres: float) -> float:
    return math.degrees(metres / EARTH_M)


def _by_hour(hour: Column, speeds: dict[str, float]) -> Column:
    """Metres a minute: peak 7-10 and 16-19, night 22-6, day otherwise."""
    rate = {k: v * 1000.0 / 60.0 for k, v in speeds.items()}
    peak = hour.between(7, 10) | hour.between(16, 19)
    return F.when(peak, F.lit(rate["peak"])).when((hour >= 22) | (hour < 6), F.lit(rate["night"])).otherwise(F.lit(rate["day"]))


def drive_minutes(metres: Column, hour: Column) -> Column:
    """Wheel time: roads detour more near the start, and the first kilometres go at town speed."""
    road = F.least(metres, F.lit(DRIVE_NEAR_M)) * DRIVE_NEAR_DETOUR + F.greatest(F.lit(0.0), metres - DRIVE_NEAR_M) * DRIVE_FAR_DETOUR
    town = F.least(road, F.lit(DRIVE_TOWN_ROAD_M))
    return town / _by_hour(hour, TOWN_KMH) + (road - town) / _by_hour(hour, ROAD_KMH)


def travel_minutes(metres: Column, mode: Column, hour: Column, parking: Column | float = PARKING_MIN) -> Column:
    """Whole minutes of a one-way trip, rounded up; null for an unknown mode."""
    buffer = parking if isinstance(parking, Column) else F.lit(parking)
    walk = metres * WALK_DETOUR / WALK_M_PER_MIN
    transit = metres * TRANSIT_DETOUR / TRANSIT_M_PER_MIN + TRANSIT_WAIT_MIN
    raw = F.when(mode == "walk", walk).when(mode == "transit", transit).when(mode == "drive", drive_minutes(metres, hour) + buffer)
    return F.ceil(raw).cast("int")


def drive_reach_m(minutes: Column, hour: Column) -> Column:
    """Straight-line metres that the wheel time covers: the inverse of drive_minutes."""
    town, fast = _by_hour(hour, TOWN_KMH), _by_hour(hour, ROAD_KMH)
    in_town = F.lit(DRIVE_TOWN_ROAD_M) / town
    road = F.when(minutes <= in_town, minutes * town).otherwise(DRIVE_TOWN_ROAD_M + (minutes - in_town) * fast)
    near = DRIVE_NEAR_M * DRIVE_NEAR_DETOUR
    return F.when(road <= near, road / DRIVE_NEAR_DETOUR).otherwise(DRIVE_NEAR_M + (road - near) / DRIVE_FAR_DETOUR)


def reach_m(mode: Column, minutes: Column) -> Column:
    """The farthest straight-line metres that any hour allows within the minutes."""
    wheel = F.greatest(F.lit(0.0), minutes - PARKING_MIN)
    drive = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: drive_reach_m(wheel, h)))
    transit = F.greatest(F.lit(0.0), minutes - TRANSIT_WAIT_MIN) * TRANSIT_M_PER_MIN / TRANSIT_DETOUR
    return F.when(mode == "walk", minutes * WALK_M_PER_MIN / WALK_DETOUR).when(mode == "transit", transit).when(mode == "drive", drive)


def destination_multiplier(window: Column) -> Column:
    """How much farther a destination may be than an everyday place, by the minutes there are."""
    return F.when(window >= 210, 2.0).when(window >= 150, 1.5).otherwise(1.0)


def tiles_across(degrees: Column, most: float = 0.49) -> Column:
    """How many tiles of at most `most` degrees cover an extent."""
    return F.ceil(F.round(degrees / most, 9)).cast("int")


def extent_m(catchment: Column, reach: Column) -> Column:
    """How far around an area its places are read: catchment and reach, to whole hundreds."""
    return (F.ceil((catchment + reach) / 100) * 100).cast("int")


def slack_m(radius: Column) -> Column:
    """How far beyond an extent a place's point may lie: its middle a little outside."""
    return F.greatest(F.lit(1000.0), radius / 4)
