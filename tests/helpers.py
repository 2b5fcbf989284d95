"""Hand-made trips."""

import datetime as dt

from tripledger.functions import columns as C
from tripledger.spec import TripSpec

SPEC = TripSpec()
RAW_COLUMNS = (
    "ride_id string, rideable_type string, started_at string, ended_at string, "
    "start_station_name string, start_station_id string, end_station_name string, "
    "end_station_id string, start_lat double, start_lng double, end_lat double, end_lng double, "
    "member_casual string, year int, month int"
)


def raw_row(ride_id="r", bike="electric_bike", start="2025-01-06 10:00:00", end="2025-01-06 10:10:00",
            origin="A", destination="B", member="member", year=2025, month=1, name=None,
            lat=41.0, lng=-87.0):
    return (ride_id, bike, start, end, name or (origin and f"station {origin}"), origin,
            destination and f"station {destination}", destination, lat, lng, 41.5, -87.5,
            member, year, month)


def raw_trips(spark, rows):
    return spark.createDataFrame(rows, RAW_COLUMNS)


def trips(spark, rows):
    """Clean trips from (date-time, minutes, member, bike, origin, destination[, month]) rows."""
    full = []
    for i, row in enumerate(rows):
        ts, minutes, member, bike, origin, destination = row[:6]
        month = row[6] if len(row) > 6 else dt.datetime.fromisoformat(ts).month
        full.append((str(i), bike, member, dt.datetime.fromisoformat(ts), float(minutes)
                     if minutes is not None else None, month, origin,
                     origin and f"station {origin}", 41.0, -87.0, destination))
    df = spark.createDataFrame(
        full,
        "ride_id string, rideable_type string, member_casual string, started_ts timestamp_ntz, "
        "duration_min double, month int, start_station_id string, start_station_name string, "
        "start_lat double, start_lng double, end_station_id string")
    return C.with_calendar(df, SPEC)


def rows(df, *keys):
    out = [r.asDict() for r in df.collect()]
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in out} if keys else out


def one(df):
    collected = df.collect()
    assert len(collected) == 1
    return collected[0].asDict()
