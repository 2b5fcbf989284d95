"""Column roles and thresholds shared by every operator.

Operators never name a column of the trip table directly: they ask a
:class:`TripSpec` which column plays which role, so the same code runs over any
trip-like event table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class TripSpec:
    trip_id: str = "ride_id"
    start_text: str = "started_at"
    end_text: str = "ended_at"
    start_ts: str = "started_ts"
    end_ts: str = "ended_ts"
    duration: str = "duration_min"
    rider: str = "member_casual"
    vehicle: str = "rideable_type"
    origin: str = "start_station_id"
    origin_name: str = "start_station_name"
    origin_x: str = "start_lng"
    origin_y: str = "start_lat"
    destination: str = "end_station_id"
    destination_name: str = "end_station_name"
    dest_x: str = "end_lng"
    dest_y: str = "end_lat"
    # ``period`` is the partition a trip was delivered in, which may differ from
    # the month of its start date; ``date`` is always the start date.
    period: str = "month"
    year: str = "year"
    date: str = "date"
    hour: str = "hour"
    dow: str = "dow"
    day_type: str = "day_type"
    # class labels
    member: str = "member"
    casual: str = "casual"
    classic: str = "classic_bike"
    electric: str = "electric_bike"

    def clean_columns(self) -> list[str]:
        """The 20 columns of the clean trip table, in order."""
        return [
            self.trip_id, self.vehicle, self.rider, self.start_ts, self.end_ts,
            self.duration, self.date, self.hour, self.dow, self.day_type,
            self.period, self.year,
            self.origin, self.origin_name, self.origin_y, self.origin_x,
            self.destination, self.destination_name, self.dest_y, self.dest_x,
        ]


@dataclass(frozen=True)
class CleanRules:
    """Duration interval ``(min_exclusive, max_inclusive]``, in minutes."""

    min_exclusive: float = 0.0
    max_inclusive: float = 1440.0


@dataclass(frozen=True)
class DateWindow:
    """A named range of start dates, both ends included (ISO text)."""

    name: str
    first: str
    last: str


# The raw file layout, in file order.
RAW_TRIP_SCHEMA = T.StructType([
    T.StructField("ride_id", T.StringType()),
    T.StructField("rideable_type", T.StringType()),
    T.StructField("started_at", T.StringType()),
    T.StructField("ended_at", T.StringType()),
    T.StructField("start_station_name", T.StringType()),
    T.StructField("start_station_id", T.StringType()),
    T.StructField("end_station_name", T.StringType()),
    T.StructField("end_station_id", T.StringType()),
    T.StructField("start_lat", T.DoubleType()),
    T.StructField("start_lng", T.DoubleType()),
    T.StructField("end_lat", T.DoubleType()),
    T.StructField("end_lng", T.DoubleType()),
    T.StructField("member_casual", T.StringType()),
])

# Duration buckets, half-open [lower, upper), in minutes.
DURATION_EDGES = (5, 10, 15, 20, 30, 45, 60, 90, 120, 240)
DURATION_LABELS = (
    "0-5", "5-10", "10-15", "15-20", "20-30", "30-45",
    "45-60", "60-90", "90-120", "120-240", "240+",
)
