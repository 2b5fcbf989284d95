"""The fact cube kept up to date from a stream of landed trips.

Hourly sums are additive, so the batch roll-ups read the stream's output as it is:
``fact_cube(hourly)`` equals the cube over all trips that have been emitted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tripledger.functions import columns as C
from tripledger.operators.metrics import FACT_MEASURES, trip_facts
from tripledger.session import shared_folder
from tripledger.spec import TripSpec


def hourly_facts(trips: DataFrame, spec: TripSpec, lateness: str = "2 days") -> DataFrame:
    """Facts per hour and class; hours close once the watermark has passed them.

    State is one row per open hour, period and class, whatever the number of trips.
    """
    ts = F.col(spec.start_ts)
    dow = C.iso_dow(ts)
    timed = trips.withColumns({
        "_event_time": ts.cast("timestamp"),
        spec.date: F.to_date(ts), spec.hour: F.hour(ts), spec.dow: dow,
        spec.day_type: C.day_type(dow),
    })
    facts = trip_facts(timed, spec, keep=["_event_time"])
    return (
        facts.withWatermark("_event_time", lateness)
        .groupBy(F.window("_event_time", "1 hour"), "month", "date", "dow", "day_type", "hour",
                 "member", "bike")
        .agg(*[F.sum(m).alias(m) for m in FACT_MEASURES])
        .drop("window")
    )


def run_to_latest(hourly: DataFrame, out: str, name: str) -> StreamingQuery:
    """Append everything available now to Parquet, with the checkpoint in the shared folder."""
    return (
        hourly.writeStream.outputMode("append").format("parquet")
        .option("path", out)
        .option("checkpointLocation", f"{shared_folder(hourly.sparkSession)}/streams/{name}")
        .trigger(availableNow=True).start()
    )
