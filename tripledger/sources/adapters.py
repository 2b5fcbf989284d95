"""Trips derived from tables that hold other kinds of events.

Both adapters are relational: a projection, or joins on keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripledger.functions import columns as C
from tripledger.spec import TripSpec

EVENT_SPEC = TripSpec(
    trip_id="event_id", start_ts="ts", duration="value",
    rider="rider_class", vehicle="vehicle_class",
    origin="origin", destination="destination", period="period",
)

ORDER_SPEC = TripSpec(
    trip_id="trip_key", start_ts="ordered_ts", end_ts="shipped_ts", duration="days_open",
    rider="priority_class", vehicle="status_class",
    origin="supply_id", origin_name="supply_name", origin_x="supply_x", origin_y="supply_y",
    destination="demand_id", destination_name="demand_name", dest_x="demand_x", dest_y="demand_y",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def trips_from_events(events: DataFrame) -> DataFrame:
    """One trip per event, by projection only.

    The origin is the key in ``props``; the destination is that key moved on by the
    whole part of ``value`` on a ring of 100, and missing for every third step.
    The period is the third of the month the event falls in.
    """
    key = F.get_json_object("props", "$.k").cast("int")
    steps = F.floor("value")
    dow = C.iso_dow(F.col("ts"))
    return events.select(
        "event_id", "ts", "value", "user_id",
        F.when(F.col("user_id") % 5 < 3, "member").otherwise("casual").alias("rider_class"),
        F.when(F.col("event_type").isin("click", "view", "purchase"), "electric_bike")
        .otherwise("classic_bike").alias("vehicle_class"),
        key.cast("string").alias("origin"),
        F.when(steps % 3 != 0, ((key + steps) % 100).cast("string")).alias("destination"),
        F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / 10) + 1).cast("int").alias("period"),
        F.to_date("ts").alias("date"), F.hour("ts").alias("hour"),
        dow.alias("dow"), C.day_type(dow).alias("day_type"),
    )


def trips_from_orders(
    lineitem: DataFrame, orders: DataFrame, supplier: DataFrame, customer: DataFrame,
    nation: DataFrame,
) -> DataFrame:
    """One raw trip per order line, from order to shipment, in days.

    Keys repeat, durations can be negative and the class can be missing, so the
    result needs cleaning. A line without a partner stays and is counted by the audit. Stations are nations; machinery orders have no
    destination. Joins carry no hints: adaptive execution broadcasts the lookup
    tables while they are small and splits skewed shuffle partitions otherwise.

    Lines meet suppliers while they are narrow, and orders meet customers before they meet the lines. So the join by
    order is the last one that deals rows anew, whatever is broadcast, and ``order_key`` states how they are dealt. Names of nations
    come after it and are not shuffled; a join estimated in front of it would also keep suppliers from being broadcast.
    """
    def nation_as(prefix: str) -> DataFrame:
        return nation.select(
            F.col("n_nationkey").alias(f"{prefix}_nation"), F.col("n_name").alias(f"{prefix}_name"))

    supply = supplier.select("s_suppkey", F.col("s_nationkey").alias("supply_nation"), "s_acctbal")
    demand = customer.select("c_custkey", F.col("c_nationkey").alias("demand_nation"), "c_acctbal", "c_mktsegment")

    days = F.datediff("l_shipdate", "o_orderdate").cast("double")
    has_end = F.col("c_mktsegment") != "MACHINERY"
    priority = F.substring("o_orderpriority", 1, 1)
    lines = lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_linestatus", "l_shipdate").join(
        supply, F.col("l_suppkey") == F.col("s_suppkey"), "left")
    placed = orders.select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority").join(
        demand, F.col("o_custkey") == F.col("c_custkey"), "left")
    return (
        lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"), "left")
        .join(nation_as("supply"), "supply_nation", "left").join(nation_as("demand"), "demand_nation", "left")
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("trip_key"), F.col("l_orderkey").alias("order_key"),
            F.when(F.col("l_linestatus") == "O", "electric_bike")
            .when(F.col("l_linestatus") == "F", "classic_bike").alias("status_class"),
            F.when(priority.isin("1", "2", "3"), "member")
            .when(priority == "5", "casual").alias("priority_class"),
            F.col("o_orderdate").alias("ordered_ts"), F.col("l_shipdate").alias("shipped_ts"),
            days.alias("days_open"),
            F.month("o_orderdate").alias("month"), F.year("o_orderdate").alias("year"),
            F.col("supply_nation").cast("string").alias("supply_id"), "supply_name",
            F.col("c_acctbal").alias("supply_y"), F.col("s_acctbal").alias("supply_x"),
            F.when(has_end, F.col("demand_nation").cast("string")).alias("demand_id"),
            F.when(has_end, F.col("demand_name")).alias("demand_name"),
            F.when(has_end, F.col("s_acctbal")).alias("demand_y"),
            F.when(has_end, F.col("c_acctbal")).alias("demand_x"),
        )
    )


def event_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trips_from_events(table(spark, sf_dir, "events"))


def raw_order_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("lineitem", "orders", "supplier", "customer", "nation")
    return trips_from_orders(*[table(spark, sf_dir, n) for n in names])
