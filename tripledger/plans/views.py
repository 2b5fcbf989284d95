"""The named queries of dashboard and report over stored metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tripledger.operators import slices as S


def dashboard(tables: dict[str, DataFrame], period: int = 0, rider: str = "all") -> dict[str, DataFrame]:
    """Every panel for one setting of the period and rider filters."""
    cube, daily, kpi = tables["cube"], tables["daily"], tables["kpi"]
    stations, od, hist = tables["stations"], tables["od"], tables["dur_hist"]
    return {
        "cards": S.kpi_cards(cube, daily, kpi, period, rider),
        "monthly": S.monthly_stack(S.slice_cube(cube, period), rider),
        "daily": S.daily_split(daily, rider),
        "heat": S.week_heat(cube, period, rider),
        "hours": S.hour_curves(cube, period),
        "durations": S.bucket_by_rider(hist, period, rider),
        "hour_avg": S.hour_avg(cube, period, rider),
        "top_stations": S.top_stations(stations, 15, rider),
        "net_stations": S.net_extremes(stations, 6, rider),
        "map": S.station_map(stations, rider),
        "map_box": S.bbox(stations),
        "map_scale": S.net_scale(stations, rider),
        "corridors": S.top_corridors(od, 60, rider),
        "classes": S.class_structure(cube, period),
        "class_avg": S.avg_grid(cube, period),
        "insight": S.insight(kpi),
    }


def report(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables and numbers of the yearly report."""
    cube, stations, od = tables["cube"], tables["stations"], tables["od"]
    return {
        "numbers": S.narrative_numbers(cube, stations, od),
        "top_stations": S.top_stations(stations, 12),
        "net_stations": S.net_extremes(stations, 6),
        "corridors": S.top_corridors(od, 34),
        "electric_share": S.share_by_period(cube),
        "casual_share": S.share_by_daytype(tables["daily"]),
        "heat": S.week_heat(cube),
        "hours": S.hour_curves(cube),
        "durations": S.bucket_by_rider(tables["dur_hist"]),
        "classes": S.class_structure(cube),
        "class_avg": S.avg_grid(cube),
    }
