import csv
import datetime as dt
import io
import json
import pathlib
import re

import pytest
from pyspark.sql import functions as F

from tests.helpers import SPEC, one, raw_row, raw_trips, rows, trips
from tripledger.operators import cleaning, metrics as M
from tripledger.plans import stages, views
from tripledger.session import shared_folder
from tripledger.sources import adapters, landing, tables
from tripledger.spec import RAW_TRIP_SCHEMA, DateWindow

HEADER = ",".join(f'"{c}"' for c in RAW_TRIP_SCHEMA.fieldNames())
LINE = '"r{0}","electric_bike","2025-01-0{1} 10:00:00","2025-01-0{1} 10:10:00","S","A","T","B",41.0,-87.0,,,"member"'


def land(root: pathlib.Path, month: int, text: str, year: int = 2025):
    folder = root / f"year={year}" / f"month={month:02d}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "trips.csv").write_text(text, encoding="utf-8")


def test_csv_scan_types_partitions_bom_and_quotes(spark, tmp_path):
    land(tmp_path, 1, "﻿" + HEADER + "\n" + LINE.format(1, 1) + "\n")
    land(tmp_path, 2, HEADER + "\n" + LINE.format(2, 2) + "\n" + LINE.format(3, 3) + "\n")
    df = landing.read_trips_csv(spark, str(tmp_path))
    got = rows(df, "ride_id")
    assert set(got) == {"r1", "r2", "r3"} and got["r1"]["month"] == 1 and got["r3"]["year"] == 2025
    assert got["r1"]["start_lat"] == 41.0 and got["r1"]["end_lat"] is None
    assert dict(df.dtypes)["month"] == "int"
    assert df.where("month = 2").count() == 2


def test_reordered_header_fails(spark, tmp_path):
    swapped = HEADER.replace('"ride_id","rideable_type"', '"rideable_type","ride_id"')
    land(tmp_path, 1, swapped + "\n" + LINE.format(1, 1) + "\n")
    with pytest.raises(Exception, match="header does not conform"):
        landing.read_trips_csv(spark, str(tmp_path)).collect()


def test_landing_audit(spark, tmp_path):
    land(tmp_path, 1, "﻿" + HEADER + "\n" + LINE.format(1, 1) + "\n")
    land(tmp_path, 2, HEADER.replace(',"member_casual"', "") + "\n" + LINE.format(2, 2) + "\n" * 1)
    land(tmp_path, 3, HEADER + "\r\n" + "".join(LINE.format(i, 3) + "\r\n" for i in range(5)))
    got = {r["file"].split("month=")[1][:2]: r for r in
           landing.landing_audit(spark, str(tmp_path)).collect()}
    assert (got["01"]["n_rows"], got["01"]["ok"]) == (1, True)
    assert (list(got["02"]["missing"]), got["02"]["ok"]) == (["member_casual"], False)
    assert (got["03"]["n_rows"], got["03"]["ok"]) == (5, True)


def test_landing_audit_of_a_file_read_in_many_splits(spark, tmp_path):
    land(tmp_path, 1, HEADER + "\n" + "".join(LINE.format(i, 1) + "\n" for i in range(2000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        got = one(landing.landing_audit(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert (got["n_rows"], got["ok"]) == (2000, True)


NOTES = (
    'id,note\n' + '1,plain\n2,"one\ntwo"\n3,"say ""hi""\n\n""bye"""\n\n' + '4,"a\r\nb"\r\n5,"\n"\n' * 40 + '6,x\n',
    'id,note\n', 'id,note\n1,"left\nopen\n', '', 'id,note\n"1\n",2\n' * 1 + '"\n\n","\n"\n' * 60,
)


@pytest.mark.parametrize("split", [1, 7, 64, 1 << 20])
def test_landing_audit_counts_records_across_splits(spark, tmp_path, split):
    """Line breaks in quotes, doubled quotes, blank lines, an open quote at the end, an empty file."""
    for i, text in enumerate(NOTES):
        (tmp_path / f"n {i}.csv").write_bytes(text.encode())
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in zip(names, (max(split, 40), 0, 1)):
            spark.conf.set(n, str(v))
        got = {r["file"][-5]: r for r in landing.landing_audit(spark, str(tmp_path), ["id", "note"]).collect()}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v) if v is not None else spark.conf.unset(n)
    assert len(got) == len(NOTES)
    for i, text in enumerate(NOTES):
        want = list(csv.reader(io.StringIO(text, newline="")))
        assert got[str(i)]["n_rows"] == max(len(want) - 1, 0)
        assert got[str(i)]["ok"] == bool(want)
    assert list(got["3"]["missing"]) == ["id", "note"]


def test_metric_order_is_kept_in_every_format(spark, tmp_path):
    df = spark.range(3000).selectExpr("id", "cast(id * 7919 % 3000 as int) AS k", "repeat('x', cast(id % 50 as int)) AS pad")
    tables.write_metric(df.repartition(8), str(tmp_path), "m", order=[F.desc("k")])
    for fmt in ("parquet", "json", "csv"):
        got = tables.read_ordered(spark, str(tmp_path), "m", fmt)
        assert got.where(F.col("position") != 3000 - F.col("k")).count() == 0 and got.count() == 3000
        assert set(got.columns) == {"id", "k", "pad", "position"}
    assert tables.read_metric(spark, str(tmp_path), "m").columns == ["id", "k", "pad"]
    lines = [line for part in sorted((tmp_path / "m.csv").glob("part-*.csv"))
             for line in part.read_text().splitlines()[1:]]
    assert [int(line.split(",")[1]) for line in lines] == list(range(2999, -1, -1))


def test_clean_stage_end_to_end(spark, tmp_path):
    land(tmp_path / "ods", 1, HEADER + "\n" + LINE.format(1, 1) + "\n" + LINE.format(1, 1) + "\n"
         + LINE.format(2, 2).replace("10:10:00", "10:00:00") + "\n")
    land(tmp_path / "ods", 2, HEADER + "\n" + LINE.format(3, 2) + "\n")
    out = str(tmp_path / "dwd")
    report = one(stages.clean_stage(spark, str(tmp_path / "ods"), out, 2025))
    assert (report["n_raw"], report["n_clean"], report["dropped_bad_duration"]) == (4, 2, 1)
    assert report["n_duplicate_rides"] == 1 and report["drop_rate_pct"] == 50.0
    back = tables.read_trips(spark, out)
    assert back.count() == 2 and set(back.columns) == set(SPEC.clean_columns())
    plan = back.where(F.col("month").isin(1, 7))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [month" in plan.replace("isnotnull(month", "month")


def test_clean_stage_reads_once_and_counts_all_classes(spark, tmp_path, monkeypatch):
    """The audit comes from the write: ids of bad rows alone, mixed ids, empty ids; a pass of its own only where it must."""
    bad_time = LINE.format(5, 1).replace("10:10:00", "soon")
    land(tmp_path / "ods", 1, "\n".join([HEADER, LINE.format(1, 1), LINE.format(1, 1), LINE.format(1, 1).replace("10:10:00", "10:00:00"),
                                         bad_time, LINE.format(6, 1).replace("member", "alien"), LINE.format("", 1)]) + "\n")
    raw = landing.read_trips_csv(spark, str(tmp_path / "ods")).where("year = 2025")
    want, own = one(cleaning.quality_audit(raw, SPEC)), cleaning.quality_audit
    asked = []
    monkeypatch.setattr(cleaning, "quality_audit", lambda *a: asked.append(1) or own(*a))
    out = str(tmp_path / "dwd")
    report = one(stages.clean_stage(spark, str(tmp_path / "ods"), out, 2025))
    assert not asked and {k: report[k] for k in want if k in report} == {k: v for k, v in want.items() if k in report}
    assert by_columns(tables.read_trips(spark, out)) == by_columns(cleaning.clean(raw, SPEC))
    nothing = one(stages.clean_stage(spark, str(tmp_path / "ods"), str(tmp_path / "none"), 1999))
    assert (nothing["n_raw"], nothing["n_clean"]) == (0, 0)
    # counts that disagree with the rows written are not believed
    asked.clear()
    monkeypatch.setattr(tables, "write_trips", lambda *a, **k: 0 if write(*a, **k) else 1)
    again = one(stages.clean_stage(spark, str(tmp_path / "ods"), out, 2025))
    assert asked and again == report


write = tables.write_trips


def by_columns(df):
    return sorted((tuple(str(r[c]) for c in sorted(df.columns)) for r in df.collect()))


def test_write_counts_overwrites_and_keeps_untouched_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    jan = [("2025-01-02 08:00:00", 5, "member", "classic_bike", "A", "B")] * 3
    feb = [("2025-02-02 08:00:00", 5, "member", "classic_bike", "A", "B")] * 2
    assert tables.write_trips(trips(spark, jan + feb), path, ["month"], count=True) == 5
    tables.write_trips(trips(spark, feb[:1]), path, ["month"], replace_touched_only=True)
    assert rows(spark.read.parquet(path).groupBy("month").count(), "month")[1]["count"] == 3
    tables.write_trips(trips(spark, feb), path, ["month"], rebalance=False)
    assert spark.read.parquet(path).count() == 2


def test_missing_layers_and_fallback(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        tables.read_trips(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        tables.read_metric(spark, str(tmp_path), "cube")
    sample = str(tmp_path / "sample")
    tables.write_sample(spark.range(5).toDF("x"), sample, files=1)
    assert len(list((tmp_path / "sample").glob("part-*.parquet"))) == 1
    assert tables.read_trips(spark, str(tmp_path / "none"), fallback=sample).count() == 5


def test_sample_by_key_is_stable_and_near_the_fraction(spark):
    df = spark.range(20_000).select(
        F.col("id").cast("string").alias("ride_id"), (F.col("id") % 3 + 1).cast("int").alias("month"))
    a = tables.sample_trips(df, SPEC, [1, 2], 0.1, 42, by_key=True)
    b = tables.sample_trips(df.repartition(9), SPEC, [1, 2], 0.1, 42, by_key=True)
    assert {r[0] for r in a.collect()} == {r[0] for r in b.collect()}
    assert abs(a.count() / 13_333 - 0.1) < 0.015 and a.where("month = 3").count() == 0
    assert abs(tables.sample_trips(df, SPEC, [1, 2]).count() / 13_333 - 0.1) < 0.015


def test_metric_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.5), (2, None, None)], "n long, s string, v double")
    tables.write_metric(df, str(tmp_path), "m")
    for fmt in ("parquet", "json", "csv"):
        assert rows(tables.read_metric(spark, str(tmp_path), "m", fmt), "n") == rows(df, "n")


def metric_trips(spark):
    data = []
    for i in range(120):
        data.append((f"2025-0{1 + i % 2}-{1 + i % 27:02d} {i % 24:02d}:30:00", 1 + i % 50,
                     "member" if i % 3 else "casual", "electric_bike" if i % 2 else "classic_bike",
                     "ABC"[i % 3], "AB"[i % 2] if i % 5 else None))
    return trips(spark, data)


def test_metric_stage_and_views(spark, tmp_path):
    df = metric_trips(spark)
    stages.metric_stage(df, str(tmp_path), min_n=3)
    stored = stages.read_metrics(spark, str(tmp_path))
    assert set(stored) == set(stages.METRIC_TABLES)
    assert rows(stored["cube"], "month", "dow", "hour", "member", "bike") == \
        rows(M.fact_cube(df, SPEC), "month", "dow", "hour", "member", "bike")
    assert one(stored["kpi"]) == one(M.kpi(df, SPEC))
    assert stored["od"].count() > 0
    for period, rider in ((0, "all"), (1, "member"), (2, "casual")):
        for name, frame in views.dashboard(stored, period, rider).items():
            assert frame.count() > 0, name
    for name, frame in views.report(stored).items():
        assert frame.count() > 0, name


def test_experiment_stage_writes_the_record_and_the_decision(spark, tmp_path):
    data = []
    for unit in range(14):
        for month in (6, 7, 8):
            for day in range(1, 6):
                for k in range(3 + (unit + day) % 4 + unit // 3):
                    data.append((f"2025-0{month}-{day:02d} {k:02d}:00:00", 5 + (unit * k + day) % 17,
                                 "member" if (unit + k) % 3 else "casual",
                                 "electric_bike" if k % 2 else "classic_bike",
                                 f"u{unit}", "x" if (k + day + unit) % 3 else None))
    plan = stages.ExperimentPlan(
        DateWindow("pre1", "2025-06-01", "2025-06-30"), DateWindow("pre2", "2025-07-01", "2025-07-30"),
        DateWindow("post", "2025-08-01", "2025-08-30"), min_n=5, iterations=40, gap_iterations=20,
        subsample=500)
    stages.experiment_stage(trips(spark, data), str(tmp_path), plan)
    doc = one(spark.read.json(str(tmp_path / "ab_tests.json")))
    assert doc["data_scope"]["n_rides"] == len(data)
    assert doc["ab_design"]["srm"]["n_treat"] == doc["ab_design"]["srm"]["n_control"] == 7
    assert doc["tests"]["daytype_hour"]["dof"] > 0
    assert doc["ab_design"]["power"]["n_per_arm"] == 2
    decision = spark.read.option("header", True).csv(str(tmp_path / "ab_decision.csv"))
    assert decision.count() == 4


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def order_tables(spark):
    """Keys repeat and are null in every table; order 1 is there twice, nation 7 under two names."""
    day = dt.datetime
    lineitem = spark.createDataFrame(
        [(1, 1, 10, "O", day(2024, 1, 5)), (1, 1, 10, "F", day(2024, 1, 9)), (1, None, 10, "F", day(2024, 1, 9)),
         (2, 1, None, "F", day(2024, 2, 9)), (None, 1, 10, "O", day(2024, 1, 5)), (9, 1, 10, "O", day(2024, 1, 5)),
         (2, 2, 11, "O", day(2024, 2, 20))],
        "l_orderkey long, l_linenumber int, l_suppkey long, l_linestatus string, l_shipdate timestamp_ntz")
    orders = spark.createDataFrame(
        [(1, 100, day(2024, 1, 2), "1-URGENT"), (1, 101, day(2024, 1, 1), "5-LOW"), (2, None, day(2024, 2, 1), "2-HIGH"),
         (None, 100, day(2024, 1, 1), "1-URGENT")],
        "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_orderpriority string")
    supplier = spark.createDataFrame(
        [(10, 7, 1.5), (10, None, 2.5), (None, 7, 3.5)], "s_suppkey long, s_nationkey int, s_acctbal double")
    customer = spark.createDataFrame(
        [(100, 8, 10.0, "BUILDING"), (101, 7, 11.0, "MACHINERY"), (101, 8, 12.0, "BUILDING"), (None, 8, 13.0, "BUILDING")],
        "c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")
    nation = spark.createDataFrame([(7, "B"), (7, "A"), (8, "C"), (None, "N")], "n_nationkey int, n_name string")
    return lineitem, orders, supplier, customer, nation


def test_clean_orders_are_dealt_once_by_order(spark, tmp_path):
    """Grouping by trip id alone gives the same rows; with the order they stay where the join put them."""
    raw = adapters.trips_from_orders(*order_tables(spark))
    # line 1 of order 1 twice, each with 2 orders: urgent with 1 customer, low with 2; suppliers 10 with nation 7 (2 names) and none
    assert raw.where("order_key = 1 AND trip_key = '1-1' AND supply_name IS NULL").count() == 2 * (1 + 3)
    assert raw.where("order_key IS NULL OR order_key = 9").count() == 2 * 3
    plain = cleaning.clean(raw, adapters.ORDER_SPEC)
    dealt = cleaning.clean(raw, adapters.ORDER_SPEC, within="order_key")
    assert {r["trip_key"] for r in dealt.collect()} == {"1", "1-1", "2-1", "2-2"}
    assert by_columns(dealt) == by_columns(plain)
    for name, df in zip(("lineitem", "orders", "supplier", "customer", "nation"), order_tables(spark)):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    stored = cleaning.clean(adapters.raw_order_trips(spark, str(tmp_path)), adapters.ORDER_SPEC, within="order_key")
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert by_columns(stored) == by_columns(plain)
    assert re.findall(r"hashpartitioning\((\w+)", plan) == ["l_orderkey", "o_orderkey"]
