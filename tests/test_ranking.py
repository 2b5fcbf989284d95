import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.helpers import one, rows
from tripledger.operators import ranking as K


def values(seed, n, spread):
    rng = random.Random(seed)
    return [(i, rng.choice("xyz"), round(rng.expovariate(1 / spread), 2)) for i in range(n)]


@pytest.mark.parametrize("n, spread", [(1, 5), (2, 5), (700, 3), (700, 300), (90, 1)])
def test_quantiles_match_numpy(spark, n, spread):
    data = values(n, n, spread)
    df = spark.createDataFrame(data, "id int, g string, v double")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.77, "e": 1.0}
    got = rows(K.quantiles(df, "v", probs, ["g"]), "g")
    for g in {row[1] for row in data}:
        own = [row[2] for row in data if row[1] == g]
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.percentile(own, 100 * p), abs=1e-9)


def test_quantiles_of_a_million_different_doubles(spark):
    """Every value differs, many by the last bit alone; two scans, and no order over the values."""
    df = spark.range(1_000_000, numPartitions=8).select(
        F.when(F.col("id") % 2 == 0, F.lit(1.0) + F.col("id") * F.lit(2.0 ** -52)).otherwise(
            F.xxhash64("id") / F.lit(2.0 ** 40)).alias("v"))
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.7501, "e": 0.99, "f": 1.0}
    values = np.array([r[0] for r in df.collect()])
    assert len(set(values)) == 1_000_000
    got = one(K.quantiles(df, "v", probs))
    ordered = np.sort(values)
    for name, p in probs.items():
        at = (len(values) - 1) * p
        below, above = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
        assert got[name] == below + (at - np.floor(at)) * (above - below)


@pytest.mark.parametrize("values", [
    [0.0, -0.0, 0.0], [-5.0, -1e-300, 0.0, 5e-324, 1e300], [float("inf"), 1.0, 2.0], [-3.0, -2.0, -1.0, -2.0], [7.0] * 9])
def test_quantiles_at_the_ends_of_the_axis(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = one(K.quantiles(df, "v", {"lo": 0.0, "hi": 1.0}))
    assert (got["lo"], got["hi"]) == (min(values), max(values))
    median = sorted(values)[len(values) // 2]
    assert len(values) % 2 == 0 or one(K.median_by(df, "v"))["median"] == median


def test_quantiles_read_their_source_twice_and_order_cells_only(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.range(5000).selectExpr("id * 1.0D as v", "id % 3 as g").write.parquet(path)
    for by in ([], ["g"]):
        q = K.quantiles(spark.read.parquet(path), "v", {"m": 0.5}, by)
        assert q.count() == (3 if by else 1)
        q.collect()
        plan = q._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        assert plan.count("FileScan") <= 2 * (1 + plan.count("Subquery subquery"))


def test_quantiles_with_null_values_and_null_groups(spark):
    df = spark.createDataFrame(
        [(None, 1.0), (None, 3.0), ("a", None), ("a", 5.0)], "g string, v double")
    got = rows(K.median_by(df, "v", ["g"]), "g")
    assert got[None]["median"] == 2.0 and got["a"]["median"] == 5.0


@pytest.mark.parametrize("bucket_rows, fan", [(50_000, 1024), (20, 1024), (5, 8)])
def test_running_totals_match_brute_force(spark, monkeypatch, bucket_rows, fan):
    """No split, one level, and two levels."""
    monkeypatch.setattr(K, "FAN", fan)
    data = values(5, 500, 50)
    df = spark.createDataFrame(data, "id int, g string, v double")
    counts = K.value_counts(df, "v", ["g"])
    got = rows(K.prefix_sums(counts, ["v"], "n_value", ["g"], bucket_rows=bucket_rows), "g", "v")
    freq = Counter((g, v) for _, g, v in data)
    for (g, v), n in freq.items():
        assert got[g, v]["n_value"] == n
        assert got[g, v]["before"] == sum(1 for _, h, w in data if h == g and w < v)
        assert got[g, v]["total"] == sum(1 for _, h, _ in data if h == g)


def test_row_numbers_over_two_columns(spark):
    data = [(i, random.Random(i).randint(0, 9) / 2) for i in range(300)]
    df = spark.createDataFrame(data, "id int, v double").repartition(5)
    got = rows(K.row_numbers(df, ["v", "id"], bucket_rows=10), "id")
    for rank, (i, _) in enumerate(sorted(data, key=lambda t: (t[1], t[0])), start=1):
        assert got[i]["rn"] == rank and got[i]["total"] == 300


def test_hot_value_leaves_small_buckets(spark):
    """A value that holds most rows is one row once counted; buckets stay balanced."""
    df = spark.range(20_000).select(
        F.when(F.col("id") % 3 > 0, 7.0).otherwise(F.col("id").cast("double")).alias("v"))
    counts = K.value_counts(df, "v").withColumn("_w", F.col("n_value"))
    n = counts.count()
    sizes = K.split_buckets(counts, ["v"], [], n, n // 64).groupBy("_b").count()
    assert sizes.agg(F.max("count")).first()[0] < n / 20
    assert one(K.median_by(df, "v"))["median"] == 7.0


@pytest.mark.parametrize("fan", [1024, 16])
def test_a_narrow_group_is_cut_as_finely_as_a_wide_one(spark, monkeypatch, fan):
    """Buckets follow the rows of a group, not its range; with a small fan they come in two levels."""
    monkeypatch.setattr(K, "FAN", fan)
    wide = spark.range(20_000).select(F.lit("wide").alias("g"), (F.xxhash64("id") / 1e6).alias("v"))
    narrow = spark.range(20_000).select(F.lit("narrow").alias("g"), (F.lit(7.0) + F.col("id") * 1e-13).alias("v"))
    few = spark.range(5).select(F.lit("few").alias("g"), F.col("id").cast("double").alias("v"))
    df = wide.unionByName(narrow).unionByName(few).withColumn("_w", F.lit(1))
    got = K.split_buckets(df, ["v"], ["g"], 40_005, 200).groupBy("g", "_b").agg(
        F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("g", "_b").collect()
    for g in ("wide", "narrow"):
        mine = [r for r in got if r["g"] == g]
        assert 90 <= len(mine) <= 256 and max(r["n"] for r in mine) < 500
        assert all(a["hi"] < b["lo"] for a, b in zip(mine, mine[1:]))
    assert [r["n"] for r in got if r["g"] == "few"] == [5]


def test_one_scan_feeds_all_branches(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.range(1000).selectExpr("id % 37 * 1.0 as v").write.parquet(path)
    counts = K.value_counts(spark.read.parquet(path), "v")
    q = K.quantiles_of_counts(counts, "v", {"median": 0.5}, bucket_rows=10)
    q.collect()
    final = q._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in final


def test_arg_extreme_breaks_ties_by_the_smallest(spark):
    df = spark.createDataFrame([("b", 3, 1), ("a", 3, 2), ("c", 1, 3), ("d", None, 4)], "k string, n int, x int")
    assert one(K.arg_extreme(df, "n", "k")) == {"k": "a", "n": 3, "x": 2}
    assert one(K.arg_extreme(df, "n", "k", "min"))["k"] == "c"
