from tests.helpers import SPEC, rows, trips
from tripledger.operators import metrics as M
from tripledger.streaming.live_cube import hourly_facts, run_to_latest

KEYS = ("month", "dow", "hour", "member", "bike")


def test_stream_adds_up_to_the_batch_cube(spark, tmp_path):
    data = [(f"2025-01-{1 + i % 9:02d} {i % 24:02d}:10:00", 1 + i % 40, "member" if i % 3 else "casual",
             "electric_bike" if i % 2 else "classic_bike", "A", "B" if i % 4 else None) for i in range(200)]
    landed = str(tmp_path / "landed")
    batch = trips(spark, data)
    batch.repartition(3).write.parquet(landed)
    # a much later trip moves the watermark past all others and stays open itself
    trips(spark, [("2025-03-01 00:00:00", 5, "member", "classic_bike", "A", "B", 1)]) \
        .write.mode("append").parquet(landed)
    out = str(tmp_path / "hourly")
    for run in range(2):                      # the second run finds nothing new
        stream = spark.readStream.schema(batch.schema).parquet(landed)
        q = run_to_latest(hourly_facts(stream, SPEC), out, f"cube-{tmp_path.name}")
        q.awaitTermination(120)
        assert q.exception() is None
    hourly = spark.read.parquet(out)
    assert rows(M.fact_cube(hourly, SPEC), *KEYS) == rows(M.fact_cube(batch, SPEC), *KEYS)
