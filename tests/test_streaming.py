"""Streams give what batches give."""

from pyspark.sql import functions as F

from tracewell.operators import trace
from tracewell.streaming import replay, windows
from tests.test_functions import MACHINE

FOLDER = "/root/testdata/sf0.001/events.parquet"


def run(df, spark, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def test_replay_of_a_stream(spark, tmp_path):
    e = spark.read.parquet(FOLDER).select("event_id", "user_id", F.element_at(F.array(F.lit("login"), F.lit("buy"), F.lit("leave")), (F.col("event_id") % 3 + 1).cast("int")).alias("kind"), (F.col("event_id") % 2).cast("string").alias("user"))
    for i in range(3):  # later files hold later events
        e.where((F.col("event_id") >= i * 333) & (F.col("event_id") < (i + 1) * 333 + (i == 2))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    machine = MACHINE | {"visits": {"idle": 99, "in": 99}, "max_transitions": 50}
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = run(replay.replay(stream, "user_id", "event_id", "kind", ["user"], machine), spark, "replayed", "append", tmp_path)
    want = trace.replay(e, "user_id", "event_id", "kind", ["user"], machine)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert got.select("outcome").distinct().count() >= 3


def test_counts_in_windows(spark, tmp_path):
    e = spark.read.parquet(FOLDER)
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    got = run(windows.counted(stream, "ts", ["event_type"], "1 day", "2 days"), spark, "counted", "complete", tmp_path)
    want = e.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("start"), "event_type").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
