"""Event time across files, late events, and targets that are compacted and replayed."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from lanegrid.operators import labels
from lanegrid.streaming import learning
from lanegrid.streaming.target import Target

SCHEMA = "type string, raw string, canonical string, kind string, ts timestamp, seq long"


def land(spark, path, parts):
    for part in parts:
        spark.createDataFrame(part, "type string, raw string, canonical string, kind string, ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are taken in the order of their times


def run(spark, root, late):
    events = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/events")
    query = learning.write_states(events, f"{root}/states", f"{root}/checkpoint", late)
    query.awaitTermination()
    return query


def state(rows):
    return sorted((tuple(r) for r in rows.collect()), key=repr)


def batch(spark, rows):
    return state(labels.fold_events(spark.createDataFrame(rows, "type string, raw string, canonical string, kind string, ts string, seq long")))


def test_out_of_order_across_files(spark, tmp_path):
    """Events dealt over files at random give the batch state; what the watermark has passed is settled; a too late one is counted."""
    rng = random.Random(2)
    kinds = ["confirm", "passive", "wrong", "taught"]
    rows = [("charge", f"r{i % 3}", "m", rng.choice(kinds), f"2024-01-{1 + i // 4:02d} {i % 4 * 6:02d}:00:00", i) for i in range(60)]
    mixed = rows[:48]
    rng.shuffle(mixed)
    land(spark, f"{tmp_path}/events", [mixed[:16], mixed[16:32], mixed[32:]])
    assert learning.late_events(run(spark, tmp_path, "12 days")) == 0
    assert state(learning.last_states(spark, f"{tmp_path}/states")) == batch(spark, rows[:48])
    later = [("charge", "end", "m", "confirm", "2024-06-01 00:00:00", 900)]
    land(spark, f"{tmp_path}/events", [rows[48:], later])
    run(spark, tmp_path, "12 days")
    settled = [r for r in state(learning.last_states(spark, f"{tmp_path}/states", settled=True))]
    assert settled == batch(spark, rows)
    land(spark, f"{tmp_path}/events", [[("charge", "r0", "m", "taught", "2024-01-01 00:00:00", 901)]])
    assert learning.late_events(run(spark, tmp_path, "12 days")) == 1
    assert state(learning.last_states(spark, f"{tmp_path}/states")) == batch(spark, rows + later)


def numbers(spark, *values):
    return spark.createDataFrame([(v % 3, v) for v in values], "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))


@pytest.fixture
def target(spark, tmp_path):
    return Target(spark, f"{tmp_path}/t", lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n")), every=3)


def test_target_is_compacted(spark, target):
    """Reading takes a base and a few batches, however many there were; replays and unfinished folders change nothing."""
    for i in range(11):
        target.put(numbers(spark, i, i + 1), i)
    base, batches = target.parts()
    assert base == 8 and batches == [9, 10] and len(os.listdir(target.path)) <= 8
    expected = {k: sum(v for i in range(11) for v in (i, i + 1) if v % 3 == k) for k in range(3)}
    assert {r["k"]: r["n"] for r in target.read().collect()} == expected
    for again in (10, 4):
        target.put(numbers(spark, again, again + 1), again)
    numbers(spark, 7).write.parquet(f"{target.path}/batch=11")
    os.remove(f"{target.path}/batch=11/_SUCCESS")
    assert {r["k"]: r["n"] for r in target.read().collect()} == expected


def test_empty_target(spark, target):
    with pytest.raises(FileNotFoundError):
        target.read()
