"""Completion on a stream: each key once, and out of the state."""

import time

import pytest
from inodeatlas.streaming.complete import complete_stream, state_store

SCHEMA = "kind string, name string, count long, size_min long, size_max long"


def write(spark, folder, number, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/{number}")
    time.sleep(0.02)  # files are taken by date


def start(spark, stream, expected, tmp_path, **options):
    told = complete_stream(stream, expected, ["kind", "name"], ("count",), ("size_min",), ("size_max",), **options)
    with state_store(spark):
        return told.writeStream.format("memory").queryName(f"told{abs(hash(str(tmp_path)))}").option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append")


def test_keys_leave_the_state(spark, tmp_path):
    inbox = tmp_path / "in"
    a, b, c = ("user", "a"), ("user", "b"), ("group", "c")
    write(spark, inbox, 0, [(*a, 1, 5, 5), (*b, 1, 7, 7), (*a, 1, 2, 9), (*c, 1, None, None), ("user", "unknown", 2, 0, 0)])
    write(spark, inbox, 1, [(*b, 2, 1, 8), (*c, 1, 4, 4)])
    write(spark, inbox, 2, [(*a, 1, 3, 3), ("user", "d", 1, 1, 1)])
    expected = spark.createDataFrame([(*a, 3), (*b, 3), (*c, 2), ("user", "d", 9)], "kind string, name string, count long")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(inbox))
    query = None
    with state_store(spark):
        query = start(spark, stream, expected, tmp_path).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.kind, r["name"]): (r["count"], r.size_min, r.size_max, r.expected, r.complete) for r in spark.table(query.name).collect()}
    assert got == {a: (3, 2, 9, 3, True), b: (3, 1, 8, 3, True), c: (2, 4, 4, 2, True), ("user", "unknown"): (2, 0, 0, None, False)}
    assert spark.table(query.name).count() == 4
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert held == [3, 1, 1]  # a, b, c wait; b and c are complete; then a, and d waits
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "none").endswith("RocksDBStateStoreProvider") is False


@pytest.mark.parametrize("timeout", [500])
def test_keys_are_given_up(spark, tmp_path, timeout):
    inbox = tmp_path / "in"
    write(spark, inbox, 0, [("user", "a", 1, 5, 6)])
    expected = spark.createDataFrame([("user", "a", 3)], "kind string, name string, count long")
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(inbox))
    with state_store(spark):
        query = start(spark, stream, expected, tmp_path, timeout_ms=timeout).trigger(processingTime="200 milliseconds").start()
    try:
        until = time.monotonic() + 60
        while time.monotonic() < until and not spark.table(query.name).count():
            time.sleep(0.3)
        assert [tuple(r) for r in spark.table(query.name).collect()] == [("user", "a", 1, 5, 6, 3, False)]
    finally:
        query.stop()


def test_keys_share_a_row_of_state(spark, tmp_path):
    inbox = tmp_path / "in"
    big = 2**60 + 1  # beyond what a float holds
    write(spark, inbox, 0, [("user", "a", 1, big, None), ("user", "b", 1, None, big), ("user", None, 1, 4, 4)])
    write(spark, inbox, 1, [("user", "a", 1, None, None), ("user", "b", 1, 3, None), ("user", "c", 1, 0, 0)])
    expected = spark.createDataFrame([("user", "a", 2), ("user", "b", 3), ("user", "c", 2)], "kind string, name string, count long")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(inbox))
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    with state_store(spark):
        query = start(spark, stream, expected, tmp_path, buckets=1).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r["name"], r["count"], r.size_min, r.size_max, r.expected, r.complete) for r in spark.table(query.name).collect()}
    assert got == {(None, 1, 4, 4, None, False), ("a", 2, big, None, 2, True)}
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert held == [1, 1]  # a and b, then b and c, in one bucket
    assert spark.conf.get("spark.sql.shuffle.partitions") == partitions
