"""Event-time timers over several runs of a stream."""

import datetime


from factloom.streaming import timers

T0 = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def _put(spark, folder, rows):
    at = lambda s: T0 + datetime.timedelta(seconds=s)
    spark.createDataFrame([(k, at(s), r) for k, s, r in rows], "key string, at timestamp, rests boolean").coalesce(1).write.mode("append").parquet(folder)


def _run(spark, tmp_path, make):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", timers.ROCKS)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = make(spark.readStream.schema("key string, at timestamp, rests boolean").parquet(str(tmp_path / "in")))
        stream.writeStream.option("checkpointLocation", str(tmp_path / "progress")).format("parquet").trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    start = int(T0.timestamp() * 1000)
    return sorted((r["key"], (r["since"] - start) // 1000, (r["due"] - start) // 1000) for r in spark.read.parquet(str(tmp_path / "out")).collect())


def test_a_beat_cancels_the_timer(spark, tmp_path):
    folder, make = str(tmp_path / "in"), lambda s: timers.stale(s, 300)
    _put(spark, folder, [("a", 0, False), ("b", 0, False), ("c", 10, True)])
    assert _run(spark, tmp_path, make) == []
    _put(spark, folder, [("b", 250, False), ("d", 299, False)])
    assert _run(spark, tmp_path, make) == []
    # time passes 300 for a, whose last beat was at 0; b's timer was moved to 550; c had retired
    _put(spark, folder, [("d", 500, False)])
    _run(spark, tmp_path, make)
    _put(spark, folder, [("d", 540, False)])
    assert _run(spark, tmp_path, make) == [("a", 0, 300)]
    # a beats again and goes stale again; b does at 550
    _put(spark, folder, [("a", 560, False), ("d", 600, False)])
    _run(spark, tmp_path, make)
    _put(spark, folder, [("d", 900, True)])
    _run(spark, tmp_path, make)
    _put(spark, folder, [("e", 901, True)])
    assert _run(spark, tmp_path, make) == [("a", 0, 300), ("a", 560, 860), ("b", 250, 550)]


def test_rechecks_come_after_an_hour_and_not_without_a_commit(spark, tmp_path):
    folder, make = str(tmp_path / "in"), timers.rechecks
    _put(spark, folder, [("x", 0, False), ("y", 0, True), ("z", 0, False), ("z", 100, True)])
    _run(spark, tmp_path, make)
    _put(spark, folder, [("w", 4000, True)])
    _run(spark, tmp_path, make)
    _put(spark, folder, [("w", 4001, True)])
    assert _run(spark, tmp_path, make) == [("x", 0, 3600)]
