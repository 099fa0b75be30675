from lexiquarry.streaming.events import windowed_counts

SF = "/root/testdata/sf0.001"


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").limit(500)
    events.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    q = windowed_counts(stream).writeStream.outputMode("complete").format("memory").queryName("counted").option("checkpointLocation", f"{tmp_path}/c").start()
    try:
        q.processAllAvailable()
        got = sorted((r.start, r.event_type, r.n) for r in spark.table("counted").collect())
    finally:
        q.stop()
    assert got == sorted((r.start, r.event_type, r.n) for r in windowed_counts(spark.read.parquet(f"{tmp_path}/in")).collect())
