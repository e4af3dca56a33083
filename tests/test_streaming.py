"""A stream of files into a series, and windowed sums."""

from lending import filled

from marlstone.streaming.ingest import ingest, windowed


def test_ingest(spark, tmp_path):
    ses = filled(spark, tmp_path / "store", segment_points=2)
    src = tmp_path / "src"
    late = []
    schema = "member int, ts bigint, value double"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{src}")
        q = ingest(ses, "Member", "visits", spark.readStream.schema(schema).parquet(f"file://{src}"), f"file://{tmp_path}/ckpt", lambda df: late.extend(df.collect()))
        assert q.awaitTermination(120) and q.exception() is None

    def held(k):
        return [tuple(r) for r in ses["Member"].series("visits", k).collect()]

    run([(100, 70, 2.0), (100, 60, 1.0), (104, 5, 0.5)])
    ses.flush()
    run([(100, 66, 9.0), (100, 70, 3.0), (100, 80, 4.0)])
    want = [(60, 1.0), (70, 2.0), (70, 3.0), (80, 4.0)]
    assert held(100) == want and [tuple(r) for r in late] == [(100, 66, 9.0)]
    # a batch whose append succeeded but whose end wasn't noted comes again, and isn't appended twice
    (tmp_path / "ckpt/commits/1").unlink()
    (tmp_path / "ckpt/commits/.1.crc").unlink(missing_ok=True)
    run([(104, 6, 1.5)])
    assert held(100) == want and held(104) == [(5, 0.5), (6, 1.5)] and len(late) == 1


def test_windowed(spark, tmp_path):
    import datetime

    rows = [("a", datetime.datetime(2024, 1, 1, 0, m), float(m)) for m in range(30)]
    spark.createDataFrame(rows, "key string, ts timestamp, value double").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("key string, ts timestamp, value double").parquet(f"file://{tmp_path}/in")
    q = windowed(stream, "ts", "5 minutes", "10 minutes", keys=("key",)).writeStream.format("memory").queryName("sums").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert sorted((r.start.minute, r.n, r.total, r.least, r.greatest) for r in spark.sql("select * from sums").collect()) == [(m, 10, sum(range(m, m + 10)), m, m + 9) for m in (0, 10, 20)]
