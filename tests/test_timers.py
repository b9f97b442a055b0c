"""Pairing with timers: late, missing and repeated offs, and an emptied state."""

from pyspark.sql import functions as F

from tessitura.streaming import timers

SCHEMA = "piece_id long, pitch int, ts timestamp, seq long, d int"


def test_notes_pair_hang_and_leave_no_state(spark, tmp_path):
    batches = [
        [(1, 60, 0, 1, 1), (1, 60, 1, 2, 1), (1, 60, 5, 3, -1), (1, 61, 2, 4, 1), (1, 62, 3, 5, -1)],  # 62: an off without a note
        [(1, 60, 6, 3, -1), (1, 60, 7, 6, -1), (1, 63, 8, 7, 1)],  # the off 3 is repeated
        [(2, 50, 5000, 8, 1)],  # time goes on: 61 and 63 hang
        [(1, 61, 20, 9, -1), (2, 50, 5010, 10, -1)],  # the off of 61 comes after the watermark
        [(3, 40, 20000, 11, 1)], [(3, 40, 40000, 12, 1)], [(3, 41, 60000, 13, 1)],
    ]
    source, out = tmp_path / "in", f"{tmp_path}/out"
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "piece_id long, pitch int, s long, seq long, d int").select("piece_id", "pitch", F.timestamp_seconds(F.col("s") + 1000).alias("ts"), "seq", "d")
        df.coalesce(1).write.parquet(f"{source}/{k:02d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").option("latestFirst", "false").parquet(str(source))
    plan = timers.paired_or_closed(stream, 600_000, late="1 minute")
    with timers.rocks(spark):
        run = plan.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).format("parquet").start(out)
        run.awaitTermination(100)
    assert not run.isActive
    got = {(r.piece_id, r.pitch, r.start_seq): (r.end_seq, r.reason) for r in spark.read.parquet(out).collect()}
    assert got == {
        (1, 60, 1): (3, "paired"), (1, 60, 2): (6, "paired"), (1, 61, 4): (None, "hanging"), (1, 63, 7): (None, "hanging"), (2, 50, 8): (10, "paired"),
        (3, 40, 11): (None, "hanging"), (3, 40, 12): (None, "hanging"),
    }
