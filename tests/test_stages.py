"""The stream of stages: order, retries, timers, and a start from the checkpoint."""

import datetime

from docketspark.streaming.stages import staged

T = datetime.datetime(2024, 1, 1, 12)


def at(hours):
    return T + datetime.timedelta(hours=hours)


def test_a_stream_that_starts_again_goes_on(spark, tmp_path):
    schema = "document_id long, stage int, ts timestamp, event_id long"
    source, out = str(tmp_path / "in"), []

    def run(*rows):
        spark.createDataFrame(list(rows), schema).coalesce(1).write.mode("append").parquet(source)

        def keep(batch, number):
            out.extend((number, *r) for r in batch.collect())

        stream = staged(spark.readStream.schema(schema).parquet(source), last=3)
        stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        last = {}
        for number, doc, *rest in sorted(out, key=lambda r: r[0]):
            last[doc] = tuple(rest)
        return last

    first = run((1, 1, at(0), 1), (1, 0, at(1), 2), (2, 3, at(1), 3), (3, 0, at(0), 4), (3, 0, at(0), 5), (3, 0, at(1), 6), (4, 2, at(1), 7), (None, 1, at(1), 8))
    assert first == {1: (1, 1, 2, "retrying"), 2: (3, 0, 1, "ready"), 3: (0, 3, 3, "failed"), 4: (2, 0, 1, "processing")}
    # retries succeed and fail; an older event changes no failures, and one behind the watermark is dropped; time goes on
    second = run((1, 2, at(2), 9), (3, 1, at(2), 10), (3, 0, at(3), 11), (2, 0, at(0.5), 12), (2, 0, at(-1), 15), (5, 1, at(20), 13))
    assert second[1] == (2, 0, 3, "stalled") and second[3] == (1, 1, 5, "stalled") and second[2] == (3, 0, 2, "ready") and second[4] == (2, 0, 1, "stalled") and second[5] == (1, 0, 1, "processing")
    third = run((4, 3, at(21), 14))
    assert third[4] == (3, 0, 2, "ready") and third[5] == (1, 0, 1, "processing")
