"""Sliding windows behind tumbling ones, over several runs of a stream."""

import datetime as dt

from pulsegrid.streaming import metrics

T0 = dt.datetime(2024, 1, 1)


def test_rejected_requests_count_once_in_every_window(spark, tmp_path):
    folder, out, cp = (str(tmp_path / n) for n in ("decisions", "out", "cp"))
    schema = "event_id long, client_id string, ts timestamp, allowed boolean"
    rows = [(k, [None, "a", ""][k % 3], T0 + dt.timedelta(seconds=7 * k), k % 4 == 0) for k in range(400)]
    for part in (rows[:150], rows[120:300], rows[300:]):  # thirty decisions are written twice
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        hits = metrics.limited_hits_stream(stream, watermark="2 minutes")
        metrics.start_append_stream(hits, out, cp, available_now=True).awaitTermination()
    got = {(r["window_start"], r["client_id"]): r["hits"] for r in spark.read.parquet(out).collect()}
    rejected = [r for r in rows if not r[3]]
    closed = max(r[2] for r in rejected) - dt.timedelta(minutes=2)
    want = {}
    for minute in range(-4, 60):
        start = T0 + dt.timedelta(minutes=minute)
        end = start + dt.timedelta(minutes=5)
        for _, client, ts, _ in rejected:
            if start <= ts < end <= closed:
                want[start, client] = want.get((start, client), 0) + 1
    assert got == want and len(want) > 50
    assert spark.read.parquet(out).count() == len(want)
