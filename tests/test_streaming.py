import datetime as dt
import random

from edgewright.functions.scalars import Baseline
from edgewright.operators.monitor import edge_monitor
from edgewright.streaming.live import live_monitor, ordered_monitor


def test_stream_agrees_with_batch(spark, tmp_path):
    base = Baseline(0.5, 1.0, 100)
    rows = [("a", i, -1.0 if i % 3 else 0.4) for i in range(60)] + [("b", i, 0.6) for i in range(60)]
    df = spark.createDataFrame(rows, "book string, trade_seq long, r double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = live_monitor(stream, base).writeStream.outputMode("update").format("memory").queryName("live").start()
    q.processAllAvailable()
    q.stop()
    live = {r.book: (r.n, round(r.cusum, 9), round(r.peak, 9), r.label) for r in spark.table("live").collect()}
    batch = {r.book: (r.n, round(r.cusum, 9), round(r.peak, 9), r.label) for r in edge_monitor(df, base, by=["book"]).collect()}
    assert live == batch


def test_shuffled_and_repeated_batches_give_the_batch_verdict(spark, tmp_path):
    base = Baseline(0.5, 1.0, 100)
    day = lambda i: dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
    rng = random.Random(3)
    rows = [(b, 7 * i % 101, day(i), (-1.0 if i % 3 else 0.4) if b == "a" else 0.6) for b in "ab" for i in range(100)]
    schema = "book string, trade_seq long, exit_date timestamp, r double"
    order = sorted(rows, key=lambda r: (r[2], rng.random()))
    parts = [order[i : i + 50] for i in range(0, 200, 50)]
    for part in parts:  # within its reach everything is out of order, and some of it comes twice
        part += rng.sample(part, 10)
        rng.shuffle(part)
    parts.append(rng.sample(rows[:60], 5))  # repeats of what has long been counted
    parts.append([("clock", 0, dt.datetime(2025, 1, 1), 0.0)])
    source = tmp_path / "in"
    source.mkdir()
    stream = spark.readStream.schema(schema).parquet(str(source))
    q = None
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(source))
        if q is None:
            q = ordered_monitor(stream, base, delay="2 days").writeStream.outputMode("update").format("memory").queryName("ordered").start()
        q.processAllAvailable()
    q.stop()
    live = {}
    for r in spark.table("ordered").collect():
        if r.book not in live or r.n >= live[r.book].n:
            live[r.book] = r
    df = spark.createDataFrame([(b, i, r) for b in "ab" for i, (_, _, _, r) in enumerate(sorted((x for x in rows if x[0] == b), key=lambda x: x[2]))], "book string, trade_seq long, r double")
    for r in edge_monitor(df, base, by=["book"]).collect():
        assert (live[r.book].n, round(live[r.book].cusum, 9), round(live[r.book].peak, 9), live[r.book].label) == (r.n, round(r.cusum, 9), round(r.peak, 9), r.label)
