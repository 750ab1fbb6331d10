"""Streams give the batch results (ST1-ST6, S8-S10)."""
from pyspark.sql import functions as F


def test_event_stream_equals_batch(spark, tmp_dir):
    from netlens.operators.alerts import events_to_alerts, parse_events
    from netlens.plans.queries import table
    from netlens.sources.derived import alert_json_lines
    from netlens.streaming.streams import stream_event_alerts, write_alert_stream
    lines = alert_json_lines(table(spark, "/root/testdata/sf0.001", "events"))
    # two rotated log files
    lines.filter("line_no % 2 = 0").select("value").write.text(f"{tmp_dir}/log/a")
    lines.filter("line_no % 2 = 1").select("value").write.text(f"{tmp_dir}/log/b")
    q = write_alert_stream(stream_event_alerts(spark, f"{tmp_dir}/log/*"), f"{tmp_dir}/out",
                           f"{tmp_dir}/ckpt", trigger={"availableNow": True})
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_dir}/out").drop("ingest_ts")
    want = events_to_alerts(parse_events(lines))
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # a second run over the same files adds nothing (checkpointed)
    q = write_alert_stream(stream_event_alerts(spark, f"{tmp_dir}/log/*"), f"{tmp_dir}/out",
                           f"{tmp_dir}/ckpt", trigger={"availableNow": True})
    q.awaitTermination()
    assert spark.read.parquet(f"{tmp_dir}/out").count() == want.count()


def test_capture_scoring_stream(spark, tmp_dir):
    from tests.test_pcap import FRAMES, write_pcap
    from netlens.sources.pcap import read_packets
    from netlens.streaming.streams import run_capture_scoring, score_batch
    write_pcap(f"{tmp_dir}/cap1.pcap", FRAMES * 4)
    write_pcap(f"{tmp_dir}/cap2.pcap", FRAMES * 2)
    for name in ("cap1.pcap", "cap2.pcap"):
        read_packets(spark, f"{tmp_dir}/{name}").write.mode("append").parquet(f"{tmp_dir}/landed")

    def score(eng):
        return eng.withColumns({"is_anomaly": F.col("syn_count") > 0,
                                "attack_type": F.lit("DDoS-SYN_Flood")})

    q = run_capture_scoring(spark, f"{tmp_dir}/landed", f"{tmp_dir}/scored", f"{tmp_dir}/ck", score)
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_dir}/scored").select("source", "chunk_id", "window_id", "label")
    want = score_batch(read_packets(spark, tmp_dir), score) \
        .select("source", "chunk_id", "window_id", "label")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0


def test_stream_timeline(spark, tmp_dir):
    from netlens.streaming.streams import stream_timeline
    rows = [("2026-01-01 00:00:01", "A"), ("2026-01-01 00:00:05", "A"), ("2026-01-01 00:00:12", "B")]
    spark.createDataFrame(rows, "ts string, label string") \
        .select(F.to_timestamp("ts").alias("ts"), "label").write.parquet(f"{tmp_dir}/al")
    s = spark.readStream.schema("ts timestamp, label string").parquet(f"{tmp_dir}/al")
    q = (stream_timeline(s).writeStream.outputMode("update").format("memory")
         .queryName("tl_test").start())
    q.processAllAvailable()
    q.stop()
    got = {(str(r["bin"]["start"]), r["label"]): r["alerts"] for r in spark.table("tl_test").collect()}
    assert got == {("2026-01-01 00:00:00", "A"): 2, ("2026-01-01 00:00:10", "B"): 1}


def test_capture_folder_stream(spark, tmp_dir):
    """Closed captures are read once each; the newest waits for a newer one (S9, ST1)."""
    from tests.test_pcap import FRAMES, write_pcap
    from netlens.sources.pcap import stream_captures
    import os
    os.makedirs(f"{tmp_dir}/caps")
    for name in ("a.pcap", "b.pcap", "c.pcap"):
        write_pcap(f"{tmp_dir}/caps/{name}", FRAMES)

    def run():
        q = (stream_captures(spark, f"{tmp_dir}/caps", f"{tmp_dir}/met").writeStream.format("parquet")
             .option("path", f"{tmp_dir}/out").option("checkpointLocation", f"{tmp_dir}/ck")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return {r["source"]: r["count"] for r in
                spark.read.parquet(f"{tmp_dir}/out").groupBy("source").count().collect()}

    assert run() == {"a.pcap": 7, "b.pcap": 7}                 # c.pcap is the newest
    write_pcap(f"{tmp_dir}/caps/d.pcap", FRAMES)
    assert run() == {"a.pcap": 7, "b.pcap": 7, "c.pcap": 7}   # each closed file once


def test_late_capture_with_an_old_time_stamp(spark, tmp_dir):
    """A file that lands after newer ones were read is read as well, once."""
    from tests.test_pcap import FRAMES, write_pcap
    from netlens.sources.pcap import stream_captures
    import os
    os.makedirs(f"{tmp_dir}/caps")

    def land(name, at):
        write_pcap(f"{tmp_dir}/caps/{name}", FRAMES)
        os.utime(f"{tmp_dir}/caps/{name}", (at, at))

    def run():
        q = (stream_captures(spark, f"{tmp_dir}/caps", f"{tmp_dir}/met").writeStream.format("parquet")
             .option("path", f"{tmp_dir}/out").option("checkpointLocation", f"{tmp_dir}/ck")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return {r["source"]: r["count"] for r in
                spark.read.parquet(f"{tmp_dir}/out").groupBy("source").count().collect()}

    land("m.pcap", 2_000)
    land("z.pcap", 3_000)
    assert run() == {"m.pcap": 7}
    land("late.pcap", 1_000)                                   # older than the last one read
    land("a.pcap", 2_000)                                      # equal time, smaller path
    want = {"m.pcap": 7, "late.pcap": 7, "a.pcap": 7}
    assert run() == want and run() == want


def test_capture_scoring_from_capture_files(spark, tmp_dir):
    """Scoring straight from a capture folder equals the batch result for closed files."""
    from tests.test_pcap import FRAMES, write_pcap
    from netlens.sources.pcap import read_packets
    from netlens.streaming.streams import run_capture_scoring, score_batch
    import os
    os.makedirs(f"{tmp_dir}/caps")
    for i, name in enumerate(("a.pcap", "b.pcap", "z.pcap")):
        write_pcap(f"{tmp_dir}/caps/{name}", FRAMES * (i + 2))

    def score(eng):
        return eng.withColumns({"is_anomaly": F.col("udp") > 0, "attack_type": F.lit("DDoS-UDP_Flood")})

    q = run_capture_scoring(spark, f"{tmp_dir}/caps", f"{tmp_dir}/scored", f"{tmp_dir}/ck", score,
                            captures=True)
    q.awaitTermination()
    got = spark.read.parquet(f"{tmp_dir}/scored").select("source", "chunk_id", "window_id", "label")
    closed = read_packets(spark, f"{tmp_dir}/caps").filter(F.col("source") != "z.pcap")
    want = score_batch(closed, score).select("source", "chunk_id", "window_id", "label")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_capture_log_of_two_streams_and_its_snapshots(spark, tmp_dir):
    """Streams with logs of their own each get every file once; a claimed entry is never overwritten."""
    import os

    from netlens.sources.pcap import PcapStreamReader
    from netlens.sources.fs import publish
    from tests.test_pcap import FRAMES, write_pcap
    os.makedirs(f"{tmp_dir}/caps")

    def stream(log):
        r = PcapStreamReader({"path": f"{tmp_dir}/caps", "logPath": f"{tmp_dir}/{log}", "skipNewest": "false"})
        r.COMPACT = 4
        return r

    def batch(r, start):
        end = r.latestOffset()
        return [os.path.basename(p.path) for p in r.partitions(start, end)], end

    a, b, at_a, at_b, got = stream("a"), stream("b"), {"batch": 0}, {"batch": 0}, {"a": [], "b": []}
    for i in range(10):
        write_pcap(f"{tmp_dir}/caps/c{i}.pcap", FRAMES)
        files, at_a = batch(a, at_a)
        got["a"] += files
        if i % 3 == 0:
            files, at_b = batch(b, at_b)
            got["b"] += files
    names = [f"c{i}.pcap" for i in range(10)]
    assert got["a"] == names and sorted(got["b"]) == names
    assert at_a == {"batch": 10} and os.path.exists(f"{tmp_dir}/a/snapshot-000000000008.json")
    again = stream("a")                               # a restart reads the snapshot and the entries after it
    for n in range(1, 5):
        os.remove(f"{tmp_dir}/a/entry-{n:012d}.json")
    assert again.latestOffset() == at_a and batch(again, at_a)[0] == []
    assert [os.path.basename(p.path) for p in again.partitions({"batch": 6}, at_a)] == names[6:]
    # two readers of one log: the entry of the first stays, both go on from it
    one, two = stream("shared"), stream("shared")
    two._load()
    first = one.latestOffset()
    os.remove(f"{tmp_dir}/caps/c0.pcap")
    assert two.latestOffset() == first
    assert [p.path for p in one.partitions({"batch": 0}, first)] == [p.path for p in two.partitions({"batch": 0}, first)]
    assert publish(f"{tmp_dir}/x", b"1") and not publish(f"{tmp_dir}/x", b"2") and open(f"{tmp_dir}/x").read() == "1"
    assert os.listdir(tmp_dir).count("x") == 1 and not [f for f in os.listdir(tmp_dir) if f.endswith(".part")]
