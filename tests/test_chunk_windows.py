"""Count windows over a chunk that lands in several files equal the batch result (ST5)."""
import time

import pytest
from pyspark.sql import functions as F

from netlens.functions.decode import decode_frames
from netlens.operators.windows import packet_rows, window_summary
from netlens.sources.pcap import PCAP_SCHEMA, read_packets
from netlens.streaming.chunk_windows import start_once, stream_packet_rows
from netlens.streaming.streams import run_piecewise_scoring, score_batch, stream_packets
from tests.test_pcap import FRAMES, write_pcap


@pytest.fixture(autouse=True)
def few_partitions(spark):
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", was)


@pytest.fixture()
def records(spark, tmp_path):
    (tmp_path / "caps").mkdir()
    write_pcap(f"{tmp_path}/caps/a.pcap", FRAMES * 12)
    write_pcap(f"{tmp_path}/caps/b.pcap", FRAMES[::-1] * 7)
    rows = sorted(read_packets(spark, f"{tmp_path}/caps", chunk_bytes=1500).collect(), key=lambda r: (r["packet_no"], r["source"]))
    assert len({(r["source"], r["chunk_id"]) for r in rows}) > 4
    return rows


def land(spark, rows, path):
    spark.createDataFrame(rows, PCAP_SCHEMA).coalesce(1).write.mode("append").parquet(path)


WAKE = ("wake", 0, 1, 1, 0, bytearray(FRAMES[0]))       # one packet of another capture: a batch to close idle chunks in


def test_pieces_equal_the_batch(spark, records, tmp_path):
    """Cut at odd packets, one run (and restart) a piece; every packet leaves once, in whole windows."""
    landed, ck, got = f"{tmp_path}/landed", f"{tmp_path}/ck", []

    def run(idle):
        def each(batch, _):
            rows = batch.collect()
            got.extend(rows)
        start_once(stream_packet_rows(decode_frames(stream_packets(spark, landed, None)), idle=idle).writeStream
                   .foreachBatch(each).option("checkpointLocation", ck)).awaitTermination()

    cuts = [0, 1, 24, 37, 90, len(records)]
    for lo, hi in zip(cuts, cuts[1:]):
        land(spark, records[lo:hi], landed)
        run(600 if hi < len(records) else 1)
    full = {}
    for r in got:
        full.setdefault((r["source"], r["chunk_id"], r["window_id"]), []).append(r["packet_no"])
    assert full and all(len(v) == 10 for v in full.values())    # only whole windows so far
    time.sleep(1.5)
    for i in (1, 2):                                            # chunks of the last piece have the short timer
        land(spark, [(f"wake{i}", *WAKE[1:])], landed)
        run(600)
    touched = {(r["source"], r["chunk_id"]) for r in records[cuts[-2]:]}
    want = packet_rows(decode_frames(spark.createDataFrame(records, PCAP_SCHEMA)))
    cols = ["source", "chunk_id", "packet_no", "window_id", "dur_us", "iat_ns", "cum_bytes", "is_fwd", "fwd_n", "bwd_n", "rate", "srate", "drate"]
    want = {tuple(r[c] for c in cols) for r in want.select(cols).collect()}
    have = [tuple(r[c] for c in cols) for r in got if not r["source"].startswith("wake")]
    assert len(set(have)) == len(have) and set(have) <= want
    assert {r for r in want if (r[0], r[1]) in touched} <= set(have)        # closed chunks are complete
    assert all(r[3] == max(w[3] for w in want if w[:2] == r[:2]) for r in want - set(have))   # the rest: open windows


def test_scores_equal_the_batch(spark, records, tmp_path):
    landed, sink = f"{tmp_path}/landed", f"{tmp_path}/scored"

    def score(eng):
        return eng.withColumns({"is_anomaly": F.col("udp") > 0, "attack_type": F.lit("DDoS-UDP_Flood")})

    whole = [r for r in records if r["kept_no"] is not None]
    n = {}
    for r in whole:
        n[r["source"], r["chunk_id"]] = max(n.get((r["source"], r["chunk_id"]), 0), r["kept_no"])
    for part in (records[:50], records[50:]):
        land(spark, part, landed)
        run_piecewise_scoring(spark, landed, sink, f"{tmp_path}/ck", score).awaitTermination()
    key = ["source", "chunk_id", "window_id", "label"]
    got = sorted(map(tuple, spark.read.parquet(sink).select(key).collect()))
    want = score_batch(spark.createDataFrame(records, PCAP_SCHEMA), score).select(key).collect()
    assert got == sorted(tuple(r) for r in want if (r["window_id"] + 1) * 10 <= n[r["source"], r["chunk_id"]]) != []


def test_a_piece_out_of_order_is_refused(spark, records, tmp_path):
    landed = f"{tmp_path}/landed"

    def run():
        rows = stream_packet_rows(decode_frames(stream_packets(spark, landed, None)))
        start_once(rows.writeStream.foreachBatch(lambda b, _: b.count()).option("checkpointLocation", f"{tmp_path}/ck")).awaitTermination()

    own = [r for r in records if r["source"] == "a.pcap" and r["chunk_id"] == 0]
    land(spark, own[3:], landed)
    run()
    land(spark, own[:3], landed)
    with pytest.raises(Exception, match="lands after"):
        run()
