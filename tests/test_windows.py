"""Hand-written packet cases for flow state and window rows."""
import pytest
from pyspark.sql import functions as F

COLS = ("source string, chunk_id long, packet_no long, ts_us long, is_arp int, proto int, "
        "ttl int, sip string, sport int, dip string, dport int, tcp_flags int, frame_len long")


def pk(spark, rows):
    return spark.createDataFrame(rows, COLS)


def tcp(n, ts, src=("10.0.0.1", 1000), dst=("10.0.0.2", 80), size=100, chunk=0, flags=0x10,
        proto=6, source="c"):
    return (source, chunk, n, ts, 0, proto, 64, src[0], src[1], dst[0], dst[1], flags, size)


def windows(spark, rows, **kw):
    from netlens.operators.windows import windows_from_packets
    return {(r["chunk_id"], r["window_id"]): r.asDict()
            for r in windows_from_packets(pk(spark, rows), **kw).collect()}


def flow_rows(spark, rows):
    from netlens.operators.windows import packet_rows
    return {r["packet_no"]: r.asDict() for r in packet_rows(pk(spark, rows)).collect()}


def test_partial_last_window_and_equal_sizes(spark):
    rows = [tcp(i, 1_000_000 * i) for i in range(1, 26)]
    w = windows(spark, rows)
    assert sorted(w) == [(0, 0), (0, 1), (0, 2)]
    assert [w[(0, i)]["number"] for i in range(3)] == [10, 10, 5]
    assert [w[(0, i)]["weight"] for i in range(3)] == [100, 100, 25]
    for r in w.values():
        assert r["std"] == 0 and r["variance"] == 0 and r["covariance"] == 0
        assert r["magnitue"] == pytest.approx((2 * 100) ** 0.5)
        assert r["tot_sum"] == 100 * r["number"]


def test_alternating_directions(spark):
    a, b = ("10.0.0.1", 1000), ("10.0.0.2", 80)
    rows = [tcp(i, 1_000_000 * i, *((a, b) if i % 2 else (b, a))) for i in range(1, 5)]
    f = flow_rows(spark, rows)
    assert [(f[i]["fwd_n"], f[i]["bwd_n"]) for i in range(1, 5)] == [(1, 0), (1, 1), (2, 1), (2, 2)]
    assert f[4]["drate"] == pytest.approx(2 / 3.0)
    assert f[4]["rate"] == pytest.approx(4 / 3.0)
    assert f[3]["cum_bytes"] == 300
    assert [f[i]["iat_ns"] for i in range(1, 5)] == [0, 1_000_000_000, 1_000_000_000, 1_000_000_000]


def test_flow_key_ignores_protocol(spark):
    rows = [tcp(1, 0), tcp(2, 2_000_000, proto=17, flags=0)]
    f = flow_rows(spark, rows)
    assert f[2]["fwd_n"] == 2 and f[2]["dur_us"] == 2_000_000


def test_same_timestamp_gives_zero_rate(spark):
    f = flow_rows(spark, [tcp(1, 5), tcp(2, 5)])
    assert f[2]["rate"] == 0 and f[2]["iat_ns"] == 0 and f[2]["flow_duration"] == 0


def test_protocol_tie_takes_smallest(spark):
    rows = [tcp(i, i, proto=6 if i <= 5 else 17, flags=0,
                dst=("10.0.0.2", 80 if i <= 5 else 53)) for i in range(1, 11)]
    w = windows(spark, rows)
    assert w[(0, 0)]["protocol_type"] == 6
    assert w[(0, 0)]["tcp"] == 0.5 and w[(0, 0)]["udp"] == 0.5


def test_chunk_boundary_restarts_flow(spark):
    rows = [tcp(i, 1_000_000 * i, chunk=0 if i <= 3 else 1) for i in range(1, 7)]
    w = windows(spark, rows)
    assert w[(0, 0)]["number"] == 3 and w[(1, 0)]["number"] == 3
    f = flow_rows(spark, rows)
    assert f[4]["dur_us"] == 0 and f[4]["fwd_n"] == 1


def test_negative_duration(spark):
    f = flow_rows(spark, [tcp(1, 10_000_000), tcp(2, 7_000_000)])
    assert f[2]["dur_us"] == -3_000_000 and f[2]["rate"] == 0
    assert f[2]["iat_ns"] == -3_000_000_000


def test_arp_only(spark):
    rows = [("c", 0, i, i, 1, 0, 0, "arp:aa", 0, "arp:bb", 0, 0, 60) for i in range(1, 4)]
    w = windows(spark, rows)[(0, 0)]
    assert (w["protocol_type"], w["ipv"], w["llc"], w["arp"]) == (0, 0, 1, 1)


def test_flags_and_app_ports(spark):
    rows = [tcp(1, 0, flags=0x02), tcp(2, 1, flags=0x12), tcp(3, 2, flags=0x3F)]
    w = windows(spark, rows)[(0, 0)]
    assert w["syn_count"] == 3 and w["ack_count"] == 2 and w["urg_count"] == 1
    assert w["fin_flag_number"] == pytest.approx(1 / 3) and w["http"] == 1


def test_windows_partition_packets_exactly(spark):
    from netlens.plans.queries import fixture_packets, fixture_windows
    sf = "/root/testdata/sf0.001"
    n = fixture_packets(spark, sf).count()
    w = fixture_windows(spark, sf)
    agg = w.agg(F.sum("number"), F.max("number")).first()
    assert agg[0] == n and agg[1] <= 10


def test_chunk_prefix_sum_is_block_independent(spark):
    from netlens.operators.flows import with_chunk
    from netlens.plans.queries import fixture_packets
    p = fixture_packets(spark, "/root/testdata/sf0.001")
    a = {(r[0], r[1]): r[2] for r in with_chunk(p, 20_000).select("source", "packet_no", "chunk_id").collect()}
    b = {(r[0], r[1]): r[2] for r in with_chunk(p, 20_000, block_rows=97)
         .select("source", "packet_no", "chunk_id").collect()}
    assert a == b and max(a.values()) >= 1
