"""Capture source and byte-level decode (S5, P1-P3, P8, W2 exact form)."""
import struct

from pyspark.sql import functions as F


def eth_ipv4(src, dst, proto, payload, ttl=64, frag=0):
    ip = struct.pack("!BBHHHBBH4s4s", 0x45, 0, 20 + len(payload), 1, frag, ttl, proto, 0,
                     bytes(src), bytes(dst))
    return b"\x00\x11\x22\x33\x44\x55" + b"\x66\x77\x88\x99\xaa\xbb" + b"\x08\x00" + ip + payload


def tcp_seg(sport, dport, flags):
    return struct.pack("!HHIIBBHHH", sport, dport, 0, 0, 0x50, flags, 1024, 0, 0)


def udp_seg(sport, dport):
    return struct.pack("!HHHH", sport, dport, 8, 0)


def arp_frame():
    return b"\xff" * 6 + b"\x66\x77\x88\x99\xaa\xbb" + b"\x08\x06" + b"\x00" * 28


def ipv6_frame():
    return b"\x00" * 12 + b"\x86\xdd" + b"\x00" * 40


def write_pcap(path, frames, truncate_last=False):
    with open(path, "wb") as fh:
        fh.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1))
        for i, f in enumerate(frames):
            fh.write(struct.pack("<IIII", 1_700_000_000 + i, 250, len(f), len(f)))
            fh.write(f[: len(f) // 2] if truncate_last and i == len(frames) - 1 else f)


def write_pcapng(path, frames):
    def block(t, body):
        pad = (-len(body)) % 4
        ln = 12 + len(body) + pad
        return struct.pack("<II", t, ln) + body + b"\x00" * pad + struct.pack("<I", ln)
    with open(path, "wb") as fh:
        fh.write(block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)))
        fh.write(block(1, struct.pack("<HHI", 1, 0, 65535)))
        for i, f in enumerate(frames):
            ts = (1_700_000_000 + i) * 1_000_000
            fh.write(block(6, struct.pack("<IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(f), len(f)) + f))


FRAMES = [
    eth_ipv4([10, 0, 0, 1], [10, 0, 0, 2], 6, tcp_seg(40001, 80, 0x12)),
    eth_ipv4([10, 0, 0, 2], [10, 0, 0, 1], 6, tcp_seg(80, 40001, 0x10)),
    eth_ipv4([10, 0, 0, 3], [8, 8, 8, 8], 17, udp_seg(5353, 53)),
    ipv6_frame(),
    arp_frame(),
    eth_ipv4([10, 0, 0, 4], [10, 0, 0, 5], 6, b"", frag=100),      # non-first fragment
    eth_ipv4([10, 0, 0, 6], [10, 0, 0, 7], 1, b"\x08\x00\x00\x00"),
]


def test_decode_pcap(spark, tmp_dir):
    from netlens.sources.pcap import decoded_packets
    write_pcap(f"{tmp_dir}/a.pcap", FRAMES)
    rows = {r["packet_no"]: r.asDict() for r in decoded_packets(spark, tmp_dir).collect()}
    assert len(rows) == 7
    r1 = rows[1]
    assert (r1["sip"], r1["sport"], r1["dip"], r1["dport"], r1["proto"], r1["tcp_flags"], r1["ttl"]) \
        == ("10.0.0.1", 40001, "10.0.0.2", 80, 6, 0x12, 64)
    assert rows[1]["ts_us"] == 1_700_000_000_000_250
    assert (rows[3]["proto"], rows[3]["dport"]) == (17, 53)
    assert rows[4]["keep"] == 0                     # IPv6 dropped from windows
    assert rows[5]["is_arp"] == 1 and rows[5]["sip"] == "arp:66:77:88:99:aa:bb"
    assert rows[6]["sport"] == 0 and rows[6]["dport"] == 0       # fragment: no L4 header
    assert rows[6]["has_l4"] == 0 and rows[1]["has_l4"] == 1 and rows[3]["has_l4"] == 1
    assert rows[7]["proto"] == 1


def test_transport_counts_only_with_its_header(spark, tmp_dir):
    """Fragments, IP options and cut headers: the protocol number alone is not TCP or UDP."""
    from netlens.functions.decode import packet_features
    from netlens.sources.pcap import decoded_packets
    tcp, udp = tcp_seg(40001, 80, 0x12), udp_seg(5353, 53)
    options = bytearray(eth_ipv4([1, 1, 1, 1], [2, 2, 2, 2], 6, b"\x01\x01\x01\x00" + tcp))
    options[14] = 0x46                                     # a header of six words
    low = bytearray(eth_ipv4([1, 1, 1, 1], [2, 2, 2, 2], 6, tcp))
    low[34 + 12] = 0x40                                    # data offset below a whole header
    write_pcap(f"{tmp_dir}/f.pcap", [
        eth_ipv4([1, 1, 1, 1], [2, 2, 2, 2], 17, udp, frag=100), eth_ipv4([1, 1, 1, 1], [2, 2, 2, 2], 17, udp),
        bytes(options), eth_ipv4([1, 1, 1, 1], [2, 2, 2, 2], 6, tcp[:19]), bytes(low),
        eth_ipv4([1, 1, 1, 1], [2, 2, 2, 2], 17, udp[:7])])
    rows = sorted(packet_features(decoded_packets(spark, tmp_dir)).collect(), key=lambda r: r["packet_no"])
    assert [(r["tcp"], r["udp"], r["dport"], r["dns"]) for r in rows] == [
        (0, 0, 0, 0), (0, 1, 53, 1), (1, 0, 80, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert [r["protocol_type"] for r in rows] == [17, 17, 6, 6, 6, 17]


def test_pcapng_and_truncation(spark, tmp_dir):
    from netlens.sources.pcap import read_packets
    write_pcapng(f"{tmp_dir}/b.pcapng", FRAMES[:3])
    write_pcap(f"{tmp_dir}/c.pcap", FRAMES[:3], truncate_last=True)
    got = read_packets(spark, tmp_dir).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"b.pcapng": 3, "c.pcap": 2}
    ts = read_packets(spark, f"{tmp_dir}/b.pcapng").agg(F.min("ts_us")).first()[0]
    assert ts == 1_700_000_000_000_000


def test_chunk_counter_and_max_packets(spark, tmp_dir):
    from netlens.sources.pcap import read_packets
    f = FRAMES[0]                                    # 54 bytes each
    write_pcap(f"{tmp_dir}/d.pcap", [f] * 7)
    rows = read_packets(spark, tmp_dir, chunk_bytes=120).orderBy("packet_no").collect()
    # 54, 108 -> chunk 0; 162 >= 120 opens chunk 1 and resets to 0; then 54, 108; 162 -> 2 ...
    assert [r["chunk_id"] for r in rows] == [0, 0, 1, 1, 1, 2, 2]
    assert read_packets(spark, tmp_dir, max_packets=4).count() == 4


def test_pcap_to_windows(spark, tmp_dir):
    from netlens.operators.windows import windows_from_packets
    from netlens.sources.pcap import decoded_packets
    write_pcap(f"{tmp_dir}/e.pcap", FRAMES * 3)
    w = windows_from_packets(decoded_packets(spark, tmp_dir))
    agg = w.agg(F.sum("number"), F.count("*")).first()
    assert agg[0] == 18 and agg[1] == 2               # 6 kept frames x 3 -> windows of 10 and 8


def test_capture_uri(spark, tmp_dir):
    """Captures are listed and read through pyarrow.fs, so URIs work like paths."""
    from netlens.sources.pcap import read_packets
    write_pcap(f"{tmp_dir}/u.pcap", FRAMES)
    got = read_packets(spark, f"file://{tmp_dir}").select("source").distinct().collect()
    assert [r[0] for r in got] == ["u.pcap"]
    assert read_packets(spark, f"file:{tmp_dir}/u.pcap").count() == 7


def mixed_captures(folder):
    """Captures of both kinds and byte orders, with several sections and interfaces, and cut ends."""
    import random
    rng = random.Random(11)
    frames = [rng.choice(FRAMES) + b"x" * rng.choice([0, 0, 7, 300]) for _ in range(400)] + [b"", b"short", FRAMES[4][:20]]
    write_pcap(f"{folder}/little.pcap", frames)
    write_pcap(f"{folder}/cut.pcap", frames[:90], truncate_last=True)
    with open(f"{folder}/big.cap", "wb") as fh:
        fh.write(struct.pack(">IHHiIII", 0xA1B23C4D, 2, 4, 0, 0, 65535, 1))
        for i, f in enumerate(frames):
            fh.write(struct.pack(">IIII", 1_700_000_000 + i, 999_123_456, len(f), len(f)) + f)

    def block(order, kind, body):
        pad = -len(body) % 4
        total = struct.pack(order + "I", 12 + len(body) + pad)
        return struct.pack(order + "I", kind) + total + body + b"\x00" * pad + total

    with open(f"{folder}/sections.pcapng", "wb") as fh:
        for order in ("<", ">"):
            fh.write(block(order, 0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)))
            for digits in (6, 9):
                fh.write(block(order, 1, struct.pack(order + "HHI", 1, 0, 65535) + struct.pack(order + "HHBxxxHH", 9, 1, digits, 0, 0)))
            for i, f in enumerate(frames):
                at = (1_700_000_000 + i) * 10 ** (9 if i % 2 else 6)
                fh.write(block(order, 6, struct.pack(order + "IIIII", i % 2, at >> 32, at & 0xFFFFFFFF, len(f), len(f)) + f))
                if i % 50 == 0:
                    fh.write(block(order, 3, struct.pack(order + "I", len(f)) + f) + block(order, 0xBAD, b"custom"))
    whole = open(f"{folder}/sections.pcapng", "rb").read()
    open(f"{folder}/cut.pcapng", "wb").write(whole[:-37])
    open(f"{folder}/none.pcap", "wb").write(b"no capture")
    open(f"{folder}/empty.pcap", "wb").close()


def test_splits_equal_the_sequential_walk(spark, tmp_dir):
    from netlens.sources.pcap import list_captures, read_capture, read_packets, split_index
    mixed_captures(tmp_dir)
    for chunk_bytes, max_packets, split in ((2_000, None, 500), (700, 123, 4_000), (10 << 20, None, 1)):
        want = sorted(map(repr, (r for f in list_captures(tmp_dir) for r in read_capture(f, chunk_bytes, max_packets))))
        got = read_packets(spark, tmp_dir, chunk_bytes, max_packets, split_bytes=split)
        rows = [tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in got.collect()]
        assert sorted(map(repr, rows)) == want and len(want) > 300
        assert got.schema == read_packets(spark, tmp_dir, chunk_bytes).schema
    splits = split_index(spark, [f"{tmp_dir}/little.pcap"], split_bytes=1_000).collect()
    assert len(splits) > 20 and max(r["stop"] for r in splits) > 20_000


def test_one_large_capture_uses_many_tasks(spark, tmp_dir):
    from netlens.sources.pcap import read_packets
    write_pcap(f"{tmp_dir}/large.pcap", FRAMES * 500)
    got = read_packets(spark, f"{tmp_dir}/large.pcap", split_bytes=10_000)
    tasks = got.groupBy(F.spark_partition_id()).count().count()
    assert got.count() == 3_500 and tasks > 15
