"""Addresses, nested networks and rule directions against the standard library (P25)."""
import ipaddress

from pyspark.sql import functions as F

ROWS = [(1, "10.0.0.3"), (2, "10.0.1.6"), (3, "192.168.255.1"), (4, "255.255.255.255"), (5, "0.0.0.0"), (6, None),
        (7, "10.0.0.256"), (8, "fe80::1"), (9, "10.0.0"), (10, " 10.0.0.1"), (11, "10.0.0.3"), (12, "01.2.3.4")]
NETS = [("all", "0.0.0.0/0"), ("ten", "10.0.0.0/8"), ("home", "10.0.0.0/24"), ("odd", "10.0.1.5/30"),
        ("host", "10.0.0.3"), ("twin", "10.0.0.3/32"), ("last", "255.255.255.255/32"), ("bad", "ten/8")]


def test_addresses(spark):
    from netlens.operators.networks import ipv4_number
    df = spark.createDataFrame(ROWS, "id int, ip string").select("id", "ip", ipv4_number("ip").alias("n"))
    for r in df.collect():
        try:
            want = int(ipaddress.IPv4Address(r["ip"]))
        except ValueError:
            want = None
        assert r["n"] == want, r


def test_nested_networks_all_match(spark):
    from netlens.operators.networks import longest_match, match_networks
    df = spark.createDataFrame(ROWS, "id int, ip string")
    nets = spark.createDataFrame(NETS, "network string, cidr string")
    got = {(r["id"], r["network"]) for r in match_networks(df, "ip", nets).collect()}
    want, best = set(), {}
    for i, ip in ROWS:
        try:
            a = ipaddress.IPv4Address(ip)
        except ValueError:
            best[i] = None
            continue
        inside = [(n, ipaddress.ip_network(c, strict=False)) for n, c in NETS if n != "bad"]
        inside = [(n, c) for n, c in inside if a in c]
        want |= {(i, n) for n, _ in inside}
        best[i] = min(inside, key=lambda x: (-x[1].prefixlen, x[0]))[0]
    assert got == want
    assert {r["id"]: r["network"] for r in longest_match(df, "ip", nets, ["id"]).collect()} == best


def test_directions_and_no_networks(spark):
    from netlens.operators.networks import direction, match_networks
    df = spark.createDataFrame([("10.0.0.1", "10.0.0.2"), ("10.0.0.1", "8.8.8.8"), ("8.8.8.8", "10.0.0.1"), ("1.1.1.1", None)],
                               "s string, d string")
    assert [r[0] for r in df.select(direction("s", "d", ["10.0.0.0/24", "172.16.0.0/12"])).collect()] \
        == ["internal", "outbound", "inbound", "external"]
    none = spark.createDataFrame([], "network string, cidr string")
    assert match_networks(df, "s", none).count() == 0
    assert match_networks(df.where(F.lit(False)), "s", spark.createDataFrame(NETS, none.schema)).count() == 0
