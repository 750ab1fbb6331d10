"""Network and direction predicates for rules.

An IPv4 address is an integer, a network such as ``10.0.0.0/8`` its first bits.
Addresses meet networks by equality: every address is cut to each prefix length in
use (at most 33) and joined on (length, bits), so nested networks all match, no range
join is needed, and the work is rows times lengths whatever the number of networks.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.operators.joins import join_small

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def ipv4_number(ip) -> Column:
    """Dotted IPv4 text -> integer; null for anything else."""
    c = F.col(ip) if isinstance(ip, str) else ip
    part = lambda i: F.split_part(c, F.lit("."), F.lit(i)).cast("long")
    return F.when(c.rlike(IPV4), part(1) * (1 << 24) + part(2) * (1 << 16) + part(3) * (1 << 8) + part(4))


def in_networks(ip, cidrs: list[str]) -> Column:
    """Whether an address lies in any of a few fixed networks; false for no address."""
    x = ipv4_number(ip)
    hit = F.lit(False)
    for cidr in cidrs:
        lo, hi = network_bounds(cidr)
        hit = hit | x.between(lo, hi)
    return F.coalesce(hit, F.lit(False))


def network_bounds(cidr: str) -> tuple[int, int]:
    """First and last address of a network as integers."""
    import ipaddress
    n = ipaddress.ip_network(cidr, strict=False)
    return int(n.network_address), int(n.broadcast_address)


def direction(src, dst, home: list[str]) -> Column:
    """inbound, outbound, internal or external, seen from the home networks."""
    a, b = in_networks(src, home), in_networks(dst, home)
    return (F.when(a & b, "internal").when(a, "outbound").when(b, "inbound").otherwise("external"))


def match_networks(df: DataFrame, ip: str, networks: DataFrame, key: str = "network") -> DataFrame:
    """One row per (row, network holding its address): the columns of ``df``, ``key`` and
    ``prefix_len``.  ``networks`` has a ``cidr`` column and the column named by ``key``;
    rows without an address, or in no network, give none."""
    length = F.split_part("cidr", F.lit("/"), F.lit(2))
    length = F.when(length == "", 32).otherwise(length.cast("int"))
    nets = networks.select(F.col(key), length.alias("prefix_len"),
                           ipv4_number(F.split_part("cidr", F.lit("/"), F.lit(1))).alias("_n"))
    # two to the free bits: a shift by a column that both sides share
    free = F.pow(F.lit(2.0), 32 - F.col("prefix_len")).cast("long")
    nets = nets.where(F.col("prefix_len").between(0, 32) & F.col("_n").isNotNull()) \
               .select(key, "prefix_len", F.floor(F.col("_n") / free).alias("_bits")).distinct()
    lengths = [r["prefix_len"] for r in nets.select("prefix_len").distinct().collect()]      # at most 33
    cut = df.withColumn("_n", ipv4_number(ip)).where(F.col("_n").isNotNull()) \
            .withColumn("prefix_len", F.explode(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"))) \
            .withColumn("_bits", F.floor(F.col("_n") / free)).drop("_n")
    return join_small(cut, nets, ["prefix_len", "_bits"]).drop("_bits").select(*df.columns, key, "prefix_len")


def longest_match(df: DataFrame, ip: str, networks: DataFrame, row_key: list[str], key: str = "network") -> DataFrame:
    """The most specific network of each row (null if none), ties by name; no row is lost."""
    best = match_networks(df.select(*row_key, ip), ip, networks, key).groupBy(*row_key).agg(
        F.min_by(key, F.struct(-F.col("prefix_len"), F.col(key))).alias(key))
    return df.join(best, row_key, "left")


def match_network_rules(packets: DataFrame, rules: DataFrame, home: list[str], row_key: list[str],
                        src: str = "sip", dst: str = "dip", dport: str = "dport",
                        proto: str = "proto") -> DataFrame:
    """One row per (packet, matching rule): ``row_key``, sid, direction.

    ``rules`` has sid, direction (``any`` for each), dst_net, proto and dport (null: any).
    The destination network is the hashed predicate, the rest is tested on what it lets through."""
    p = packets.select(*row_key, src, dst, dport, proto,
                       direction(src, dst, home).alias("direction"))
    nets = rules.select(F.struct("sid", F.col("direction").alias("wanted"), F.col("proto").alias("p"),
                                 F.col("dport").alias("port")).alias("rule"), F.col("dst_net").alias("cidr"))
    hit = match_networks(p, dst, nets, "rule")
    ok = ((F.col("rule.wanted") == "any") | (F.col("rule.wanted") == F.col("direction"))) \
        & (F.col("rule.p").isNull() | (F.col("rule.p") == F.col(proto))) \
        & (F.col("rule.port").isNull() | (F.col("rule.port") == F.col(dport)))
    return hit.where(ok).select(*row_key, F.col("rule.sid").alias("sid"), "direction")
