"""Packet header decode (P1-P7) as Column expressions.

Two entry points:

* :func:`decode_frames` turns a raw Ethernet ``frame BINARY`` column into the
  header columns (ethertype, proto, ttl, addresses, ports, TCP flags) with
  byte ``substring`` / ``conv`` expressions only: no UDF, so the decode stays
  inside whole-stage codegen.
* :func:`packet_features` turns decoded header columns into the per-packet
  0/1 feature columns the window summary averages.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netlens.functions.columns import flag

# FIXED VALUES: Ethernet types kept, TCP flag bits, application ports.
ETH_IPV4 = 0x0800
ETH_ARP = 0x0806
TCP_FLAG_BITS = {"fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08,
                 "ack": 0x10, "urg": 0x20, "ece": 0x40, "cwr": 0x80}
FLAG_NUMBER_BITS = ["fin", "syn", "rst", "psh", "ack", "ece", "cwr"]
FLAG_COUNT_BITS = ["ack", "syn", "fin", "urg", "rst"]
APP_TCP_PORTS = {"http": 80, "https": 443, "ssh": 22, "telnet": 23, "smtp": 25,
                 "irc": 21}
APP_UDP_PORTS = {"dns": 53, "smtp": 25}
DHCP_PORTS = (67, 68)
MQTT_PORT = 1883
COAP_PORT = 5683
PROTOCOL_NAMES = {0: "IP", 1: "ICMP", 2: "IGMP", 6: "TCP", 17: "UDP"}
UNKNOWN_PROTOCOL = "Unknown for now"


def _u(frame: Column, pos1: int | Column, n: int) -> Column:
    """Unsigned big-endian integer of ``n`` bytes at 1-based byte ``pos1``."""
    return F.conv(F.hex(F.substring(frame, pos1, n)), 16, 10).cast("long")


def _ipv4(frame: Column, pos1: int) -> Column:
    return F.concat_ws(".", *[_u(frame, pos1 + i, 1).cast("string") for i in range(4)])


def _mac(frame: Column, pos1: int) -> Column:
    return F.lower(F.concat_ws(":", *[F.hex(F.substring(frame, pos1 + i, 1))
                                      for i in range(6)]))


def decode_frames(df: DataFrame, frame: str = "frame") -> DataFrame:
    """Raw Ethernet frame -> header columns; non IPv4/ARP rows flagged ``keep=0``.

    Honours the IPv4 header length (IHL); a non-first fragment carries no L4
    header, so its ports and flags are 0 and ``has_l4`` is 0; truncated L4
    headers give 0 as well.
    ARP endpoints are the MAC addresses prefixed ``arp:`` with ports 0.
    """
    fr = F.col(frame)
    length = F.length(fr)
    ethertype = F.when(length >= 14, _u(fr, 13, 2))
    is_ip = (ethertype == ETH_IPV4) & (length >= 34)
    is_arp = ethertype == ETH_ARP
    ihl = (_u(fr, 15, 1).bitwiseAND(0x0F) * 4).cast("int")
    frag_off = _u(fr, 21, 2).bitwiseAND(0x1FFF)
    proto = F.when(is_ip, _u(fr, 24, 1)).otherwise(0).cast("int")
    l4 = (ihl + 15).cast("int")                       # 1-based start of L4
    # a transport header counts if it is whole: first fragment, 20 bytes and a data
    # offset of at least 5 words for TCP, 8 bytes for UDP
    offset = F.conv(F.hex(F.substring(fr, l4 + 12, F.lit(1))), 16, 10).cast("int")
    tcp_ok = (proto == 6) & (length >= l4 + 19) & (offset >= 0x50)
    has_ports = is_ip & (frag_off == 0) & (tcp_ok | (proto == 17) & (length >= l4 + 7))
    sport = F.when(has_ports, F.conv(F.hex(F.substring(fr, l4, F.lit(2))), 16, 10)
                   .cast("int")).otherwise(0)
    dport = F.when(has_ports, F.conv(F.hex(F.substring(fr, l4 + 2, F.lit(2))), 16, 10)
                   .cast("int")).otherwise(0)
    flags = F.when(has_ports & (proto == 6), F.conv(F.hex(F.substring(fr, l4 + 13, F.lit(1))), 16, 10)
                   .cast("int")).otherwise(0)
    return (df
            .withColumn("ethertype", ethertype.cast("int"))
            .withColumn("keep", flag(is_ip | is_arp))
            .withColumn("is_arp", flag(is_arp))
            .withColumn("proto", proto)
            .withColumn("ttl", F.when(is_ip, _u(fr, 23, 1)).otherwise(0).cast("int"))
            .withColumn("sip", F.when(is_ip, _ipv4(fr, 27))
                        .when(is_arp, F.concat(F.lit("arp:"), _mac(fr, 7))))
            .withColumn("dip", F.when(is_ip, _ipv4(fr, 31))
                        .when(is_arp, F.concat(F.lit("arp:"), _mac(fr, 1))))
            .withColumn("sport", sport)
            .withColumn("dport", dport)
            .withColumn("has_l4", flag(F.coalesce(has_ports, F.lit(False))))
            .withColumn("tcp_flags", flags)
            .withColumn("frame_len", length.cast("long")))


def protocol_name(proto) -> Column:
    """Protocol number -> name."""
    p = F.col(proto) if isinstance(proto, str) else proto
    expr = None
    for num, name in PROTOCOL_NAMES.items():
        expr = (F.when(p == num, name) if expr is None else expr.when(p == num, name))
    return expr.otherwise(UNKNOWN_PROTOCOL)


def either_port(p: int) -> Column:
    return (F.col("sport") == p) | (F.col("dport") == p)


def packet_features(df: DataFrame) -> DataFrame:
    """Decoded header columns -> per-packet 0/1 features.

    Needs ``is_arp, proto, ttl, sport, dport, tcp_flags, frame_len``.  TCP and
    UDP count only with a whole transport header (``has_l4``; tables without
    that column hold packets that have one); ICMP counts by protocol number.
    """
    is_arp = F.col("is_arp") == 1
    proto = F.col("proto")
    has_l4 = (F.col("has_l4") == 1) if "has_l4" in df.columns else F.lit(True)
    tcp = (~is_arp) & (proto == 6) & has_l4
    udp = (~is_arp) & (proto == 17) & has_l4
    icmp = (~is_arp) & (proto == 1)
    fl = F.col("tcp_flags")
    cols = {
        "protocol_type": F.when(is_arp, 0).otherwise(proto).cast("int"),
        "duration": F.when(is_arp, 0).otherwise(F.col("ttl")).cast("int"),
    }
    for name in FLAG_NUMBER_BITS:
        cols[f"{name}_flag_number"] = flag(tcp & (fl.bitwiseAND(TCP_FLAG_BITS[name]) != 0))
    for name in FLAG_COUNT_BITS:
        cols[f"{name}_count"] = flag(tcp & (fl.bitwiseAND(TCP_FLAG_BITS[name]) != 0))
    app = {k: F.lit(False) for k in ("http", "https", "dns", "telnet", "smtp", "ssh", "irc")}
    for k, p in APP_TCP_PORTS.items():
        app[k] = app[k] | (tcp & either_port(p))
    for k, p in APP_UDP_PORTS.items():
        app[k] = app[k] | (udp & either_port(p))
    for k in ("http", "https", "dns", "telnet", "smtp", "ssh", "irc"):
        cols[k] = flag(app[k])
    cols["tcp"] = flag(tcp)
    cols["udp"] = flag(udp)
    cols["dhcp"] = flag(udp & (((F.col("sport") == DHCP_PORTS[0]) & (F.col("dport") == DHCP_PORTS[1]))
                               | ((F.col("sport") == DHCP_PORTS[1]) & (F.col("dport") == DHCP_PORTS[0]))))
    cols["arp"] = flag(is_arp)
    cols["icmp"] = flag(icmp)
    cols["ipv"] = flag(~is_arp)
    cols["llc"] = F.lit(1)
    cols["mqtt"] = flag(either_port(MQTT_PORT) & (tcp | udp))
    cols["coap"] = flag(either_port(COAP_PORT) & (tcp | udp))
    return df.withColumns(cols)
