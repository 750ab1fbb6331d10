"""Inputs that Spark derives from the driver tables (FIXTURES.md part B).

None of the reference's captures exist here, so packet, label and alert
tables are derived from ``events`` (and ``labels`` / ``documents`` /
``pages``) by one deterministic rule set; the DuckDB oracle applies the same
rules in SQL.  Every function returns a lazy DataFrame over the whole table.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netlens.functions.columns import epoch_micros
from netlens.schema import CLASSES_ALPHA

# FIXED VALUES (fixture rule set B1): event type -> IP protocol (0 = ARP frame)
EVENT_PROTO = {"click": 6, "purchase": 6, "view": 17, "signup": 1, "error": 0}
# FIXED VALUES (fixture rule set B1): k % 8 -> service port of the b endpoint
B_PORTS = [80, 443, 53, 23, 25, 22, 21, 9999]
# FIXED VALUES (fixture rule set B2): event types in alphabetical order
EVENT_TYPES_ALPHA = ["click", "error", "purchase", "signup", "view"]
# FIXED VALUES (fixture rule set B2): signature names for derived alert events
SIGNATURES = [
    "ET SCAN Nmap SYN scan",
    "ET DOS Possible SYN flood",
    "LOCAL SQLi UNION SELECT in URI",
    "LOCAL XSS script tag in request",
    "LOCAL OS Command Injection in URI",
    "ET INFO Session traversal",
    "ENGINE STREAM invalid checksum",
    "ENGINE FRAG overlap",
    "LOCAL Telnet to IoT device (policy)",
    "ET EXPLOIT Possible Mirai dropper",
    "ET HUNTING curl user agent",
    "ENGINE Applayer detect protocol only one direction",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_k() -> Column:
    return F.get_json_object(F.col("props"), "$.k").cast("int")


def _case(key: Column, mapping: dict, default=None) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def packets_from_events(events: DataFrame) -> DataFrame:
    """Decoded packet rows (no chunk id yet) from ``events``.

    Output: source, packet_no, ts_us, is_arp, proto, ttl, sip, sport, dip,
    dport, tcp_flags, frame_len, event_type, user_id, k.  Two projections:
    protocol, endpoints and ports are computed once and referenced by name.
    """
    u = F.col("user_id")
    proto = _case(F.col("event_type"), EVENT_PROTO).cast("int")
    e = events.select(
        F.col("event_id"), F.col("ts"), u.alias("user_id"), F.col("event_type"),
        F.col("value"), event_k().alias("k"), proto.alias("proto"))
    k, u, proto = F.col("k"), F.col("user_id"), F.col("proto")
    ported = proto.isin(6, 17)
    e = e.select(
        "*",
        F.concat(F.lit("10.0.0."), (u % 16).cast("string")).alias("a_ip"),
        F.concat(F.lit("10.0.1."), (k % 8).cast("string")).alias("b_ip"),
        F.when(ported, 1024 + u % 8).otherwise(0).cast("int").alias("a_port"),
        F.when(ported, _case(k % 8, dict(enumerate(B_PORTS)))).otherwise(0).cast("int")
         .alias("b_port"),
        ((k % 3) == 0).alias("swap"))
    swap = F.col("swap")
    return e.select(
        F.concat(F.lit("cap"), (u % 4).cast("string")).alias("source"),
        F.col("event_id").alias("packet_no"),
        epoch_micros("ts").alias("ts_us"),
        (proto == 0).cast("int").alias("is_arp"),
        proto,
        F.when(proto == 0, 0).when(k % 2 == 0, 64).otherwise(128).cast("int").alias("ttl"),
        F.when(swap, F.col("b_ip")).otherwise(F.col("a_ip")).alias("sip"),
        F.when(swap, F.col("b_port")).otherwise(F.col("a_port")).alias("sport"),
        F.when(swap, F.col("a_ip")).otherwise(F.col("b_ip")).alias("dip"),
        F.when(swap, F.col("a_port")).otherwise(F.col("b_port")).alias("dport"),
        F.when(proto == 6, (k * 37) % 256).otherwise(0).cast("int").alias("tcp_flags"),
        (F.lit(54) + F.floor(F.col("value")).cast("long") % 1447).cast("long").alias("frame_len"),
        F.col("event_type"), u, k,
    )


def class_label(u: Column | None = None) -> Column:
    """Fixture class label: class number ``user_id % 34`` in alphabetical order."""
    u = F.col("user_id") if u is None else u
    return F.element_at(F.array(*[F.lit(c) for c in CLASSES_ALPHA]),
                        (u % len(CLASSES_ALPHA) + 1).cast("int"))


def predicted_event_type(k: Column | None = None) -> Column:
    """Fixture prediction: event type number ``k % 5`` in alphabetical order."""
    k = event_k() if k is None else k
    return F.element_at(F.array(*[F.lit(c) for c in EVENT_TYPES_ALPHA]),
                        (k % 5 + 1).cast("int"))


def labelled_events(events: DataFrame) -> DataFrame:
    """events + ``label`` (34-class name), ``source`` and ``k`` (fixture B2)."""
    k = event_k()
    return events.select(
        "event_id", "ts", "user_id", "event_type", "value",
        k.alias("k"),
        F.concat(F.lit("cap"), (F.col("user_id") % 4).cast("string")).alias("source"),
        class_label().alias("label"))


def alert_json_lines(events: DataFrame) -> DataFrame:
    """One JSON text line per event shaped like a signature-engine event log.

    ``k % 4`` gives the severity (0 means the field is absent); every 7th
    event is a ``flow`` event, every 11th line is blank and every 13th is
    broken JSON, so the tolerant reader has something to skip.
    """
    k = event_k()
    eid = F.col("event_id")
    sig = F.element_at(F.array(*[F.lit(s) for s in SIGNATURES]),
                       (k % len(SIGNATURES) + 1).cast("int"))
    sev = k % 4
    # a NULL severity is left out of the JSON text (to_json drops null fields)
    alert = F.struct(sig.alias("signature"), F.when(sev != 0, sev).alias("severity"))
    ev = F.struct(
        F.when(eid % 7 == 0, F.lit("flow")).otherwise(F.lit("alert")).alias("event_type"),
        F.concat(F.date_format(F.col("ts"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                 F.lit("+0000")).alias("timestamp"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 16).cast("string")).alias("src_ip"),
        F.concat(F.lit("10.0.1."), (k % 8).cast("string")).alias("dest_ip"),
        class_label().alias("capture"),
        alert.alias("alert"))
    line = (F.when(eid % 11 == 0, F.lit(""))
            .when(eid % 13 == 0, F.concat(F.lit('{"event_type": "alert", "broken'), eid.cast("string")))
            .otherwise(F.to_json(ev)))
    return events.select(eid.alias("line_no"), line.alias("value"))


def scored_windows(events: DataFrame) -> DataFrame:
    """Fixture scoring output: one row per event as a scored window.

    capture = the event's class label (one capture per class), ts = event
    time, is_anomaly = ``k % 3 = 0``, attack_type = class number
    ``(user_id + k) % 34`` in alphabetical order.
    """
    k = event_k()
    return events.select(
        F.col("event_id").alias("window_id"), F.col("ts"),
        class_label().alias("capture"),
        ((k % 3) == 0).alias("is_anomaly"),
        F.element_at(F.array(*[F.lit(c) for c in CLASSES_ALPHA]),
                     ((F.col("user_id") + k) % len(CLASSES_ALPHA) + 1).cast("int"))
         .alias("attack_type"))


# FIXED VALUES: the four web-attack request paths of the smoke capture.
ATTACK_URIS = [
    "/index.php?id=1%20union%20select%20user,pass%20from%20users",
    "/search?q=<script>alert(1)</script>",
    "/cgi-bin/cmd?x=;cat%20/etc/passwd",
    "/api?id=1%27%20or%201=1--",
]


def http_requests(pages: DataFrame) -> DataFrame:
    """Requests built from ``pages``: the page URL as URI and its HTML as body.

    Every 10th page gets one of the four attack paths appended; every 7th
    page is a TCP/23 session whose payload is the HTML.
    """
    pid = F.col("page_id")
    attack = F.element_at(F.array(*[F.lit(u) for u in ATTACK_URIS]),
                          (F.floor(pid / 10) % 4 + 1).cast("int"))
    uri = F.when(pid % 10 == 0, F.concat(F.col("url"), attack)).otherwise(F.col("url"))
    dport = F.when(pid % 7 == 0, 23).when(F.col("url").startswith("https"), 443).otherwise(80)
    return pages.select(pid.alias("request_id"), uri.alias("uri"), F.col("html").alias("body"),
                        F.lit(6).alias("proto"), dport.alias("dport"))


def _ip_hex(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    return F.concat(*[F.lpad(F.hex(parts[i].cast("int")), 2, "0") for i in range(4)])


def _u16_hex(x: Column) -> Column:
    return F.lpad(F.hex(x.cast("int")), 4, "0")


# FIXED VALUES (fixture rule set): MAC addresses of the derived frames
SRC_MAC = "020000000001"
DST_MAC = "020000000002"


def frames_from_packets(packets: DataFrame) -> DataFrame:
    """Ethernet frames (BINARY) built from derived packet columns, padded to
    ``frame_len``: IPv4 + TCP (20 bytes, flags set) / UDP (8) / ICMP (4), or
    ARP.  Decoding them must give the packet columns back."""
    proto = F.col("proto")
    is_arp = F.col("is_arp") == 1
    ip_hdr = F.concat(F.lit("45000000"), F.lit("00004000"),
                      F.lpad(F.hex(F.col("ttl")), 2, "0"), F.lpad(F.hex(proto), 2, "0"),
                      F.lit("0000"), _ip_hex(F.col("sip")), _ip_hex(F.col("dip")))
    l4 = (F.when(proto == 6, F.concat(_u16_hex(F.col("sport")), _u16_hex(F.col("dport")),
                                      F.lit("0000000000000000"), F.lit("50"),
                                      F.lpad(F.hex(F.col("tcp_flags")), 2, "0"),
                                      F.lit("040000000000")))
          .when(proto == 17, F.concat(_u16_hex(F.col("sport")), _u16_hex(F.col("dport")),
                                      F.lit("00080000")))
          .otherwise(F.lit("08000000")))
    body = F.when(is_arp, F.concat(F.lit("0806"), F.lit("00" * 28))) \
        .otherwise(F.concat(F.lit("0800"), ip_hdr, l4))
    hexs = F.concat(F.lit(DST_MAC), F.lit(SRC_MAC), body)
    pad = F.greatest(F.col("frame_len") * 2 - F.length(hexs), F.lit(0))
    frame = F.unhex(F.concat(hexs, F.repeat(F.lit("0"), pad.cast("int"))))
    return packets.select("source", "packet_no", "ts_us", frame.alias("frame"))


def replicate_packets(packets: DataFrame, times: int) -> DataFrame:
    """Benchmark volume: every packet ``times`` times as separate captures
    (``packet_no * times + r``, source ``<source>-<r>``), via explode."""
    r = F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("_r")
    return (packets.select("*", r)
                   .withColumn("packet_no", F.col("packet_no") * times + F.col("_r"))
                   .withColumn("source", F.concat(F.col("source"), F.lit("-"),
                                                  F.col("_r").cast("string")))
                   .drop("_r"))
