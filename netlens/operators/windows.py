"""Fixed-size traffic windows.

A window is ``size`` consecutive kept packets of one capture chunk.  The
summary is a single ``groupBy(source, chunk_id, window_id).agg(...)``; after
:func:`netlens.operators.flows.partition_chunks` it needs no extra shuffle.
Sums of integer columns are exact (LONG) and divided once, so the same
numbers come out of any engine; the size variance uses the exact integer
form ``(n*sum(x^2) - sum(x)^2) / n^2``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netlens.functions.decode import packet_features
from netlens.operators.flows import (partition_chunks, with_chunk, with_flow_state,
                                     with_window_id)
from netlens.schema import RAW, V1, WINDOW_PACKETS

WINDOW_KEY = ["source", "chunk_id", "window_id"]

# FIXED VALUES: per-packet columns averaged / summed in a window row.
MEAN_INT_COLS = (["duration"]
                 + [f"{f}_flag_number" for f in ("fin", "syn", "rst", "psh", "ack", "ece", "cwr")]
                 + ["http", "https", "dns", "telnet", "smtp", "ssh", "irc",
                    "tcp", "udp", "dhcp", "arp", "icmp", "ipv", "llc"])
SUM_COLS = ["ack_count", "syn_count", "fin_count", "urg_count", "rst_count"]


def packet_rows(packets: DataFrame, chunk_bytes: int | None = None,
                size: int = WINDOW_PACKETS, block_rows: int = 1 << 20,
                max_packets: int | None = None) -> DataFrame:
    """Decoded packets -> per-packet features with flow state and window id.

    When ``chunk_bytes`` is given the chunk id is computed here (SQL form);
    otherwise the input must already carry ``chunk_id`` (packet source).
    Only kept packets (IPv4/ARP) enter windows.
    """
    if chunk_bytes is not None:                  # chunk bytes count every record
        packets = with_chunk(packets, chunk_bytes, block_rows=block_rows)
    if max_packets is not None:                  # P8: records counted before filtering
        if "record_no" not in packets.columns:
            raise ValueError("max_packets needs record_no (from with_chunk)")
        packets = packets.filter(F.col("record_no") <= max_packets)
    if "keep" in packets.columns:
        packets = packets.filter(F.col("keep") == 1)
    p = partition_chunks(packet_features(packets))
    return with_window_id(with_flow_state(p), size)


def _n():
    return F.count(F.lit(1))


def _exact_var_pop(x: str):
    n, sx, sxx = _n(), F.sum(x), F.sum(F.col(x) * F.col(x))
    return (n * sxx - sx * sx) / (n * n)


def window_summary(rows: DataFrame, directional: str = "both") -> DataFrame:
    """46-feature window rows (A3) from :func:`packet_rows` output.

    ``directional="both"`` (default) treats both streams as all packet sizes:
    Magnitue = sqrt(2*mean), Radius = sqrt(2*var_pop), Covariance = var_pop,
    Variance = 1 when the sizes vary else 0, Weight = n*n (A5).
    ``directional="split"`` uses incoming (not the flow's first direction)
    and outgoing sizes with the all-sizes fallback for an empty side (A6).
    Protocol Type is the most frequent protocol, the smallest on a tie (A4).
    """
    n = _n()
    size = "frame_len"
    aggs = [
        (F.sum("cum_bytes") / n).alias("header_length"),
        (F.sum("dur_us") / n / F.lit(1e6)).alias("flow_duration"),
        F.avg("rate").alias("rate"), F.avg("srate").alias("srate"),
        F.avg("drate").alias("drate"),
        (F.sum("iat_ns") / n).alias("iat"),
        F.mode("protocol_type", True).cast("double").alias("protocol_type"),
        F.sum(size).cast("double").alias("tot_sum"),
        F.min(size).cast("double").alias("min"),
        F.max(size).cast("double").alias("max"),
        (F.sum(size) / n).alias("avg"),
        F.sqrt(_exact_var_pop(size)).alias("std"),
        (F.sum(size) / n).alias("tot_size"),
        n.cast("double").alias("number"),
    ]
    aggs += [(F.sum(c) / n).alias(c) for c in MEAN_INT_COLS]
    aggs += [F.sum(c).cast("double").alias(c) for c in SUM_COLS]
    if directional == "both":
        var = _exact_var_pop(size)
        aggs += [
            F.sqrt(2 * F.sum(size) / n).alias("magnitue"),
            F.sqrt(2 * var).alias("radius"),
            var.alias("covariance"),
            F.when(F.max(size) > F.min(size), 1.0).otherwise(0.0).alias("variance"),
            (n * n).cast("double").alias("weight"),
        ]
        out = rows.groupBy(*WINDOW_KEY).agg(*aggs)
    elif directional == "split":
        aggs += [F.sort_array(F.collect_list(F.struct(
            F.col("packet_no"), F.col("is_fwd"), F.col(size).alias("x")))).alias("_pk")]
        out = _split_streams(rows.groupBy(*WINDOW_KEY).agg(*aggs))
    else:
        raise ValueError(f"directional must be 'both' or 'split', not {directional!r}")
    return out.select(*WINDOW_KEY, *[F.col(c).cast("double").alias(c) for c in RAW])


def _split_streams(df: DataFrame) -> DataFrame:
    """Directional stats from the window's packets (at most ``size`` of them)."""
    pk = F.col("_pk")
    inc0 = F.transform(F.filter(pk, lambda r: r["is_fwd"] == 0), lambda r: r["x"].cast("double"))
    out0 = F.transform(F.filter(pk, lambda r: r["is_fwd"] == 1), lambda r: r["x"].cast("double"))
    allx = F.transform(pk, lambda r: r["x"].cast("double"))
    df = df.withColumns({
        "_in": F.when(F.size(inc0) == 0, allx).otherwise(inc0),
        "_out": F.when(F.size(out0) == 0, allx).otherwise(out0),
    })

    def mean(a):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / F.size(a)

    def var(a, m):
        return F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - m) * (x - m)) / F.size(a)

    df = df.withColumns({"_mi": mean(F.col("_in")), "_mo": mean(F.col("_out"))})
    df = df.withColumns({"_vi": var(F.col("_in"), F.col("_mi")),
                         "_vo": var(F.col("_out"), F.col("_mo")),
                         "_np": F.least(F.size("_in"), F.size("_out"))})
    cov = F.aggregate(
        F.sequence(F.lit(1), F.col("_np")), F.lit(0.0),
        lambda s, i: s + (F.element_at("_in", i) - F.col("_mi"))
        * (F.element_at("_out", i) - F.col("_mo"))) / F.col("_np")
    return df.withColumns({
        "magnitue": F.sqrt(F.col("_mi") + F.col("_mo")),
        "radius": F.sqrt(F.col("_vi") + F.col("_vo")),
        "covariance": cov,
        "variance": F.when(F.col("_vo") != 0, F.col("_vi") / F.col("_vo")).otherwise(0.0),
        "weight": (F.size("_in") * F.size("_out")).cast("double"),
    })


def windows_from_packets(packets: DataFrame, chunk_bytes: int | None = None,
                         size: int = WINDOW_PACKETS, directional: str = "both",
                         block_rows: int = 1 << 20, max_packets: int | None = None) -> DataFrame:
    """Decoded packets -> 46-feature window rows (W1-W6 + A3)."""
    return window_summary(packet_rows(packets, chunk_bytes, size, block_rows, max_packets),
                          directional)


def size_summary(rows: DataFrame, by=WINDOW_KEY) -> DataFrame:
    """Size sum/min/max/mean/std_pop and packet count per group."""
    n = _n()
    return rows.groupBy(*by).agg(
        F.sum("frame_len").alias("tot_sum"), F.min("frame_len").alias("min"),
        F.max("frame_len").alias("max"), (F.sum("frame_len") / n).alias("avg"),
        F.sqrt(_exact_var_pop("frame_len")).alias("std"), n.alias("number"))


def two_stream_stats(rows: DataFrame, by=WINDOW_KEY) -> DataFrame:
    """Incoming vs outgoing size streams of a group (A7, older dialect).

    Incoming = packets not in the flow's first direction.  Pearson
    correlation of the i-th incoming with the i-th outgoing size, their
    covariance divided by the incoming length, variance ratio in/out and
    weight = n_in * n_out.  Pairs are formed with a per-side row number and
    an equi-join on (group, position): no cross product.
    """
    w = Window.partitionBy(*by, "is_fwd").orderBy("packet_no")
    r = rows.select(*by, "is_fwd", "packet_no", F.col("frame_len").cast("double").alias("x")) \
        .withColumn("_pos", F.row_number().over(w))
    inc = r.filter(F.col("is_fwd") == 0).select(*by, "_pos", F.col("x").alias("xi"))
    out = r.filter(F.col("is_fwd") == 1).select(*by, "_pos", F.col("x").alias("xo"))
    xl = F.col("x").cast("long")
    fin, fout = F.col("is_fwd") == 0, F.col("is_fwd") == 1
    side = r.groupBy(*by).agg(
        F.sum(1 - F.col("is_fwd")).cast("long").alias("n_in"),
        F.sum("is_fwd").cast("long").alias("n_out"),
        F.sum(F.when(fin, xl)).alias("_si"), F.sum(F.when(fout, xl)).alias("_so"),
        F.sum(F.when(fin, xl * xl)).alias("_ssi"), F.sum(F.when(fout, xl * xl)).alias("_sso"))
    # exact integer moments: n^2 * var = n * sum(x^2) - sum(x)^2
    m2i = F.col("n_in") * F.col("_ssi") - F.col("_si") * F.col("_si")
    m2o = F.col("n_out") * F.col("_sso") - F.col("_so") * F.col("_so")
    side = side.select(
        *by, "n_in", "n_out",
        F.try_divide(F.col("_si"), F.col("n_in")).alias("mean_in"),
        F.try_divide(F.col("_so"), F.col("n_out")).alias("mean_out"),
        F.try_divide(m2i * F.col("n_out") * F.col("n_out"),
                     m2o * F.col("n_in") * F.col("n_in")).alias("variance_ratio"))
    pairs = inc.join(out, [*by, "_pos"]).groupBy(*by).agg(
        F.sum("xi").alias("_sxi"), F.sum("xo").alias("_sxo"),
        F.sum(F.col("xi") * F.col("xi")).alias("_sxxi"),
        F.sum(F.col("xo") * F.col("xo")).alias("_sxxo"),
        F.sum(F.col("xi") * F.col("xo")).alias("_sxy"), F.count(F.lit(1)).alias("_np"))
    # Pearson from exact sums of integer sizes; NULL when a side is constant
    np_, sxi, sxo = F.col("_np"), F.col("_sxi"), F.col("_sxo")
    pearson = F.try_divide(np_ * F.col("_sxy") - sxi * sxo,
                           F.sqrt((np_ * F.col("_sxxi") - sxi * sxi)
                                  * (np_ * F.col("_sxxo") - sxo * sxo)))
    res = side.join(pairs.withColumn("pearson", pearson), list(by), "left")
    return res.select(
        *by, "n_in", "n_out", "mean_in", "mean_out", "pearson",
        F.try_divide(F.col("_sxy") - F.col("_sxi") * F.col("_sxo") / F.col("_np"),
                     F.col("n_in")).alias("covariance"),
        "variance_ratio",
        (F.col("n_in") * F.col("n_out")).alias("weight"))


def window_summary_v1(packets: DataFrame, chunk_bytes: int | None = None,
                      size: int = WINDOW_PACKETS, block_rows: int = 1 << 20) -> DataFrame:
    """Older 39-column window dialect.

    Differences from A3: sample std and ``Variance`` = sample variance of the
    sizes (NULL for a one-packet window), ``Rate`` = packets / (last ts -
    first ts) with NULL for a zero span, capture-wide IAT (seconds),
    ``Time_To_Live``, ``IGMP``, L4 header length (TCP 20, UDP 8, else 0) and
    LLC only for IP packets.
    """
    from netlens.operators.flows import capture_iat

    if chunk_bytes is not None:
        packets = with_chunk(packets, chunk_bytes, block_rows=block_rows)
    if "keep" in packets.columns:
        packets = packets.filter(F.col("keep") == 1)
    p = partition_chunks(packet_features(packets))
    p = with_window_id(capture_iat(p), size)
    is_ip = F.col("is_arp") == 0
    p = p.withColumns({
        "l4_header": F.when(is_ip & (F.col("proto") == 6), 20)
                      .when(is_ip & (F.col("proto") == 17), 8).otherwise(0),
        "igmp": (is_ip & (F.col("proto") == 2)).cast("int"),
        "llc_v1": is_ip.cast("int"),
    })
    n = _n()
    mean_cols = [c for c in MEAN_INT_COLS if c not in ("duration", "llc")]
    aggs = [
        (F.sum("l4_header") / n).alias("header_length"),
        F.mode("protocol_type", True).cast("double").alias("protocol_type"),
        (F.sum("duration") / n).alias("time_to_live"),
        F.try_divide(n.cast("double"),
                     (F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)).alias("rate"),
        (F.sum("igmp") / n).alias("igmp"),
        (F.sum("llc_v1") / n).alias("llc"),
        F.sum("frame_len").cast("double").alias("tot_sum"),
        F.min("frame_len").cast("double").alias("min"),
        F.max("frame_len").cast("double").alias("max"),
        (F.sum("frame_len") / n).alias("avg"),
        F.sqrt(_exact_var_samp("frame_len")).alias("std"),
        (F.sum("frame_len") / n).alias("tot_size"),
        F.avg("capture_iat").alias("iat"),
        n.cast("double").alias("number"),
        _exact_var_samp("frame_len").alias("variance"),
    ]
    aggs += [(F.sum(c) / n).alias(c) for c in mean_cols]
    aggs += [F.sum(c).cast("double").alias(c) for c in SUM_COLS if c != "urg_count"]
    out = p.groupBy(*WINDOW_KEY).agg(*aggs)
    return out.select(*WINDOW_KEY, *[F.col(c).cast("double").alias(c) for c in V1])


def _exact_var_samp(x: str):
    n, sx, sxx = _n(), F.sum(x), F.sum(F.col(x) * F.col(x))
    return F.try_divide((n * sxx - sx * sx).cast("double"), (n * (n - 1)).cast("double"))
