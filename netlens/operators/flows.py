"""Chunking, flow state and per-host counters.

Layout for scale: the packet table is hash-partitioned once on
``(source, chunk_id)``.  A chunk is a bounded slice of one capture (10 MiB of
frames in production), so a capture that holds a third of all packets is
still spread over many tasks, and every later window (flow state, window id)
and the window summary reuse that one partitioning without another shuffle.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netlens.schema import CHUNK_BYTES

UNBOUNDED = Window.unboundedPreceding
CURRENT = Window.currentRow


def with_chunk(packets: DataFrame, limit_bytes: int = CHUNK_BYTES,
               block_rows: int = 1 << 20, order: str = "packet_no",
               size: str = "frame_len") -> DataFrame:
    """``chunk_id = floor(running bytes per source / limit_bytes)`` (W2, SQL form).

    The running sums are a distributed two-level prefix sum, so no capture
    is ever one task: (1) per-(source, block) totals, pre-aggregated
    map-side; (2) an exclusive running sum over the small block table;
    (3) a running sum inside each block, which holds at most ``block_rows``
    packet numbers.  The block-offset join is an equi-join on (source, block)
    that AQE turns into a broadcast when the measured block table is small,
    and keeps as a shuffle join otherwise.

    Bytes count every record (kept or not).  ``kept_pos`` is the running
    count of kept records (``keep`` column, all when absent) per source; the
    window ids are derived from it without another sort.  ``record_no`` is
    the record's position in its capture (for ``max_packets``, P8).

    The packet source computes the exact chunk (the record that reaches the
    limit opens a new chunk and is not counted) while walking record
    headers; this closed form matches it up to the first boundary, and
    :func:`netlens.operators.chunks.with_exact_chunk` throughout.
    """
    return (running_bytes(packets, block_rows, order, size)
            .withColumn("chunk_id", F.floor(F.col("run_bytes") / F.lit(float(limit_bytes))).cast("long"))
            .drop("run_bytes"))


def running_bytes(packets: DataFrame, block_rows: int = 1 << 20, order: str = "packet_no",
                  size: str = "frame_len") -> DataFrame:
    """``run_bytes`` (bytes of the capture up to and with the record), ``kept_pos`` and
    ``record_no`` by the two-level prefix sum of :func:`with_chunk`."""
    kept = F.col("keep").cast("long") if "keep" in packets.columns else F.lit(1).cast("long")
    blk = F.floor(F.col(order) / F.lit(block_rows)).cast("long")
    p = packets.withColumns({"_blk": blk, "_kept": kept})
    totals = p.groupBy("source", "_blk").agg(F.sum(size).alias("_blk_bytes"),
                                            F.sum("_kept").alias("_blk_kept"),
                                            F.count(F.lit(1)).alias("_blk_n"))
    w_off = Window.partitionBy("source").orderBy("_blk").rowsBetween(UNBOUNDED, -1)
    offsets = totals.select(
        "source", "_blk",
        F.coalesce(F.sum("_blk_bytes").over(w_off), F.lit(0)).alias("_off_bytes"),
        F.coalesce(F.sum("_blk_kept").over(w_off), F.lit(0)).alias("_off_kept"),
        F.coalesce(F.sum("_blk_n").over(w_off), F.lit(0)).alias("_off_n"))
    w_in = Window.partitionBy("source", "_blk").orderBy(order).rowsBetween(UNBOUNDED, CURRENT)
    return (p.join(offsets, ["source", "_blk"])
             .withColumns({"run_bytes": F.col("_off_bytes") + F.sum(size).over(w_in),
                           "kept_pos": F.col("_off_kept") + F.sum("_kept").over(w_in),
                           "record_no": F.col("_off_n") + F.count(F.lit(1)).over(w_in)})
             .drop("_blk", "_kept", "_off_bytes", "_off_kept", "_off_n"))


def flow_key_cols() -> dict[str, Column]:
    """Unordered endpoint pair: (ip, port) tuples sorted lexically then numerically."""
    a_first = (F.col("sip") < F.col("dip")) | (
        (F.col("sip") == F.col("dip")) & (F.col("sport") <= F.col("dport")))
    return {
        "lo_ip": F.when(a_first, F.col("sip")).otherwise(F.col("dip")),
        "lo_port": F.when(a_first, F.col("sport")).otherwise(F.col("dport")),
        "hi_ip": F.when(a_first, F.col("dip")).otherwise(F.col("sip")),
        "hi_port": F.when(a_first, F.col("dport")).otherwise(F.col("sport")),
    }


FLOW_KEY = ["lo_ip", "lo_port", "hi_ip", "hi_port"]


def partition_chunks(packets: DataFrame) -> DataFrame:
    """The one shuffle of the packet path: hash on (source, chunk_id)."""
    return packets.repartition("source", "chunk_id")


def with_flow_state(packets: DataFrame) -> DataFrame:
    """Per-flow running state inside each chunk.

    Adds lo/hi flow key, ``dur_us`` (time since the flow's first packet),
    ``iat_ns`` (0 for a flow's first packet), ``is_fwd`` (same direction as
    the flow's first packet), running ``fwd_n``/``bwd_n``, ``cum_bytes`` and
    ``rate``/``srate``/``drate`` (0 when the duration is not positive).
    Packet order is ``packet_no`` (file order), not time.

    One window pass: ``d`` = the sender is the key's low endpoint (no window
    needed), ``is_fwd`` = ``d`` equals the first packet's ``d``, and the
    forward count is the running sum of ``d`` or its complement.
    """
    keys = flow_key_cols()
    p = packets.withColumns(keys).withColumn(
        "_d", ((F.col("sip") == F.col("lo_ip")) & (F.col("sport") == F.col("lo_port"))).cast("long"))
    w = Window.partitionBy("source", "chunk_id", *FLOW_KEY).orderBy("packet_no")
    run = w.rowsBetween(UNBOUNDED, CURRENT)
    p = p.withColumns({
        "dur_us": F.col("ts_us") - F.first("ts_us").over(run),
        "iat_ns": F.coalesce((F.col("ts_us") - F.lag("ts_us").over(w)) * 1000, F.lit(0)),
        "cum_bytes": F.sum("frame_len").over(run),
        "_d0": F.first("_d").over(run),
        "_cd": F.sum("_d").over(run),
        "_n": F.count(F.lit(1)).over(run),
    })
    return flow_rates(p)


def flow_rates(p: DataFrame) -> DataFrame:
    """Direction counts and rates (W4, W6) from the running columns ``dur_us``, ``_d``
    (sent by the key's low endpoint), ``_d0`` (the flow's first ``_d``), ``_cd`` (sum of
    ``_d``) and ``_n`` (packets so far)."""
    first_low = F.col("_d0") == 1
    p = p.withColumns({
        "is_fwd": (F.col("_d") == F.col("_d0")).cast("int"),
        "fwd_n": F.when(first_low, F.col("_cd")).otherwise(F.col("_n") - F.col("_cd")),
        "bwd_n": F.when(first_low, F.col("_n") - F.col("_cd")).otherwise(F.col("_cd")),
    }).drop("_d", "_d0", "_cd", "_n")
    dur_s = F.col("dur_us") / F.lit(1e6)
    pos = F.col("dur_us") > 0
    return p.withColumns({
        "flow_duration": dur_s,
        "rate": F.when(pos, (F.col("fwd_n") + F.col("bwd_n")) / dur_s).otherwise(0.0),
        "srate": F.when(pos, F.col("fwd_n") / dur_s).otherwise(0.0),
        "drate": F.when(pos, F.col("bwd_n") / dur_s).otherwise(0.0),
    })


def with_window_id(packets: DataFrame, size: int = 10) -> DataFrame:
    """``window_id`` = kept-packet position in the chunk div ``size``.

    * ``kept_no`` (position among kept records in the chunk, from the
      capture source): plain arithmetic, no window;
    * ``kept_pos`` (running kept count per source, from :func:`with_chunk`):
      position = kept_pos - min(kept_pos) over the chunk, an unordered
      window that reuses the chunk-clustered sort of the flow windows;
    * otherwise ``row_number`` over the chunk ordered by ``packet_no``.
    """
    if "kept_no" in packets.columns:
        pos0 = F.col("kept_no") - 1
    elif "kept_pos" in packets.columns:
        pos0 = F.col("kept_pos") - F.min("kept_pos").over(Window.partitionBy("source", "chunk_id"))
    else:
        pos0 = F.row_number().over(Window.partitionBy("source", "chunk_id").orderBy("packet_no")) - 1
    return packets.withColumn("window_id", F.floor(pos0 / F.lit(size)).cast("long"))


def capture_iat(packets: DataFrame) -> DataFrame:
    """Capture-wide inter-arrival time in seconds, first packet 0.

    Partitioned by (source, chunk_id): a chunk's first packet looks back to
    the previous chunk's last packet through a small per-chunk boundary
    table, so no capture collapses into one task.
    """
    w = Window.partitionBy("source", "chunk_id").orderBy("packet_no")
    p = packets.withColumn("_prev", F.lag("ts_us").over(w))
    ends = (packets.groupBy("source", "chunk_id")
            .agg(F.max_by("ts_us", "packet_no").alias("_last_ts")))
    we = Window.partitionBy("source").orderBy("chunk_id")
    ends = ends.select("source", F.col("chunk_id"),
                       F.lag("_last_ts").over(we).alias("_chunk_prev"))
    return (p.join(ends, ["source", "chunk_id"], "left")
             .withColumn("capture_iat",
                         F.coalesce(F.col("ts_us") - F.coalesce("_prev", "_chunk_prev"),
                                    F.lit(0)) / F.lit(1e6))
             .drop("_prev", "_chunk_prev"))


def flow_info(packets: DataFrame) -> DataFrame:
    """Per-flow bytes, duration and time statistics.

    ``idle`` is the last gap inside the flow (NULL for a one-packet flow),
    ``active`` is the flow duration.  Times are seconds.
    """
    p = packets.withColumns(flow_key_cols())
    w = Window.partitionBy("source", "chunk_id", *FLOW_KEY).orderBy("packet_no")
    p = p.withColumns({"_gap": F.col("ts_us") - F.lag("ts_us").over(w),
                       "_d": F.col("ts_us") - F.first("ts_us").over(w)})
    ts_s = F.col("ts_us") / F.lit(1e6)
    n = F.count(F.lit(1))
    sx = F.sum("ts_us")
    return (p.groupBy("source", "chunk_id", *FLOW_KEY).agg(
        n.alias("packets"),
        F.sum("frame_len").alias("bytes"),
        ((F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)).alias("duration"),
        F.min(ts_s).alias("min_ts"), F.max(ts_s).alias("max_ts"),
        (sx / F.lit(1e6)).alias("sum_ts"),
        (sx / n / F.lit(1e6)).alias("mean_ts"),
        _exact_std("_d").alias("std_ts"),
        (F.max_by("_gap", "packet_no") / F.lit(1e6)).alias("idle"),
        ((F.max("ts_us") - F.min("ts_us")) / F.lit(1e6)).alias("active")))


def _exact_std(d: str) -> Column:
    """Population std in seconds of microsecond offsets, from exact decimal moments."""
    x = F.col(d).cast("decimal(38,0)")
    n = F.count(F.lit(1)).cast("decimal(38,0)")
    m2 = (n * F.sum(x * x) - F.sum(x) * F.sum(x)).cast("double")
    return F.sqrt(m2 / (n * n).cast("double")) / F.lit(1e6)


def flow_directions(packets: DataFrame) -> DataFrame:
    """Packets and bytes per direction of each flow (A10).

    Forward is the direction of the flow's first packet in the chunk.
    """
    p = with_flow_state(packets)
    fwd = F.col("is_fwd") == 1
    return p.groupBy("source", "chunk_id", *FLOW_KEY).agg(
        F.sum(fwd.cast("long")).alias("fwd_packets"),
        F.sum((~fwd).cast("long")).alias("bwd_packets"),
        F.sum(F.when(fwd, F.col("frame_len")).otherwise(0)).alias("fwd_bytes"),
        F.sum(F.when(~fwd, F.col("frame_len")).otherwise(0)).alias("bwd_bytes"))


def host_counts(packets: DataFrame) -> DataFrame:
    """Packets per source IP, destination IP and destination port.

    One pass with GROUPING SETS; ``key_kind`` names the set.
    """
    p = packets.select("source", "sip", "dip",
                       F.col("dport").cast("string").alias("dport_s"))
    return (p.groupingSets([["source", "sip"], ["source", "dip"], ["source", "dport_s"]],
                           "source", "sip", "dip", "dport_s")
             .agg(F.count(F.lit(1)).alias("packets"),
                  F.grouping("sip").alias("_gs"), F.grouping("dip").alias("_gd"))
             .select("source",
                     F.when(F.col("_gs") == 0, "src_ip").when(F.col("_gd") == 0, "dst_ip")
                      .otherwise("dst_port").alias("key_kind"),
                     F.coalesce("sip", "dip", "dport_s").alias("key"),
                     "packets"))


def protocol_counts(packets: DataFrame) -> DataFrame:
    """Packets per (protocol, src ip / dst ip / src port / dst port)."""
    p = packets.select("source", "proto", "sip", "dip",
                       F.col("sport").cast("string").alias("sport_s"),
                       F.col("dport").cast("string").alias("dport_s"))
    return (p.groupingSets(
                [["source", "proto", "sip"], ["source", "proto", "dip"],
                 ["source", "proto", "sport_s"], ["source", "proto", "dport_s"]],
                "source", "proto", "sip", "dip", "sport_s", "dport_s")
             .agg(F.count(F.lit(1)).alias("packets"),
                  F.grouping("sip").alias("_gs"), F.grouping("dip").alias("_gd"),
                  F.grouping("sport_s").alias("_gp"))
             .select("source", "proto",
                     F.when(F.col("_gs") == 0, "src_ip").when(F.col("_gd") == 0, "dst_ip")
                      .when(F.col("_gp") == 0, "src_port").otherwise("dst_port").alias("key_kind"),
                     F.coalesce("sip", "dip", "sport_s", "dport_s").alias("key"),
                     "packets"))


def privileged_connections(packets: DataFrame) -> DataFrame:
    """Packets to a privileged port (1..1023) per source IP and per destination IP."""
    p = packets.filter((F.col("dport") >= 1) & (F.col("dport") <= 1023))
    by_src = p.groupBy("source", F.col("sip").alias("ip")).agg(
        F.count(F.lit(1)).alias("packets")).withColumn("side", F.lit("src"))
    by_dst = p.groupBy("source", F.col("dip").alias("ip")).agg(
        F.count(F.lit(1)).alias("packets")).withColumn("side", F.lit("dst"))
    return by_src.unionByName(by_dst).select("source", "side", "ip", "packets")
