"""Count windows over chunks that land in pieces (ST5).

A chunk's packets may be spread over several landed files, cut at any packet.  A stream
keyed by (source, chunk) keeps, as managed state, what the next piece needs: per flow
its first and last time stamp, first direction and running counts, and the packets of
the window that is still open (fewer than a window's size).  Packets leave the operator
once, in whole windows, with the running columns of
:func:`netlens.operators.flows.with_flow_state`; a micro-batch therefore holds whole
windows only, and the batch operators (:func:`window_summary`) apply to it unchanged.

A chunk that gets no packet for ``idle`` of processing time is closed: its open window
is emitted short and its state is dropped.  ``idle`` must be longer than the time
between two pieces of a chunk: a piece that comes later begins its flows anew, and its
windows go on only if the table has ``kept_no``.  Pieces of a chunk must land in packet
order; one that goes back raises.  State is bounded by a chunk (10 MiB of frames).
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import LongType, StructType

from netlens.functions.decode import packet_features
from netlens.operators.flows import FLOW_KEY, flow_key_cols, flow_rates
from netlens.schema import WINDOW_PACKETS

RUNNING = ("dur_us", "iat_ns", "cum_bytes", "_d0", "_cd", "_n", "window_id")
STATE = "kept long, last_no long, flows binary, pending binary"


def _pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_all().to_pandas()


def _continue(rows: pd.DataFrame, flows: pd.DataFrame | None) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Running columns of new packets (in packet order) and the flows after them."""
    code = pd.MultiIndex.from_frame(rows[FLOW_KEY]).factorize()[0]
    by = rows.groupby(code, sort=False)
    ts, d = rows["ts_us"], rows["_d"]
    first, d0, prev = by["ts_us"].transform("first"), by["_d"].transform("first"), by["ts_us"].shift(1)
    n, cd, size = by.cumcount() + 1, by["_d"].cumsum(), by["frame_len"].cumsum()
    if flows is not None and len(flows):
        old = rows[FLOW_KEY].merge(flows, "left", FLOW_KEY).set_index(rows.index)
        known = old["n0"].notna()
        first, d0 = old["t0"].where(known, first), old["d0"].where(known, d0)
        prev = prev.fillna(old["t1"])
        n, cd, size = n + old["n0"].fillna(0), cd + old["cd0"].fillna(0), size + old["size0"].fillna(0)
    gap = (ts - prev).fillna(0)
    out = rows.assign(dur_us=ts - first, iat_ns=gap * 1000, cum_bytes=size, _d0=d0, _cd=cd, _n=n)
    out = out.astype(dict.fromkeys(RUNNING[:-1], np.int64))
    last = out.assign(t0=first, d0=d0, t1=ts, n0=n, cd0=cd, size0=size).groupby(code, sort=False).tail(1)
    last = last[[*FLOW_KEY, "t0", "d0", "t1", "n0", "cd0", "size0"]].astype(dict.fromkeys(
        ("t0", "d0", "t1", "n0", "cd0", "size0"), np.int64))
    if flows is not None and len(flows):
        last = pd.concat([flows, last]).drop_duplicates(FLOW_KEY, keep="last")
    return out, last


def _operator(columns: list[str], size: int, idle_ms: int):
    def step(key: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            pending = _unpack(state.get[3])
            state.remove()
            if len(pending):
                yield pending[columns]
            return
        rows = pd.concat(list(pieces)).sort_values("packet_no", kind="stable").reset_index(drop=True)
        kept, last_no, flows, pending = 0, None, None, None
        if state.exists:
            kept, last_no, flows, pending = state.get
            flows, pending = _unpack(flows), _unpack(pending)
            if rows["packet_no"].iloc[0] <= last_no:
                raise ValueError(f"packet {rows['packet_no'].iloc[0]} of chunk {key} lands after packet {last_no}")
        rows, flows = _continue(rows, flows)
        at = rows["kept_no"].to_numpy() - 1 if "kept_no" in rows else kept + np.arange(len(rows))
        rows["window_id"] = at // size
        kept, last_no = int(at[-1]) + 1, int(rows["packet_no"].iloc[-1])
        rows = rows[columns]
        if pending is not None and len(pending):
            rows = pd.concat([pending[columns], rows], ignore_index=True)
        whole = rows["window_id"] < kept // size
        state.update((kept, last_no, _pack(flows), _pack(rows[~whole])))
        state.setTimeoutDuration(idle_ms)
        if whole.any():
            yield rows[whole]
    return step


def start_once(writer: DataStreamWriter) -> StreamingQuery:
    """Start a query with timers for what is there now.  Spark runs empty batches as long as a
    state may time out, so a run without them ends; due timers fire in the next run's batches."""
    conf, name = SparkSession.active().conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    was = conf.get(name)
    conf.set(name, "false")
    try:
        return writer.trigger(availableNow=True).start()
    finally:
        conf.set(name, was)


def stream_packet_rows(packets: DataFrame, size: int = WINDOW_PACKETS, idle: float = 600.0) -> DataFrame:
    """Streaming form of :func:`netlens.operators.windows.packet_rows`.

    ``packets`` is a stream of decoded packets with ``source, chunk_id, packet_no`` (the
    capture reader's, :func:`netlens.functions.decode.decode_frames`).  Emits each kept packet
    once, when its window is whole or its chunk has been idle for ``idle`` seconds, with the
    same columns as the batch form.  Columns that the windows do not need (the frame) are dropped.
    """
    p = packets.filter(F.col("keep") == 1) if "keep" in packets.columns else packets
    keys = flow_key_cols()
    p = packet_features(p).drop("frame").withColumns(keys).withColumn(
        "_d", ((F.col("sip") == F.col("lo_ip")) & (F.col("sport") == F.col("lo_port"))).cast("long"))
    schema = StructType(list(p.schema.fields))
    for name in RUNNING:
        schema = schema.add(name, LongType())
    rows = p.groupBy("source", "chunk_id").applyInPandasWithState(
        _operator(schema.names, size, int(idle * 1000)), schema, STATE, "append", GroupStateTimeout.ProcessingTimeTimeout)
    return flow_rates(rows)
