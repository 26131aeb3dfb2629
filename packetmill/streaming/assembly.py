"""Flow assembly and connection windows on streams.

``stream_flows`` keeps one open flow per connection (a few numbers) and closes it by the
same rule as the batch operator: a silence of ``idle`` or an age of ``active``, noticed
either from the connection's next packet or from the watermark. ``stream_windows`` keeps
the flows of a time bucket, by shares of the destinations, until the watermark passes the bucket, with
the same halo as the batch operator, so a flooded destination is spread over buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from packetmill.operators import conn, flows
from packetmill.schemas import ACTIVE_US, CONN_WINDOW_US, HOST_WINDOW_ROWS, IDLE_US

_FLAGS = ["syn", "synack", "rst", "fin", "urg"]
_OPEN = ("start_us bigint, last_us bigint, first_seq bigint, ahead boolean, packets bigint, bytes_a bigint, "
         "bytes_b bigint, wrong_fragment bigint, " + ", ".join(f"{f} boolean" for f in _FLAGS))
_CLOSED = "conn_key string, " + _OPEN
_NAMES = [c.split()[0] for c in _OPEN.split(", ")]


def _part(rows: dict[str, np.ndarray], at: int, end: int) -> dict:
    """Fold the rows ``at`` to ``end`` of one flow, which are sorted by time."""
    a, size = rows["from_a"][at:end], rows["bytes"][at:end]
    return {
        "start_us": int(rows["ts_us"][at]), "last_us": int(rows["ts_us"][end - 1]),
        "first_seq": int(rows["seq"][at]), "ahead": bool(a[0]), "packets": end - at,
        "bytes_a": int(size[a].sum()), "bytes_b": int(size[~a].sum()),
        "wrong_fragment": int(rows["frag"][at:end].sum()), **{f: bool(rows[f][at:end].any()) for f in _FLAGS},
    }


_PACKET = ["ts_us", "seq", "from_a", "bytes", "frag", *_FLAGS]


def _sorted(batches: list[pd.DataFrame]) -> dict[str, np.ndarray]:
    """The packets' columns in the order of time and number. Arrays, since most connections have a handful of packets a batch."""
    columns = {c: np.concatenate([b[c].to_numpy() for b in batches]) for c in _PACKET}
    for c in ("frag", *_FLAGS):
        if columns[c].dtype != bool:  # nulls among them count as unset
            columns[c] = np.array([v is not None and bool(v) for v in columns[c]], bool)
    order = np.lexsort((columns["seq"], columns["ts_us"]))
    return {c: values[order] for c, values in columns.items()}


def _join(open_flow: dict | None, part: dict) -> dict:
    """Add a part to the open flow. A late packet moves its last time back, as arrival does."""
    if open_flow is None:
        return part
    out = dict(open_flow, last_us=part["last_us"])
    for c in ("packets", "bytes_a", "bytes_b", "wrong_fragment"):
        out[c] += part[c]
    for c in _FLAGS:
        out[c] = out[c] or part[c]
    return out


def _advance(open_flow: dict | None, rows: dict[str, np.ndarray], idle: int, active: int):
    """Feed sorted rows; returns (closed flows, open flow). Steps once per flow, not per row."""
    closed, at, ts = [], 0, rows["ts_us"]
    breaks = np.flatnonzero(np.diff(ts) >= idle) + 1
    while at < len(ts):
        if open_flow is not None:
            if ts[at] - open_flow["last_us"] >= idle or ts[at] - open_flow["start_us"] >= active:
                closed.append(open_flow)
                open_flow = None
        start = open_flow["start_us"] if open_flow else int(ts[at])
        later = breaks[np.searchsorted(breaks, at, side="right"):]
        end = min(int(later[0]) if len(later) else len(ts),
                  int(np.searchsorted(ts, start + active, side="left")))
        end = max(end, at + 1)
        open_flow = _join(open_flow, _part(rows, at, end))
        at = end
    return closed, open_flow


def _stepper(idle: int, active: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_flow = dict(zip(_NAMES, state.get)) if state.exists else None
        watermark_us = state.getCurrentWatermarkMs() * 1000
        closed = []
        if state.hasTimedOut:
            closed, open_flow = [open_flow], None
        else:
            # One trigger's packets of one connection; the trigger's file limit bounds it.
            closed, open_flow = _advance(open_flow, _sorted(list(batches)), idle, active)
        if open_flow is not None:
            due = min(open_flow["last_us"] + idle, open_flow["start_us"] + active)
            if due <= watermark_us:
                closed, open_flow = [*closed, open_flow], None
        if open_flow is None:
            if state.exists:
                state.remove()
        else:
            state.update(tuple(open_flow[c] for c in _NAMES))
            state.setTimeoutTimestamp(max(-(-due // 1000), state.getCurrentWatermarkMs() + 1))
        if closed:
            yield pd.DataFrame({"conn_key": [key[0]] * len(closed), **{c: [f[c] for f in closed] for c in _NAMES}})

    return step


def stream_flows(packets: DataFrame, delay: str = "10 seconds", idle: int = IDLE_US,
                 active: int = ACTIVE_US) -> DataFrame:
    """Closed flows of a packet stream, with the columns of the batch assembly."""
    pk = flows.keyed(packets, idle).withColumn("event_time", F.timestamp_micros("ts_us"))
    closed = pk.withWatermark("event_time", delay).groupBy("conn_key").applyInPandasWithState(
        _stepper(idle, active), _CLOSED, _OPEN, "append", GroupStateTimeout.EventTimeTimeout)
    due = F.least(F.col("last_us") + idle, F.col("start_us") + active)
    return flows.orient(closed).withColumn("emit_us", due).withColumn("is_flush", F.lit(False))


# --- connection windows ----------------------------------------------------------

_WIN_IN = ["conn_key", "start_us", "emit_us", "first_seq", "dst_ip", "service", "src_ip", "src_port",
           "syn_error", "rst", "is_halo"]
_WIN_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(),
              pa.bool_(), pa.bool_(), pa.bool_()]
_WIN_SCHEMA = pa.schema(list(zip(_WIN_IN, _WIN_TYPES)))
#: Arrow streams, one a batch that had rows for the group.
_WIN_STATE = "chunks array<binary>"
_COUNTS = ["n", "sn", "syn", "ssyn", "rst", "srst", "hn", "hsn", "hport", "hother", "hsyn", "hssyn", "hrst", "hsrst"]
_WIN_OUT = "conn_key string, start_us bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS)
#: Shares of the destinations. A bucket is held in as many groups at most: a group costs milliseconds a batch, however few its rows.
SHARES = 8


class _Trailing:
    """Sums over the same group among rows first..self, by prefix sums over the rows in group order."""

    def __init__(self, groups: np.ndarray):
        n = len(groups)
        self.order, self.place, self.keys = np.argsort(groups, kind="stable"), np.empty(n, np.int64), groups.astype(np.int64) * n
        self.place[self.order] = np.arange(n)
        self.sorted = self.keys[self.order] + self.order

    def begins(self, first: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.sorted, self.keys + first)

    def sums(self, begins: np.ndarray, values: np.ndarray | None = None) -> np.ndarray:
        if values is None:
            return self.place + 1 - begins
        run = np.concatenate([[0], np.cumsum(values[self.order])])
        return run[self.place + 1] - run[begins]


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers from 1 for the values of a column, 0 for null."""
    indices = column.combine_chunks().dictionary_encode().indices
    return indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1


def _bucket_counts(rows: pa.Table) -> pd.DataFrame:
    """Counts of the flows of one bucket, whatever their destinations."""
    columns = {c: rows[c].to_numpy() for c in ("emit_us", "first_seq", "syn_error", "rst", "is_halo")}
    dst = _codes(rows["dst_ip"])
    order = np.lexsort((columns["first_seq"], columns["emit_us"], dst))
    columns, dst = {c: v[order] for c, v in columns.items()}, dst[order]
    # Times of one destination lie apart from those of the next by more than a window.
    emit = columns["emit_us"] - columns["emit_us"].min()
    emit = emit + dst * (emit.max() + CONN_WINDOW_US + 1)
    first = np.searchsorted(emit, emit - CONN_WINDOW_US, side="left")
    host = np.maximum(first, np.arange(len(emit)) - HOST_WINDOW_ROWS + 1)

    def within(outer: np.ndarray, inner: np.ndarray) -> np.ndarray:
        return outer * (int(inner.max()) + 1) + inner

    service, port, source = (_codes(rows[c])[order] for c in ("service", "src_port", "src_ip"))
    by = {"": _Trailing(dst), "s": _Trailing(within(dst, service)), "port": _Trailing(within(dst, port)),
          "source": _Trailing(within(dst, np.where((service == 0) | (source == 0), 0, within(service, source))))}
    syn, rst = columns["syn_error"].astype(np.int64), columns["rst"].astype(np.int64)
    taken = pa.array(order)
    found = {c: rows[c].take(taken).to_numpy() for c in ("conn_key", "start_us")}
    for prefix, start in (("", first), ("h", host)):
        for kind in ("", "s"):
            begins = by[kind].begins(start)
            for name, values in ((f"{kind}n", None), (f"{kind}syn", syn), (f"{kind}rst", rst)):
                found[prefix + name] = by[kind].sums(begins, values)
    found["hport"] = by["port"].sums(by["port"].begins(host))
    found["hother"] = found["hsn"] - by["source"].sums(by["source"].begins(host))
    own = ~columns["is_halo"].astype(bool)
    return pd.DataFrame({c: found[c][own] for c in ("conn_key", "start_us", *_COUNTS)})


def _chunk(rows: pd.DataFrame) -> bytes:
    out = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(rows[_WIN_IN], _WIN_SCHEMA, preserve_index=False)
    with pa.ipc.new_stream(out, _WIN_SCHEMA) as writer:
        writer.write_batch(batch)
    return out.getvalue().to_pybytes()


def _window_stepper(bucket_us: int):
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            state.remove()
            yield _bucket_counts(pa.concat_tables([pa.ipc.open_stream(bytes(chunk)).read_all() for chunk in held]))
            return
        new = [b for b in batches if len(b)]
        if new:  # what is held stays as it is
            held.append(_chunk(pd.concat(new) if len(new) > 1 else new[0]))
        state.update((held,))
        end_ms = (int(key[1]) + 1) * bucket_us // 1000
        state.setTimeoutTimestamp(max(end_ms, state.getCurrentWatermarkMs() + 1))

    return step


def stream_windows(closed: DataFrame, delay: str = "30 seconds", bucket_us: int = conn.BUCKET_US, shares: int = SHARES) -> DataFrame:
    """Frame counts per flow of a stream of described flows (see ``_COUNTS``)."""
    rows = conn.with_halo(closed, bucket_us).withColumn("event_time", F.timestamp_micros("emit_us"))
    rows = rows.withColumn("share", F.pmod(F.xxhash64("dst_ip"), F.lit(shares)))
    return rows.withWatermark("event_time", delay).groupBy("share", "bucket").applyInPandasWithState(
        _window_stepper(bucket_us), _WIN_OUT, _WIN_STATE, "append", GroupStateTimeout.EventTimeTimeout)
