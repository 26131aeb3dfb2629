"""Bidirectional flow assembly.

Packets are first folded into *segments*: one row per connection and per slice of
``idle`` microseconds. Two packets of one slice are always less than the idle timeout
apart, so a slice never contains an idle break and the fold is a plain grouped aggregate
that combines on the map side; a connection that owns a third of the capture costs no
more than any other. Everything after that works on segments, of which a connection has
at most one per 30 seconds, and only the few slices in which an active timeout strikes
are looked at packet by packet again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetmill.functions import net
from packetmill.functions.numbers import slot
from packetmill.operators import clock as timeline_ops
from packetmill.schemas import ACTIVE_US, IDLE_US
from packetmill.session import materialise

_KEY = "conn_key"


def keyed(packets: DataFrame, slice_us: int = IDLE_US) -> DataFrame:
    ends = [F.col(c) for c in ("src_ip", "src_port", "dst_ip", "dst_port")]
    return packets.select(
        "seq", "ts_us",
        net.connection_key(*ends, F.col("protocol")).alias(_KEY),
        net.from_first_endpoint(*ends).alias("from_a"),
        F.greatest(F.col("length"), F.lit(0)).alias("bytes"),
        net.is_syn(F.col("flags")).alias("syn"),
        net.is_synack(F.col("flags")).alias("synack"),
        net.has_letter(F.col("flags"), "R").alias("rst"),
        net.has_letter(F.col("flags"), "F").alias("fin"),
        net.has_letter(F.col("flags"), "U").alias("urg"),
        (F.col("fragment_offset") > 0).alias("frag"),
        slot(F.col("ts_us"), slice_us).alias("slice"),
    )


_PIECE = ["head", "start_us", "last_us", "packets", "bytes_a", "bytes_b", "wrong_fragment",
          "syn", "synack", "rst", "fin", "urg"]

# The first packet by (time, arrival number) and its direction, as one number. A
# fixed-width decimal keeps the aggregate in hash buffers; a struct would need a sort.
_SHIFT = 10 ** 18


def _head_code():
    tail = (F.col("seq") * 2 + F.col("from_a").cast("long")).cast("decimal(18,0)")
    return (F.col("ts_us").cast("decimal(18,0)") * F.lit(_SHIFT).cast("decimal(19,0)")
            + tail).cast("decimal(38,0)")


def _head_tail(head, start_us):
    return (head - start_us.cast("decimal(18,0)") * F.lit(_SHIFT).cast("decimal(19,0)")).cast("long")


def _head_seq(head, start_us):
    return F.shiftright(_head_tail(head, start_us), 1)


def _fold():
    """Aggregates of a set of packets; all of them can be merged again by ``_merge``."""
    return [
        F.min(_head_code()).alias("head"),
        F.min("ts_us").alias("start_us"),
        F.max("ts_us").alias("last_us"),
        F.count(F.lit(1)).alias("packets"),
        F.sum(F.when(F.col("from_a"), F.col("bytes")).otherwise(0)).alias("bytes_a"),
        F.sum(F.when(F.col("from_a"), 0).otherwise(F.col("bytes"))).alias("bytes_b"),
        F.sum(F.col("frag").cast("long")).alias("wrong_fragment"),
        *[F.bool_or(c).alias(c) for c in ("syn", "synack", "rst", "fin", "urg")],
    ]


def _merge():
    return [
        F.min("head").alias("head"),
        F.min("start_us").alias("start_us"),
        F.max("last_us").alias("last_us"),
        *[F.sum(c).alias(c) for c in ("packets", "bytes_a", "bytes_b", "wrong_fragment")],
        *[F.bool_or(c).alias(c) for c in ("syn", "synack", "rst", "fin", "urg")],
    ]


def _segments(pk: DataFrame) -> DataFrame:
    return pk.groupBy(_KEY, "slice").agg(*_fold())


def _idle_sessions(segments: DataFrame, pk: DataFrame, arrival: bool, idle: int) -> DataFrame:
    """Add ``gap_us`` (silence before the segment) and ``opens`` (an idle break precedes it)."""
    order = Window.partitionBy(_KEY).orderBy("slice")
    seg = segments.withColumn("prev_last", F.lag("last_us").over(order))
    seg = seg.withColumn("gap_us", F.col("start_us") - F.col("prev_last"))
    long_gap = F.col("gap_us") >= idle
    if not arrival:
        return seg.withColumn("opens", F.col("gap_us").isNull() | long_gap)
    # On the arrival clock a flow ends only when some packet is seen at or after
    # last + idle and before the connection's own next packet.
    asked = seg.where(long_gap).select(
        _KEY, "slice", "start_us", _head_seq(F.col("head"), F.col("start_us")).alias("own_seq"),
        (F.col("prev_last") + idle).alias("deadline"))
    broken = (
        timeline_ops.next_packet(asked, "deadline", pk)
        .where((F.col("next_us") < F.col("start_us")) | (F.col("next_seq") < F.col("own_seq")))
        .select(_KEY, "slice", F.lit(True).alias("broken"))
    )
    seg = seg.join(broken, [_KEY, "slice"], "left")
    return seg.withColumn("opens", F.col("gap_us").isNull() | F.coalesce("broken", F.lit(False))).drop("broken")


def _with_session(seg: DataFrame, active: int) -> DataFrame:
    """Number the sessions of a connection and mark those the active timeout can split."""
    running = Window.partitionBy(_KEY).orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    seg = seg.withColumn("session", F.sum(F.col("opens").cast("int")).over(running))
    whole = Window.partitionBy(_KEY, "session")
    return seg.withColumn("begin_us", F.min("start_us").over(whole)).withColumn(
        "is_long", F.max("last_us").over(whole) - F.col("begin_us") >= active)


def _active_starts(seg: DataFrame, pk: DataFrame, arrival: bool, active: int) -> DataFrame:
    """Times at which the active timeout opens a new flow inside a long session.

    Flow starts follow one another, so they come from a walk over the session. What is
    walked is pruned first, exactly: the k-th start misses ``begin + k * active`` by at
    most the silences met on the way, so a packet can only be a start if its offset
    within the period is no larger than the sum of the largest silences of all slices up
    to its own. An even connection has few candidates, a bursty one keeps all its packets; they
    are read in order, batch by batch, and never gathered.
    """
    inner = F.when(F.col("opens"), F.lit(0)).otherwise(F.col("gap_us")).alias("gap_in")
    slices = seg.where("is_long").select(_KEY, "session", "slice", "begin_us", "opens", inner)

    points = pk.select(_KEY, "slice", "ts_us", "seq").join(slices, [_KEY, "slice"])
    in_slice = Window.partitionBy(_KEY, "slice").orderBy("ts_us", "seq")
    points = points.withColumn(
        "gap", F.coalesce(F.col("ts_us") - F.lag("ts_us").over(in_slice), F.col("gap_in")))
    silence = points.groupBy(_KEY, "session", "slice").agg(F.max("gap").alias("silence"))
    so_far = Window.partitionBy(_KEY, "session").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
    # Two consecutive gaps can precede a start on the arrival clock, one otherwise.
    slack = silence.select(
        _KEY, "slice", (F.sum("silence").over(so_far) * (2 if arrival else 1)).alias("slack"))
    candidates = (
        points.join(slack, [_KEY, "slice"])
        .where(F.pmod(F.col("ts_us") - F.col("begin_us"), F.lit(active)) <= F.col("slack"))
        .select(_KEY, "session", "slice", "opens", "ts_us", "seq")
    )
    if arrival:
        candidates = timeline_ops.previous_packet_time(candidates, pk)
    else:
        candidates = candidates.withColumn("prev_global_us", F.lit(None).cast("long"))

    # A connection's candidates come as a sorted stream; the walk holds one start, however many there are.
    stream = (candidates.select(_KEY, "session", "slice", "opens", "ts_us", "seq", "prev_global_us")
              .repartition(_KEY).sortWithinPartitions(_KEY, "session", "ts_us", "seq"))
    return stream.mapInArrow(
        _walk(arrival, active), f"{_KEY} string, slice bigint, opens boolean, split_us bigint, split_seq bigint")


def _walk(arrival: bool, active: int):
    """Starts after the first of each session, from points in order; sessions may cross batches.

    From a start the walk jumps to the first point at or past the deadline. On the arrival clock the flow takes
    this first overdue packet of its own along, and the next one opens, unless another packet at or past the deadline
    was seen before it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, start, closed = None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.array(batch.column(0).to_pylist(), object)
            session, ts = batch.column(1).to_numpy(), batch.column(4).to_numpy()
            seen = pc.fill_null(batch.column(6), np.iinfo(np.int64).min).to_numpy()
            firsts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (session[1:] != session[:-1])])
            found = []
            for lo, hi in zip(firsts, np.append(firsts[1:], len(ts))):
                at = lo
                if (keys[lo], session[lo]) != current:
                    current, start, closed, at = (keys[lo], session[lo]), ts[lo], False, lo + 1
                while at < hi:
                    if not closed:
                        at += np.searchsorted(ts[at:hi], start + active)
                        if at >= hi:
                            break
                        if arrival and seen[at] < start + active:
                            closed, at = True, at + 1
                            continue
                    found.append(at)
                    start, closed, at = ts[at], False, at + 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(i).take(pa.array(found, pa.int64())) for i in (0, 2, 3, 4, 5)],
                names=[_KEY, "slice", "opens", "split_us", "split_seq"])

    return run


def assemble(packets: DataFrame, clock: str = "event_time",
             idle: int = IDLE_US, active: int = ACTIVE_US) -> DataFrame:
    """One row per flow.

    ``clock="event_time"`` closes a flow at a silence of ``idle`` or ``active`` after its
    start and needs no order across connections. ``clock="arrival"`` reproduces a single
    collector whose clock is the packet just seen: timeouts are noticed only when some
    packet arrives, and a flow includes its own first overdue packet.
    """
    arrival = clock == "arrival"
    pk = keyed(packets, idle)
    seg = _with_session(_idle_sessions(_segments(pk), pk, arrival, idle), active)
    seg = materialise(seg, "segments")
    # Starts are at least ``active`` apart and a slice is shorter: one split per slice.
    splits = materialise(_active_starts(seg, pk, arrival, active), "splits")

    whole = seg.join(splits, [_KEY, "slice"], "left_anti").select("opens", _KEY, *_PIECE)
    tail = (F.col("ts_us") > F.col("split_us")) | (
        (F.col("ts_us") == F.col("split_us")) & (F.col("seq") >= F.col("split_seq")))
    cut = (
        pk.join(splits, [_KEY, "slice"])
        .groupBy(_KEY, "slice", "opens", tail.alias("tail")).agg(*_fold())
        .select((F.col("opens") | F.col("tail")).alias("opens"), _KEY, *_PIECE)
    )
    order = Window.partitionBy(_KEY).orderBy("head").rowsBetween(
        Window.unboundedPreceding, 0)
    pieces = whole.unionByName(cut).withColumn("flow_no", F.sum(F.col("opens").cast("int")).over(order))
    flows = _finish(pieces.groupBy(_KEY, "flow_no").agg(*_merge()))
    if arrival:
        return _arrival_emission(flows, pk, idle, active)
    due = F.least(F.col("last_us") + idle, F.col("start_us") + active)
    return flows.withColumn("emit_us", due).withColumn("is_flush", F.lit(False))


def _finish(flows: DataFrame) -> DataFrame:
    tail = _head_tail(F.col("head"), F.col("start_us"))
    return orient(flows.withColumn("first_seq", F.shiftright(tail, 1)).withColumn("ahead", tail % 2 == 1))


def orient(flows: DataFrame) -> DataFrame:
    """Turn the two sides of a connection into source and destination.

    ``ahead`` tells whether the first packet came from the first endpoint of the key.
    """
    parts = F.split(F.col(_KEY), r"\|")

    def endpoint(i):
        port = F.substring_index(parts[i], ":", -1)
        return parts[i].substr(F.lit(1), F.length(parts[i]) - F.length(port) - 1), port.cast("int")

    (a_ip, a_port), (b_ip, b_port) = endpoint(0), endpoint(1)
    ahead = F.col("ahead")

    def side(x, y):
        return F.when(ahead, x).otherwise(y)

    return flows.select(
        _KEY, "first_seq",
        side(a_ip, b_ip).alias("src_ip"), side(b_ip, a_ip).alias("dst_ip"),
        side(a_port, b_port).alias("src_port"), side(b_port, a_port).alias("dst_port"),
        parts[2].alias("protocol"),
        "start_us", "last_us", "packets",
        side(F.col("bytes_a"), F.col("bytes_b")).alias("src_bytes"),
        side(F.col("bytes_b"), F.col("bytes_a")).alias("dst_bytes"),
        "wrong_fragment", "syn", "synack", "rst", "fin", "urg",
    )


def _arrival_emission(flows: DataFrame, pk: DataFrame, idle: int, active: int) -> DataFrame:
    """A flow is emitted at the first packet past its deadline, or flushed at the end."""
    due = F.least(F.col("last_us") + idle, F.col("start_us") + active)
    seen = timeline_ops.next_packet(flows.withColumn("deadline_us", due), "deadline_us", pk)
    return (
        seen.withColumn("emit_us", F.coalesce("next_us", "last_us"))
        .withColumn("is_flush", F.col("next_us").isNull())
        .drop("deadline_us", "next_us", "next_seq")
    )


def describe(flows: DataFrame) -> DataFrame:
    """Add flow id, service, flag, error state, duration, land, urgent and ISO times."""
    state = [F.col(c) for c in ("syn", "synack", "rst")]
    return flows.select(
        "*",
        net.record_flow_id(F.col(_KEY), F.col("start_us")).alias("flow_id"),
        net.service_of(F.col("protocol"), F.col("dst_port")).alias("service"),
        net.connection_flag(*state).alias("flag"),
        net.syn_error(*state).alias("syn_error"),
        F.floor(F.greatest(F.col("last_us") - F.col("start_us"), F.lit(0)) / F.lit(1_000_000))
        .cast("long").alias("duration"),
        (F.col("src_ip") == F.col("dst_ip")).cast("int").alias("land"),
        F.col("urg").cast("int").alias("urgent"),
        net.iso_utc(F.col("start_us")).alias("flow_start_time"),
        net.iso_utc(F.col("last_us")).alias("timestamp"),
    )
