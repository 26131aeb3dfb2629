"""Connection-window features of emitted flows.

Every frame looks back at most ``CONN_WINDOW_US`` and stays within one destination, so
flows are cut into (destination, time bucket) groups, each bucket preceded by a *halo*: a
copy of the rows in the last window of the bucket before it. A destination under flood is
thereby spread over as many tasks as it has buckets, in a single shuffle.

Inside a group no frame is ever summed anew: a trailing count is the running count up to
the row minus the running count of what has left the frame. Both of these start unbounded,
which Spark evaluates in one forward pass, so a crowded window costs the same per row as
an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetmill.functions.numbers import slot

from packetmill.schemas import CONN_WINDOW_US, HOST_WINDOW_ROWS

BUCKET_US = 10_000_000


def with_halo(flows: DataFrame, bucket_us: int = BUCKET_US, window_us: int = CONN_WINDOW_US) -> DataFrame:
    """Assign ``bucket`` and repeat the tail of each bucket as context of the next one."""
    own = slot(F.col("emit_us"), bucket_us)
    last = slot((F.col("emit_us") + F.lit(window_us)), bucket_us)
    return flows.withColumn("_own", own).withColumn(
        "bucket", F.explode(F.when(last > own, F.array(own, last)).otherwise(F.array(own)))
    ).withColumn("is_halo", F.col("bucket") != F.col("_own")).drop("_own")


def connection_windows(flows: DataFrame, bucket_us: int = BUCKET_US,
                       window_us: int = CONN_WINDOW_US, host_rows: int = HOST_WINDOW_ROWS,
                       digits: int | None = 6) -> DataFrame:
    """Add the eight trailing-window and ten host-window features.

    ``digits=None`` leaves rates unrounded. Rows at the same emission time see each other
    only in the order of ``first_seq``, as they were emitted one after another.
    """
    rows = with_halo(flows, bucket_us, window_us)
    one, syn, rst = F.lit(1), F.col("syn_error").cast("int"), F.col("rst").cast("int")
    start = Window.unboundedPreceding

    def group(*keys):
        return Window.partitionBy("dst_ip", "bucket", *keys)

    def running(window, value, gone):
        """Sum up to the row minus the sum over the rows that left the frame."""
        upto = window.rowsBetween(start, 0)
        return F.sum(value).over(upto) - F.coalesce(F.sum(value).over(gone), F.lit(0))

    def in_time(keys, value):
        ordered = group(*keys).orderBy("emit_us", "first_seq")
        return running(ordered, value, group(*keys).orderBy("emit_us").rangeBetween(start, -window_us - 1))

    def in_rows(keys, value):
        """Over the last ``host_rows`` connections of the destination, by their position."""
        ordered = group(*keys).orderBy("_at")
        return running(ordered, value, ordered.rangeBetween(start, -host_rows))

    # Position within the destination; all groups below are subsets of it, so none of
    # their windows needs another shuffle.
    rows = rows.withColumn("_at", F.row_number().over(group().orderBy("emit_us", "first_seq")))
    srv, port, source = ["service"], ["src_port"], ["service", "src_ip"]
    frames = {"n": ([], one), "syn": ([], syn), "rst": ([], rst), "sn": (srv, one), "ssyn": (srv, syn),
              "srst": (srv, rst), "port": (port, one), "source": (source, one)}
    rows = rows.withColumns({f"_{k}": in_time(*f) for k, f in frames.items()})
    # Both frames end at the row itself, so the shorter one, and with it the frame that
    # satisfies both limits, is the one with the smaller counts.
    rows = rows.withColumns({f"_h{k}": F.least(f"_{k}", in_rows(*f)) for k, f in frames.items()})
    rows = rows.where(~F.col("is_halo"))
    h = {k: F.col(f"_h{k}") for k in frames}

    def rate(part: Column, whole: Column) -> Column:
        whole = F.greatest(one, whole)
        if digits is None:
            return part / whole
        # Half-even on the scaled quotient; far cheaper than decimal rounding.
        scale = F.lit(10.0 ** digits)
        return F.rint(part * scale / whole) / scale

    def rest(part: Column, whole: Column) -> Column:
        return 1.0 - rate(part, whole) if digits is None else rate(F.greatest(one, whole) - part, whole)

    n, sn = F.col("_n"), F.col("_sn")
    out = {
        "count": F.greatest(one, n),
        "srv_count": F.greatest(one, sn),
        "serror_rate": rate(F.col("_syn"), n),
        "srv_serror_rate": rate(F.col("_ssyn"), sn),
        "rerror_rate": rate(F.col("_rst"), n),
        "srv_rerror_rate": rate(F.col("_srst"), sn),
        "same_srv_rate": rate(sn, n),
        "diff_srv_rate": rest(sn, n),
        "dst_host_count": F.greatest(one, h["n"]),
        "dst_host_srv_count": F.greatest(one, h["sn"]),
        "dst_host_same_srv_rate": rate(h["sn"], h["n"]),
        "dst_host_diff_srv_rate": rest(h["sn"], h["n"]),
        "dst_host_same_src_port_rate": rate(h["port"], h["n"]),
        "dst_host_srv_diff_host_rate": rate(h["sn"] - h["source"], h["sn"]),
        "dst_host_serror_rate": rate(h["syn"], h["n"]),
        "dst_host_srv_serror_rate": rate(h["ssyn"], h["sn"]),
        "dst_host_rerror_rate": rate(h["rst"], h["n"]),
        "dst_host_srv_rerror_rate": rate(h["srst"], h["sn"]),
    }
    helpers = ["bucket", "is_halo", "_at", *[f"_{k}" for k in frames], *[f"_h{k}" for k in frames]]
    return rows.withColumns(out).drop(*helpers)
