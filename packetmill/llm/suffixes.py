"""Removal of repeated byte strings through a suffix array built column by column.

Every ``span``-byte window is owned by one anchor, the leftmost smallest k-gram hash inside it, so equal windows have
equal anchors. Consecutive windows of one anchor are a run, its bytes a segment. Segments with an
anchor that no other text has cannot repeat; of equal segments all but the first repeat as a whole. What is left
are different segments with equal anchors, and for these the suffix array of the collection decides.

It is built by inserting one symbol of every segment in each round, from the last to the first: the position of a
new suffix follows from the Burrows-Wheeler transform of the collection so far, the common prefixes of its neighbours
from the ones before. Both are files that each round reads and writes in sequence; whose suffix stands where is read off
the finished transform.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetmill.llm.common import batch_rows, input_bytes, texts_of, with_key
from packetmill.session import materialise

SPAN, GRAM = 100, 50
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
# Bytes hashed at a time, and bytes whose runs are compared before they leave a task.
_AT_ONCE, _GATHER = 1 << 20, 24 << 20
_RUN = np.dtype([("m", "<u8"), ("r", "<u8"), ("key", "<i8"), ("a", "<u4"), ("w", "u1")])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sums(b: np.ndarray) -> np.ndarray:
    """Prefix sums of byte times power: the polynomial hash of any substring is a difference times an inverse power."""
    powers = np.full(len(b), _BASE, np.uint64)
    if len(b):
        powers[0] = 1
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(np.cumprod(powers) * (b.astype(np.uint64) + np.uint64(1)), out=out[1:])
    return out


def _inverses(n: int) -> np.ndarray:
    powers = np.full(n, _INVERSE, np.uint64)
    powers[:1] = 1
    return np.cumprod(powers)


def runs_of(b: np.ndarray, ends: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor in texts laid end to end; ``ends`` are the texts' ends.

    Returns ``(anchor hash, segment hash, first window, windows)``; at most ``span - gram + 1`` windows a run.
    """
    grams, wide = len(b) - gram + 1, span - gram + 1
    if len(b) < span:
        empty = np.empty(0, np.uint64)
        return empty, empty, np.empty(0, np.int64), np.empty(0, np.int64)
    sums, inverse = _sums(b), _inverses(len(b))
    h = _mixed((sums[gram:] - sums[:grams]) * inverse[:grams])
    low = (h & ~np.uint64((1 << 24) - 1)) | np.arange(grams, dtype=np.uint64)
    width = 1
    while width * 2 <= wide:
        low = np.minimum(low[:len(low) - width], low[width:])
        width *= 2
    if wide > width:
        low = np.minimum(low[:len(low) - (wide - width)], low[wide - width:])
    at = np.arange(len(low))
    text = np.searchsorted(ends, at, "right")
    whole = at + span <= ends[text]
    first = np.flatnonzero(whole & np.r_[True, (low[1:] != low[:-1]) | ~whole[:-1] | (text[1:] != text[:-1])])
    last = np.flatnonzero(whole & np.r_[(low[1:] != low[:-1]) | ~whole[1:] | (text[1:] != text[:-1]), True])
    anchor = h[(low[first] & np.uint64((1 << 24) - 1)).astype(np.int64)]
    segment = _mixed((sums[last + span] - sums[first]) * inverse[first] + (last - first).astype(np.uint64))
    return anchor, segment, first, last - first + 1


def text_runs(keys: list[int], raws: list[bytes], span: int, gram: int) -> Iterator[np.ndarray]:
    """Runs of many texts as records. Long texts are cut with an overlap, which only cuts runs."""
    jobs, size = [], 0

    def flush():
        b = np.frombuffer(b"".join(r for _, _, r in jobs), np.uint8)
        ends = np.cumsum([len(r) for _, _, r in jobs])
        m, r, a, w = runs_of(b, ends, span, gram)
        owner = np.searchsorted(ends, a, "right")
        out = np.empty(len(m), _RUN)
        out["m"], out["r"], out["w"] = m, r, w
        out["key"] = np.array([k for k, _, _ in jobs])[owner]
        out["a"] = a - (ends[owner] - np.array([len(r) for _, _, r in jobs])[owner]) + np.array([o for _, o, _ in jobs])[owner]
        return out

    for key, raw in zip(keys, raws):
        for at in range(0, max(len(raw) - span + 1, 0), _AT_ONCE):
            jobs.append((key, at, raw[at:at + _AT_ONCE + span - 1]))
            size += len(jobs[-1][2])
            if size >= _AT_ONCE:
                yield flush()
                jobs, size = [], 0
    if jobs:
        yield flush()


def firsts(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by (anchor, segment, key, place): the records, and whether each is the first of its segment."""
    runs = runs[np.lexsort((runs["a"], runs["key"], runs["r"], runs["m"]))]
    same = (runs["m"][1:] == runs["m"][:-1]) & (runs["r"][1:] == runs["r"][:-1]) & (runs["w"][1:] == runs["w"][:-1])
    return runs, np.r_[True, ~same][:len(runs)]


class ColumnFiles:
    """The collection so far as files of equal length: the symbol before each suffix and its common prefix with the one before."""

    COLUMNS = {"bwt": np.dtype("u1"), "lcp": np.dtype("u1")}

    def __init__(self, folder: str, block: int = 1 << 20):
        self.folder, self.block, self.round = folder, block, 0

    def path(self, column: str, number: int) -> str:
        return os.path.join(self.folder, f"{column}.{number}")

    def read(self, column: str) -> np.ndarray:
        return np.fromfile(self.path(column, self.round), self.COLUMNS[column])

    def begin(self, values: dict[str, np.ndarray]) -> None:
        for c, t in self.COLUMNS.items():
            values[c].astype(t).tofile(self.path(c, 0))

    def insert(self, places: np.ndarray, new: dict[str, np.ndarray], changed: dict[str, tuple]) -> None:
        """Merge new rows at their final ``places`` (ascending) into the old ones, block by block.

        ``changed`` sets old rows of a column, by their old number, before they are copied.
        """
        for c, t in self.COLUMNS.items():
            old_path, new_path = self.path(c, self.round), self.path(c, self.round + 1)
            total = os.path.getsize(old_path) // t.itemsize + len(places)
            rows, values = changed.get(c, (np.empty(0, np.int64), np.empty(0, t)))
            taken = 0
            with open(old_path, "rb") as source, open(new_path, "wb") as target:
                for at in range(0, total, self.block):
                    stop = min(at + self.block, total)
                    lo, hi = np.searchsorted(places, [at, stop])
                    out, mine = np.empty(stop - at, t), np.zeros(stop - at, bool)
                    mine[places[lo:hi] - at] = True
                    old = np.fromfile(source, t, stop - at - (hi - lo))
                    x, y = np.searchsorted(rows, [taken, taken + len(old)])
                    old[rows[x:y] - taken] = values[x:y]
                    taken += len(old)
                    out[mine], out[~mine] = new[c][lo:hi], old
                    out.tofile(target)
            os.remove(old_path)
        self.round += 1

    def remove(self) -> None:
        for c in self.COLUMNS:
            os.remove(self.path(c, self.round))


class RangeMin:
    """Minima of ranges of bytes: both ends are read, whole blocks between them answered by two stretches of a power of two."""

    STEPS = 4  # blocks of 1 << STEPS values

    def __init__(self, values: np.ndarray):
        wide = 1 << self.STEPS
        self.values, least = values, values[:len(values) // wide * wide]
        for _ in range(self.STEPS):
            least = np.minimum(least[::2], least[1::2])
        self.levels, step = [least], 1
        while 2 * step <= len(least):
            self.levels.append(np.minimum(self.levels[-1][:-step], self.levels[-1][step:]))
            step *= 2

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Minimum of ``values[begin:end]``, every range holding something."""
        near = np.arange(1 << self.STEPS)
        out = np.minimum(self.values[np.minimum(begin[:, None] + near, end[:, None] - 1)].min(axis=1, initial=255),
                         self.values[np.maximum(end[:, None] - 1 - near, begin[:, None])].min(axis=1, initial=255))
        first, last = -(-begin >> self.STEPS), end >> self.STEPS
        inside = np.flatnonzero(last > first)
        level = np.frexp(last[inside] - first[inside])[1] - 1
        for k in np.unique(level):
            rows = inside[level == k]
            table = self.levels[k]
            out[rows] = np.minimum(out[rows], np.minimum(table[first[rows]], table[last[rows] - (1 << k)]))
        return out


def suffix_array(segments: list[bytes], folder: str, block: int = 1 << 20) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(owner, size, lcp)`` of all suffixes of all segments in order; ``lcp`` is with the suffix before.

    Equal suffixes stand in the order of the segments. Segments have 1 to 254 bytes; symbols are counted from 1, since 0 ends a segment.
    """
    n = len(segments)
    sizes = np.array([len(s) for s in segments])
    longest = int(sizes.max())
    if longest > 254 or sizes.min() < 1:
        raise ValueError("segments have 1 to 254 bytes")
    # Right-aligned symbols: column t holds the symbol of round t.
    columns = np.zeros((longest + 1, n), np.uint16)
    for s, seg in enumerate(segments):
        columns[:len(seg), s] = np.frombuffer(seg, np.uint8)[::-1].astype(np.uint16) + 1
    kinds = np.unique(columns)
    codes = np.searchsorted(kinds, columns).astype(np.uint8) if len(kinds) <= 256 else None
    if codes is None:
        raise ValueError("a collection uses at most 255 different bytes")
    files = ColumnFiles(folder, block)
    # The empty suffixes, one a segment, in the order of the segments.
    files.begin({"bwt": codes[0], "lcp": np.zeros(n)})
    place = np.arange(n)  # where the longest suffix so far of each segment stands
    for t in range(longest):
        active = np.flatnonzero(sizes > t)
        bwt, least = files.read("bwt"), RangeMin(files.read("lcp"))
        order = np.argsort(bwt, kind="stable")
        finished = int(np.count_nonzero(bwt == 0))
        rank = np.empty(len(bwt), np.int64)
        rank[order] = np.arange(len(bwt))
        mine = rank[place[active]]  # in the order by symbol, then by the suffix behind it
        final = mine - finished + n
        by_place = np.argsort(final)
        active, mine, final = active[by_place], mine[by_place], final[by_place]
        here, before = order[mine], order[mine - 1]
        same = (mine > 0) & (bwt[before] == bwt[here])
        prefix = np.zeros(len(mine), np.uint8)
        if same.any():
            prefix[same] = 1 + least(before[same] + 1, here[same] + 1)
        after = order[np.minimum(mine + 1, len(order) - 1)]
        follows = (mine + 1 < len(order)) & (bwt[after] == bwt[here])
        # The row after a new one, if it is an old one with the same symbol, gets a new common prefix.
        is_new = np.zeros(len(order), bool)
        is_new[mine] = True
        old_next = follows & ~is_new[np.minimum(mine + 1, len(order) - 1)]
        rows = np.flatnonzero(old_next)
        changed_rows = final[rows] + 1 - np.searchsorted(final, final[rows] + 1)
        changed = 1 + least(here[rows] + 1, after[rows] + 1) if len(rows) else np.empty(0, np.uint8)
        files.insert(final, {"bwt": codes[t + 1][active], "lcp": prefix}, {"lcp": (changed_rows, changed.astype(np.uint8))})
        # Old rows moved up behind the new ones; only the new ones are longest suffixes of active segments.
        place[active] = final
    bwt, lcp = files.read("bwt"), files.read("lcp")
    files.remove()
    # A suffix's place among all, in the order by the symbol before it, is the place of the suffix one symbol longer.
    longer = np.empty(len(bwt), np.int64)
    longer[np.argsort(bwt, kind="stable")] = np.arange(len(bwt))
    owner, size, place = np.empty(len(bwt), np.int64), np.zeros(len(bwt), np.int64), np.arange(n)
    owner[:n] = place
    for t in range(longest):
        active = np.flatnonzero(sizes > t)
        place[active] = longer[place[active]]
        owner[place[active]], size[place[active]] = active, t + 1
    return owner, size, lcp


def repeated_windows(segments: list[bytes], keys: np.ndarray, starts: np.ndarray, span: int, folder: str) -> Iterator[tuple[int, int, int]]:
    """``(key, first window, windows)`` of all windows in the segments that also start earlier in one of them."""
    owner, size, lcp = suffix_array(segments, folder)
    full = size >= span
    sizes = np.array([len(s) for s in segments])
    own, at = owner[full], starts[owner[full]] + sizes[owner[full]] - size[full]
    # Rows of one class are neighbours: shorter suffixes never stand between them.
    joined = lcp[full] >= span
    if not joined.any():
        return
    first = np.flatnonzero(~joined)
    order = np.empty(len(own), np.int64)
    order[np.lexsort((at, keys[own]))] = np.arange(len(own))
    least = np.minimum.reduceat(order, first)
    repeated = order != np.repeat(least, np.diff(np.append(first, len(own))))
    k, p = keys[own[repeated]], at[repeated]
    ranked = np.lexsort((p, k))
    k, p = k[ranked], p[ranked]
    new = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]) | (p[1:] != p[:-1] + 1)])
    for i, j in zip(new, np.append(new[1:], len(k))):
        yield int(k[i]), int(p[i]), int(j - i)


def covered(starts: np.ndarray, counts: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte runs ``(begin, end)`` covered by the windows that start at ``starts ... starts + counts - 1``."""
    order = np.argsort(starts, kind="stable")
    begin, end = starts[order], np.maximum.accumulate(starts[order] + counts[order] - 1 + span)
    new = np.flatnonzero(np.r_[True, begin[1:] > end[:-1]][:len(begin)])
    return begin[new], end[np.append(new[1:], len(begin)) - 1] if len(begin) else end


def window_hashes(segment: bytes, span: int) -> np.ndarray:
    """The hash of every ``span``-byte window of a segment."""
    sums, n = _sums(np.frombuffer(segment, np.uint8)), len(segment) - span + 1
    return _mixed((sums[span:] - sums[:n]) * _inverses(n))


def in_buckets(asked: DataFrame, bucket_segments: int) -> DataFrame:
    """Segments with the ``bucket`` that sorts them, by anchor; -1 for an anchor with more than ``bucket_segments`` segments."""
    heavy = materialise(asked.groupBy("m").count().filter(F.col("count") > bucket_segments).select("m", F.lit(-1).alias("heavy")), "repeat-heavy")
    marked = asked.join(heavy, "m", "left")
    groups = max(1, -(-marked.filter("heavy is null").count() // bucket_segments))
    return marked.withColumn("bucket", F.coalesce(F.col("heavy").cast("long"), F.pmod(F.xxhash64("m"), F.lit(groups)))).drop("heavy")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM,
                   bucket_bytes: int = 4 << 20, bucket_segments: int = 8192) -> DataFrame:
    """Remove each byte covered by a ``span``-byte string that also starts earlier.

    Earlier is a smaller id, or an earlier place in the same text. Returns ``id_col, n_bytes, starts, ends`` (the removed
    byte runs) and ``kept`` (the remaining bytes, perhaps not whole characters) per row. Strings are judged on the
    input; matches don't cross documents. Null and empty texts have no bytes. Repeated and null ids are
    documents of their own, nulls last, equal ids in the order of their texts; an empty table gives an empty result.

    Runs leave a task packed by bucket of their anchor, and only the first of equal segments does, so a text that
    a third of all documents hold costs a row per task. Only segments that share an anchor with a
    different segment are fetched and sorted. An anchor with more than ``bucket_segments`` of them (one string with as many
    different surroundings) is not sorted in one task: its windows are told apart by the hash of their bytes.
    """
    rows = with_key(docs.select(id_col, text_col), id_col, tie=text_col).select(
        "__key", F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    buckets = max(1, -(-input_bytes(rows) // bucket_bytes))

    def leave(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        runs, first = firsts(np.concatenate(parts))
        for kind, chosen in ((0, runs[first]), (1, runs[~first])):
            if not len(chosen):
                continue
            bucket = ((chosen["m"] if kind == 0 else chosen["key"].view("<u8")) >> np.uint64(0 if kind else 32)) % np.uint64(buckets)
            chosen = chosen[np.argsort(bucket, kind="stable")]
            numbers, counts = np.unique(bucket, return_counts=True)
            ends = np.cumsum(counts)
            for at in range(0, len(numbers), 64):
                stop = min(at + 64, len(numbers))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[at:stop].astype(np.int64)), pa.array([kind] * (stop - at), pa.int32()),
                     pa.array([chosen[e - c:e].tobytes() for e, c in zip(ends[at:stop], counts[at:stop])], pa.binary())],
                    names=["bucket", "kind", "runs"])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            raws = [t.encode("utf-8") for t in texts_of(batch.column(1))]
            parts += text_runs(batch.column(0).to_pylist(), raws, span, gram)
            size += sum(map(len, raws))
            if size > _GATHER:
                yield from leave(parts)
                parts, size = [], 0
        if parts:
            yield from leave(parts)

    def match(table: pa.Table) -> pa.Table:
        """kind 1: repeats as a whole; kind 0: shares its anchor with a different segment."""
        kinds, packed = table.column("kind").to_pylist(), table.column("runs").to_pylist()
        gone = [np.frombuffer(p, _RUN) for k, p in zip(kinds, packed) if k]
        open_ = [np.frombuffer(p, _RUN) for k, p in zip(kinds, packed) if not k]
        asked = np.empty(0, _RUN)
        if open_:
            runs, first = firsts(np.concatenate(open_))
            gone.append(runs[~first])
            runs = runs[first]
            shared = runs["m"][1:] == runs["m"][:-1]
            asked = runs[np.r_[False, shared] | np.r_[shared, False]]
        both = np.concatenate([*gone, asked])
        kind = np.repeat([1, 0], [len(both) - len(asked), len(asked)])
        return pa.table({"kind": pa.array(kind, pa.int32()), "m": pa.array(both["m"].view("<i8")), "key": pa.array(both["key"]),
                         "a": pa.array(both["a"].astype(np.int64)), "w": pa.array(both["w"].astype(np.int32))})

    dealt = rows.select("__key", "text").mapInArrow(gather, "bucket long, kind int, runs binary")
    runs = materialise(dealt.groupBy("bucket").applyInArrow(match, "kind int, m long, key long, a long, w int"), "repeat-runs")
    asked = runs.filter("kind = 0")
    asked = materialise(in_buckets(asked, bucket_segments), "repeat-asked")

    def wanted(chosen: DataFrame) -> DataFrame:
        return chosen.groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("bucket", "m", "a", "w")).alias("pieces"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"bucket": [], "key": [], "a": [], "segment": []}
            for key, text, pieces in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode("utf-8")
                for p in pieces:
                    out["bucket"].append(p["bucket"])
                    out["key"].append(key)
                    out["a"].append(p["a"])
                    out["segment"].append(raw[p["a"]:p["a"] + p["w"] - 1 + span])
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int64()), pa.array(out["key"], pa.int64()),
                                              pa.array(out["a"], pa.int64()), pa.array(out["segment"], pa.binary())], names=list(out))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The single windows of segments, by the hash of their bytes."""
        for batch in batches:
            for key, text, pieces in zip(*(c.to_pylist() for c in batch.columns)):
                raw, m, h, a = text.encode("utf-8"), [], [], []
                for p in pieces:
                    h.append(window_hashes(raw[p["a"]:p["a"] + p["w"] - 1 + span], span))
                    m.append(np.full(p["w"], p["m"], np.int64))
                    a.append(np.arange(p["a"], p["a"] + p["w"], dtype=np.int64))
                a = np.concatenate(a)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(m)), pa.array(np.concatenate(h).view(np.int64)),
                                                  pa.array(np.full(len(a), key, np.int64)), pa.array(a)], names=["m", "h", "key", "a"])

    def sort(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("a", "ascending")])
        with tempfile.TemporaryDirectory() as folder:  # for this task alone, gone when it ends
            found = list(repeated_windows(table.column("segment").to_pylist(), table.column("key").to_numpy(),
                                          table.column("a").to_numpy(), span, folder))
        k, a, w = zip(*found) if found else ((), (), ())
        return pa.table({"key": pa.array(k, pa.int64()), "a": pa.array(a, pa.int64()), "w": pa.array(w, pa.int32())})

    with batch_rows(docs.sparkSession, 64):
        pieces = rows.select("__key", "text").join(wanted(asked.filter("bucket >= 0")), "__key").mapInArrow(
            cut, "bucket long, key long, a long, segment binary")
        partial = materialise(pieces.groupBy("bucket").applyInArrow(sort, "key long, a long, w int"), "repeat-parts")
        single = materialise(rows.select("__key", "text").join(wanted(asked.filter("bucket < 0")), "__key").mapInArrow(
            split, "m long, h long, key long, a long"), "repeat-windows")
    # Equal windows of one anchor: all but the first go. The first is an aggregate, so the most frequent window is combined early.
    least = single.groupBy("m", "h").agg(F.min(F.struct("key", "a")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = single.join(least, ["m", "h"]).filter(F.struct("key", "a") != F.col("first")).select("key", "a", F.lit(1).alias("w"))
    gone = runs.filter("kind = 1").select("key", "a", "w").unionByName(partial).unionByName(again)
    by_row = gone.groupBy(F.col("key").alias("__key")).agg(F.collect_list(F.struct("a", "w")).alias("gone"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"id": batch.column(0), "n_bytes": [], "starts": [], "ends": [], "kept": []}
            for text, windows in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                raw = (text or "").encode("utf-8")
                windows = windows or []
                begin, end = covered(np.array([x["a"] for x in windows], np.int64), np.array([x["w"] for x in windows], np.int64), span)
                edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(raw)]
                out["n_bytes"].append(len(raw))
                out["starts"].append(begin.tolist())
                out["ends"].append(end.tolist())
                out["kept"].append(b"".join(raw[i:j] for i, j in zip(edges[::2], edges[1::2])))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([out["id"], pa.array(out["n_bytes"], pa.int64()), pa.array(out["starts"], longs),
                                              pa.array(out["ends"], longs), pa.array(out["kept"], pa.binary())], names=list(out))

    done = rows.join(by_row, "__key", "left").select(F.col("id").cast("long").alias("id"), "text", "gone").mapInArrow(
        finish, "id long, n_bytes long, starts array<bigint>, ends array<bigint>, kept binary")
    return done.withColumnRenamed("id", id_col)
