"""Periodic runs of words, found by block convolution at dyadic scales.

A run is a stretch of consecutive words with smallest period q and at least ``copies`` periods that no neighbouring word
extends. At scale L the periods from L to 2L - 1 are looked for: a run of such a period holds a whole aligned
block of L words and the place q words later where the block stands again. Sums of squared differences between a
block and every place of the window after it come from one exact integer transform (number theoretic, modulo
a prime); they vanish where nothing differs. Blocks that follow one another and match at the same distance are
a seed, and seeds are extended word by word to the whole stretch, which also discards a sum that
vanishes modulo the prime only.

Two exact rules spare work, and neither drops a run. A block with a word that does not come again within the scale's
distances matches nowhere. A block whose whole window lies in a known run of a period up to the block's length matches only at
multiples of that period, and these are no smallest periods.
"""

from __future__ import annotations

from collections import defaultdict
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetmill.llm.common import append_columns, texts_of

# A prime with transforms of up to 2**23 places, and a generator of its units.
PRIME, GENERATOR = 998_244_353, 3
#: Longest block: longer distances are searched window by window. Places transformed at a time: bounds memory.
LONGEST, _AT_ONCE = 1 << 15, 1 << 20
COPIES, SHORTEST = 4, 6
_NEVER = np.iinfo(np.int64).max
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


@cache
def _powers(half: int, inverse: bool) -> np.ndarray:
    """The first ``half`` powers of the root of order ``2 * half``."""
    root = pow(GENERATOR, (PRIME - 1) // (2 * half), PRIME)
    root = pow(root, PRIME - 2, PRIME) if inverse else root
    out = np.ones(1, np.uint64)
    while len(out) < half:
        out = np.concatenate([out, out * np.uint64(pow(root, len(out), PRIME)) % PRIME])
    return out


def transform(rows: np.ndarray) -> np.ndarray:
    """Number theoretic transform of each row (a power of two of places), in bit-reversed order."""
    n, size = rows.shape
    span = size
    while span > 1:
        half = span // 2
        pair = rows.reshape(n, size // span, 2, half)
        out = np.empty_like(pair)
        np.remainder(pair[:, :, 0] + pair[:, :, 1], PRIME, out=out[:, :, 0])
        np.remainder((pair[:, :, 0] + PRIME - pair[:, :, 1]) * _powers(half, False), PRIME, out=out[:, :, 1])
        rows, span = out.reshape(n, size), half
    return rows


def back(rows: np.ndarray) -> np.ndarray:
    """Inverse of ``transform``."""
    n, size = rows.shape
    span = 2
    while span <= size:
        half = span // 2
        pair = rows.reshape(n, size // span, 2, half)
        turned = pair[:, :, 1] * _powers(half, True) % PRIME
        out = np.empty_like(pair)
        np.remainder(pair[:, :, 0] + turned, PRIME, out=out[:, :, 0])
        np.remainder(pair[:, :, 0] + PRIME - turned, PRIME, out=out[:, :, 1])
        rows, span = out.reshape(n, size), span * 2
    return rows * np.uint64(pow(size, PRIME - 2, PRIME)) % PRIME


def zero_mismatch(blocks: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """Whether block i stands at each of the first ``L`` places of window i, as far as sums modulo the prime tell.

    ``blocks`` is (n, L) and ``windows`` (n, 2L), of codes below the prime.
    """
    n, length = blocks.shape
    turned = np.zeros((n, 2 * length), np.uint64)
    turned[:, :length] = blocks[:, ::-1]
    products = back(transform(turned) * transform(windows) % PRIME)[:, length - 1:2 * length - 1]
    upto = np.zeros((n, 2 * length + 1), np.uint64)
    np.cumsum(windows * windows % PRIME, axis=1, out=upto[:, 1:])
    squares = (blocks * blocks % PRIME).sum(axis=1)[:, None] + (upto[:, length:2 * length] - upto[:, :length])
    return (squares + 2 * (PRIME - products)) % PRIME == 0


def _next_distance(codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Words to the next equal word of the same document."""
    key = doc * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    out = np.full(len(codes), _NEVER)
    same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
    out[order[same]] = order[same + 1] - order[same]
    return out


def _matches(codes: np.ndarray, at: np.ndarray, length: int, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of blocks and distances from ``shift`` to ``shift + length - 1`` where a block stands again."""
    starts, distances = [], []
    step = max(1, _AT_ONCE // (2 * length))
    for i in range(0, len(at), step):
        s = at[i:i + step]
        blocks = codes[s[:, None] + np.arange(length)].astype(np.uint64)
        places = s[:, None] + np.arange(shift, shift + 2 * length)
        windows = np.where(places < len(codes), codes[np.minimum(places, len(codes) - 1)], 0).astype(np.uint64)
        row, place = np.nonzero(zero_mismatch(blocks, windows))
        starts.append(s[row])
        distances.append(place + shift)
    return np.concatenate(starts or [at[:0]]), np.concatenate(distances or [at[:0]])


def _stretches(codes: np.ndarray, low: int, high: int, first: int, end: int, d: int):
    """Maximal stretches of places equal to the one ``d`` later that meet ``low .. high``, within a document ``first .. end``."""
    equal = codes[low:high] == codes[low + d:high + d]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
    for x, y in (edges.reshape(-1, 2) + low).tolist():
        while x == low > first:
            low = max(first, low - (high - low))
            differ = np.flatnonzero(codes[low:x] != codes[low + d:x + d])
            x = low + int(differ[-1]) + 1 if len(differ) else low
        while y == high < end - d:
            high = min(end - d, high + (high - low))
            differ = np.flatnonzero(codes[y:high] != codes[y + d:high + d])
            y = y + int(differ[0]) if len(differ) else high
        yield x, y


def find_runs(codes: np.ndarray, ends: np.ndarray, copies: int = COPIES, shortest: int = SHORTEST) -> np.ndarray:
    """Rows ``(start, length, period)`` of all runs, places counted over all documents, by start and period.

    ``codes`` are the words of consecutive documents, ``ends`` the documents' ends; equal words of one document have equal codes
    from 1 to below the prime. ``copies`` is at least 4.
    """
    if copies < 4:
        raise ValueError("blocks are certain to be found in runs of four periods or more")
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - starts
    doc = np.repeat(np.arange(len(sizes)), sizes)
    furthest = _next_distance(codes, doc)
    seen: dict[tuple[int, int], int] = {}
    scale = 1
    while len(sizes) and copies * scale <= sizes.max():
        length = min(scale, LONGEST)
        here = np.flatnonzero(sizes >= max(shortest, copies * scale))
        for shift in range(scale, 2 * scale, length):
            count = np.maximum((sizes[here] - shift) // length, 0)
            number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            at = np.repeat(starts[here], count) + number * length
            at = at[furthest[at] <= 2 * scale - 1]
            at = at[~_inside(at, at + shift + 2 * length, [(s, e) for (s, e), q in seen.items() if q <= length])]
            s, d = _matches(codes, at, length, shift)
            fits = s + d + length <= ends[doc[s]]
            s, d = s[fits], d[fits]
            order = np.lexsort((s, d))
            s, d = s[order], d[order]
            if not len(s):
                continue
            new = np.flatnonzero(np.concatenate([[True], (np.diff(d) != 0) | (np.diff(s) != length) | (np.diff(doc[s]) != 0)]))
            chain = np.diff(np.append(new, len(s)))
            wanted = chain * length + 2 * (length - 1) + d[new] >= np.maximum(shortest, copies * d[new])
            for i, c in zip(new[wanted].tolist(), chain[wanted].tolist()):
                a, q, k = int(s[i]), int(d[i]), int(doc[s[i]])
                low, high = max(int(starts[k]), a - length + 1), min(int(ends[k]) - q, a + c * length + length - 1)
                for x, y in _stretches(codes, low, high, int(starts[k]), int(ends[k]), q):
                    if y + q - x >= max(shortest, copies * q):
                        seen.setdefault((x, y + q), q)
        if length == scale and scale < LONGEST:
            furthest = np.maximum(furthest[:-scale], furthest[scale:]) if len(furthest) > scale else furthest[:0]
        scale *= 2
    return np.array(sorted((s, e - s, q) for (s, e), q in seen.items()), np.int64).reshape(-1, 3)


def _inside(low: np.ndarray, high: np.ndarray, runs: list[tuple[int, int]]) -> np.ndarray:
    """Whether each stretch lies in one of the runs."""
    if not runs or not len(low):
        return np.zeros(len(low), bool)
    known = np.array(sorted(runs))
    furthest = np.maximum.accumulate(known[:, 1])
    place = np.searchsorted(known[:, 0], low, "right") - 1
    return (place >= 0) & (furthest[place] >= high)


def coded(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """All words of the texts, their codes from 1, and the texts' ends."""
    split = [t.encode("utf-8").split() for t in texts]
    words = [w for part in split for w in part]
    numbers: dict = defaultdict()
    numbers.default_factory = lambda: len(numbers) + 1
    codes = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    return words, codes, np.cumsum([len(part) for part in split], dtype=np.int64)


def with_runs(docs: DataFrame, text_col: str = "text", copies: int = COPIES, shortest: int = SHORTEST) -> DataFrame:
    """Every row with ``n_words``, ``runs`` (array of start, length, period by start and period; starts count words from 0)
    and ``collapsed``: the words left, joined by one space, where each run keeps its first period.

    Words are what the six ASCII white-space characters part. Null and empty texts have no run and collapse to an
    empty text; a text is one piece however long it is; repeated rows each get their row; an empty table gives an empty
    result; columns with the names of new ones are replaced, other columns stay.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            words, codes, ends = coded(texts_of(batch.column(batch.schema.get_field_index(text_col))))
            runs = find_runs(codes, ends, copies, shortest)
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, runs[:, 0] + runs[:, 2], 1)
            np.add.at(change, runs[:, 0] + runs[:, 1], -1)
            kept = np.cumsum(change[:-1]) == 0
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            owner = np.searchsorted(ends, runs[:, 0], "right")
            lists, collapsed = [[] for _ in ends], []
            for k, (s, n, q) in zip(owner.tolist(), runs.tolist()):
                lists[k].append({"start": s - int(starts[k]), "length": n, "period": q})
            for a, b in zip(starts.tolist(), ends.tolist()):
                part = words[a:b] if kept[a:b].all() else [words[i] for i in (np.flatnonzero(kept[a:b]) + a).tolist()]
                collapsed.append(b" ".join(part).decode("utf-8"))
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))
            return {"n_words": pa.array(ends - starts, pa.int64()), "runs": pa.array(lists, kind),
                    "collapsed": pa.array(collapsed, pa.string())}
        return work

    return append_columns(docs, make, [T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)),
                                       T.StructField("collapsed", T.StringType())])


def strongest(runs: F.Column = "runs"):
    """The run with the greatest exact length over period; ties by start, then period. Null without runs."""
    def earlier(a, b):
        apart = b["length"] * a["period"] - a["length"] * b["period"]
        apart = F.when(apart != 0, apart).when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["period"] - b["period"])
        return F.signum(apart).cast("int")
    return F.get(F.array_sort(runs, earlier), F.lit(0))


def repeat_tail(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with periodic tails in a tenth of them, to hold a detector against known periods.

    With h the CRC-32 of the decimal id and g its tenth, a text with h divisible by ten has its words from ``a = g % n`` on
    replaced by repetitions of the first ``1 + (n - a) // (3 + g % 8)`` of them, joined by one space. Other texts, null ids and
    texts without words stay as they are.
    """
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            sums = batch.column(batch.schema.get_field_index("__crc")).to_pylist()
            for i, (text, crc) in enumerate(zip(texts, sums)):
                words = text.encode("utf-8").split() if text and crc is not None and crc % 10 == 0 else []
                if words:
                    g, n = crc // 10, len(words)
                    a = g % n
                    p = 1 + (n - a) // (3 + g % 8)
                    unit = words[a:a + p]
                    tail = (unit * (-(-(n - a) // p)))[:n - a]
                    texts[i] = b" ".join(words[:a] + tail).decode("utf-8")
            return {text_col: pa.array(texts, pa.string())}
        return work

    return append_columns(docs.withColumn("__crc", h), make, [T.StructField(text_col, T.StringType())]).drop("__crc")
