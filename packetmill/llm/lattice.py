"""Language-model scores from subword lattices.

A word, behind the mark of its beginning, can be cut into vocabulary pieces in many ways. Each way has the product of its
pieces' probabilities, and the word has the sum over all ways: a forward recursion in log space over the
byte positions of the word. Pieces never reach across a word's beginning, so a text is the product of its
words and of one end.

The piece probabilities start from the scores of an existing vocabulary (a merge vocabulary scores by rank: those
become Zipf weights) and are re-estimated on the training documents by expected counts over all cuttings.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetmill.llm.common import batch_rows, input_bytes
from packetmill.llm.pieces import _BYTE, _NORMAL, _USER, Model
from packetmill.session import materialise

_BASE = 0x9E3779B97F4A7C15 | 1
_MARK = "▁".encode()
_PRIME = np.uint64(_BASE)
#: Bytes of a batch of words whose arcs are held.
_HELD = 1 << 17


class Vocabulary:
    """Pieces as byte strings, findable by the hash of a substring. Byte-fallback pieces stand for their single byte."""

    def __init__(self, data: bytes):
        model = Model(data)
        used = [(i, t) for i, t in enumerate(model.types) if t in (_NORMAL, _USER, _BYTE)]
        text = [bytes([int(model.pieces[i][3:5], 16)]) if t == _BYTE else model.pieces[i].encode() for i, t in used]
        self.fallback = {b[0]: k for k, ((_, t), b) in enumerate(zip(used, text)) if t == _BYTE}
        self.size = len(used)
        self.longest = max(map(len, text))
        plain = [(k, b) for k, ((_, t), b) in enumerate(zip(used, text)) if t != _BYTE and b]
        hashes = np.array([_hash(b) for _, b in plain], np.uint64)
        order = np.argsort(hashes)
        self.hashes, self.places = hashes[order], np.array([k for k, _ in plain])[order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.bytes_of = np.array([self.fallback.get(b, -1) for b in range(256)])
        self.powers = np.array([pow(_BASE, n, 1 << 64) for n in range(self.longest + 1)], np.uint64)
        scores = np.array([model.scores[i] for i, _ in used])
        self.start = _from_scores(scores, np.array([t == _BYTE for _, t in used]))

    def arcs(self, prefix: np.ndarray, symbols: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that end at byte ``end`` of each row: ``(first byte positions, piece or -1)``, then the fallback."""
        begin = np.arange(max(0, end - self.longest), end)
        h = prefix[:, end, None] - prefix[:, begin] * self.powers[end - begin]
        at = np.searchsorted(self.hashes, h)
        at[at == len(self.hashes)] = 0
        return begin, np.where(self.hashes[at] == h, self.places[at], -1)

    def all_arcs(self, prefix: np.ndarray, symbols: np.ndarray) -> Sequence[tuple[np.ndarray, np.ndarray]]:
        """The pieces by their end: looked up once, but anew at each use where a very long word would fill the memory."""
        every = _Arcs(self, prefix, symbols)
        return list(every) if symbols.size <= _HELD else every


class _Arcs(Sequence):
    def __init__(self, vocabulary: Vocabulary, prefix: np.ndarray, symbols: np.ndarray):
        self.vocabulary, self.prefix, self.symbols = vocabulary, prefix, symbols

    def __len__(self) -> int:
        return self.symbols.shape[1]

    def __getitem__(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        if not 0 <= place < len(self):
            raise IndexError(place)
        return self.vocabulary.arcs(self.prefix, self.symbols, place + 1)


def _hash(b: bytes) -> int:
    h = 0
    for c in b:
        h = (h * _BASE + c + 1) % (1 << 64)
    return h


def _from_scores(scores: np.ndarray, byte: np.ndarray) -> np.ndarray:
    """Log weights: log probabilities as they are, ranks (whole negative numbers) by Zipf; bytes as the rarest piece."""
    normal = scores[~byte]
    if len(normal) and (normal == np.round(normal)).all():
        logs = -np.log(2.7 - np.minimum(scores, 0))
    else:
        logs = scores.astype(np.float64)
    if byte.any() and (~byte).any():
        logs[byte] = logs[~byte].min()
    return logs


def normalise(weights: np.ndarray, end: float) -> np.ndarray:
    """Log probabilities of all pieces and, last, of the end."""
    logs = np.append(weights, end)
    return logs - np.logaddexp.reduce(logs)


def _rows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Marked words of one length as a byte matrix, and the hash of each prefix."""
    b = np.frombuffer(b"".join(_MARK + w for w in words), np.uint8).reshape(len(words), -1)
    prefix = np.zeros((len(words), b.shape[1] + 1), np.uint64)
    for j in range(b.shape[1]):
        prefix[:, j + 1] = prefix[:, j] * _PRIME + b[:, j] + np.uint64(1)
    return b, prefix


def _batches(words: list[bytes], cells: int = 1 << 16) -> Iterator[np.ndarray]:
    """Places of words of equal length, few enough at a time to keep the matrices small."""
    lengths = np.array([len(w) for w in words])
    order = np.argsort(lengths, kind="stable")
    for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
        if len(same):
            step = max(1, cells // (int(lengths[same[0]]) + 3))
            for at in range(0, len(same), step):
                yield same[at:at + step]


def _forward(vocabulary: Vocabulary, logp: np.ndarray, b: np.ndarray, arcs: list) -> np.ndarray:
    """``alpha[:, j]``: log probability of the first j bytes, over all ways to cut them; ``arcs`` holds the pieces by their end."""
    n = b.shape[1]
    alpha = np.full((len(b), n + 1), -np.inf)
    alpha[:, 0] = 0
    padded = np.append(logp[:vocabulary.size], -np.inf)
    for j in range(1, n + 1):
        begin, piece = arcs[j - 1]
        ways = alpha[:, begin] + padded[piece]
        alpha[:, j] = np.logaddexp(np.logaddexp.reduce(ways, axis=1), alpha[:, j - 1] + padded[vocabulary.bytes_of[b[:, j - 1]]])
    return alpha


def word_scores(vocabulary: Vocabulary, logp: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Natural log of each word's marginal probability."""
    out = np.empty(len(words))
    for at in _batches(words):
        b, prefix = _rows([words[i] for i in at])
        out[at] = _forward(vocabulary, logp, b, vocabulary.all_arcs(prefix, b))[:, -1]
    return out


def expected_counts(vocabulary: Vocabulary, logp: np.ndarray, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over all ways to cut the words, each word counted ``counts`` times."""
    padded = np.append(logp[:vocabulary.size], -np.inf)
    out = np.zeros(vocabulary.size + 1)
    for at in _batches(words):
        b, prefix = _rows([words[i] for i in at])
        arcs = vocabulary.all_arcs(prefix, b)  # looked up once, walked forward and back
        alpha = _forward(vocabulary, logp, b, arcs)
        n, c = b.shape[1], counts[at][:, None]
        beta = np.full_like(alpha, -np.inf)
        beta[:, n] = 0
        for j in range(n, 0, -1):
            begin, piece = arcs[j - 1]
            byte = vocabulary.bytes_of[b[:, j - 1]]
            reach = padded[piece] + beta[:, j, None]
            single = padded[byte] + beta[:, j]
            use = np.exp(alpha[:, begin] + reach - alpha[:, -1:]) * c
            out += np.bincount(piece.ravel() % len(out), use.ravel(), len(out))
            out += np.bincount(byte % len(out), np.exp(alpha[:, j - 1] + single - alpha[:, -1]) * c[:, 0], len(out))
            beta[:, begin] = np.logaddexp(beta[:, begin], reach)
            beta[:, j - 1] = np.logaddexp(beta[:, j - 1], single)
    return out[:-1]


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z in lower case."""
    return text.encode("utf-8").lower().split()


def _in_order(table: pa.Table) -> pa.Table:
    """The rows of a block by id and text: however they arrive, their words get the same numbers."""
    return table.sort_by([("id", "ascending"), ("text", "ascending")])


def _block_words(table: pa.Table) -> tuple[list[np.ndarray], list[bytes]]:
    """The words of each row as numbers in order of appearance; the block's distinct words by number."""
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = numbers.__len__
    each = []
    for text in table.column("text").to_pylist():
        words = words_of(text or "")
        each.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
    return each, list(numbers)


def score(docs: DataFrame, held_out, model_path: str, id_col: str = "doc_id", text_col: str = "text", rounds: int = 2,
          block_bytes: int = 12 << 20) -> DataFrame:
    """Per row: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    ``held_out`` is a Column; the other rows teach. ``base_score`` is a smoothed unigram over whole words and ends,
    ``score`` the log10 of the text's marginal probability under the piece lattice.

    Documents are dealt into blocks by a hash. A block sends each of its distinct words once, the counts are
    summed by word, every distinct word is scored once, and a join on the word sends count and score to each block that has it,
    so nothing is joined per occurrence. Piece probabilities are one bounded table: a row per vocabulary piece goes to the
    driver. Null and empty texts are one end token. Repeated rows are scored, and counted, each; without training rows
    every count is 0 and the vocabulary's own weights score; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    with open(model_path, "rb") as f:
        model = spark.sparkContext.broadcast(f.read())
    blocks = max(1, -(-input_bytes(docs, text_col) // block_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"),
                       (~F.coalesce(held_out, F.lit(False))).alias("train"))
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)).cast("long"))

    def distinct(group: tuple, table: pa.Table) -> pa.Table:
        table = _in_order(table)
        each, words = _block_words(table)
        train = [ids for ids, t in zip(each, table.column("train").to_pylist()) if t]
        uses = np.bincount(np.concatenate([np.empty(0, np.int32), *train]), minlength=len(words))
        return pa.table({"block": pa.array([group[0].as_py()] * len(words), pa.int64()),
                         "number": pa.array(range(len(words)), pa.int32()), "word": pa.array(words, pa.binary()),
                         "n": pa.array(uses, pa.int64())})

    # A word has one row per block here, however often it occurs, and then one row.
    sent = materialise(blocked.groupBy("block").applyInArrow(distinct, "block long, number int, word binary, n long"), "lm-sent")
    by_word = materialise(sent.groupBy("word").agg(F.sum("n").alias("c")), "lm-words")
    ends = rows.filter("train").count()
    totals = by_word.filter("c > 0").agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = (totals["n"] or 0) + ends, totals["v"] + (ends > 0)

    vocabulary = Vocabulary(model.value)
    logp = normalise(vocabulary.start, np.logaddexp.reduce(vocabulary.start) - np.log(5))
    if tokens:
        for _ in range(rounds):
            logp = _reestimate(by_word, model, logp, ends)
    current = spark.sparkContext.broadcast(logp)

    def lattices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(model.value)
        for batch in batches:
            logs = word_scores(known, current.value, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(logs)], names=["word", "c", "logp"])

    with batch_rows(spark, 20_000):
        scores = materialise(by_word.mapInArrow(lattices, "word binary, c long, logp double"), "lm-scores")
    answers = materialise(sent.select("block", "number", "word").join(scores, "word").select("block", "number", "c", "logp"), "lm-answers")
    end_logp = float(logp[-1])

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        table = _in_order(table)
        each, _ = _block_words(table)
        order = found.column("number").to_numpy()
        c, lp = np.empty(len(order), np.int64), np.empty(len(order))
        c[order], lp[order] = found.column("c").to_numpy(), found.column("logp").to_numpy()
        base = np.log10((c + 0.5) / (tokens + 0.5 * (kinds + 1)))
        base_end = np.log10((ends + 0.5) / (tokens + 0.5 * (kinds + 1)))
        out = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        for ids in each:
            out["n_tokens"].append(len(ids) + 1)
            out["n_known"].append(int(np.count_nonzero(c[ids])) + (ends > 0))
            out["base_score"].append(float(base[ids].sum() + base_end))
            out["score"].append(float((lp[ids].sum() + end_logp) / np.log(10)))
        return pa.table({"id": table.column("id"), "held_out": pa.array([not t for t in table.column("train").to_pylist()], pa.bool_()),
                         "n_tokens": pa.array(out["n_tokens"], pa.int64()), "n_known": pa.array(out["n_known"], pa.int64()),
                         "train_tokens": pa.array([tokens] * len(each), pa.int64()),
                         "base_score": pa.array(out["base_score"], pa.float64()), "score": pa.array(out["score"], pa.float64())})

    scored = blocked.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        finish, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumnRenamed("id", id_col)


def _reestimate(by_word: DataFrame, model, logp: np.ndarray, ends: int) -> np.ndarray:
    """One round of expected counts over all training words; a tenth of a use is added to each piece."""
    spark = by_word.sparkSession
    now = spark.sparkContext.broadcast(logp)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(model.value)
        total = np.zeros(vocabulary.size)
        for batch in batches:
            total += expected_counts(vocabulary, now.value, batch.column(0).to_pylist(),
                                     batch.column(1).to_numpy().astype(np.float64))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "uses"])

    with batch_rows(spark, 20_000):
        uses = (by_word.filter("c > 0").select("word", "c").mapInArrow(expect, "piece int, uses double")
                .groupBy("piece").agg(F.sum("uses").alias("uses")).collect())
    total = np.full(len(logp) - 1, 0.1)
    for r in uses:
        total[r["piece"]] += r["uses"]
    return normalise(np.log(total), np.log(ends + 0.1))
