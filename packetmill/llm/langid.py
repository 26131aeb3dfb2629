"""Language identification: averaged embeddings of hashed subwords, a linear softmax, calibrated rejection.

A text is the bag of its byte 2- to 4-grams (lower case, everything but letters as one space), each hashed to a row
of an embedding table; the mean row goes through a linear layer. Both are trained together by stochastic gradient
descent in numpy on a bounded sample of labelled rows, in one task. A part of the sample is kept
back: it sets the temperature of the scores, and the score and the share of subwords known from training below which a
prediction is rejected.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetmill.llm.common import append_columns, texts_of

UNKNOWN = "und"
BUCKETS, DIM, GRAMS = 1 << 16, 16, (2, 3, 4)
_NOT_LETTERS = re.compile(r"[\W\d_]+")
# Code points hashed at a time: bounds the memory for a long text.
_AT_ONCE = 1 << 18


def grams(text: str) -> np.ndarray:
    """Bucket of every n-gram; nothing for a text without letters."""
    plain = _NOT_LETTERS.sub(" ", text.lower()).strip()
    if not plain:
        return np.empty(0, np.int64)
    b = np.frombuffer(f" {plain} ".encode(), np.uint8).astype(np.uint64)
    out, h = [], b
    for n in range(2, max(GRAMS) + 1):
        h = h[:-1] * np.uint64(1 << 8) + b[n - 1:]
        if n in GRAMS and len(h):
            out.append((h + np.uint64(n << 40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48))
    return np.concatenate(out).astype(np.int64)


class LanguageModel:
    """Labels, the product of embeddings and output layer, and the calibration.

    The last column of ``table`` is 1 where training met the bucket.
    """

    def __init__(self, labels: list[str], table: np.ndarray, bias: np.ndarray, temperature: float = 1.0,
                 threshold: float = 0.0, least_known: float = 0.0):
        self.labels, self.table, self.bias = labels, table, bias
        self.temperature, self.threshold, self.least_known = temperature, threshold, least_known

    def outputs(self, text: str) -> np.ndarray | None:
        """Mean logits of all n-grams of the whole text and the share of known ones, or None without a letter."""
        total, count = np.zeros(len(self.labels) + 1), 0
        for at in range(0, len(text), _AT_ONCE):
            g = grams(text[at:at + _AT_ONCE])
            total += self.table[g].sum(axis=0, dtype=np.float64)
            count += len(g)
        return total / count + np.append(self.bias, 0) if count else None

    def predict(self, text: str) -> tuple[str, float, bool]:
        """``(label, score, rejected)``."""
        z = self.outputs(text) if self.labels else None
        if z is None:
            return UNKNOWN, 0.0, True
        p = _softmax(z[None, :-1] / self.temperature)[0]
        best = int(p.argmax())
        return self.labels[best], float(p[best]), bool(p[best] < self.threshold or z[-1] < self.least_known)

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, labels=np.array(self.labels, dtype=str), table=self.table, bias=self.bias,
                 rest=np.array([self.temperature, self.threshold, self.least_known]))
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes) -> LanguageModel:
        with np.load(io.BytesIO(data)) as f:
            return cls(f["labels"].tolist(), f["table"], f["bias"], *f["rest"].tolist())


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _pieces(text: str, rng: np.random.Generator) -> list[str]:
    """The text cut into pieces of 20 to 400 code points, so that short texts are learnt as well."""
    out, at = [], 0
    while at < len(text):
        n = int(rng.integers(20, 400))
        out.append(text[at:at + n])
        at += n
    return out


def train(texts: list[str], labels: list[str], epochs: int = 2, rate: float = 0.5, batch: int = 32, most: int = 24_000,
          false_reject: float = 0.002, seed: int = 11) -> LanguageModel:
    """Fit on pieces of the sampled texts, ``most`` pieces at most; every fifth text only calibrates."""
    names = sorted(set(labels))
    if not names:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    learn, check = [], []
    for i, (text, label) in enumerate(zip(texts, labels)):
        y = names.index(label)
        (check if i % 5 == 4 and len(texts) >= 10 else learn).extend((g, y) for p in _pieces(text, rng) if len(g := grams(p)))
    learn = [learn[i] for i in rng.permutation(len(learn))[:most]]
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, len(names)), np.float32), np.zeros(len(names), np.float32)
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        order = rng.permutation(len(learn))
        for at in range(0, len(order), batch):
            chosen = [learn[i] for i in order[at:at + batch]]
            sizes = np.array([len(g) for g, _ in chosen])
            index = np.concatenate([g for g, _ in chosen])
            owner = np.repeat(np.arange(len(chosen)), sizes)
            hidden = np.add.reduceat(emb[index], np.cumsum(sizes) - sizes) / sizes[:, None]
            error = _softmax(hidden @ out + bias)
            error[np.arange(len(chosen)), [y for _, y in chosen]] -= 1
            lr = rate * (1 - done / steps)
            back = (error @ out.T / sizes[:, None]).astype(np.float32)
            out -= lr * hidden.T @ error
            bias -= lr * error.mean(axis=0)
            np.subtract.at(emb, index, lr * back[owner])
            done += len(chosen)
    known = np.zeros((BUCKETS, 1), np.float32)
    for g, _ in learn:
        known[g] = 1
    model = LanguageModel(names, np.hstack([emb @ out, known]).astype(np.float32), bias.astype(np.float64))
    _calibrate(model, check or learn, false_reject)
    return model


def _calibrate(model: LanguageModel, examples: list, false_reject: float) -> None:
    """Temperature by likelihood; limits that turn away ``false_reject`` of the right predictions, a half at most."""
    if not examples:
        return
    means = np.array([model.table[g].mean(axis=0, dtype=np.float64) for g, _ in examples])
    z, known = means[:, :-1] + model.bias, means[:, -1]
    y = np.array([y for _, y in examples])
    right = np.arange(len(y)), y
    model.temperature = float(min(np.geomspace(0.05, 4, 60),
                                  key=lambda t: -np.log(np.maximum(_softmax(z / t)[right], 1e-12)).mean()))
    p = _softmax(z / model.temperature)
    sure = p.argmax(axis=1) == y
    if sure.any():
        model.threshold = float(min(0.5, np.quantile(p.max(axis=1)[sure], false_reject)))
        model.least_known = float(min(0.5, np.quantile(known[sure], false_reject)))


def labelled_sample(docs: DataFrame, chosen: Column, id_col: str, text_col: str, label_col: str,
                    per_label: int, max_bytes: int = 1 << 20) -> DataFrame:
    """About ``per_label`` rows of each label among the ``chosen``, by a hash of id and text: a bound on the fitting only.

    One count per label goes to the driver; labels are names of languages. Texts over ``max_bytes`` don't teach.
    """
    able = docs.filter(chosen & F.col(label_col).isNotNull() & (F.octet_length(text_col).between(1, max_bytes)))
    counts = {r[label_col]: r["count"] for r in able.groupBy(label_col).count().collect()}
    share = F.lit(0.0)
    for label, n in sorted(counts.items()):
        share = F.when(F.col(label_col) == label, F.lit(per_label / n)).otherwise(share)
    draw = F.pmod(F.xxhash64(F.lit("sample"), id_col, text_col), F.lit(1 << 30)) / float(1 << 30)
    return able.filter(draw < share).select(F.xxhash64(id_col, text_col).alias("draw"), F.col(text_col).alias("text"),
                                            F.col(label_col).alias("label"))


def fit(docs: DataFrame, chosen: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
        per_label: int = 400) -> bytes:
    """Train in one task on about ``per_label`` rows a label; returns the stored model (its size is fixed by the labels)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat(list(frames) or [pd.DataFrame(columns=["draw", "text", "label"])]).sort_values(["draw", "text"])
        yield pd.DataFrame({"model": [train(got["text"].tolist(), got["label"].tolist()).dump()]})

    sample = labelled_sample(docs, chosen, id_col, text_col, label_col, per_label)
    rows = sample.repartition(1).mapInPandas(run, "model binary").collect()
    return bytes(rows[0]["model"]) if rows else train([], []).dump()


FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
          T.StructField("rejected", T.BooleanType())]


def predict(docs: DataFrame, model: bytes, text_col: str = "text") -> DataFrame:
    """Every row with ``lang_pred``, ``score`` and ``rejected``.

    Null texts and texts without a letter are ``und`` with score 0, and rejected. Rows are independent: repeats
    get equal results, an empty table an empty one; input columns named like a result are replaced. Without a
    single labelled row every text is ``und``.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known = LanguageModel.load(sent.value)

        def work(batch: pa.RecordBatch) -> dict:
            found = [known.predict(t) for t in texts_of(batch.column(batch.schema.get_field_index(text_col)))]
            return {f.name: pa.array([x[i] for x in found], t)
                    for i, (f, t) in enumerate(zip(FIELDS, (pa.string(), pa.float64(), pa.bool_())))}
        return work

    return append_columns(docs, make, FIELDS)


def in_fold(id_col: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id is in no fold but the first."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds, F.lit(0)) == fold
