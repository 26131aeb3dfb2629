"""Personal data: fixed rules, and a tagger trained on labelled spans that finds what the rules miss.

The tagger reads characters in overlapping windows. A span must hold a digit or an at sign, so only the surroundings of
those are read; that changes nothing that could be found. Each character takes its tag from the window where
it lies farthest from an edge, and only then are tags joined to spans, so a span may cross windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetmill.llm.common import append_columns, texts_of
from packetmill.llm.tagger import PAD, Tagger, encode

KINDS = ["email", "ip", "card", "phone"]
WINDOW, STRIDE, CONTEXT = 80, 40, 24
_TRIGGER = re.compile("[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# No match of the plain pattern starts inside a run of digits, so runs need not be tried from every digit.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at sign takes the whole run of local characters before it, back to the last address."""
    after = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            after = found.end()
            yield start, after
        at = text.find("@", max(at + 1, after))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """What the fixed rules find, by start and then kind."""
    out = []
    if "@" in text:
        out += [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m.group())) <= 15]
    return ordered(out)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def regions(text: str) -> list[tuple[int, int]]:
    """Where a span can be: the surroundings of digits and at signs, joined where they touch."""
    out: list[list[int]] = []
    for m in _TRIGGER.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def windows(regs: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(region, begin, end)`` of overlapping windows."""
    out = []
    for k, (a, b) in enumerate(regs):
        at = a
        while True:
            out.append((k, at, min(at + WINDOW, b)))
            if at + WINDOW >= b:
                break
            at += STRIDE
    return out


def found_spans(model: Tagger, texts: list[str], at_once: int = 4096) -> list[list[Span]]:
    """The tagger's spans of each text, after the windows are reconciled."""
    jobs = [(d, w) for d, text in enumerate(texts) for w in windows(regions(text))]
    spans: list[list[Span]] = [[] for _ in texts]
    open_: dict[int, tuple] = {}
    classes: dict[int, np.ndarray] = {}

    def finish(doc: int) -> None:
        begin, tags, _ = open_.pop(doc)
        spans[doc] += _spans(texts[doc], begin, tags, model.kinds)

    for at in range(0, len(jobs), at_once):
        part = jobs[at:at + at_once]
        chars = np.full((len(part), WINDOW), PAD)
        for row, (d, (_, a, b)) in enumerate(part):
            if d not in classes:
                classes = {d: encode(texts[d])}
            chars[row, :b - a] = classes[d][a:b]
        tagged = model.decode(chars)
        for row, (d, (k, a, b)) in enumerate(part):
            if d in open_ and open_[d][2] != k:
                finish(d)
            if d not in open_:
                open_[d] = (a, tagged[row, :b - a], k)
                continue
            begin, tags, _ = open_[d]
            middle = a - begin + (WINDOW - STRIDE) // 2  # each side of it is nearer to the middle of its window
            open_[d] = (begin, np.concatenate([tags[:middle], tagged[row, middle - (a - begin):b - a]]), k)
        for d in [d for d in open_ if d != part[-1][0]]:
            finish(d)
    for d in list(open_):
        finish(d)
    return spans


def _spans(text: str, begin: int, tags: np.ndarray, kinds: list[str]) -> list[Span]:
    """Runs of one kind, without white space at the ends, that hold a digit or an at sign."""
    out, i = [], 0
    while i < len(tags):
        if not tags[i]:
            i += 1
            continue
        kind, j = (tags[i] - 1) // 2, i + 1
        while j < len(tags) and tags[j] == 2 + 2 * kind:
            j += 1
        piece = text[begin + i:begin + j]
        a = begin + i + len(piece) - len(piece.lstrip())
        b = begin + i + len(piece.rstrip())
        if a < b and _TRIGGER.search(text, a, b):
            out.append((kinds[kind], a, b))
        i = j
    return out


def all_spans(base: list[Span], found: list[Span]) -> list[Span]:
    """The base spans, and the tagger's that touch none of them."""
    edges = sorted((a, b) for _, a, b in base)
    starts = np.array([a for a, _ in edges])
    ends = np.maximum.accumulate(np.array([b for _, b in edges])) if edges else starts
    extra = [s for s in found if not edges or not (k := int(np.searchsorted(starts, s[2]))) or ends[k - 1] <= s[1]]
    return ordered(base + extra)


def to_text(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind in brackets."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _variant(kind: str, value: str, rng: np.random.Generator) -> str:
    """Another way to write a labelled value, so that the tagger learns more than the rule that labelled it."""
    digits = _digits(value)
    if kind == "phone" and len(digits) >= 10:
        area, first, last = digits[-10:-7], digits[-7:-4], digits[-4:]
        return [f"({area}) {first}-{last}", f"{area}-{first}-{last}", f"{area}.{first}.{last}", value][rng.integers(4)]
    if kind == "card":
        sep = "-. "[rng.integers(3)]
        return sep.join(digits[i:i + 4] for i in range(0, len(digits), 4)) if rng.random() < 0.6 else value
    return value


def training_windows(texts: list[str], labels: list[list[Span]], most: int, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows of character classes and tags from texts with labelled spans; half of the values are written otherwise."""
    rng, chars, tags = np.random.default_rng(seed), [], []
    for text, spans in zip(texts, labels):
        out, kept, at, size = [], [], 0, 0
        for kind, a, b in spans:
            if a < at:
                continue
            value = _variant(kind, text[a:b], rng) if rng.random() < 0.5 else text[a:b]
            size += a - at + len(value)
            out += [text[at:a], value]
            kept.append((kind, size - len(value), size))
            at = b
        text = "".join([*out, text[at:]])
        tag, classes = np.zeros(len(text), np.int64), encode(text)
        for kind, a, b in kept:
            tag[a], tag[a + 1:b] = 1 + 2 * KINDS.index(kind), 2 + 2 * KINDS.index(kind)
        for _, a, b in windows(regions(text)):
            if tag[a] and not tag[a] % 2:  # begins inside of a span
                a += int(np.argmax((tag[a:b] == 0) | (tag[a:b] % 2 == 1))) if ((tag[a:b] == 0) | (tag[a:b] % 2 == 1)).any() else b - a
            if a < b:
                row, t = np.full(WINDOW, PAD), np.zeros(WINDOW, np.int64)
                row[:b - a], t[:b - a] = classes[a:b], tag[a:b]
                chars.append(row)
                tags.append(t)
    keep = rng.permutation(len(chars))[:most]
    return (np.array([chars[i] for i in keep]).reshape(-1, WINDOW), np.array([tags[i] for i in keep]).reshape(-1, WINDOW))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = 1500, most: int = 6000,
        max_bytes: int = 1 << 20) -> bytes | None:
    """Train in one task on about ``sample`` documents with digits or at signs, labelled by the fixed rules.

    The sample is drawn by a hash of id and text; documents over ``max_bytes`` don't teach; ``most`` windows are
    used. None without a labelled span: then only the rules find anything.
    """
    able = docs.filter(F.col(text_col).rlike("[0-9@]") & (F.octet_length(text_col) <= max_bytes))
    count = able.count()
    draw = F.pmod(F.xxhash64(F.lit("pii"), id_col, text_col), F.lit(1 << 30)) / float(1 << 30)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts = pd.concat(list(frames) or [pd.DataFrame(columns=["draw", "text"])]).sort_values(["draw", "text"])["text"].tolist()
        labels = [base_spans(t) for t in texts]
        chars, tags = training_windows(texts, labels, most)
        model = None
        if tags.any():
            tagger = Tagger(KINDS)
            tagger.train(chars, tags)
            model = tagger.dump()
        yield pd.DataFrame({"model": [model]})

    rows = (able.filter(draw < sample / max(count, 1)).select(F.xxhash64(id_col, text_col).alias("draw"), F.col(text_col).alias("text"))
            .repartition(1).mapInPandas(run, "model binary").collect())
    return bytes(rows[0]["model"]) if rows and rows[0]["model"] is not None else None


FIELDS = [*(T.StructField(f"n_{k}", T.LongType()) for k in KINDS), T.StructField("base_spans", T.StringType()),
          T.StructField("spans", T.StringType())]


def detect(docs: DataFrame, model: bytes | None, text_col: str = "text", with_mask: bool = False) -> DataFrame:
    """Every row with counts of base spans by kind, ``base_spans``, ``spans`` and, if asked for, ``masked``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind, joined by commas. Null and empty
    texts have none (``masked``: null stays null). Rows are independent: repeats get equal results, an empty table
    an empty one; input columns named like a result are replaced.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    fields = FIELDS + ([T.StructField("masked", T.StringType())] if with_mask else [])

    def make():
        tagger = Tagger.load(sent.value) if sent.value is not None else None

        def work(batch: pa.RecordBatch) -> dict:
            column = batch.column(batch.schema.get_field_index(text_col))
            texts = texts_of(column)
            base = [base_spans(t) for t in texts]
            found = found_spans(tagger, texts) if tagger else [[] for _ in texts]
            both = [all_spans(b, f) for b, f in zip(base, found)]
            out = {f"n_{k}": pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in KINDS}
            out |= {"base_spans": pa.array(map(to_text, base), pa.string()), "spans": pa.array(map(to_text, both), pa.string())}
            if with_mask:
                out["masked"] = pa.array([masked(t, s) if ok else None for t, s, ok in zip(texts, both, column.is_valid().to_pylist())], pa.string())
            return out
        return work

    return append_columns(docs, make, fields)
