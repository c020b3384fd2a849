"""Quality classification with Naive Bayes support vectors.

Texts become indicators of hashed n-grams: words and word pairs, and one to three word shapes (letters folded to a, A or
0, punctuation kept, a repeat of the word before marked). Each indicator is scaled by the log ratio of its smoothed
shares in the two classes, texts are brought to unit length, and a linear hinge-loss model is fitted by dual coordinate
descent (Hsieh et al., 2008). Platt scaling on the sample's withheld quarter turns margins into scores.

Defined results: a null, empty or blank text has no indicators and scores as margin 0; without labels every score is
0.5, with one class only 0 or 1. A place counts once in a text however often its n-gram occurs, so very long texts need no
more room than the 131,072 places. Repeated rows are each scored alike; an empty table gives an empty result. Extra columns pass through; those named like an output column are replaced.
"""

from __future__ import annotations

import dataclasses
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.language_id import held_out
from maskwright.llm.runtime import add_columns, draw, hash_sample, keep_rows

PLACES = 1 << 17
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_cases = [(re.compile(p), s) for p, s in ((r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a"), (r"\d+", "0"), (r"(.)\1+", r"\1\1"))]


def shape(word: str) -> str:
    for pattern, by in _cases:
        word = pattern.sub(by, word)
    return word


class Words:
    """Hashes of distinct words and of their shapes, remembered by a worker up to a bound."""

    def __init__(self, most: int = 150_000):
        self.most, self.seen = most, {}

    def codes(self, distinct: list[bytes]) -> np.ndarray:
        if len(self.seen) + len(distinct) > self.most:
            self.seen = {}
        for w in distinct:
            if w not in self.seen:
                self.seen[w] = (zlib.crc32(w), zlib.crc32(shape(w.decode()).encode(), 7))
        return np.array([self.seen[w] for w in distinct], np.uint64).reshape(-1, 2)


_words = Words()


def _place(value: np.ndarray, kind: int) -> np.ndarray:
    value = (value + np.uint64(kind)) * _M1
    return (((value ^ (value >> np.uint64(31))) * _M2) >> np.uint64(47)).astype(np.int64)


def indicators(texts: pa.Array) -> list[np.ndarray]:
    """The distinct places of each text's n-grams, ascending; null and blank texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    if not len(data):
        return [np.zeros(0, np.int64)] * len(texts)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    # Every word and every stretch between is a piece; stretches are dropped after the hashing of distinct pieces.
    edge = np.ones(len(data), bool)
    edge[1:] = solid[1:] != solid[:-1]
    inner = offsets[:-1] - offsets[0]
    edge[inner[inner < len(data)]] = True
    starts = np.flatnonzero(edge)
    bounds = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    word = solid[starts]
    coded = pieces.filter(pa.array(word)).dictionary_encode()
    code = np.asarray(coded.indices)
    known = _words.codes(coded.dictionary.to_pylist())
    row = np.searchsorted(offsets - offsets[0], starts[word], "right") - 1
    out = np.zeros(len(texts) * PLACES, bool) if len(texts) <= 128 else None
    if out is None:
        half = len(texts) // 2
        return indicators(texts.slice(0, half)) + indicators(texts.slice(half))
    if len(code):
        w, s = known[code, 0], known[code, 1].copy()
        with_last = np.zeros(len(row), bool)
        with_last[1:] = row[1:] == row[:-1]
        s[1:][(code[1:] == code[:-1]) & with_last[1:]] ^= np.uint64(0x5BD1E995)
        base = row.astype(np.int64) * PLACES
        out[base + _place(w, 1)] = True
        out[base + _place(s, 2)] = True
        pair = with_last[1:]
        out[base[1:][pair] + _place(w[1:] * _M2 + w[:-1], 3)[pair]] = True
        two = s[1:] * _M2 + s[:-1]
        out[base[1:][pair] + _place(two, 4)[pair]] = True
        triple = pair[1:] & pair[:-1]
        out[base[2:][triple] + _place(s[2:] * _M1 + two[:-1], 5)[triple]] = True
    on = np.flatnonzero(out)
    ends = np.searchsorted(on, np.arange(1, len(texts) + 1) * PLACES)
    return [on[a:b] - k * PLACES for k, (a, b) in enumerate(zip([0, *ends[:-1]], ends))]


@dataclasses.dataclass
class Model:
    ratio: np.ndarray  # log-count ratios
    weight: np.ndarray
    slope: float
    shift: float
    constant: float | None = None

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        flat = np.concatenate([*rows, np.zeros(0, np.int64)])
        at = np.repeat(np.arange(len(rows)), sizes)
        ratio = self.ratio[flat]
        top = np.bincount(at, ratio * self.weight[flat], len(rows))
        return top / np.sqrt(np.maximum(np.bincount(at, ratio * ratio, len(rows)), 1e-12))

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(rows), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(rows) + self.shift, -30, 30)))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    counts = [np.bincount(np.concatenate([r for r, y in zip(rows, labels) if y == c] or [np.zeros(0, np.int64)]), minlength=PLACES) + smooth for c in (1, 0)]
    ratio = np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())
    # Places never seen in training carry no evidence.
    ratio[(counts[0] == smooth) & (counts[1] == smooth)] = 0
    return ratio


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], sign: np.ndarray, cost: np.ndarray, epochs: int = 30, seed: int = 8) -> np.ndarray:
    """Weights of the hinge-loss support vector machine; ``values`` are the rows' entries, of unit length or empty."""
    weight, alpha, order = np.zeros(PLACES), np.zeros(len(rows)), np.random.default_rng(seed)
    square = np.array([v @ v for v in values])
    for _ in range(epochs):
        worst = 0.0
        for i in order.permutation(len(rows)):
            if square[i] == 0:
                continue
            gradient = sign[i] * (weight[rows[i]] @ values[i]) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0:
                weight[rows[i]] += step * sign[i] * values[i]
                alpha[i], worst = new, max(worst, abs(step))
        if worst < 1e-3:
            break
    return weight


def platt(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift of the logistic curve through (margin, label), with Platt's softened targets, by Newton steps."""
    up, down = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hess = x.T @ (x * (p * (1 - p))[:, None]) + 1e-4 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (p - target) + 1e-4 * beta)
        beta -= np.clip(step, -5, 5)
    return float(max(beta[0], 0.0)), float(beta[1])


def fit(texts: list[str], labels: np.ndarray) -> Model:
    empty = np.zeros(PLACES)
    if not len(labels):
        return Model(empty, empty, 0.0, 0.0, 0.5)
    if len(set(labels.tolist())) < 2:
        return Model(empty, empty, 0.0, 0.0, float(labels[0]))
    rows = [r.astype(np.int32) for a in range(0, len(texts), 128) for r in indicators(pa.array(texts[a : a + 128], pa.large_string()))]
    rank = np.zeros(len(labels), int)
    for c in (0, 1):
        rank[labels == c] = np.arange((labels == c).sum())
    learn = rank % 4 != 3 if min((labels == 0).sum(), (labels == 1).sum()) >= 4 else np.ones(len(labels), bool)
    inside, y = [r for r, k in zip(rows, learn) if k], labels[learn]
    ratio = log_count_ratios(inside, y)
    values = [ratio[r] / max(np.sqrt(ratio[r] @ ratio[r]), 1e-6) for r in inside]
    cost = np.where(y == 1, len(y) / (2 * (y == 1).sum()), len(y) / (2 * (y == 0).sum()))
    weight = dual_coordinate_descent(inside, values, np.where(y == 1, 1.0, -1.0), cost)
    model = Model(ratio, weight, 1.0, 0.0)
    test = ~learn if not learn.all() else learn
    model.slope, model.shift = platt(model.margins([r for r, k in zip(rows, test) if k]), labels[test])
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", text_col: str = "text", id_col: str = "doc_id", per_class: int = 2000, most_bytes: int = 64 << 20) -> Model:
    """Fits on at most ``per_class`` labelled ids of each class, twice that many rows and ``most_bytes`` of text in all, drawn by a hash of the id.

    Held-out ids are never read; ids with both labels are not learned from.
    """
    named = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out())
    named = named.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("top")).where("y = top").drop("top")
    counts = {r.y: r.n for r in named.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = [F.xxhash64("doc_id", F.lit(8)), F.col("doc_id")]
    drawn = [hash_sample(named.where(F.col("y") == y), n, per_class, 8, "doc_id").orderBy(*order).limit(per_class) for y, n in sorted(counts.items())]
    if not drawn:
        return fit([], np.zeros(0, int))
    # At most twice per_class ids: a fixed bound, whatever the size of the tables.
    chosen = drawn[0].union(drawn[1]) if len(drawn) == 2 else drawn[0]
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    found = draw(texts.join(F.broadcast(chosen), "doc_id"), [*order, F.xxhash64("text")], 4 * per_class, most_bytes)
    found = sorted(found, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.text))
    return fit([r.text for r in found], np.array([r.y for r in found], int))


def add_scores(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``docs`` with score and predicted (1 from ``threshold``)."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # two vectors of PLACES

    def compute(texts: pa.Array) -> list:
        scores = held.value.scores(indicators(texts))
        return [scores, (scores >= threshold).astype(np.int32)]

    return add_columns(docs, text_col, [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())], compute, max_rows=128)


def accept(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows of ``docs`` scored at ``threshold`` or more; columns as they were."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    return keep_rows(docs, "text", lambda texts: held.value.scores(indicators(texts)) >= threshold)
