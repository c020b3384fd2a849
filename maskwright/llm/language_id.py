"""Language identification with string kernels: Nystroem landmarks and one-versus-rest kernel ridge regression.

The kernel is a blended spectrum over letters: texts share as many points as they share distinct character n-grams
(n = 1..4, presence not count), divided by the root of each text's own number. n-grams are hashed into 65,536 places.
Training maps a bounded sample onto landmark similarities, whitens them by the landmark kernel, and solves a ridge
regression for each language against the rest. As the kernel is linear in presence, landmarks and coefficients fold
into one weight matrix, and a batch of texts is scored by one matrix product.

Defined results: a null text, or one without any letter, is ``und`` with score 0; the same where no row can be learned from.
Ties go to the first language in alphabetical order. NUL and other characters that are no letters only part words. Very long texts
count whole, half a million characters at a time. Repeated rows are each scored alike; an empty table gives an empty result. Extra columns pass through; those named like an output are replaced.
"""

from __future__ import annotations

import dataclasses
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.llm.runtime import add_columns, draw, keep_rows

PLACES = 1 << 16
ORDERS = 4
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def presence(texts: list[str]) -> np.ndarray:
    """len(texts) x PLACES matrix of 0 and 1: hashed n-grams of whole texts; rows without a letter are zero."""
    out = np.zeros((len(texts), PLACES), np.uint8)
    flat, letter = out.reshape(-1), _is_letter()
    for lo, hi in _spans([len(t) for t in texts]):
        lower = [t.lower() for t in texts[lo:hi]]
        # A separator ends every text; lower-casing may change a text's length.
        points = np.frombuffer("\0".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        row = np.repeat(np.arange(lo, hi), [len(t) + 1 for t in lower])
        is_letter = letter[points]
        # Runs of anything else become one blank.
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]
        code = np.where(is_letter, points, 32)[keep].astype(np.uint64)
        row = row[keep].astype(np.int64)
        value = np.zeros(len(code), np.uint64)
        for n in range(1, ORDERS + 1):
            if len(code) < n:
                break
            value = (value[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15)) ^ (code[n - 1 :] + np.uint64(n))
            mixed = ((value ^ (value >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)
            same = row[n - 1 :] == row[: len(row) - n + 1]
            flat[(row[: len(mixed)] * PLACES + mixed.astype(np.int64))[same]] = 1
    none = [i for i, t in enumerate(texts) if not any(c.isalpha() for c in t)]
    out[none] = 0
    return out


def _spans(lengths: list[int], most: int = 500_000):
    lo, held = 0, 0
    for k, n in enumerate(lengths):
        if held and held + n > most:
            yield lo, k
            lo, held = k, 0
        held += n + 1
    if lengths:
        yield lo, len(lengths)


@dataclasses.dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # PLACES x languages
    sharpness: float

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(kernel regression values, whether the text has a letter)."""
        found = presence(texts)
        size = found.sum(1, dtype=np.int64)
        return (found.astype(np.float32) @ self.weights) / np.sqrt(np.maximum(size, 1))[:, None], size > 0

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        values, known = self.scores(texts)
        best = values.argmax(1)
        shares = _softmax(values * self.sharpness)[np.arange(len(texts)), best]
        return [self.languages[b] if k else "und" for b, k in zip(best, known)], np.where(known, shares, 0.0)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(texts: list[str], langs: list[str], landmarks: int = 256, ridge: float = 1e-3) -> Model | None:
    """A model of the sample, or None if no text has a letter. Landmarks are taken from every language in turn."""
    languages = sorted(set(langs))
    turn: dict[str, int] = {}
    order = []
    for k, lang in enumerate(langs):
        turn[lang] = turn.get(lang, -1) + 1
        order.append((turn[lang], lang, k))
    texts, langs = [texts[k] for *_, k in sorted(order)], [langs[k] for *_, k in sorted(order)]
    marks = presence(texts[:landmarks]).astype(np.float32)
    marks = marks[marks.any(1)]
    if not len(marks):
        return None
    marks /= np.sqrt(marks.sum(1))[:, None]
    rows = []
    for a in range(0, len(texts), 64):
        block = presence(texts[a : a + 64]).astype(np.float32)
        rows.append((block @ marks.T) / np.sqrt(np.maximum(block.sum(1), 1))[:, None])
    near = np.concatenate(rows).astype(np.float64)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    held = values > values.max() * 1e-8
    whiten = vectors[:, held] / np.sqrt(values[held])
    mapped = near @ whiten
    target = np.where(np.array(langs)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
    # Each language counts alike, however many rows of it the sample has.
    weight = 1.0 / np.array([turn[x] + 1 for x in langs])
    gram = mapped.T @ (mapped * weight[:, None]) + ridge * np.eye(mapped.shape[1])
    solved = whiten @ np.linalg.solve(gram, mapped.T @ (target * weight[:, None]))
    fitted, truth = near @ solved, target.argmax(1)
    loss = {s: -np.log(_softmax(fitted * s)[np.arange(len(truth)), truth] + 1e-12).mean() for s in (1.0, 2.0, 4.0, 8.0)}
    return Model(languages, marks.T @ solved.astype(np.float32), min(loss, key=loss.get))


def held_out(id_col: str = "doc_id"):
    """Rows kept out of training: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", per_language: int = 300, most: int = 4000, most_bytes: int = 64 << 20) -> Model | None:
    """Fits on about ``per_language`` labelled rows a language, ``most`` rows and ``most_bytes`` of text in all, drawn by a hash of the id."""
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("doc_id")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()}
    if not counts:
        return None
    quota = max(1, min(per_language, most // len(counts)))
    shares = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, quota / n)))])
    # The shares bound what is drawn to about ``quota`` rows a language; the limits hold where one id has many rows.
    drawn = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(1 << 30)) < F.coalesce(F.try_element_at(shares, F.col("lang")), F.lit(0.0)) * (1 << 30))
    chosen = draw(drawn, [F.xxhash64("doc_id", F.lit(7)), F.col("doc_id"), F.col("lang"), F.xxhash64("text")], most, most_bytes)
    chosen = sorted(chosen, key=lambda r: (zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.lang, r.text))
    return fit([r.text for r in chosen], [r.lang for r in chosen]) if chosen else None


def add_predictions(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # PLACES x languages floats

    def compute(texts: pa.Array) -> list:
        every = [t or "" for t in texts.to_pylist()]
        if held.value is None:
            return [["und"] * len(every), [0.0] * len(every)]
        langs, scores = held.value.predict(every)
        return [langs, scores.astype(float)]

    return add_columns(docs, text_col, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], compute, max_rows=64)


def accept(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """Rows of ``docs`` in a language that the model recognises with a score of ``least`` or more; columns as they were."""
    held = docs.sparkSession.sparkContext.broadcast(train(docs))

    def decide(texts: pa.Array) -> np.ndarray:
        if held.value is None:
            return np.zeros(len(texts), bool)
        langs, scores = held.value.predict([t or "" for t in texts.to_pylist()])
        return (np.array(langs) != "und") & (scores >= least)

    return keep_rows(docs, "text", decide, max_rows=64)
