"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader updates.

A text's words give two streams: the words in lower case, and their shapes (runs of lower-case letters,
capitals, digits and other characters, each run as one sign; a mark if the word is that before it).
Uni- and bigrams of either stream are hashed into 2**BITS weights. A score is the logistic of a sparse
dot product: the weights of all n-grams of the whole text, over their number, plus a bias.

Training takes one pass after another over at most `max_rows` labelled texts (those with the least
digest of their doc_id, so the choice doesn't depend on order); each coordinate has FTRL-proximal state,
and weights whose gradient sum stays within l1 are zero. Scoring runs over Arrow batches; what goes to
the executors is the weight vector, whose size is fixed.

Defined results: null and empty texts score as the bias alone; rows without doc_id are scored but never
learned from; where a doc_id has several labels the least counts; without any labelled text all scores are 0.5;
repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

BITS = 20
MAX_ROWS = 6000
#: FTRL: learning rate, its smoothing, L1 and L2, passes.
ALPHA, BETA, L1, L2, PASSES = 2.0, 1.0, 0.002, 0.0005, 3
#: Distinct words whose hashes a worker keeps at most; then it starts anew.
CACHE = 400_000
SPLIT = regex.compile(r"[^\x20\x09-\x0D]+").findall
_SHAPES = [(regex.compile(p), s) for p, s in ((r"\p{Lu}+", "\x01"), (r"\p{L}+", "\x02"), (r"\p{N}+", "\x03"))]
M32 = np.uint64(0xFFFFFFFF)
MIX = np.uint64(0x9E3779B97F4A7C15)


_COLLAPSE = regex.compile(r"(.)\1+", flags=regex.S)


def _hash(text: str) -> int:
    return crc32(text.encode("utf-8", "replace"))


def _slow_shape(word: str) -> str:
    for pattern, sign in _SHAPES:
        word = pattern.sub(sign, word)
    return _COLLAPSE.sub(r"\1", word)


def shape(word: str) -> str:
    """Runs of capitals, other letters, digits and each other character as one sign; most words need no pattern for it."""
    end = "" if word[-1].isalnum() else word[-1]
    body = word[: len(word) - len(end)]
    if body.isalpha() and not "" < end < "\x04":
        if body.islower():
            return "\x02" + end
        if body[0].isupper() and body[1:].islower():
            return "\x01\x02" + end
    return _slow_shape(word)


class Hashes(dict):
    """Word to (hash of the word, hash of its shape), in one 64-bit number."""

    def __init__(self):
        super().__init__()
        self.shapes: dict[str, int] = {}

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        kind = shape(word)
        low = self.shapes.get(kind)
        if low is None:
            if len(self.shapes) >= CACHE:
                self.shapes.clear()
            low = self.shapes[kind] = _hash(kind)
        self[word] = v = _hash(word.lower()) << 32 | low
        return v


def features(text: str | None, hashes: Hashes) -> np.ndarray:
    """Indices of all n-grams of a text, repeats included."""
    words = SPLIT(text or "")
    if not words:
        return np.empty(0, np.int64)
    v = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    word, kind = v >> np.uint64(32), v & M32
    if len(v) > 1:
        kind[1:] += np.uint64(0x51ED27) * (v[1:] == v[:-1])
    salt = lambda x, k: ((x + np.uint64(k)) * MIX) >> np.uint64(64 - BITS)
    pair = lambda x: (x[:-1] * np.uint64(0xC2B2AE3D) + x[1:]) & np.uint64(0xFFFFFFFFFFFF)
    return np.concatenate([salt(word, 1 << 40), salt(kind, 2 << 40), salt(pair(word), 3 << 50), salt(pair(kind), 4 << 50)]).astype(np.int64)


class Model:
    """Weights of the n-grams, and a bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def score(self, index: np.ndarray) -> float:
        z = self.bias + (float(self.weights[index].sum()) / len(index) if len(index) else 0.0)
        return float(1 / (1 + np.exp(-min(max(z, -30.0), 30.0))))


def train(rows: list[tuple[str | None, int]], passes: int = PASSES) -> Model:
    """FTRL-proximal over rows (text, label), in their order."""
    n = 1 << BITS
    z, g2 = np.zeros(n), np.zeros(n)
    zb = gb = 0.0
    bias, hashes = 0.0, Hashes()

    def weights(zi: np.ndarray, ni: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    examples = []
    for text, label in rows:
        index = features(text, hashes)
        which, count = np.unique(index, return_counts=True)
        examples.append((which.astype(np.int32), (count / max(1, len(index))).astype(np.float32), label))
    for _ in range(passes):
        for which, x, label in examples:
            zi, ni = z[which], g2[which]
            w = weights(zi, ni)
            bias = -zb / ((BETA + gb**0.5) / ALPHA + L2)
            p = 1 / (1 + np.exp(-min(max(float(w @ x) + bias, -30.0), 30.0)))
            g = (p - label) * x
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[which] = zi + g - sigma * w
            g2[which] = ni + g * g
            e = p - label
            zb += e - ((gb + e * e) ** 0.5 - gb**0.5) / ALPHA * bias
            gb += e * e
    return Model(weights(z, g2).astype(np.float32), -zb / ((BETA + gb**0.5) / ALPHA + L2) if gb else 0.0)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """A model of labels (doc_id, label), learned from at most max_rows texts of docs."""
    best = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.min("label").alias("label"))
    best = best.withColumn("at", F.md5(F.col("doc_id").cast("string")))
    chosen = best.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy("at", "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most max_rows ids
    texts = texts.groupBy("doc_id", "at", "label").agg(F.min("text").alias("text"))
    rows = sorted((at, text, label) for at, text, label in texts.select("at", "text", "label").toArrow().to_pandas().itertuples(index=False))
    return train([(text, int(label)) for _, text, label in rows])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score) for all of docs."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = Model(*shared.value), Hashes()
        for b in batches:
            got = [m.score(features(t.as_py(), hashes)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
