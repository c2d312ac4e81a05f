"""Quality classifier: logistic regression over hashed word n-grams, learned by follow-the-regularised-leader updates.

Words are runs of word characters or of punctuation, in lower case; the features of a text are its words, its pairs of
neighbouring words, and the shape of a pair (the same word again, or not), hashed to DIM places. A text is the
L2-normed vector of log(1 + count). Learning takes at most MAX_TRAIN labelled rows, those with the smallest hash of their
key, so that the sample is the same on every run; their features are made where the texts are read, and one task learns
from them in the order of that hash: follow-the-regularised-leader is sequential, and MAX_TRAIN bounds what the task
holds. Scoring is a sparse dot product for every text, with the weights (DIM floats) as a broadcast of fixed
size.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_runs, trim, with_arrow

DIM = 1 << 18
MAX_TRAIN, EPOCHS = 6000, 5
#: Follow-the-regularised-leader (proximal): step size, smoothing, L1 and L2.
ALPHA, BETA, L1, L2 = 2.0, 1.0, 0.02, 0.02

_WORD = re.compile(r"\w+|[^\w\s]+")
_AGAIN, _OTHER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start of each text's features and the end, places, values) of a batch."""
    words = [_WORD.findall((t or "").lower()) for t in texts]
    n = np.array([len(w) for w in words], np.int64)
    flat = [x for w in words for x in w]
    known: dict[str, int] = {w: xxhash.xxh3_64_intdigest(w) for w in set(flat)}
    h = np.fromiter(map(known.__getitem__, flat), np.uint64, len(flat))
    doc = np.repeat(np.arange(len(texts)), n)
    same = doc[1:] == doc[:-1]
    a, b, d2 = h[:-1][same], h[1:][same], doc[1:][same]
    with np.errstate(over="ignore"):
        pair = (a * np.uint64(0x9FB21C651E98DF25)) ^ (b + np.uint64(0x632BE59BD9B4E019))
        pair ^= pair >> np.uint64(29)
    shape = np.where(a == b, np.uint64(_AGAIN), np.uint64(_OTHER))
    place = (np.concatenate([h, pair, shape]) >> np.uint64(64 - 18)).astype(np.int64)
    key, count = np.unique(np.concatenate([doc, d2, d2]) * DIM + place, return_counts=True)
    doc, place, value = key // DIM, key % DIM, np.log1p(count)
    starts = np.searchsorted(doc, np.arange(len(texts) + 1))
    norm = np.sqrt(np.bincount(doc, value * value, len(texts)))
    return starts, place, value / np.maximum(norm, 1e-12)[doc]


@dataclass
class Model:
    weights: np.ndarray  # DIM floats
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        starts, place, value = features(texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(starts))
        z = self.bias + np.bincount(doc, self.weights[place] * value, len(texts))
        return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def learn(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias from (places, values, label), in the order given, EPOCHS times over."""
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)

    def weight(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rows = [(np.append(p, DIM), np.append(v, 1.0), y) for p, v, y in rows]
    for _ in range(EPOCHS):
        for p, v, y in rows:
            w = weight(p)
            g = (1.0 / (1.0 + np.exp(-np.clip(w @ v, -35, 35))) - y) * v
            step = (np.sqrt(n[p] + g * g) - np.sqrt(n[p])) / ALPHA
            z[p] += g - step * w
            n[p] += g * g
    w = weight(slice(None))
    return w[:DIM], float(w[DIM])


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", max_train: int = MAX_TRAIN) -> Model:
    """A model from the labelled rows; rows without a key, or with a label other than 0 and 1, teach nothing, and a key
    that is labelled or stored repeatedly counts as often as it is joined. Without any row, every text scores 0.5."""
    spark = docs.sparkSession
    own = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(F.col(key), F.col(label).cast("int").alias("_label"))
    sample = own.withColumn("_order", F.xxhash64(F.col(key), F.lit(7))).orderBy("_order", key, "_label").limit(max_train)
    # at most max_train rows of three numbers: a bound that no input can exceed
    joined = docs.select(key, text).join(F.broadcast(sample), key)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for texts in text_runs(b.column(0).to_pylist()):
                starts, place, value = features(texts)
                cells = [(place[i:j].astype(np.int32).tobytes(), value[i:j].astype(np.float32).tobytes()) for i, j in zip(starts, starts[1:])]
                label, order = (b.column(c).slice(at, len(texts)) for c in (1, 2))
                yield pa.RecordBatch.from_arrays([label, order, pa.array([c[0] for c in cells], pa.binary()), pa.array([c[1] for c in cells], pa.binary())], names=["label", "order", "place", "value"])
                at += len(texts)
        trim()

    def fitted(t: pa.Table) -> pa.Table:
        t = t.sort_by([("order", "ascending"), ("label", "ascending"), ("place", "ascending")])
        rows = [(np.frombuffer(p, np.int32), np.frombuffer(v, np.float32).astype(float), y) for p, v, y in zip(t["place"].to_pylist(), t["value"].to_pylist(), t["label"].to_pylist())]
        w, bias = learn(rows)
        n = len(rows)
        del t, rows
        trim()
        return pa.table({"n": [n], "bias": [bias], "weights": [w.astype(np.float32).tobytes()]})

    cells = joined.select(text, "_label", "_order").mapInArrow(featured, "label int, order long, place binary, value binary")
    parts = cells.groupBy(F.lit(0).alias("all")).applyInArrow(fitted, "n long, bias double, weights binary").collect()
    if not parts:
        return Model(np.zeros(DIM, np.float32), 0.0)
    return Model(np.frombuffer(parts[0].weights, np.float32), parts[0].bias)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, higher for likelier quality; null and empty texts get the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[pa.Array], pa.Array]:
        def make(column: pa.Array) -> pa.Array:
            return pa.array(np.concatenate([np.zeros(0), *(shared.value.scores(texts) for texts in text_runs(column.to_pylist()))]))

        return make

    return with_arrow(docs, [text], out, "double", start)
