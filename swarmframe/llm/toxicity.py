"""Toxicity of documents: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's words (letters, digits and bytes of other scripts; A-Z folded) are hashed in one vectorised pass over its bytes;
unigrams (words and their beginnings, as compounds share them), bigrams and pairs with one word between become buckets. A feature is present or not, so length does not add up.
FTRL keeps a rate per bucket, and its L1 term leaves most weights at zero: the model that travels to the tasks is the list
of buckets with a weight. Training reads a bounded sample of the labelled rows, half of it toxic where there are as many; the
intercept is moved back by the change in odds, so scores stay probabilities. Texts are read whole.

Cases: a null or empty text has no features and gets the intercept's score; repeated rows are scored each; labels without a
document, null labels and repeated labels are harmless (a repeated label counts each time); without labels the score is 0; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, shipped, texts_of

BUCKET_BITS = 22
STEMS = (4, 5, 6, 7)

_WORD = np.zeros(256, dtype=bool)
_WORD[128:] = True
for _range in (b"09", b"AZ", b"az"):
    _WORD[_range[0]:_range[1] + 1] = True
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[ord("A"):ord("Z") + 1] += np.uint64(32)
_P = np.uint64(1099511628211)  # fixed: an odd 64-bit prime
_POWERS = np.ones(4096, dtype=np.uint64)
np.multiply.accumulate(np.full(4095, _P, dtype=np.uint64), out=_POWERS[1:])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(29))
    return h * np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """A 64-bit hash per word, in order, and hashes of the first ``STEMS`` bytes of the words that are longer."""
    raw = np.frombuffer(data, dtype=np.uint8)
    inside = np.concatenate([[False], _WORD[raw], [False]])
    change = np.flatnonzero(inside[1:] != inside[:-1])
    begins, ends = change[::2], change[1::2]
    lengths = ends - begins
    if not len(begins):
        none = np.zeros(0, dtype=np.uint64)
        return none, [none] * len(STEMS)
    at = np.flatnonzero(inside[1:-1])
    place = at - np.repeat(begins, lengths)
    values = (_FOLD[raw[at]] + np.uint64(1)) * _POWERS[place % 4096]
    starts = np.cumsum(lengths) - lengths
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values)])  # wraps around, and so do the differences
    words = _mixed(sums[starts + lengths] - sums[starts])
    stems = [_mixed(sums[s + k] - sums[s]) * np.uint64(7) for k in STEMS for s in [starts[lengths > k]]]
    return words, stems


def _buckets(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Buckets of a text's words and their beginnings, word pairs and pairs with a word between; they may repeat."""
    h, stems = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    return np.concatenate([_buckets(x) for x in (h, h[:-1] * np.uint64(3) + h[1:], h[:-2] * np.uint64(5) + h[2:], *stems)])


@dataclass
class ToxicityModel:
    buckets: np.ndarray  # ascending
    weights: np.ndarray
    intercept: float

    def __post_init__(self) -> None:
        self._dense = None

    def score(self, text: str | None) -> float:
        if self._dense is None:
            self._dense = np.zeros(1 << BUCKET_BITS, dtype=np.float32)
            self._dense[self.buckets] = self.weights
        found = features(text)
        weights = self._dense[found]
        used = np.unique(found[weights != 0])
        z = self.intercept + float(self._dense[used].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-np.clip(z, -35, 35))))


def train(texts: Sequence[str | None], labels: Sequence[int], alpha: float = 1.0, beta: float = 1.0, l1: float | None = None,
          l2: float = 1.0, epochs: int = 10, positive_share: float | None = None, seed: int = 7) -> ToxicityModel:
    """FTRL-proximal over documents; ``positive_share`` is the share among all labelled rows, if the sample has another.

    ``l1``, unless given, follows the noise of the gradient sums: a third of the root of the number of toxic rows.
    """
    l1 = np.sqrt(sum(1 for x in labels if x == 1)) / 3 if l1 is None else l1
    n = 1 << BUCKET_BITS
    z, squares = np.zeros(n), np.zeros(n)
    z0 = squares0 = 0.0
    rows = [np.unique(features(t)) for t in texts]
    y = np.asarray(labels, dtype=float)

    def weights(at: np.ndarray) -> np.ndarray:
        small = np.abs(z[at]) <= l1
        w = -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(squares[at])) / alpha + l2)
        return np.where(small, 0.0, w)

    def intercept() -> float:
        return -z0 / ((beta + np.sqrt(squares0)) / alpha)

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at = rows[i]
            w, w0 = weights(at), intercept()
            p = 1 / (1 + np.exp(-np.clip(w0 + w.sum(), -35, 35)))
            g = p - y[i]
            rate = (np.sqrt(squares[at] + g * g) - np.sqrt(squares[at])) / alpha
            z[at] += g - rate * w
            squares[at] += g * g
            z0 += g - (np.sqrt(squares0 + g * g) - np.sqrt(squares0)) / alpha * w0
            squares0 += g * g
    w = weights(np.arange(n))
    used = np.flatnonzero(w)
    w0 = float(intercept())
    share = float(y.mean()) if len(y) else 0.0
    if positive_share and 0 < share < 1 and positive_share < 1:
        w0 += float(np.log(positive_share / (1 - positive_share)) - np.log(share / (1 - share)))
    if not len(y) or share == 0:
        w0 = -35.0
    return ToxicityModel(used, w[used].astype(np.float32), w0)


def fit_toxicity_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                       label_col: str = "toxic", rows_per_class: int = 2500, **options: float) -> ToxicityModel:
    """A model from at most about ``rows_per_class`` labelled rows of each class that are not held out."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    counts = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if not total:
        return train([], [])
    place = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20))
    limit = F.when(F.col("label") == 1, int(min(1.0, rows_per_class / max(counts.get(1, 0), 1)) * (1 << 20))).otherwise(
        int(min(1.0, rows_per_class / max(counts.get(0, 0), 1)) * (1 << 20)))
    # about 2 x rows_per_class rows of two numbers, whatever the size of the tables: the texts need not move
    texts = docs.select(docs[id_col].alias("k"), docs[text_col].alias("text"))
    picked = texts.join(F.broadcast(known.where(place < limit)), F.col("k") == F.col("id")).select("k", "text", "label")
    # ids that stand for many documents, or have many labels, are picked together: twice the expected number is the most that is taken
    picked = picked.orderBy(F.xxhash64("k", "text", "label")).limit(4 * rows_per_class)
    rows = sorted(picked.collect(), key=lambda r: (r["k"], r["text"] or "", r["label"]))
    return train([r["text"] for r in rows], [r["label"] for r in rows], positive_share=counts.get(1, 0) / total, **options)


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``score``) per row."""
    model_var = docs.sparkSession.sparkContext.broadcast(model)  # at most 12 bytes per bucket with a weight
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_var.value
        for batch in batches:
            scores = pa.array([own.score(t) for t in texts_of(batch.column(1))], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), scores], names=["doc_id", "score"])

    return shipped(rows).mapInArrow(run, f"doc_id {id_type}, score double")
