"""Language of documents: averaged hashed subword embeddings with a linear softmax.

Subwords are byte n-grams of the folded text (white space becomes one mark, so word ends count), hashed into buckets. A
bucket has a small vector; a document is the mean of its subwords' vectors; a softmax over a linear map gives the
languages. Both are trained by stochastic gradient descent in numpy on a bounded sample of labelled documents, picked by
a hash of the id; a part of it that is kept out fits the softmax temperature and the limits of rejection: the score, and how
common a text's subwords are in the languages learned (their mean log frequency, drawn to the usual one in short texts). The
limits are what right answers and mixtures of two known languages seldom miss; the second is half way down to the texts of
left-out languages (each taken out of the frequencies in turn) where those are lower still. A trained model is one number per bucket and language (its size is fixed by parameters), so scoring is a sum of
table rows over a text's bytes. Texts are read whole, in training too.

Cases: a text that is null or has no letter is ``und`` with score 0; ties go to the language that sorts first; repeated
rows are scored each; without a labelled row everything is ``und``; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, shipped, texts_of

UNKNOWN = "und"
BUCKET_BITS = 16
SIZES = (2, 3, 4)
#: Fixed: for how common subwords are, only those of lower-case words count, with so many of usual text added to each text.
WORD_SIZES, SHRINK = (4,), 20

# ASCII letters folded, white space to a mark, digits to one digit
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_FOLD[[9, 10, 11, 12, 13, 32]] = ord("_")
_FOLD[ord("0"):ord("9") + 1] = ord("0")
_PRIMES = np.array([2654435761, 2246822519, 3266489917, 668265263], dtype=np.uint32)  # fixed: odd multipliers


def subwords(data: bytes, size: int) -> np.ndarray:
    """Buckets of the byte n-grams of one length."""
    b = _FOLD[np.frombuffer(data, dtype=np.uint8)].astype(np.uint32)
    n = len(b) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    h = np.full(n, size * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
    for k in range(size):
        h = (h ^ b[k:k + n]) * _PRIMES[k % 4]
        h ^= h >> np.uint32(15)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _framed(text: str) -> bytes:
    return b"_" + text.encode("utf-8", "surrogatepass") + b"_"


_LETTERS = bytes(b if chr(b).isalpha() or b >= 128 else ord("_") for b in range(256))


def _words_only(text: str) -> bytes:
    """The text in lower case, one mark for whatever stands between letters."""
    b = np.frombuffer(_framed(text.lower()).translate(_LETTERS), dtype=np.uint8)
    return b[np.append(True, (b[1:] != ord("_")) | (b[:-1] != ord("_")))].tobytes()


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # bucket x language: vectors times the linear map
    bias: np.ndarray
    temperature: float
    reject_below: float
    common: np.ndarray | None = None  # per bucket the log frequency over all languages, less the usual mean of a text
    strange_below: float = -np.inf

    def logits(self, text: str) -> np.ndarray:
        return self._means(_framed(text), self.table, SIZES)[0] + self.bias

    def rejects(self, text: str, score: float) -> bool:
        """Whether a text with this score is of no known language."""
        if score < self.reject_below:
            return True
        if self.common is None:
            return False
        mean, n = self._means(_words_only(text), self.common, WORD_SIZES)
        return float(mean * n / (n + SHRINK)) < self.strange_below

    def _means(self, data: bytes, table: np.ndarray, sizes: Sequence[int]) -> tuple[np.ndarray, int]:
        total, n = np.zeros(table.shape[1:]), 0
        for at in range(0, len(data), 1 << 20):  # long texts a part at a time, overlapping by a subword
            for size in sizes:
                buckets = subwords(data[at:at + (1 << 20) + size - 1], size)
                n += len(buckets)
                total += table[buckets].sum(axis=0, dtype=np.float64)
        return total / max(n, 1), n

    def predict(self, text: str | None) -> tuple[str, float]:
        import regex

        if not self.languages or not text or not regex.search(r"\p{L}", text):
            return UNKNOWN, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def train(texts: Sequence[str], labels: Sequence[str], dim: int = 16, epochs: int = 6, rate: float = 0.5,
          keep_out: float = 0.2, rejected: float = 0.001, seed: int = 7) -> LanguageModel:
    """SGD over documents; the kept-out part sets the temperature and the score that ``rejected`` of its right answers miss."""
    languages = sorted(set(labels))
    if not languages:
        return LanguageModel([], np.zeros((1 << BUCKET_BITS, 0), dtype=np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    known = []
    for text in texts:
        data = _framed(text)
        counts = np.bincount(np.concatenate([subwords(data, s) for s in SIZES]), minlength=1)
        at = np.flatnonzero(counts)
        known.append((at, counts[at] / max(counts.sum(), 1)))
    target = np.array([languages.index(x) for x in labels])
    order = rng.permutation(len(known))
    n_out = int(len(known) * keep_out)
    out, fit = order[:n_out], order[n_out:]
    vectors = rng.normal(0, 0.1, (1 << BUCKET_BITS, dim))
    linear, bias = rng.normal(0, 0.1, (dim, len(languages))), np.zeros(len(languages))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(fit):
            at, weight = known[i]
            mean = weight @ vectors[at]
            z = mean @ linear + bias
            error = np.exp(z - z.max())
            error /= error.sum()
            error[target[i]] -= 1
            back = linear @ error
            linear -= step * np.outer(mean, error)
            bias -= step * 0.1 * error
            vectors[at] -= (step * 50 * weight)[:, None] * back  # a mean spreads a gradient thin over its subwords
    table = (vectors @ linear).astype(np.float32)
    z = np.array([weight @ table[at] + bias for at, weight in (known[i] for i in (out if n_out else fit))])
    truth = target[out if n_out else fit]

    def probabilities(temperature: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
        return e / e.sum(axis=1, keepdims=True)

    rows = np.arange(len(truth))
    temperature = min(np.geomspace(0.25, 4, 25), key=lambda t: -np.log(probabilities(t)[rows, truth] + 1e-12).mean())
    p = probabilities(temperature)
    right = p.argmax(axis=1) == truth
    scores = np.sort(p[rows, truth][right])
    reject = float(scores[int(len(scores) * rejected)]) if len(scores) else 0.0
    # mixtures: texts of two or more languages, equal parts of each
    right_at = np.flatnonzero(right)
    mixtures = []
    for count in range(2, min(len(languages), 4) + 1):
        for _ in range(200 if len(set(truth[right_at])) >= count else 0):
            some = rng.choice(np.unique(truth[right_at]), count, replace=False)
            mixtures.append([int(rng.choice(right_at[truth[right_at] == k])) for k in some])
    if mixtures:
        mixed = np.array([z[m].mean(axis=0) for m in mixtures]) / temperature
        e = np.exp(mixed - mixed.max(axis=1, keepdims=True))
        reject = min(reject, _low((e / e.sum(axis=1, keepdims=True)).max(axis=1), rejected))

    words = []
    for text in texts:
        data = _words_only(text)
        counts = np.bincount(np.concatenate([subwords(data, size) for size in WORD_SIZES]), minlength=1)
        at = np.flatnonzero(counts)
        words.append((at, counts[at]))
    per_language = np.zeros((len(languages), 1 << BUCKET_BITS))
    for i in fit:
        at, counts = words[i]
        per_language[target[i], at] += counts
    part = [words[i] for i in (out if n_out else fit)]
    sizes = np.array([counts.sum() for _, counts in part])

    def familiar(counts: np.ndarray, usual_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log frequencies by ``counts``, less their median over texts ``usual_of``; the shrunk means of all texts of ``part``."""
        logs = np.log((counts + 0.1) / (counts.sum() + 0.1 * len(counts)))
        means = np.array([n @ logs[at] / max(n.sum(), 1) for at, n in part])
        usual = float(np.median(means[usual_of])) if len(usual_of) else 0.0
        return logs - usual, (means - usual) * sizes / (sizes + SHRINK)

    common, own = familiar(per_language.sum(axis=0), right_at)
    strange = _low(np.array([*own[right_at], *(own[m].mean() for m in mixtures)]), rejected) if len(right_at) else -np.inf
    foreign = []
    for k in range(len(languages) if len(languages) > 1 else 0):
        _, scores = familiar(per_language.sum(axis=0) - per_language[k], right_at[truth[right_at] != k])
        foreign += scores[truth == k].tolist()
    # half way down to the texts of left-out languages, where those are lower; with one language nothing shows what is strange
    if not foreign:
        strange = -np.inf
    elif np.quantile(foreign, 0.99) < strange:
        strange = (strange + float(np.quantile(foreign, 0.99))) / 2
    return LanguageModel(languages, table, bias, float(temperature), reject, common.astype(np.float32), float(strange))


def _low(scores: np.ndarray, share: float) -> float:
    """The score that ``share`` of ``scores`` are below."""
    return float(np.sort(scores)[int(len(scores) * share)])


def training_sample(docs: DataFrame, id_col: str, text_col: str, label: Column, rows: int, least: int = 200,
                    max_labels: int = 200) -> list:
    """About ``rows`` labelled rows (all, if fewer), by a hash of id and text: (text, label).

    Every label has its share of them, but about ``least`` rows where it has as many; labels beyond the ``max_labels`` most frequent
    are not sampled. Twice the expected number is the most that is taken, as rows of one id (or null) are picked together.
    """
    labelled = docs.where(label.isNotNull() & F.col(text_col).isNotNull()).select(
        docs[id_col].alias("id"), docs[text_col].alias("text"), label.alias("label"))
    counts = labelled.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(max_labels).collect()
    n = sum(r["n"] for r in counts)
    if not n:
        return []
    share = min(1.0, rows / n)
    shares = {r["label"]: max(share, min(1.0, least / r["n"])) for r in counts}
    limit = F.lit(0)
    for name, part in shares.items():
        limit = F.when(F.col("label") == name, int(part * (1 << 20))).otherwise(limit)
    place = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20))
    expected = sum(part * r["n"] for part, r in zip(shares.values(), counts, strict=True))
    picked = labelled.where(place < limit).select("text", "label", F.xxhash64("id", "text").alias("k"))
    return picked.orderBy("k").limit(int(2 * expected) + 100).collect()


def fit_language_model(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                       sample_rows: int = 3000, **options: float) -> LanguageModel:
    """A model from about ``sample_rows`` labelled rows that are not held out, more where rare languages need them (see ``training_sample``)."""
    rows = training_sample(docs.where(~held_out(id_col)), id_col, text_col, F.col(lang_col).cast("string"), sample_rows)
    return train([r["text"] for r in rows], [r["label"] for r in rows], **options)


def predict_languages(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``text_key``, ``lang_pred``, ``score``, ``rejected``) per row."""
    model_var = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of buckets and languages
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(docs[text_col]).alias("text_key"), docs[text_col].cast("string").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_var.value
        for batch in batches:
            found = [own.predict(t) for t in texts_of(batch.column(2))]
            score = [s for _, s in found]
            rejected = [lang == UNKNOWN or own.rejects(t, s) for t, (lang, s) in zip(texts_of(batch.column(2)), found, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([lang for lang, _ in found], pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())],
                names=["doc_id", "text_key", "lang_pred", "score", "rejected"])

    return shipped(rows).mapInArrow(run, f"doc_id {id_type}, text_key long, lang_pred string, score double, rejected boolean")


def keep_known_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose language the model does not reject."""
    model_var = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model_var.value
        for batch in batches:
            found = [own.predict(t) for t in texts_of(batch.column(at))]
            stays = [lang != UNKNOWN and not own.rejects(t, s) for t, (lang, s) in zip(texts_of(batch.column(at)), found, strict=True)]
            yield batch.filter(pa.array(stays, pa.bool_()))

    return shipped(docs).mapInArrow(run, docs.schema)
