"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text's subwords are the byte n-grams (2 to 4) of its words, lower-cased, with a space
at either end of a word; digits and ASCII punctuation act as spaces. Each subword is
hashed to a row of an embedding table, the rows are averaged, and a linear softmax
gives the languages. Both are trained by stochastic gradient descent in numpy on a
bounded sample of labelled rows (per_language rows of each language at most, chosen by
a hash of doc_id). A fifth of the sample is kept for calibration.

Rejection. A softmax is sure of a language even of texts in none of them, so the score has
two factors. The probability is calibrated by a temperature fitted on the calibration
texts with smoothed labels, which keeps it below certainty where languages separate
perfectly. The evidence is the share of a text's subwords that training texts held, with
PRIOR subwords more that count as known, so that short texts are not judged by one odd word. A
text is accepted when its evidence is at least 1 - UNKNOWN, or less where all but a
thousandth of the calibration texts have less, and its score at least what all but a
thousandth of the rightly named calibration texts reach, and never more than one half.

Prediction needs only the table of embedding times softmax weights, so it is one pass
over the text with no state that grows with the corpus.

Defined cases: null text, and text without a letter, is `und` with score 0 and not
accepted; with no labelled rows everything is `und`. Ties between languages go to the
first in alphabetical order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS, WIDTH = 1 << 16, 16
KNOWN = 1 << 22  # places of the set of known subwords
UNKNOWN = 0.2  # share of unknown subwords that a text may have
PRIOR = 20
SMOOTHING = 0.02  # of the labels that fit the temperature
STEPS = 6000  # of gradient descent at least, by more epochs over a small sample
_FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalpha() else 32 for c in range(256))


def subwords(text: bytes) -> np.ndarray:
    """Hashes below KNOWN of the text's byte n-grams that lie within one word and its bounding spaces; the first 16 bits are the bucket."""
    folded = b" " + b" ".join(text.translate(_FOLD).split()) + b" "
    b = np.frombuffer(folded, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.int64)
    space = b == 32
    h, out = b, []
    inner = np.zeros(len(b), dtype=bool)
    for n in (2, 3, 4):
        if len(b) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        if n > 2:
            inner = inner[:-1] | space[n - 2 : len(b) - 1]
        else:
            inner = np.zeros(len(h), dtype=bool)
        g = h[~inner]
        out.append((g ^ (g >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(10))
    return np.concatenate(out).astype(np.int64)


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Model:
    """languages in order; weights: a row of logits for each subword bucket; known: whether training texts held a subword; least score and evidence of accepted texts."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    known: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0
    least_evidence: float = 0.0

    def logits(self, grams: np.ndarray) -> np.ndarray:
        if not len(grams):
            return self.bias
        ids = grams >> 6
        counts = np.bincount(ids, minlength=BUCKETS) if len(ids) > 4 * BUCKETS else None
        total = counts @ self.weights if counts is not None else self.weights[ids].sum(axis=0, dtype=np.float64)
        return total / len(ids) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or text is None or not has_letter(text):
            return "und", 0.0, False
        grams = subwords(text.encode())
        p = softmax(self.logits(grams) / self.temperature)
        best, sure = int(np.argmax(p)), evidence(grams, self.known)
        score = float(p[best]) * sure
        return self.languages[best], score, score >= self.threshold and sure >= self.least_evidence


def evidence(grams: np.ndarray, known: np.ndarray) -> float:
    return (int(known[grams].sum()) + PRIOR) / (len(grams) + PRIOR)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max())
    return e / e.sum()


def train(rows: list[tuple[int, str, str]], epochs: int = 4, rate: float = 0.5, seed: int = 7) -> Model:
    """Fit embeddings and softmax by SGD on (doc_id, text, lang) rows; every fifth, by hash, calibrates."""
    rows = sorted((r for r in rows if r[1] is not None and r[2] is not None and has_letter(r[1])), key=lambda r: (zlib.crc32(f"order {r[0]}".encode()), r[1]))
    languages = sorted({r[2] for r in rows})
    index = {v: i for i, v in enumerate(languages)}
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), np.zeros(KNOWN, bool))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH))
    lin, bias = np.zeros((len(languages), WIDTH)), np.zeros(len(languages))
    bags = []
    for doc_id, text, lang in rows:
        grams = subwords(text.encode())
        ids, counts = np.unique(grams >> 6, return_counts=True)
        if len(ids):
            bags.append((ids, counts / counts.sum(), index[lang], zlib.crc32(f"part {doc_id}".encode()) % 5 == 0, text))
    fit = [b for b in bags if not b[3]] or bags
    held = [b for b in bags if b[3]] or bags
    epochs = max(epochs, -(-STEPS // max(len(fit), 1)))
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for k in rng.permutation(len(fit)):
            ids, share, y, *_ = fit[k]
            lr = rate * (1 - done / steps)
            done += 1
            hidden = share @ emb[ids]
            g = softmax(lin @ hidden + bias)
            g[y] -= 1
            back = g @ lin
            lin -= lr * np.outer(g, hidden)
            bias -= lr * 0.1 * g
            emb[ids] -= lr * 10 * np.outer(share, back)
    known = np.zeros(KNOWN, bool)
    for *_, text in fit:
        known[subwords(text.encode())] = True
    model = Model(languages, (emb @ lin.T).astype(np.float32), bias, known)
    raw = np.array([share @ model.weights[ids] + bias for ids, share, *_ in held])
    truth = np.array([y for _, _, y, *_ in held])

    def loss(t: float) -> float:
        z = raw / t
        z = z - z.max(axis=1, keepdims=True)
        z = np.log(np.exp(z).sum(axis=1, keepdims=True)) - z
        return float(((1 - SMOOTHING) * z[np.arange(len(z)), truth] + SMOOTHING * z.mean(axis=1)).mean())

    model.temperature = min(np.geomspace(0.001, 100, 251), key=loss)
    sure = np.array([evidence(subwords(text.encode()), known) for *_, text in held])
    score = np.array([softmax(z / model.temperature).max() for z in raw]) * sure
    right = raw.argmax(axis=1) == truth
    model.threshold = float(min(0.5, np.quantile(score[right], 0.001))) if right.any() else 0.5
    model.least_evidence = float(min(1 - UNKNOWN, np.quantile(sure, 0.001)))
    for *_, text in held:
        known[subwords(text.encode())] = True
    return model


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of doc_id as text, modulo `of`; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % of


def fit(docs: DataFrame, per_language: int = 1200, usable: Column | None = None, sample_rows: int = 60_000) -> Model:
    """Train on a sample of labelled rows: per_language of each language, sample_rows in all, as expected numbers.

    usable says which rows may be learned from.
    """
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    if usable is not None:
        labelled = labelled.where(usable)
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return train([])
    per_language = min(per_language, sample_rows / len(sizes))
    unit = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, per_language / r["count"]))]), F.col("lang"))
    rows = labelled.where(unit < share).select("doc_id", "text", "lang").collect()
    return train([tuple(r) for r in rows])


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The kept columns of docs (all, if not named) with lang_pred, lang_score, lang_accepted.

    Columns of docs that have one of these three names give way to the operator's.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "lang_score", "lang_accepted")]
    need = list(dict.fromkeys([*names, "text"]))
    out = T.StructType([*docs.select(*names).schema, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_accepted", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.predict(t) for t in batch["text"].to_pylist()]
            cols = [batch[n] for n in names] + [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays(cols, names=[*names, "lang_pred", "lang_score", "lang_accepted"])

    return docs.select(*need).mapInArrow(run, out)
