"""Toxicity by multiple-instance learning: a document is toxic if any of its sentences is.

A sentence's probability is a logistic function of its words; the document's is their noisy-or. Weights are trained
from document labels alone, and the sentence probabilities then point to the sentences that offend.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, written

#: The model is fitted on so many labelled rows at most, those with the least hash of doc_id.
TRAIN_ROWS = 20_000
#: Words that the model weighs: all that so many training rows hold and whose dependence on the label is beyond chance.
MIN_DOCS, MIN_CHI = 6, 20
#: Lengths of the word beginnings that count as features beside whole words, marked by a final "~".
BEGINNINGS = (3, 4, 5, 6, 7)
#: The one letter whose small form takes two characters.
_DOTTED = "\u0130"
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*|[.!?\n]+")


def sentences(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _SENTENCE.finditer(text)]


def features(train: DataFrame) -> list[str]:
    """The words whose presence depends on the label, MIN_CHI or more by chi squared; train: text, label."""
    words = F.regexp_extract_all(F.lower(F.translate("text", _DOTTED, "i")), F.lit(r"(\p{L}+)"), 1)
    begun = [F.transform(F.filter(words, lambda w: F.length(w) > k), lambda w: F.concat(F.left(w, F.lit(k)), F.lit("~"))) for k in BEGINNINGS]  # noqa: B023
    word = F.explode(F.array_distinct(F.concat(words, *begun))).alias("word")
    size = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    n, pos = size["n"], size["pos"]
    if not pos or pos == n:
        return []
    counts = train.select("label", word).groupBy("word").agg(F.count("*").alias("df"), F.sum("label").alias("a")).where(F.col("df") >= MIN_DOCS)
    expected = F.col("df") * F.lit(pos / n)
    chi = (F.col("a") - expected) * (F.col("a") - expected) * F.lit(n / (n - pos)) / (expected * (1 - F.col("df") / F.lit(n + 1)))
    return sorted(r["word"] for r in counts.where(chi > MIN_CHI).select("word").collect())  # bounded by the words of TRAIN_ROWS texts


class _Features(dict):
    """word -> its features' numbers, found once per word; starts anew when it holds many words."""

    def __init__(self, names: list[str]):
        super().__init__()
        self.index = {w: k for k, w in enumerate(names)}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        keys = (word, *(f"{word[:k]}~" for k in BEGINNINGS if len(word) > k))
        self[word] = found = tuple(self.index[k] for k in keys if k in self.index)
        return found


def _hits(text: str, known: _Features) -> list[tuple[int, int]]:
    """(sentence, feature) pairs of a text, each once."""
    low = text.replace(_DOTTED, "i").lower()  # place for place
    if not any(known[w] for w in set(_WORD.findall(low))):
        return []
    found = [(m.start(), f) for m in _WORD.finditer(low) for f in known[m.group()]]
    starts = [a for a, _ in sentences(text)]
    return sorted({(int(s) - 1, f) for s, (_, f) in zip(np.searchsorted(starts, [p for p, _ in found], "right"), found, strict=True)})


def train(docs: DataFrame, labels: DataFrame) -> tuple[list[str], np.ndarray, float]:
    """(words, weights, bias) from docs (doc_id, text) and labels (doc_id, label 0/1); null texts and labels are left out.

    Of more than TRAIN_ROWS labels those with the least hash of doc_id, on a tie the least id, count; repeated rows of
    docs count as often as they come. Without labels there are no words, and each sentence scores next to nothing.
    """
    labels = labels.where("label is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    chosen = written(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS), "toxic-ids")
    # TRAIN_ROWS ids at most: they go to the texts, so that no text is shuffled
    rows = written(docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), "doc_id"), "toxic-train")
    words = features(rows)

    def each(batches):
        index = _Features(words)
        for b in batches:
            texts = b.column("text").to_pylist()
            got = [_hits(t, index) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("label"), pa.array([len(sentences(t)) for t in texts], pa.int32()), pa.array([[s for s, _ in g] for g in got], pa.list_(pa.int32())), pa.array([[f for _, f in g] for g in got], pa.list_(pa.int32()))],
                ["doc_id", "label", "n", "s", "f"],
            )

    bags = rows.mapInArrow(each, f"doc_id {kind_of(rows)}, label int, n int, s array<int>, f array<int>").toPandas()
    bags = bags.sort_values(["doc_id", "n", "label"]).reset_index(drop=True)
    return words, *fit(bags, len(words))


def fit(bags: pd.DataFrame, k: int, steps: int = 600, rate: float = 0.1, decay: float = 1e-5) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the noisy-or log loss over bags (label, n sentences, s, f), by Adam."""
    if not len(bags):
        return np.zeros(k), -8.0
    doc = np.repeat(np.arange(len(bags)), bags["s"].map(len))
    s = np.concatenate([*bags["s"], np.empty(0, np.int64)]).astype(np.int64)
    f = np.concatenate([*bags["f"], np.empty(0, np.int64)]).astype(np.int64)
    _, sent = np.unique(doc * (int(bags["n"].max()) + 1) + s, return_inverse=True)
    n_sent = int(sent.max()) + 1 if len(sent) else 0
    of = np.zeros(n_sent, np.int64)
    of[sent] = doc
    plain = bags["n"].to_numpy() - np.bincount(of, minlength=len(bags))  # sentences without a feature
    y = bags["label"].to_numpy(float)
    w, b = np.zeros(k), -8.0
    m, v = np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(sent, w[f], minlength=n_sent)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        log_none = np.bincount(of, -np.logaddexp(0, z), minlength=len(bags)) - plain * np.logaddexp(0, b)
        none = np.exp(log_none)
        # d loss / d log_none, then down to the sentences: d log_none / dz = -p
        g = np.where(y > 0, none / np.maximum(1 - none, 1e-9), -1.0) / len(bags)
        dz = -p * g[of]
        grad = np.append(np.bincount(f, dz[sent], minlength=k) + decay * w, dz.sum() - (plain * p0 * g).sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-12)
        w, b = w - step[:k], min(b - step[k], -1.0)
    return w, float(b)


def score(docs: DataFrame, model: tuple[list[str], np.ndarray, float], offending: float = 0.5) -> DataFrame:
    """(doc_id, score, offending): noisy-or probability, and start:end of the sentences that reach `offending`.

    Offsets are code points, end exclusive. A null or empty text scores 0 and has no sentences. A row for each of docs,
    repeated ones too; doc_id may have any type, other columns are ignored.
    """
    words, w, b = model

    def one(text: str | None, index: _Features) -> tuple[float, str]:
        if not text:
            return 0.0, ""
        spans, got = sentences(text), _hits(text, index)
        z = np.full(len(spans), b)
        for s, f in got:
            z[s] += w[f]
        p = 1 / (1 + np.exp(-z))
        return float(-np.expm1(-np.logaddexp(0, z).sum())), ",".join(f"{spans[k][0]}:{spans[k][1]}" for k in np.flatnonzero(p >= offending))

    def each(batches):
        index = _Features(words)
        for batch in batches:
            got = [one(t, index) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([g for g, _ in got], pa.float64()), pa.array([s for _, s in got], pa.string())], ["doc_id", "score", "offending"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind_of(docs)}, score double, offending string")
