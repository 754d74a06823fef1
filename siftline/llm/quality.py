"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives and unlabelled web text train g on measurements of the text. With the class prior pi the risk is
pi * E_P[l(g, +1)] + max(0, E_U[l(g, -1)] - pi * E_P[l(g, -1)]): negatives are never needed, and the clipped term keeps g
from overfitting the positives. Where the clipped term is negative, a step goes against its gradient, as its authors
propose.

The loss is the squared one and g is linear in steps of the measurements, so that the risk needs the means and mean
products of the steps only. Spark sums these over every unlabelled text, however many there are. The prior comes from
positives and unlabelled texts alone: among the texts that look most like positives nearly all are, so the least ratio
of the shares of unlabelled texts and of positives above a threshold estimates it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kind_of, written
from .shingles import shingle_hashes, word_hashes

#: Labelled positives that the model is fitted on at most: least hash of doc_id. Unlabelled texts all count.
TRAIN_ROWS = 20_000
#: Where each measurement steps: these quantiles of it over all texts.
STEPS_AT = (0.01, 0.03, 0.1, 0.25, 0.5, 0.75, 0.9, 0.97, 0.99)
#: Thresholds tried for the prior, and the least share of positives above one.
CELLS, LEAST_SHARE = 400, 0.2
#: Weight of the squared coefficients: so much at least, and more with few positives (this over their number).
RIDGE, RIDGE_ROWS = 0.01, 10
#: Measurements: each a share or a logarithm, so that the length of a text doesn't set their scale.
NAMES = ("log_words", "word_length", "symbols", "marks", "upper", "digits", "other_punctuation", "distinct_words", "distinct_trigrams", "lines", "distinct_lines", "not_ascii")
_CLASSES = [b"#*$%&|<>", b"!?", bytes(range(65, 91)), bytes(range(48, 58)), b",.;:-'\"()"]


def measurements(texts: list[str | None]) -> np.ndarray:
    """One row of NAMES per text; a null or empty text measures 0 throughout."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    words, begin = word_hashes(texts, lower=False)
    kinds = np.zeros((256, len(_CLASSES) + 1))
    for k, c in enumerate(_CLASSES):
        kinds[list(c), k] = 1
    kinds[128:192, len(_CLASSES)] = 1  # a continuation byte: one at least in each character beyond ASCII
    out = np.zeros((len(texts), len(NAMES)))
    for k, r in enumerate(raw):
        w = words[begin[k] : begin[k + 1]]
        if not len(w):
            continue
        symbols, marks, upper, digits, punctuation, wide = np.bincount(np.frombuffer(r, np.uint8), minlength=256) @ kinds
        size, grams, lines = len(w), shingle_hashes(w, 3), [x for x in r.split(b"\n") if x.strip()]
        chars = max(1, len(r) - size)
        out[k] = (np.log(size), chars / size / 10, symbols / size, marks / size, upper / chars, digits / chars, punctuation / size, len(np.unique(w)) / size,
                  len(np.unique(grams)) / len(grams), len(lines) / size, len(set(lines)) / max(1, len(lines)), wide / chars)
    return out


def _frame(docs: DataFrame, *keep: str) -> DataFrame:
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def each(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(list(measurements(b.column("text").to_pylist())), pa.list_(pa.float64()))], [*keep, "x"])

    return docs.select(*keep, "text").mapInArrow(each, ", ".join([*(f"{c} {kinds[c]}" for c in keep), "x array<double>"]))


def _steps(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The basis of g: 1, and for each measurement and cut whether the one exceeds the other."""
    return np.concatenate([np.ones((len(x), 1)), (x[:, :, None] > cuts[None]).reshape(len(x), -1)], axis=1)


def _summed(rows: DataFrame, of, size: int) -> np.ndarray:
    """Sums of of(x), an array of size numbers, over the measurements x of all rows: first within tasks, then by Spark
    in a few tasks; the driver gets a row from each of these."""
    fan = 16

    def each(batches):
        total = np.zeros(size)
        for b in batches:
            if b.num_rows:
                total += of(np.stack(b.column("x").to_numpy(zero_copy_only=False)))
        yield pa.RecordBatch.from_arrays([pa.array([list(total)], pa.list_(pa.float64()))], ["x"])

    def again(batches):
        total = np.zeros(size)
        for b in batches:
            for v in b.column("x").to_numpy(zero_copy_only=False):
                total += v
        yield pa.RecordBatch.from_arrays([pa.array([list(total)], pa.list_(pa.float64()))], ["x"])

    parts = rows.select("x").mapInArrow(each, "x array<double>").repartition(fan).mapInArrow(again, "x array<double>").toPandas()["x"]
    return np.sum([np.asarray(v) for v in parts], axis=0)


def class_prior(above_p: np.ndarray, above_u: np.ndarray, n_p: int, n_u: int) -> float:
    """Share of positives among the unlabelled from the shares of both above falling thresholds, within 0.05 and 0.99.

    A ratio counts with a margin for chance, so that thresholds with few texts above them don't decide.
    """
    fits = above_p >= LEAST_SHARE
    if not fits.any():
        return 0.99
    p, u = above_p[fits], above_u[fits]
    margin = np.sqrt(u / n_u) + np.sqrt(p * (1 - p) / n_p) * u / p
    ratio = (u + margin) / p
    k = int(ratio.argmin())
    return float(np.clip(u[k] / p[k], 0.05, 0.99))


def fit(mean_p: np.ndarray, gram_p: np.ndarray, mean_u: np.ndarray, gram_u: np.ndarray, prior: float, ridge: float = RIDGE, steps: int = 400, rate: float = 0.005) -> np.ndarray:
    """Coefficients of g that lessen the non-negative risk with the loss (1 - z)^2 / 4, from means and mean products.

    Starts where the risk without the clipping is least, which equations give, and goes on by Adam where that makes
    the clipped term negative.
    """
    k = len(mean_p)
    w = np.linalg.solve(gram_u + ridge * np.eye(k), 2 * prior * mean_p - mean_u)
    m, v = np.zeros(k), np.zeros(k)
    for t in range(1, steps + 1):
        loss = lambda mean, gram: (1 + 2 * mean @ w + w @ gram @ w) / 4  # noqa: E731  of the label -1
        slope = lambda mean, gram: (mean + gram @ w) / 2
        minus = loss(mean_u, gram_u) - prior * loss(mean_p, gram_p)
        if minus >= 0 and t == 1:
            return w
        d_minus = slope(mean_u, gram_u) - prior * slope(mean_p, gram_p)
        grad = prior * (gram_p @ w - mean_p) / 2 + d_minus + ridge * w / 2 if minus >= 0 else -d_minus
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def train(docs: DataFrame, labels: DataFrame) -> dict | None:
    """The model from unlabelled docs (doc_id, text) and labels (doc_id, label 0/1); None without positives or texts.

    Of the labels only the ones serve. Null texts and labels are left out. Repeated rows of docs count as often as
    they come; of more than TRAIN_ROWS positives those with the least hash of doc_id, on a tie the least id, count.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    # ids alone are sorted; there are TRAIN_ROWS at most, so that they go to the texts
    good = written(labels.where("label = 1").select("doc_id").distinct().orderBy(*order).limit(TRAIN_ROWS), "quality-ids")
    rows = written(_frame(docs.where("text is not null"), "doc_id"), "measured")
    positive = written(rows.join(F.broadcast(good), "doc_id", "left_semi"), "positives")
    n_u, n_p = rows.count(), positive.count()
    if not n_p or not n_u:
        return None
    at = rows.agg(*[F.percentile_approx(F.col("x")[k], list(STEPS_AT), 2000).alias(f"q{k}") for k in range(len(NAMES))]).first()
    cuts = np.array([list(q) for q in at])
    k = 1 + cuts.size

    def moments(x: np.ndarray) -> np.ndarray:
        s = _steps(x, cuts)
        return (s.T @ s).ravel()

    gram_u = _summed(rows, moments, k * k).reshape(k, k) / n_u
    # each half of the positives tells the prior by how the other half's likeness to positives is spread
    side = F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))
    halves = [written(positive.where(side == i), "half") for i in (0, 1)]
    sizes = [h.count() for h in halves]
    sums = [_summed(h, moments, k * k).reshape(k, k) for h in halves]
    gram_p, ridge = (sums[0] + sums[1]) / n_p, max(RIDGE, RIDGE_ROWS / n_p)
    edges = np.linspace(0, 4, CELLS + 1)[1:-1]
    priors = []
    for i in (0, 1):
        if not sizes[i] or not sizes[1 - i]:
            continue
        likeness = np.linalg.solve(gram_u + ridge * np.eye(k), sums[i][0] / sizes[i])  # density of positives over that of all texts

        def cells(x: np.ndarray, likeness=likeness) -> np.ndarray:
            return np.bincount(np.searchsorted(edges, _steps(x, cuts) @ likeness), minlength=CELLS).astype(float)

        above_u, above_p = (np.cumsum(_summed(r, cells, CELLS)[::-1]) / n for r, n in ((rows, n_u), (halves[1 - i], sizes[1 - i])))
        priors.append(class_prior(above_p, above_u, sizes[1 - i], n_u))
    prior = float(np.mean(priors)) if priors else 0.99
    return {"cuts": cuts, "w": fit(gram_p[0], gram_p, gram_u[0], gram_u, prior, ridge), "prior": prior}


def score(docs: DataFrame, model: dict | None) -> DataFrame:
    """(doc_id, score): probability of good quality; 0 for a null text or one without words, 0.5 without a model.

    A row for each of docs, repeated ones too; doc_id may have any type, other columns are ignored.
    """

    def each(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                x = measurements(b.column("text").to_pylist())
                s = np.full(len(x), 0.5) if model is None else np.clip((1 + _steps(x, model["cuts"]) @ model["w"]) / 2, 0, 1)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.where(x.any(axis=1), s, 0.0))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind_of(docs)}, score double")
