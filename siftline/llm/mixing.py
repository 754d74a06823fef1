"""Mixing to target weights with soft domain membership.

A labelled table teaches a naive Bayes classifier over hashed words; it gives every document a posterior over the
domains. Nonnegative rates per document are then fitted by projected gradient descent on the squared distance between
the expected domain token totals, sum of rate * tokens * posterior, and the targets. Only sums over the table, one
number per domain, reach the driver in a step; the rates stay distributed.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, blank_words, written

#: Buckets that words are hashed to: bounds the classifier's table, whatever the vocabulary.
BUCKETS = 1 << 15
#: The classifier is fitted on about so many labelled rows at most, picked by a hash of doc_id.
TRAIN_ROWS = 20_000
STEPS = 40


def _buckets(docs: DataFrame, *keep: str) -> DataFrame:
    words = docs.select(*keep, F.explode(blank_words(ascii_lower(F.col("text")))).alias("word"))
    return words.select(*keep, F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int").alias("bucket"))


def domain_model(docs: DataFrame, labelled: DataFrame, domains: list[str]) -> tuple[DataFrame, list[float]]:
    """Log likelihoods (bucket, l0, l1, ...) of the domains and their log priors.

    labelled: doc_id, domain; rows with another or a null domain are ignored. A domain without rows gets the
    smoothed uniform distribution.
    """
    rows = labelled.where(F.col("domain").isin(domains)).select("doc_id", "domain")
    n = rows.count()
    if n > TRAIN_ROWS:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(math.ceil(n / TRAIN_ROWS))) == 0)
    rows = written(rows, "labelled")
    sizes = {r["domain"]: r["count"] for r in rows.groupBy("domain").count().collect()}
    train = docs.select("doc_id", "text").join(rows, "doc_id")
    counts = written(_buckets(train, "domain").groupBy("bucket").agg(*[F.count_if(F.col("domain") == d).alias(f"c{k}") for k, d in enumerate(domains)]), "bucket-counts")
    totals = counts.agg(*[F.coalesce(F.sum(f"c{k}"), F.lit(0)).alias(f"c{k}") for k in range(len(domains))]).first()
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    logs = [F.log((F.coalesce(f"c{k}", F.lit(0)) + 1) / F.lit(float(totals[k] + BUCKETS))).alias(f"l{k}") for k in range(len(domains))]
    model = written(every.select("bucket", *logs).coalesce(1), "domain-model")
    whole = sum(sizes.values()) + len(domains)
    return model, [math.log((sizes.get(d, 0) + 1) / whole) for d in domains]


def memberships(docs: DataFrame, model: DataFrame, prior: list[float]) -> DataFrame:
    """(doc_id, n_tokens, p): posteriors over the domains, tempered by the square root of the number of tokens.

    A document without tokens gets the prior. Repeated ids count as one document.
    """
    k = len(prior)
    found = _buckets(docs, "doc_id").join(F.broadcast(model), "bucket")  # BUCKETS rows
    sums = found.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), *[F.sum(f"l{i}").alias(f"s{i}") for i in range(k)])
    rows = docs.select("doc_id").distinct().join(sums, "doc_id", "left").withColumn("n_tokens", F.coalesce("n_tokens", F.lit(0)))
    score = [F.lit(prior[i]) + F.coalesce(F.col(f"s{i}") / F.sqrt(F.greatest("n_tokens", F.lit(1))), F.lit(0.0)) for i in range(k)]
    top = F.array_max(F.array(*score))
    weights = rows.withColumn("e", F.array(*[F.exp(s - top) for s in score]))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return weights.select("doc_id", "n_tokens", F.transform("e", lambda x: x / total).alias("p"))


def fit_rates(members: DataFrame, targets: list[float], steps: int = STEPS) -> DataFrame:
    """members with rate >= 0: projected gradient steps from rate 1 until the expected domain token totals match.

    targets: the wanted share of the tokens per domain; they are scaled to sum to 1, and the total to the tokens
    there are; targets that are all 0 or less want nothing, and every rate is 0. Where no rates can match (a domain that no document belongs to), the nearest totals result.
    A step moves a rate by the document's posteriors times the residuals, scaled by the inverse of their Gram matrix.
    """
    k = len(targets)
    members = written(members, "members")
    p = [F.get("p", F.lit(i)) for i in range(k)]
    base = members.agg(F.sum("n_tokens").alias("n"), *[F.sum(F.col("n_tokens") * p[i] * p[j]).alias(f"g{i}_{j}") for i in range(k) for j in range(k)]).first()
    if not (n := float(base["n"] or 0)):
        return members.withColumn("rate", F.lit(1.0))
    gram = np.array([[base[f"g{i}_{j}"] / n for j in range(k)] for i in range(k)])
    scale = np.linalg.pinv(gram + 1e-9 * np.eye(k))
    want = np.maximum(np.array(targets, float), 0)
    if not want.sum():
        return members.withColumn("rate", F.lit(0.0))  # nothing is wanted
    want /= want.sum()
    rate: Column = F.lit(1.0)
    at, best = members, (math.inf, None)
    for step in range(steps):
        rows = at.withColumn("rate", rate)
        got = rows.agg(*[F.sum(F.col("rate") * F.col("n_tokens") * p[i]).alias(f"t{i}") for i in range(k)]).first()
        residual = np.array([float(got[f"t{i}"]) / n for i in range(k)]) - want
        size = float(np.abs(residual).max())
        if size < best[0]:
            best = size, rows
        if size < 1e-9:
            break
        move = scale @ residual
        rate = F.greatest(F.lit(0.0), rate - sum((p[i] * F.lit(float(move[i])) for i in range(1, k)), p[0] * F.lit(float(move[0]))))
        if step % 8 == 7:
            at = written(at.withColumn("start", rate).select(*members.columns, "start"), "rates")
            rate = F.col("start")
    return best[1].select(*members.columns, "rate")


def label_domains(labels: DataFrame) -> DataFrame:
    """Domains of the labels table: toxic, else low (quality 0), else good; rows without either label have none."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good").alias("domain"))


#: Domains and target shares of tokens that the query and the pipeline use.
TARGETS = {"good": 0.9, "low": 0.06, "toxic": 0.04}


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float]) -> DataFrame:
    """(doc_id, n_tokens, p_<domain> ..., rate): how often to take each document of docs.

    Null and empty texts have no tokens, the prior as posterior and a rate like any other. Extra columns of docs are
    ignored. Rates are fractions of a pass over the document: 0 leaves it out, 2 takes it twice.
    """
    names = list(targets)
    model, prior = domain_model(docs, labelled, names)
    rates = fit_rates(memberships(docs, model, prior), list(targets.values()))
    return rates.select("doc_id", "n_tokens", *[F.get("p", F.lit(i)).alias(f"p_{d}") for i, d in enumerate(names)], "rate")
