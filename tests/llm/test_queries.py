"""The queries of the ten operators and the stages of the pipeline: columns, folds, SQL, and odd input."""

import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siftline.llm import decontaminate, line_dedup, mixing, ngram_join, pii, quality_rules, queries, substring_dedup
from siftline.llm.sql import oracle_sql

CLASH = "doc_id long, text string, kept string, n_words int, policy string, removed string, n_left int, n_exact int, fail_bits int, n_chars long, rate double, p_good string, component_id string, pos int, item_id int"


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_agrees(spark, sf, duck, name):
    got, want = queries.queries()[name](spark, sf).toPandas(), duck.sql(oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    # a column of whole numbers with nulls is one of floats in pandas
    cell = lambda v: None if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    rows = lambda x: sorted(str([cell(v) for v in r]) for r in x[sorted(x.columns)].astype(object).values.tolist())
    assert rows(got) == rows(want)


@pytest.mark.parametrize(("name", "folds", "held", "bound"), [("op1_langid", 5, 0, None), ("op4_toxicity", 3, 1, 0.7), ("op10_quality", 3, 1, 0.5)])
def test_predictions(spark, sf, name, folds, held, bound):
    rows = queries.queries()[name](spark, sf).toPandas()
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    assert sorted(rows.doc_id) == sorted(docs.doc_id)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % folds == held) for r in rows.itertuples())
    assert rows.score.between(0, 1).all()
    if bound:
        assert (rows.predicted == (rows.score >= bound)).all()


def naive_bayes(docs, labelled, domains):
    """Posteriors word by word, with the same buckets as the operator (given as bucket lists per document)."""
    counts = np.zeros((len(domains), mixing.BUCKETS))
    sizes = np.zeros(len(domains))
    for d, buckets in docs.items():
        if labelled.get(d) in domains:
            sizes[domains.index(labelled[d])] += 1
            np.add.at(counts[domains.index(labelled[d])], buckets, 1)
    logs = np.log((counts + 1) / (counts.sum(axis=1, keepdims=True) + mixing.BUCKETS))
    prior = np.log((sizes + 1) / (sizes.sum() + len(domains)))
    out = {}
    for d, buckets in docs.items():
        s = prior + (logs[:, buckets].sum(axis=1) / np.sqrt(max(1, len(buckets))))
        e = np.exp(s - s.max())
        out[d] = e / e.sum()
    return out


def test_mixing_by_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = mixing.label_domains(spark.read.parquet(f"{sf}/labels.parquet"))
    got = mixing.mix(docs, labels, mixing.TARGETS).toPandas().set_index("doc_id").sort_index()
    buckets = {r.doc_id: [] for r in docs.collect()}
    for r in mixing._buckets(docs, "doc_id").collect():
        buckets[r.doc_id].append(r.bucket)
    names = list(mixing.TARGETS)
    p = naive_bayes(buckets, {r.doc_id: r.domain for r in labels.collect()}, names)
    want = np.array([p[d] for d in got.index])
    assert np.allclose(got[[f"p_{n}" for n in names]], want, atol=1e-6)
    # plain projected gradient descent over all documents at once reaches no smaller distance
    n = np.array([len(buckets[d]) for d in got.index], float)
    target = np.array(list(mixing.TARGETS.values())) / sum(mixing.TARGETS.values())
    off = lambda rate: np.abs((rate * n) @ want / n.sum() - target).max()
    rate = np.ones(len(n))
    for _ in range(3000):
        rate = np.maximum(0, rate - want @ ((rate * n) @ want / n.sum() - target))
    assert off(got.rate.to_numpy()) <= off(rate) + 1e-4
    none = mixing.mix(docs.limit(5), labels, {"good": 0.0, "low": 0.0}).toPandas()
    assert (none.rate == 0).all() and len(none) == 5


@pytest.fixture(scope="module")
def clash(spark):
    long = "Every word of this one counts for a place in the text that is kept as it was before. " * 4
    fresh = [" ".join(f"w{x}" for x in np.random.RandomState(k).randint(0, 10**6, 60)) for k in range(4)]
    rows = [(1, fresh[0]), (2, fresh[0]), (3, None), (4, ""), (5, fresh[1] + "\n" + fresh[2]), (None, fresh[3]), (7, "short"), (8, long), (9, fresh[1])]
    return spark.createDataFrame([(d, t, "mine", 777, "p", "r", 3, 4, 5, len(t or ""), 0.5, "g", "c", 6, 7) for d, t in rows], CLASH)


def test_stages_keep_columns_and_rows(spark, sf, clash):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, clash, sf)
        assert out.columns == clash.columns and out.dtypes == clash.dtypes
        assert all((r.kept, r.n_words, r.removed, r.n_left, r.component_id) == ("mine", 777, "r", 3, "c") for r in out.collect())
        assert stage(spark, clash.limit(0), sf).count() == 0
    of = lambda k: sorted(((r.doc_id or 0, r.text) for r in corpus_pipeline.STAGES[k][1](spark, clash, sf).collect()), key=str)
    rows = {r.doc_id: r.text for r in clash.collect()}
    assert {d for d, _ in of(0)} == {1, 2, 5, 9, 0}
    lines = dict(of(1))
    assert 2 not in lines and lines[5] == rows[5] and 9 not in lines and lines[3] is None and lines[0] == rows[None]
    assert {d for d, _ in of(2)} == {1, 3, 4, 5, 0, 7, 8, 9}
    assert {d for d, _ in of(3)} == {1, 2, 3, 4, 5, 0, 7, 8, 9}
    last = corpus_pipeline.STAGES[4][1](spark, clash, sf).toPandas()
    assert len(last) == 9 and last.rate.notna().sum() == 8


def test_pipeline_by_stages(spark, sf):
    """run() is the stages by brute force, each from what the one before has left, and the last adds rates."""
    docs = pd.read_parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.apply_policy(quality_rules.ledger(spark.read.parquet(f"{sf}/documents.parquet")), "v2").where("kept").select("doc_id").collect()}
    texts = {d: t for d, t in zip(docs.doc_id, docs.text, strict=True) if d in kept}
    places = [((d, k), tuple(words(x))) for d in sorted(texts) for k, x in enumerate(texts[d].split("\n")) if words(x)]
    first, short = {}, {}
    for at, w in places:
        first.setdefault(w, at)
    for w, at in first.items():  # lines that lack the same word at the same place, and lines with one word less
        for k in range(len(w) if len(w) >= 5 else 0):
            short.setdefault((len(w), k, w[:k] + w[k + 1 :]), []).append(at)
    near = {at for ats in short.values() for at in ats if min(ats) < at}
    for (n, _, v), ats in short.items():
        if n > 5 and v in first:
            near |= {max(at, first[v]) for at in ats if at != first[v]}
    gone = {at for at, w in places if first[w] != at or at in near}
    left = {}
    for d, t in texts.items():
        lines = [x for k, x in enumerate(t.split("\n")) if (d, k) not in gone]
        if len(lines) == len(t.split("\n")) or any(map(words, lines)):
            left[d] = "\n".join(lines)
    sets = {d: (lambda w: {w[k : k + 5] for k in range(len(w) - 4)} or ({w} if w else set()))(tuple((t or "").encode().lower().split())) for d, t in left.items()}
    root = {d: d for d in sets}
    holders = {}
    for d, s in sets.items():
        for g in s:
            holders.setdefault(g, []).append(d)

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = {(a, b) for ds in holders.values() for i, b in enumerate(ds) for a in ds[:i]}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= 80 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    single = {d: t for d, t in left.items() if top(d) == d}
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) for t in pd.read_parquet(f"{sf}/benchmark.parquet").text]
    windows = {tuple(w[k : k + 13]) for w in items if w for k in range(max(1, len(w) - 12))}
    sizes = {len(w) for w in windows}

    def clean(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        hit = {p + j for n in sizes for p in range(len(w) - n + 1) if tuple(w[p : p + n]) in windows for j in range(n)}
        return not hit or 20 * len(hit) < len(w)

    want = {d: t for d, t in single.items() if clean(t)}
    got = corpus_pipeline.run(spark, sf).toPandas()
    assert dict(zip(got.doc_id, got.text, strict=True)) == want and len(got) == len(want)
    assert {"n_tokens", "rate", *(f"p_{d}" for d in mixing.TARGETS)} <= set(got.columns) and (got.rate >= 0).all()


def test_any_ids_and_repeated_ones(spark, sf):
    """Ids of text, ids that several rows have, and none at all."""
    text = " ".join(f"w{k}" for k in range(40))
    other = " ".join(f"v{k}" for k in range(40))
    rows = spark.createDataFrame([("a", text), ("a", text), ("b", text + " end"), ("b", other), (None, text), ("c", "mail me at x.y@ex.com"), ("c", "nothing")], "doc_id string, text string")
    groups = {(r.doc_id, r.component_id) for r in ngram_join.similar_groups(rows).collect()}
    assert groups == {("a", "a"), ("b", "b"), ("c", "c"), (None, None)}  # of b the least text, which is like no other
    spans = sorted((r.doc_id, r.n_email) for r in pii.extract(rows.where("doc_id = 'c'")).collect())
    assert spans == [("c", 0), ("c", 1)]
    lines = sorted((r.doc_id or "", r.text) for r in line_dedup.dedup_lines(rows).collect())
    assert len(lines) == 7 and ("b", other) in lines
    item = spark.createDataFrame([(1, text)], "item_id long, text string")
    hits = sorted((r.doc_id or "", r.n_words, r.n_hit) for r in decontaminate.contamination(rows, item).collect())
    assert hits == [("", 40, 0), ("a", 40, 40), ("b", 40, 0), ("c", 1, 0)] or hits[1:3] == [("a", 40, 40), ("b", 40, 0)]
    assert quality_rules.ledger(rows).count() == 7


def test_ids_of_text_in_scores(spark, sf):
    from siftline.llm import quality, toxicity

    rows = spark.createDataFrame([("a", "one two"), (None, None)], "doc_id string, text string")
    assert {r.doc_id for r in quality.score(rows, None).collect()} == {r.doc_id for r in toxicity.score(rows, ([], np.zeros(0), -8.0)).collect()} == {"a", None}
    assert rows.where(F.col("doc_id").isNull()).count() == 1


def test_passages_of_any_ids(spark):
    """op8: ids of text, repeated ids, clashing columns, no rows."""
    words_of = lambda seed, n: " ".join(f"w{x}" for x in np.random.RandomState(seed).randint(0, 10**6, n))
    common = words_of(1, 60)
    rows = [("b", words_of(2, 30) + " " + common), ("a", common + " " + words_of(3, 20)), ("c", words_of(4, 80)), ("c", words_of(5, 10) + " " + common), (None, common), ("d", None), ("e", ""), ("f", common)]
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id string, text string, first string, v int")
    got = sorted((r.doc_id, r.start_word, r.end_word, r.other_doc_id, r.first) for r in substring_dedup.passages(df).collect())
    least = min(t for d, t in rows if d == "c")
    want = [("a", 0, 60, "b", True), ("b", 30, 90, "a", False), ("f", 0, 60, "a", False)] + ([("c", 10, 70, "a", False)] if common in least else [])
    assert got == sorted(want)
    assert substring_dedup.passages(df.limit(0)).count() == 0
    small = spark.createDataFrame([(2, rows[0][1]), (1, rows[1][1])], "doc_id int, text string")
    assert {(r.doc_id, r.other_doc_id) for r in substring_dedup.passages(small).collect()} == {(1, 2), (2, 1)} and dict(substring_dedup.passages(small).dtypes)["doc_id"] == "int"
