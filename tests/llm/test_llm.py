"""The ten operators against brute force and on odd input: nulls, empties, ties, repeated rows, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftline.llm import decontaminate, langid, line_dedup, mixing, ngram_join, pii, quality, quality_rules, substring_dedup, toxicity
from siftline.llm.common import components, fold_of
from siftline.llm.shingles import word_hashes

BLANK = r"[\x20\x09-\x0D]+"
ODD = "doc_id long, text string, lang string, h long, n int, verdict string, rate double, c int"
LONG = " ".join(f"w{k % 977}" for k in range(20_000))
ODD_ROWS = [
    (1, None, None, None, 1, "x", 0.5, 1), (2, "", "en", 2, None, None, None, None), (3, " \n\t", None, 3, 1, "y", 1.0, 2), (4, "one", "en", 4, 1, "z", 2.0, 3),
    (5, LONG, "en", 5, 1, "x", 0.5, 4), (6, LONG, "de", 6, 1, "x", 0.5, 4), (7, "漢字 émoji \U0001f600 a@b.cd", None, 7, 1, "x", 0.5, 5), (7, "漢字 émoji \U0001f600 a@b.cd", None, 7, 1, "x", 0.5, 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD_ROWS, ODD)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet").cache()


def words(text):
    return [w for w in re.split(BLANK, text or "") if w]


# 6 ------------------------------------------------------------------------------------------------------------------


def measured(text):
    ws, lines = words(text), [x for x in (text or "").split("\n") if words(x)]
    grams = defaultdict(list)
    for k in range(len(ws) - 2):
        grams[tuple(ws[k : k + 3])].append(k)
    again = {k + j for places in grams.values() if len(places) > 1 for k in places for j in range(3)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)


def test_quality_ledger(spark, docs, odd):
    more = spark.createDataFrame([(10**6, "a b c a b c d"), (10**6 + 1, "x x x x x"), (10**6 + 2, "| # a\n\nb\nb\nb")], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(more).unionByName(odd.select("doc_id", "text"))
    got = quality_rules.ledger(rows).collect()
    assert len(got) == rows.count()
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == measured(r.text)
    assert set(quality_rules.ledger(odd).columns) >= set(odd.columns)
    assert quality_rules.ledger(odd.limit(0)).count() == 0


def test_policies_and_ablation(docs):
    rows = quality_rules.ledger(docs)
    kept = {p: {r.doc_id for r in quality_rules.apply_policy(rows, p).where("kept").collect()} for p in quality_rules.POLICIES}
    assert kept["v2"] < kept["v1"]
    bits = Counter(r.fail_bits for r in rows.select("fail_bits").collect())
    for r in quality_rules.ablation(rows, "v2").collect():
        bit = next(1 << x.bit for x in quality_rules.RULES if x.name == r.rule)
        assert r.failed == sum(n for b, n in bits.items() if b & bit) and r.only == bits.get(bit, 0)


# 9 ------------------------------------------------------------------------------------------------------------------


def edits(a, b):
    row = list(range(len(b) + 1))
    for x in a:
        row, old = [row[0] + 1], row
        for k, y in enumerate(b):
            row.append(min(old[k] + (x != y), old[k + 1] + 1, row[k] + 1))
    return row[-1]


def test_line_dedup_by_brute_force(spark):
    rng = np.random.RandomState(3)
    base = [["w%d" % x for x in rng.randint(0, 30, n)] for n in (1, 3, 5, 6, 7, 12, 13)]
    rows = []
    for d in range(60):
        lines = []
        for _ in range(4):
            line = list(base[rng.randint(len(base))])
            for _ in range(rng.randint(0, 3)):
                k = rng.randint(len(line)) if line else 0
                line[k : k + rng.randint(0, 2)] = ["w%d" % rng.randint(30)] * rng.randint(0, 2)
            lines.append(" ".join(line))
        rows.append((d, "\n".join(lines)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    places = [((d, k), tuple(words(x))) for d, t in rows for k, x in enumerate(t.split("\n")) if words(x)]
    first = {}
    for at, w in places:
        first.setdefault(w, at)
    near = {w for w, a in first.items() if len(w) >= 5 and any(b < a and len(v) >= 5 and edits(v, w) <= 1 for v, b in first.items())}
    want = {at: "exact" if first[w] != at else "near" for at, w in places if first[w] != at or w in near}
    got = {(r.doc_id, r.line_no): r.verdict for r in line_dedup.line_verdicts(frame).collect()}
    assert got == want and {"exact", "near"} <= set(want.values())
    texts = {r.doc_id: r.text for r in line_dedup.dedup_lines(frame).collect()}
    assert texts == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in want) for d, t in rows}


def test_line_dedup_odd(odd):
    got = {r.doc_id: r for r in line_dedup.dedup_lines(odd).collect()}
    assert got[1].text is None and got[2].text == "" and got[6].text == "" and got[6].n_exact == 1 and got[5].text == LONG
    assert set(line_dedup.dedup_lines(odd).columns) >= set(odd.columns)
    assert line_dedup.dedup_lines(odd.limit(0)).count() == 0


# 7 ------------------------------------------------------------------------------------------------------------------


def groups_by_brute_force(rows):
    sets = {}
    for d, t in rows:
        w = tuple((t or "").encode().lower().split())
        sets[d] = {w[k : k + 5] for k in range(len(w) - 4)} or ({w} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in sets}


def test_ngram_join_by_brute_force(spark, docs):
    rng = np.random.RandomState(5)
    base = [f"w{x}" for x in rng.randint(0, 500, 60)]
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for k in range(60):  # a group of near copies around the limit, and a passage that many documents share
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randint(len(w))] = f"v{rng.randint(10**6)}"
        rows.append((10_000 + k, " ".join(w)))
        rows.append((20_000 + k, " ".join([*(f"u{x}" for x in rng.randint(0, 10**6, 40)), *base[:30]])))
    rows += [(30_000, None), (30_001, ""), (30_002, "a B"), (30_003, "A b"), (30_004, "a b c")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups_by_brute_force(rows)


def test_ngram_join_odd(odd):
    got = {r.doc_id: r for r in ngram_join.similar_groups(odd).collect()}
    assert got[5].component_id == got[6].component_id == 5 and got[1].n_shingles == got[3].n_shingles == 0 and got[2].component_id == 2
    assert ngram_join.similar_groups(odd.limit(0)).count() == 0


def test_keep_one_keeps_null_ids(spark):
    rows = [(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "q r s t u v w"), (None, "one of its own kind of text")]
    got = ngram_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == [(0, rows[3][1]), rows[0], rows[2]]


def test_components(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (102, 101), (200, 201)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 1 for k in range(2, 41)) and got[101] == got[102] == 100 and got[201] == 200


# 3 ------------------------------------------------------------------------------------------------------------------


def test_decontamination_edges(spark, odd):
    item = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    ws = item.lower().split()
    docs = spark.createDataFrame(
        [(1, "x " + item + " y"), (2, " ".join(ws[:12])), (3, " ".join(ws[1:14]) + " z" * 400), (4, "short item"), (5, "Short, ITEM! again short item"), (6, None), (7, ""), (8, "solo"), (9, " ".join(ws[2:]) + " " + " ".join(ws[:13]))],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([(1, item), (2, "short item"), (3, None), (4, ""), (5, "solo"), (10, item)], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(docs, items).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items) == (17, 15, 2) and got[1].contaminated
    assert got[1].items_sha256 == hashlib.sha256(b"1,10").hexdigest()
    assert got[2].n_hit == 0 and not got[2].contaminated
    assert got[3].n_hit == 13 and not got[3].contaminated
    assert got[4].n_hit == 2 and got[5].n_hit == 4 and got[8].n_hit == 1 and got[9].n_hit == 26
    assert got[6].n_words == got[7].n_words == 0 and not got[6].contaminated
    assert decontaminate.contamination(odd, items.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(odd.limit(0), items).count() == 0
    near = {(r.doc_id, r.item_id) for r in decontaminate.proximity(docs, items).collect()}
    assert {(1, 1), (2, 1), (5, 2)} <= near
    assert decontaminate.proximity(odd, items.limit(0)).count() == decontaminate.proximity(odd.limit(0), items).count() == 0


def test_runs_of_equal_words(spark):
    """Runs that just are and just aren't long enough lie side by side on one diagonal, at both ends of the item."""
    ws = [f"w{k}" for k in range(60)]
    doc = ws[:13] + ["x"] + ws[14:26] + ["x"] + ws[27:40] + ["x"] * 4 + ws[44:]
    docs = spark.createDataFrame([(1, " ".join(doc))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(ws))], "item_id long, text string")
    hit = sorted(r.pos for r in decontaminate.window_hits(docs, items).collect())
    assert hit == [*range(13), *range(27, 40), *range(44, 60)]


def test_index_holds_every_place(spark, docs):
    items = decontaminate.item_terms(spark.createDataFrame([(1, "the Data of")], "item_id long, text string"))
    got = sorted((r.doc_id, r.term, r.pos) for r in decontaminate.postings(docs, items).collect())
    cut = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
    want = sorted((r.doc_id, w, k) for r in docs.collect() for k, w in enumerate(cut(r.text)) if w in ("the", "data", "of"))
    assert got == want and want


def test_near_matches(spark):
    """Two rare terms that are up to three words nearer or farther than in the item are near, those four words off aren't."""
    item, common = "rare1 a b c d rare2", "a b c d " * 9
    texts = [common, "rare1 rare2", "rare1 a b c d a b c rare2", "rare1 a b c d a b c d rare2", None, "rare2 rare1"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "rare1 a b c d rare2")], "doc_id long, text string")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert {(r.doc_id, r.n_near) for r in decontaminate.proximity(docs, items).collect()} == {(2, 1)}


# 2 ------------------------------------------------------------------------------------------------------------------


def test_mixing_meets_targets(docs, labels, odd):
    rows = mixing.mix(docs, mixing.label_domains(labels), mixing.TARGETS).toPandas()
    assert len(rows) == docs.count() and (rows.rate >= 0).all()
    total = rows.n_tokens.sum()
    for d, share in mixing.TARGETS.items():
        assert (rows.rate * rows.n_tokens * rows[f"p_{d}"]).sum() / total == pytest.approx(share, abs=1e-4)
    few = mixing.mix(odd, mixing.label_domains(labels), mixing.TARGETS).toPandas()
    assert len(few) == 7 and few.rate.notna().all()
    assert mixing.mix(odd.limit(0), mixing.label_domains(labels), mixing.TARGETS).count() == 0


def test_rates_project_to_zero(spark):
    members = spark.createDataFrame([(1, 100, [1.0, 0.0]), (2, 100, [0.0, 1.0])], "doc_id long, n_tokens long, p array<double>")
    got = {r.doc_id: r.rate for r in mixing.fit_rates(members, [1.0, 0.0]).collect()}
    assert got[1] == pytest.approx(2, abs=1e-6) and got[2] == pytest.approx(0, abs=1e-6)


# 1 ------------------------------------------------------------------------------------------------------------------


def test_language_id(docs, odd):
    fold = fold_of(F.col("doc_id"), 5)
    model = langid.train(docs.where(fold != 0))
    rows = langid.identify(docs, model).join(docs.select("doc_id", "lang", fold.alias("fold")), "doc_id").where("fold = 0").toPandas()
    assert (rows.lang == rows.lang_pred).mean() > 0.95
    got = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[3].lang_pred == "und" and got[4].lang_pred in langid.collected(model) and 0 < got[4].score <= 1
    assert {r.lang_pred for r in langid.identify(odd, model.limit(0)).collect()} == {"und"}
    few = docs.where("doc_id % 10 = 0").select(F.col("doc_id").cast("string").alias("doc_id"), "text").unionByName(odd.select(F.concat(F.lit("x"), "doc_id").alias("doc_id"), "text"))
    both = [sorted((r.doc_id, r.lang_pred, round(r.score, 3), round(r.bits_per_byte, 2)) for r in langid.identify(few, model, most).collect()) for most in (langid.MOST_LEAVES, 10)]
    assert both[0] == both[1] and len(both[0]) == few.count()


def test_rare_contexts_stay(spark):
    """A language of many contexts that come once keeps them, beside one of few."""
    rng = np.random.RandomState(0)
    rows = [("aa", "".join(chr(c) for c in rng.randint(97, 123, 5000))) for _ in range(4)] + [("bb", "the same words again and again")]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    want = {(lang, (chr(10) * 3 + t)[k : k + 4]) for lang, t in rows for k in range(len(t))}
    assert model.count() == len(want)


def test_code_lengths_by_recursion(docs):
    model = langid.collected(langid.train(docs.where("lang in ('en', 'fr')").limit(20)))
    trees = langid.Trees(model)
    for j, lang in enumerate(trees.langs):
        levels = [defaultdict(Counter) for _ in range(4)]
        for code, n in zip(*model[lang], strict=True):
            b = int(code).to_bytes(4, "big")
            for k in range(4):
                levels[k][b[3 - k : 3]][b[3]] += int(n)
        for text in ("the ongoing", "Zażółć 12€", "", docs.first().text[:200]):
            b, total = b"\n\n\n" + text.encode(), 0.0
            for i in range(3, len(b)):
                for k in (3, 2, 1, 0):
                    c = levels[k].get(b[i - k : i])
                    if c is None:
                        continue
                    if b[i] in c:
                        total += math.log2((sum(c.values()) + len(c)) / c[b[i]])
                        break
                    total += math.log2((sum(c.values()) + len(c)) / len(c))
                else:
                    total += 8
            assert trees.code_lengths([text])[0][j] == pytest.approx(total, rel=1e-4)


# 4 ------------------------------------------------------------------------------------------------------------------


def test_toxicity_finds_sentences(spark, odd):
    rng = np.random.RandomState(1)
    rows = []
    for d in range(600):
        text = [" ".join(f"w{chr(97 + x)}" for x in rng.randint(0, 20, 8)) + "." for _ in range(rng.randint(1, 6))]
        toxic = d % 3 == 0
        if toxic:
            text[rng.randint(len(text))] = "wa wb scumbag wc."
        rows.append((d, " ".join(text), int(toxic)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, label int")
    model = toxicity.train(frame.drop("label"), frame.where("doc_id < 400").drop("text"))
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert all((got[d].score >= 0.7) == bool(y) for d, _, y in rows)
    a, b = map(int, got[0].offending.split(",")[0].split(":"))
    assert "scumbag" in rows[0][1][a:b] and rows[0][1][a:b].count(".") == 1
    out = {r.doc_id: r.score for r in toxicity.score(odd, model).collect()}
    assert out[1] == out[2] == 0 and all(0 <= s <= 1 for s in out.values())
    assert toxicity.train(frame, frame.limit(0))[0] == []
    cased = spark.createDataFrame([("a", "WA SCUMBAG wc."), ("b", "WA SCUMBAG wc. \u0130stanbul"), ("c", "WA wc. \u0130stanbul")], "doc_id string, text string")
    out = {r.doc_id: r.score for r in toxicity.score(cased, model).collect()}
    assert out["a"] > 0.7 and abs(out["a"] - out["b"]) < 0.05 and out["c"] < 0.3


def test_noisy_or_by_hand(spark, docs, labels):
    """Scores are the noisy-or of the sentences' logistic scores, each counted anew from the weights."""
    words, w, b = model = toxicity.train(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    weight = dict(zip(words, w, strict=True))
    for r in toxicity.score(docs.limit(60), model).join(docs.select("doc_id", "text"), "doc_id").collect():
        none = 1.0
        for s in re.findall(r"[^.!?\n]+[.!?\n]*|[.!?\n]+", r.text or ""):
            ws = set(re.findall(r"[^\W\d_]+", s.replace("\u0130", "i").lower()))
            keys = ws | {f"{x[:k]}~" for x in ws for k in toxicity.BEGINNINGS if len(x) > k}
            none *= 1 - 1 / (1 + math.exp(-(b + sum(weight.get(k, 0) for k in keys))))
        assert r.score == pytest.approx(1 - none, abs=1e-9)


# 10 -----------------------------------------------------------------------------------------------------------------


def test_quality_classifier(docs, labels, odd):
    train = labels.select("doc_id", F.col("quality").alias("label"))
    model = quality.train(docs, train)
    rows = quality.score(docs, model).join(train, "doc_id").toPandas()
    assert ((rows.score >= 0.5) == (rows.label == 1)).mean() > 0.9
    out = {r.doc_id: r.score for r in quality.score(odd, model).collect()}
    assert out[1] == out[2] == out[3] == 0 and all(0 <= s <= 1 for s in out.values())
    assert 0.5 < model["prior"] < 0.99
    assert quality.train(docs, train.limit(0)) is None and quality.train(docs.limit(0), train) is None
    assert quality.score(odd.limit(0), None).count() == 0


def test_risk_by_brute_force():
    """The fitted coefficients lessen the non-negative risk, summed up text by text, as much as plain descent does."""
    rng = np.random.RandomState(3)
    good, bad = rng.randn(3000, 12) + 1, rng.randn(1000, 12) - 1
    p, u = good[:1000], np.concatenate([good[1000:], bad])
    cuts = np.quantile(u, quality.STEPS_AT, axis=0).T
    sp, su = quality._steps(p, cuts), quality._steps(u, cuts)
    w = quality.fit(sp.mean(axis=0), sp.T @ sp / len(sp), su.mean(axis=0), su.T @ su / len(su), 2 / 3)
    minus = lambda w: ((1 + su @ w) ** 2).mean() / 4 - 2 / 3 * ((1 + sp @ w) ** 2).mean() / 4
    risk = lambda w: 2 / 3 * ((1 - sp @ w) ** 2).mean() / 4 + max(0, minus(w))
    assert minus(w) > -0.01
    for _ in range(50):
        assert risk(w) <= risk(w + rng.randn(len(w)) * 0.02) + 1e-3
    assert ((su @ w > 0) == (np.arange(len(su)) < 2000)).mean() > 0.97


# 5 ------------------------------------------------------------------------------------------------------------------

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def base_spans(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(len(x.lstrip("0")) < 4 and int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]():  # noqa: B023
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_pii_base_spans(spark, docs, odd):
    texts = ["a.b@c d@e.f x@y@z.com a@b.c_d@e.f", "1.2.3.4.5 256.1.1.1 007.1.2.3 1.2.3.4567", "4111 1111 1111 1111 4111-1111-1111-1111 4111111111111112", "+1 (017) 555-7713, +12 34 + 5 +1234567890123456", "\x01a@b.cd\x01 é\U0001f600 1.2.3.4", "9" * 50_000 + " a@b" + ".c" * 20_000]
    rows = docs.select("doc_id", "text").unionByName(odd.select("doc_id", "text").where("doc_id < 7").withColumn("doc_id", F.col("doc_id") + 10**7)).unionByName(spark.createDataFrame([(10**6 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
    want = {r.doc_id: base_spans(r.text) for r in rows.collect()}
    got = pii.extract(rows).collect()
    assert len(got) == len(want)
    for r in got:
        spans = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s.startswith(k) for s in spans) for k in PATTERNS]
        assert set(spans) <= set(filter(None, r.spans.split(",")))
    assert pii.extract(odd.limit(0)).count() == 0


def test_pii_bootstraps_from_context(spark):
    rng = np.random.RandomState(2)

    def card(valid):
        while True:
            d = "".join(map(str, rng.randint(0, 10, 16)))
            if luhn(d) == valid:
                return d

    rows = [(k, f"please charge {card(True)} now") for k in range(30)] + [(100 + k, f"please charge {card(False)} now") for k in range(3)] + [(200 + k, f"order number {card(False)} shipped") for k in range(30)]
    got = {r.doc_id: r for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + k].n_card == 0 and got[100 + k].spans == "card:14:30" for k in range(3))
    assert all(got[200 + k].spans == "" for k in range(30))


def test_pii_finds_unseen_forms_in_known_contexts(spark):
    rng = np.random.RandomState(3)
    digits = lambda n: "".join(map(str, rng.randint(0, 10, n)))
    rows = [(k, f"please call +49{digits(9)} today") for k in range(30)] + [(100 + k, f"write to user{digits(4)}@host{k}.com soon") for k in range(30)]
    odd = {200: ("please call 030 1234 567 today", "phone:12:24"), 201: ("please call (0301234567), today", "phone:13:23"), 202: ("write to jane at example dot com soon", "email:9:32"), 203: ("write to jane [at] example.com, soon", "email:9:30"), 204: ("order number 030 7654 321 shipped", "")}
    rows += [(d, t) for d, (t, _) in odd.items()]
    got = {r.doc_id: r.spans for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: got[d] for d in odd} == {d: want for d, (_, want) in odd.items()}


def test_bootstrap_by_brute_force(spark):
    """Patterns and instances scored anew, round by round, from the same words beside the same candidates."""
    rng = np.random.RandomState(11)
    digits = lambda n: "".join(map(str, rng.randint(0, 10, n)))
    rows = [(k, f"{['please call', 'or dial'][k % 2]} +49{digits(9)} {['today', 'soon'][k % 3 > 0]}") for k in range(500)]
    rows += [(1000 + k, f"{['please call', 'or dial', 'see page', 'at the office ring'][k % 4]} {digits(3)} {digits(5)} {['today', 'now'][k % 5 > 1]}") for k in range(60)]
    rows += [(2000 + k, f"or dial 0{digits(8)} {'x' * 200} mister") for k in range(8)] + [(3000 + k, f"the office ring 0{digits(7)} {'x' * 200} mister") for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    near = [r.asDict() for r in pii.found(frame).select("doc_id", "h", F.explode("near").alias("s")).select("doc_id", "h", "s.*").collect()]
    assert {len(r["right"][0]) for r in near if 2000 <= r["doc_id"] < 3000} == {200}  # words in whole

    def patterns(r):
        left, right = r["left"], r["right"]
        out = {"<" + left[-1]} if left else set()
        out |= {">" + right[0]} if right else set()
        out |= ({"<" + " ".join(left)} if len(left) > 1 else set()) | ({">" + " ".join(right)} if len(right) > 1 else set())
        return out | ({f"<{left[-1]}>{right[0]}"} if left and right else set())

    seeds = [r for r in near if r["kind"]]
    want = set()
    for kind in pii.ORDER:
        shapes = {r["shape"] for r in seeds if r["kind"] == kind}
        seeded = {r["value"] for r in seeds if r["kind"] == kind}
        of, worth = defaultdict(set), defaultdict(float)
        for r in near:
            if r["kind"] in ("", kind):
                for p in patterns(r):
                    of[p].add(r["value"])
                worth[r["value"]] = max(worth[r["value"]], 1.0 if r["shape"] in shapes else pii.UNSEEN)
        known = set(seeded)
        while True:
            good = {p: len(v & known) / len(v) for p, v in of.items() if len(v) >= pii.MIN_INSTANCES and len(v & known) / len(v) >= pii.CONFIDENT}
            score = {x: worth[x] * (1 - math.prod(1 - p for q, p in good.items() if x in of[q])) for x in worth if x not in seeded}
            more = known | {x for x, s in score.items() if s >= pii.ACCEPTED}
            if more == known:
                break
            known = more
        want |= {(r["doc_id"], kind) for r in near if not r["kind"] and r["value"] in known - seeded}
    got = {(r.doc_id, r.kind) for r in pii.bootstrap(spark.createDataFrame(near, "doc_id long, h long, kind string, start int, end int, shape string, value long, left array<string>, right array<string>")).collect()}
    assert {d for d, _ in got} == {d for d, _ in want} and got <= want and len(got) > 10


def test_pii_recall_of_hidden_identifiers(spark):
    """Of identifiers that no base pattern matches, in contexts that seeds have, nine in ten are found, and no others."""
    rng = np.random.RandomState(21)
    digits = lambda n: "".join(map(str, rng.randint(0, 10, n)))
    noise = lambda n: " ".join("".join(chr(97 + c) for c in rng.randint(0, 26, 5)) for _ in range(n))
    rows, hidden = [], {}
    frames = [("phone", "my number is", "so ring me", lambda: f"+1 {digits(10)}", lambda: f"{digits(3)} {digits(3)} {digits(4)}"), ("ip", "logged in from", "last night", lambda: ".".join(str(x) for x in rng.randint(0, 256, 4)), lambda: f"host{digits(3)}-{digits(2)}")]
    for k in range(400):
        kind, left, right, seed, unseen = frames[k % 2]
        hide = k % 8 < 2 and k > 100
        value = unseen() if hide else seed()
        before = noise(10)
        rows.append((k, f"{before} {left} {value} {right} {noise(10)}"))
        if hide:
            at = len(before) + len(left) + 2
            hidden[k] = f"{kind}:{at}:{at + len(value)}"
    rows += [(1000 + k, f"{noise(8)} {digits(6)} {noise(8)} a{digits(3)}b {noise(4)}") for k in range(200)]
    got = {r.doc_id: set(filter(None, r.spans.split(","))) for r in pii.extract(spark.createDataFrame(rows, "doc_id long, text string")).where("n_added > 0").collect()}
    assert sum(s in got.get(d, ()) for d, s in hidden.items()) >= 0.9 * len(hidden)
    assert set(got) <= set(hidden)


# 8 ------------------------------------------------------------------------------------------------------------------


def test_substring_dedup(spark, docs, odd):
    rng = np.random.RandomState(9)
    fresh = lambda n: [f"w{x}" for x in rng.randint(0, 10**6, n)]
    passage, wrong = fresh(80), fresh(45)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for k in range(40):
        rows.append((10_000 + k, " ".join(fresh(30) + passage + fresh(20))))
        rows.append((20_000 + k, " ".join(fresh(60) + wrong + fresh(60))))
    near = list(passage)
    near[40] = "changed"
    rows.append((30_000, " ".join(fresh(70) + near + fresh(5))))
    got = defaultdict(set)
    for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.n_words >= substring_dedup.PASSAGE
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    places = defaultdict(list)
    for d, t in rows:
        w = (t or "").encode().lower().split()
        for k in range(len(w) - 49):
            places[tuple(w[k : k + 50])].append((d, k))
    exact = defaultdict(set)
    for at in places.values():
        if len({d for d, _ in at}) > 1:
            for d, k in at:
                exact[d] |= set(range(k, k + 50))
    assert all(want <= got[d] for d, want in exact.items())
    assert all(d not in got for d in range(20_000, 20_040))
    assert got[30_000] and got[30_000] <= set(range(68, 152))
    out = [(r.doc_id, r.first) for r in substring_dedup.passages(odd).collect()]
    assert sorted(out) == [(5, True), (6, False)]
    assert substring_dedup.passages(odd.limit(0)).count() == 0


def test_substring_dedup_behind_a_first_document(spark):
    """Passages of later documents of which the first document with their anchors holds a piece only."""
    rng = np.random.RandomState(19)
    fresh = lambda n: [f"w{x}" for x in rng.randint(0, 10**6, n)]
    rows, want = [], {}
    for k in range(60):
        passage = fresh(int(rng.randint(50, 71)))
        size = int(rng.randint(27, 50))
        at = int(rng.randint(0, len(passage) - size + 1))
        rows.append((k, " ".join(fresh(30) + passage[at : at + size] + fresh(30))))
        for j in (1, 2, 3):
            before = int(rng.randint(0, 60))
            rows.append((1000 * j + k, " ".join(fresh(before) + passage + fresh(20))))
            want[1000 * j + k] = set(range(before, before + len(passage)))
    got, first = defaultdict(set), defaultdict(set)
    for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
        first[r.doc_id].add(r.first)
    assert got == want
    assert all((True in first[d]) >= (d < 2000) and (False in first[d]) == (d >= 2000) for d in want)


def test_substring_dedup_shifted_words(spark):
    """A word put into or taken out of the middle of a passage of 60 words."""
    rng = np.random.RandomState(29)
    fresh = lambda n: [f"w{x}" for x in rng.randint(0, 10**6, n)]
    rows = []
    for k in range(100):
        passage = fresh(60)
        changed = [passage[:30] + fresh(1) + passage[30:], passage[:30] + passage[31:]][k % 2]
        rows += [(k, " ".join(fresh(30) + passage + fresh(30))), (1000 + k, " ".join(fresh(45) + changed + fresh(15)))]
    got = defaultdict(set)
    for r in substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    found = [k for k in range(100) if got[k] and got[1000 + k]]
    print("recall of shifted passages", len(found))
    assert len(found) >= 90
    assert all(got[k] == set(range(30, 90)) and got[1000 + k] == set(range(45, 106 - k % 2 * 2)) for k in found)


def test_substring_dedup_of_similar_passages_behind_first_documents(spark):
    """Passages that are only similar, of which earlier documents hold one half or the other."""
    rng = np.random.RandomState(39)
    fresh = lambda n: [f"w{x}" for x in rng.randint(0, 10**6, n)]
    rows, want = [], {}
    for k in range(60):
        passage, at = fresh(60), int(rng.randint(28, 32))
        changed = passage[:at] + fresh(1) + passage[at + 1 :]
        rows += [(k, " ".join(fresh(40) + passage[:at] + fresh(40))), (100 + k, " ".join(fresh(40) + passage[at + 1 :] + fresh(40)))]
        for j, words_ in ((1, passage), (2, changed)):
            before = int(rng.randint(0, 60))
            rows.append((1000 * j + k, " ".join(fresh(before) + words_ + fresh(40))))
            want[1000 * j + k] = (before, before + 60, 1000 * (3 - j) + k, j == 1)
    got = substring_dedup.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.start_word, r.end_word, r.other_doc_id, r.first) for r in got} == want
    assert len(got) == len(want)


def test_large_groups_are_compared_as_pair_by_pair(spark, monkeypatch):
    rng = np.random.default_rng(12)
    width = 2 * substring_dedup.CONTEXT + 1
    mid = width // 2
    x, group = [], []
    for g in range(6):
        base = rng.integers(1, 10**6, width + 20).astype(np.int32) if g else np.full(width + 20, 7, np.int32)
        for _ in range(60):
            w = base.copy()
            for _ in range(rng.integers(0, 7)):
                at = int(rng.choice([rng.integers(0, mid - 14), rng.integers(mid + 5, width)]))
                w[at] = rng.integers(1, 10**6)
                if rng.random() < 0.3:
                    w = np.concatenate([w[: mid + 20], w[mid + 21 :], w[:1]])
            if g % 3 == 2:
                w[: mid - 20], w[mid + 35 :] = rng.integers(1, 10**6, mid - 20), rng.integers(1, 10**6, len(w) - mid - 35)
            w[: rng.integers(0, 60)] = 0
            x.append(w[:width])
            group.append(g)
    x, group = np.stack(x), np.array(group)
    doc = rng.integers(0, 40, len(x))
    near = (rng.integers(1, 3, len(x)) << 32) | rng.integers(0, 3, len(x))
    c = rng.integers(75, 10**4, len(x))

    def told():
        out = {True: {}, False: {}}
        for r in substring_dedup._compared(group, doc, c, near, x).to_pylist():
            out[r["first"]][r["doc_id"], r["start_word"], r["end_word"]] = min(r["other_doc_id"], out[r["first"]].get((r["doc_id"], r["start_word"], r["end_word"]), 10**9))
        inside = lambda t: any(f[0] == t[0] and f[1] <= t[1] and t[2] <= f[2] for f in out[False])
        return out[False], {t: o for t, o in out[True].items() if not inside(t)}

    calls, compare = [0], substring_dedup._Found.compare
    monkeypatch.setattr(substring_dedup._Found, "compare", lambda self, a, b: (calls.__setitem__(0, calls[0] + len(a)), compare(self, a, b)))
    monkeypatch.setattr(substring_dedup, "SMALL", 10**6)
    want, all_pairs = told(), calls[0]
    monkeypatch.setattr(substring_dedup, "SMALL", 2)
    calls[0] = 0
    assert told() == want and len(want[0]) > 100 and len(want[1]) > 5
    assert calls[0] < all_pairs


def test_blocks_of_large_groups_meet(spark, monkeypatch):
    rng = np.random.RandomState(49)
    base = [f"w{x}" for x in rng.randint(0, 10**6, 140)]
    rows = []
    for k in range(30):
        w = list(base)
        for at in rng.randint(0, 140, 3):
            w[at] = f"x{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(substring_dedup.passages(docs).collect())
    monkeypatch.setattr(substring_dedup, "BLOCK", 7)
    assert sorted(substring_dedup.passages(docs).collect()) == want and len({r.doc_id for r in want}) == 30


def test_stretches_that_repeat_themselves(spark):
    """Anchors at both ends only, and all words of stretches that another text repeats, too."""
    rng = np.random.RandomState(59)
    fresh = lambda n: [f"w{x}" for x in rng.randint(0, 10**6, n)]
    end = fresh(45)
    rows = [
        (1, ["x"] * 1500), (2, fresh(20) + ["x"] * 131 + fresh(20)), (3, fresh(20) + ["x"] * 49 + fresh(20)),
        (4, fresh(20) + ["a", "b", "c"] * 30 + end), (5, fresh(3) + ["c", "a", "b"] * 11 + end + fresh(9)),
        (6, fresh(15) + ["y"] * 30 + ["z"] + ["y"] * 30), (7, fresh(40) + ["y"] * 400),
    ]
    batch = pa.RecordBatch.from_pydict({"doc_id": [d for d, _ in rows], "text": [" ".join(w) for _, w in rows]})
    anchors = pd.concat([b.to_pandas() for b in substring_dedup._windows([batch])])
    assert (anchors[anchors.c >= 0].groupby("doc").size().loc[[1, 7]] <= 8).all()
    got = defaultdict(set)
    for r in substring_dedup.passages(spark.createDataFrame([(d, " ".join(w)) for d, w in rows], "doc_id long, text string")).collect():
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    assert got[1] == set(range(1500)) and got[2] == set(range(20, 151)) and not got[3]
    assert got[4] >= set(range(77, 155)) and got[5] == set(range(3, 81))
    assert got[6] == set(range(15, 76)) and got[7] == set(range(40, 440))


def test_windows_are_those_of_the_tree():
    keys = np.random.RandomState(0).permutation(300).astype(np.uint64)
    low = substring_dedup._minima(keys, 46)
    assert (low == [keys[k : k + 46].min() for k in range(300 - 45)]).all()


def test_words_match_python():
    texts = [None, "", " a\x0bB\tc ", "é À x", LONG]
    found, begin = word_hashes(texts)
    assert list(np.diff(begin)) == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in (t or "").encode().lower().split()]
    assert len(set(zip(flat, found.tolist(), strict=True))) == len(set(flat)) == len(set(found.tolist()))


def test_streamed_groups_dont_depend_on_batches():
    rng = np.random.RandomState(4)
    rows = pd.DataFrame({"v": np.sort(rng.randint(0, 40, 300)), "doc": rng.randint(0, 6, 300)})
    whole = pd.concat(substring_dedup._met([rows])).sort_values(["v", "doc"]).values.tolist()
    parts = pd.concat(substring_dedup._met([rows[k : k + 7].reset_index(drop=True) for k in range(0, 300, 7)])).sort_values(["v", "doc"]).values.tolist()
    assert whole == parts == [x for x in sorted(rows.values.tolist()) if len(set(rows[rows.v == x[0]].doc)) > 1]


@pytest.mark.parametrize("size", [1, 2, 7, 50, 1000])
def test_candidates_dont_depend_on_batches(size):
    rng = np.random.RandomState(6)
    rows = pd.DataFrame({"h": rng.randint(0, 12, 400), "length": rng.randint(0, 3, 400), "n": 100, "rep": np.arange(400), "pos": 0}).sort_values(["h", "length"]).reset_index(drop=True)
    out = pd.concat(ngram_join._neighbours([rows[k : k + size].reset_index(drop=True) for k in range(0, 400, size)]))
    own = out.other == out.rep
    assert sorted(out[own].rep) == sorted(rows.rep)
    want = set()
    for k, r in enumerate(rows.itertuples()):
        run = rows[(rows.h == r.h) & (rows.length == r.length)].rep.tolist()
        want |= {(r.rep, x) for x in run[: min(ngram_join.HUBS, run.index(r.rep))]}
        if k and rows.h[k - 1] == r.h:
            want.add((r.rep, rows.rep[k - 1]))
    assert set(zip(out[~own].rep, out[~own].other, strict=True)) == want


def test_variant_keys_are_those_of_the_shorter_lines(spark):
    rng = random.Random(9)
    lines = [[rng.choice("abc") for _ in range(n)] for n in (5, 6, 7, 16, 17, 26, 90) for _ in range(6)]
    frame = spark.createDataFrame([(k, w) for k, w in enumerate(lines)], "k int, words array<string>")
    rows = frame.select("words", line_dedup._variant_keys(F.col("words")).alias("v"), line_dedup._whole_key(F.col("words")).alias("w")).collect()
    without = [[*r.words[:k], *r.words[k + 1 :]] for r in rows for k in range(len(r.words))]
    keys = spark.createDataFrame([(k, w) for k, w in enumerate(without)], "k int, words array<string>").select("k", line_dedup._whole_key(F.col("words")).alias("w")).collect()
    assert [r.w for r in sorted(keys, key=lambda r: r.k)] == [v for r in rows for v in r.v]
    assert len({tuple(w) for w in without}) == len({r.w for r in keys})


def test_within_one_edit_by_brute_force(spark):
    rng = random.Random(10)
    pairs = [([rng.choice("ab") for _ in range(rng.randint(1, 5))], [rng.choice("ab") for _ in range(rng.randint(1, 5))]) for _ in range(600)]
    pairs = [(a, b) for a, b in pairs if a != b]

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    rows = spark.createDataFrame(pairs, "a array<string>, b array<string>").select("a", "b", line_dedup._within_one_edit(F.col("a"), F.col("b")).alias("near")).collect()
    assert [r.near for r in rows] == [near(r.a, r.b) for r in rows]
    assert {r.near for r in rows} == {True, False}


def test_stretches_of_many_rows_are_those_of_each():
    rng = np.random.default_rng(11)
    width = 2 * substring_dedup.CONTEXT + 1
    mid = width // 2
    pairs = []
    for k in range(600):
        words = rng.integers(1, 3 if k % 5 == 0 else 500, width + 20).astype(np.int32)
        x, y = words[:width].copy(), words[:width].copy()
        for _ in range(rng.integers(0, 4)):
            at = int(rng.integers(mid + 1, width))
            kind = rng.integers(0, 3)
            if kind == 0:
                y[at] = 999
            elif kind == 1:
                y = np.concatenate([y[:at], [777], y[at:-1]]).astype(np.int32)
            else:
                y = np.concatenate([y[: mid - 30], y[mid - 29 :], words[width : width + 1]]).astype(np.int32) if k % 2 else np.concatenate([y[1 : mid - 20], [555], y[mid - 20 :]]).astype(np.int32)
        for z in (x, y):
            z[: rng.integers(0, 40)] = 0
            z[width - rng.integers(0, 40) :] = 0
        y[mid] = y[mid] if k % 7 else 998
        pairs.append((x, y))
    got = substring_dedup.all_stretches(np.stack([p[0] for p in pairs]), np.stack([p[1] for p in pairs]))
    want = [substring_dedup.stretches(x, y) or (0, 0, 0, 0) for x, y in pairs]
    assert [tuple(map(int, g)) for g in got] == [tuple(map(int, w)) for w in want]
    assert sum(w != (0, 0, 0, 0) for w in want) > 100 and sum(w[:2] != w[2:] for w in want) > 50
