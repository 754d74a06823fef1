"""op11 to op13 by brute force: odd rows, many blocks, small chunks, ranges that cut words."""

import hashlib
import random
import uuid
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftline.llm import conversation_trie, queries, token_alignment, warc

TURNS = "conv_id long, turn long, role string, text string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_nodes(rows):
    key = lambda r: hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()[:24]
    own, built, members, children, leaves, saved = {}, {}, {}, Counter(), Counter(), Counter()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, key(r))):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = own.get(c - (c % 100 if c >= 0 else -(-c % 100)), [])
        built[c] = tuple(head[:h] + turns[h:])
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    children.update(p[:-1] for p in members if p)
    for p, cs in members.items():
        for d in range(len(p) + 1):
            saved[p[:d]] += (len(cs) - 1) * (len(p[-1][1]) if p else 0)
            leaves[p[:d]] += p not in children
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if built[c] == p).encode()).hexdigest()
    return sorted([(min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), children[p], leaves[p], saved[p], ends(p)) for p, cs in members.items()], key=str)


def conversations(kind):
    random.seed(5)
    if kind == "mixed":
        rows = [(c, t if random.random() < 0.9 else None, random.choice(["u", "a", None]), random.choice(["", "x", "yż", "zz", None])) for c in [*range(-30, 60), *range(100, 260)] for t in range(random.randint(1, 9))]
        return rows + rows[:20] + [(None, 1, "u", "t")]
    if kind == "deep":
        return [(c, t, "u", "same" if t < 40 or c % 2 else f"d{c}") for c in range(40) for t in range(random.choice([30, 45, 50]))]
    return {"empty": [], "single": [(5, None, None, None)], "turnless": [(106, 0, "u", "a")]}[kind]


@pytest.mark.parametrize("kind", ["mixed", "deep", "empty", "single", "turnless"])
@pytest.mark.parametrize("size", [3, 200_000])
def test_prefix_nodes(spark, monkeypatch, kind, size):
    """Blocks of three sequences: most nodes go on over the ends of blocks, the root over all of them."""
    monkeypatch.setattr(conversation_trie, "BLOCK_ROWS", size)
    rows = conversations(kind)
    df = spark.createDataFrame(rows, TURNS).withColumns({"depth": F.lit("mine"), "key": F.lit(7)})
    shared = conversation_trie.share_heads(conversation_trie.sequences(df))
    nodes = conversation_trie.prefix_nodes(shared)
    assert sorted([tuple(r) for r in nodes.select(NODE).collect()], key=str) == plain_nodes(rows)
    if kind == "mixed":
        texts = conversation_trie.with_turns(nodes, df, shared).where("depth > 0")
        assert texts.where("text is null or role is null").isEmpty() and texts.count() == nodes.count() - 1


def test_range_minimum():
    values = np.random.RandomState(1).randint(0, 9, 100)
    table = conversation_trie.RangeMinimum(values)
    low, high = np.triu_indices(100)
    assert (table.of(low, high + 1) == [values[a : b + 1].min() for a, b in zip(low, high, strict=True)]).all()
    start, least = np.repeat(np.arange(100), 9), np.tile(np.arange(9), 100)
    left, right = table.reach_left(start, least), table.reach_right(start, least)
    for s, m, x, y in zip(start, least, left, right, strict=True):
        assert all(values[x + 1 : s + 1] >= m) and (x == 0 or values[x] < m)
        assert all(values[s + 1 : y + 1] >= m) and (y == 99 or values[y + 1] < m)


PAGES = "page_id long, url string, html string"


def plain_records(rows):
    ids = {}
    for p, _, h in rows:
        ids.setdefault((h or "").encode(), []).append(p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        top = max((x for x in ids[b] if x is not None), default=None)
        again = len(b) >= 1000 and len(ids[b]) > 1 and top is not None and p != top
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages():
    big = "żółć<p>\r\n" * 300
    rows = [(1, "http://a/ b\r\nX: y", "x" * 1000), (2, None, "x" * 1000), (3, "u", "x" * 999), (4, "u", "x" * 999), (5, "u", None), (6, "u", ""), (None, "u", "y" * 2000), (None, "u", "y" * 2000)]
    return rows + [(7, "u", big), (8, "u", big), (8, "u", big), (None, "u", big), (9, "u", "WARC/1.1\r\n\r\n" * 100), (10, "ü", "\r\n\r\n"), (11, "u", "z" * (256 << 10))] + [(k, "u", "c" * 1500) for k in range(20, 60)]


@pytest.mark.parametrize(("chunk", "file_bytes"), [(256 << 10, 1 << 29), (1000, 500)])
def test_archives(spark, monkeypatch, pages, chunk, file_bytes):
    monkeypatch.setattr(warc, "CHUNK", chunk)
    df = spark.createDataFrame(pages, PAGES).withColumns({"record_id": F.lit("mine"), "data": F.lit(1)})
    files = warc.write_archives(warc.records_of(df), warc.new_folder(spark), file_bytes=file_bytes)
    chunks = warc.read_archives(files)
    assert sorted([tuple(r) for r in warc.resolved(warc.records(chunks)).drop("uri").collect()], key=str) == plain_records(pages)
    rows = chunks.collect()
    assert max(len(r.data) for r in rows) <= chunk and all(r.n_bytes == r.chunk_no * chunk + len(r.data) for r in rows)
    whole = {}
    for r in sorted(rows, key=lambda r: (r.record_id, r.chunk_no)):
        if r.record_type == "response" and r.page_id in ("9", "11"):
            whole[r.page_id] = whole.get(r.page_id, b"") + r.data
            assert r.digest == hashlib.sha1(whole[r.page_id]).hexdigest()
    assert {k: v.decode() for k, v in whole.items()} == {str(p): h for p, _, h in pages if p in (9, 11)}
    if file_bytes == 500:
        assert files.count() > 8


def test_archives_of_no_pages_and_ids_of_text(spark):
    assert warc.archive(spark.createDataFrame([], PAGES), warc.new_folder(spark)).count() == 0
    rows = [(f"p\r\n{k % 3}", None, "q" * 1500) for k in range(4)]
    got = warc.archive(spark.createDataFrame(rows, "page_id string, url string, html string"), warc.new_folder(spark)).drop("uri").collect()
    assert sorted(map(tuple, got), key=str) == plain_records(rows)


def test_archives_of_others(spark, tmp_path):
    """Plain archives, other kinds of records, and files that end too soon."""
    body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nhello"
    head = lambda kind, more, n: f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{kind}>\r\n{more}Content-Length: {n}\r\n\r\n".encode()
    text = head("warcinfo", "", 3) + b"a:b\r\n\r\n" + head("response", "Content-Type: application/http\r\n", len(body)) + body + b"\r\n\r\n" + head("resource", "", 0) + b"\r\n\r\n"
    (tmp_path / "a.warc").write_bytes(text)
    (tmp_path / "b.warc").write_bytes(text[:-30])
    read = lambda name: warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/{name}",)], "path string"))
    assert {(r.record_type, bytes(r.data)) for r in read("a.warc").collect()} == {("warcinfo", b"a:b"), ("response", b"hello"), ("resource", b"")}
    with pytest.raises(Exception, match="the archive ends within a record"):
        read("b.warc").collect()


@pytest.fixture(scope="module")
def pair():
    read = lambda name: open(f"{token_alignment.TOKENIZERS}/{name}", "rb").read()  # noqa: E731, SIM115
    return token_alignment.Pair(read("byte_bpe_50k.json"), read("piece_bpe_32k.model"))


def plain_alignment(pair, rows):
    """Whole texts by the two libraries; groups and links one by one."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(f"{token_alignment.TOKENIZERS}/byte_bpe_50k.json")
    whole.encode_special_tokens = True
    told, counts = [], Counter()
    for _, text in rows:
        a = whole.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pair._b.encode(text) if text else []
        spelled = lambda ids, table: b"".join(table[i] for i in ids)
        if not text or {spelled(a, pair.a_bytes), spelled(b, pair.b_bytes)} != {(" " + text).encode()}:
            told.append(None)
            continue
        ends_a, ends_b = ({e: k for k, e in enumerate(np.cumsum([len(t[i]) for i in ids]).tolist())} for ids, t in ((a, pair.a_bytes), (b, pair.b_bytes)))
        groups, links, p, q = [], [], 0, 0
        for e in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a[e] + 1, ends_b[e] + 1
            groups.append(f"{','.join(map(str, a[p:x]))}|{','.join(map(str, b[q:y]))}")
            links.append((a[x - 1], b[y - 1]))
            p, q = x, y
        counts.update(links)
        told.append((len(a), len(b), groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for (d, _), t in zip(rows, told, strict=True):
        out.append((d, 0, 0, 0, 0, 0, 0, "") if t is None else (d, t[0], t[1], len(t[2]), len(t[3]), sum(counts[x] == best[x[1]] for x in t[3]), sum(counts[x] for x in t[3]), ";".join(t[2])))
    return sorted(out, key=str)


ODD = [
    (1, "hello  world"), (2, None), (3, ""), (4, " lead"), (5, "trail "), (6, "a\n\nb c\n d"), (7, "x ▁ y"), (8, "<s> <|endoftext|> </s> <unk>"), (9, "żółć 你好世界 🎉   b"), (9, "żółć 你好世界 🎉   b"), (None, "x y"), (11, " "),
    (12, "\x00 a \x1c b"), (13, "it's we'll  I'M x\tz  \n\n q"), (14, "a" * 3000), (15, " " * 500 + "b"), (16, "don't stop.\xa0nbsp"), (17, "ﬁ ﬀ Å ① x²"), (18, "你好世界" * 200), (19, "ab\n" * 200), (20, "x\n bar foo x\n"),
]


@pytest.mark.parametrize("size", [1 << 16, 50])
def test_alignment(spark, monkeypatch, pair, size):
    """With ranges of 50 characters most texts are cut within words, and whole again over three levels."""
    monkeypatch.setattr(token_alignment, "RANGE", size)
    monkeypatch.setattr(token_alignment, "FAN", 4)
    monkeypatch.setattr(token_alignment, "WORDS", 40)
    random.seed(7)
    parts = ["żółć", "hello", "x", "99", "(a)", "\n", "tree-like", "  ", "你好世界", '"quoted,"', "don't"]
    rows = ODD + [(k, " ".join(random.choice([*parts, "▁" if k == 103 else "u"]) for _ in range(random.randint(1, 300)))) for k in range(100, 130)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"groups": F.lit(1), "key": F.lit("mine")})
    assert sorted([tuple(r) for r in token_alignment.align(df).collect()], key=str) == plain_alignment(pair, rows)
    if size == 50:
        fragments = token_alignment._fragments(df, token_alignment.load(spark))
        assert fragments.where("size(tail_a) + size(tail_b) > 0").count() > 20
    assert token_alignment.align(df.limit(0)).count() == 0


def test_alignment_of_given_texts(spark, sf, pair):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op13_token_alignment(spark, sf).collect()
    digest = lambda n, groups: hashlib.sha256(groups.encode()).hexdigest() if n else ""
    assert sorted(map(tuple, got), key=str) == sorted([(*r[:7], digest(r[1], r[7])) for r in plain_alignment(pair, rows)], key=str)


def test_fragments_compose_in_any_tree(pair):
    a, b = pair.tokens("don't split żółć, tree-like 你好 words at 1234567 places; whole again")
    ends = [np.cumsum(s[i]) for s, i in ((pair.a_size, a), (pair.b_size, b))]
    rng = np.random.RandomState(0)

    def cut(borders):
        return [token_alignment.fragment(a[(ends[0] > x) & (ends[0] <= y)], ends[0][(ends[0] > x) & (ends[0] <= y)], b[(ends[1] > x) & (ends[1] <= y)], ends[1][(ends[1] > x) & (ends[1] <= y)]) for x, y in zip(borders, borders[1:], strict=False)]

    def text(f):
        return ";".join(x for x in (token_alignment.written_group(*f["head"]), f["groups"]) if x), f["tail"]

    total = int(ends[0][-1])
    want = text(cut([0, total])[0])
    for _ in range(40):
        parts = cut([0, *sorted(rng.choice(np.arange(1, total), rng.randint(1, 30), replace=False)), total])
        while len(parts) > 1:
            k = rng.randint(len(parts) - 1)
            parts[k : k + 2] = [token_alignment.compose(parts[k], parts[k + 1])]
        assert text(parts[0]) == want


def test_names_of_records(spark):
    """A record's name doesn't change from run to run."""
    df = spark.createDataFrame([(1, "a")], "page_id long, d string").select(warc.record_uuid(F.col("page_id"), F.col("d")).alias("u"))
    assert uuid.UUID(df.first().u.removeprefix("urn:uuid:")).hex == hashlib.md5(b"1:a").hexdigest()
