"""Alignment of two tokenizers over one corpus.

Tokens of A (byte-level BPE) and B (BPE with byte fallback) spell the same bytes. Offsets where tokens of both end cut
them into groups; the two tokens that end there are linked. What a stretch of bytes says about this is a fragment: open
tokens up to its first common end, closed groups, open tokens after its last one. Fragments compose associatively, so
a text may be cut anywhere and put together again in any tree of compositions:

* Both tokenizers start anew at a space between two other characters (B has no piece that goes on behind a word's end,
  which is checked when it is loaded). A text of up to RANGE characters is composed of its words; each task looks at
  a word once and then counts it.
* A longer text is cut into ranges of RANGE characters, wherever that falls. Each range is a row of its own, of any
  task: it is tokenized from the last such space before it on, and keeps the tokens that end within it. A tree of
  groupings composes FAN fragments at a time.

The count of a pair of ids needs the whole corpus. Tokens that end together spell a suffix of one another, so there are
never more pairs than the two vocabularies have suffix pairs (some 200,000 for the given ones, whatever the corpus):
their counts are summed by a grouping, and may then go to all tasks.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kind_of, written

#: Where the vocabulary files are, for the driver: executors get their contents.
TOKENIZERS = "/opt/tokenizers"
#: Characters of a range, of which each is a row of its own; fragments composed by one task of a level.
RANGE = 1 << 16
FAN = 16
#: Words that a task remembers, and their longest: others are tokenized each time.
WORDS, LONGEST = 400_000, 64
#: Texts and characters handled at once.
ROWS, CHARS = 512, 1 << 21
#: How ids are written: vocabularies of up to 65,536 entries.
IDS = "<u2"
_BREAK = re.compile(r"(?<=\S) (?=\S)")
#: The split pattern of A, and the stretches of code points that a byte-level alphabet keeps as they are.
SPLIT_A = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTED = (range(0x21, 0x7F), range(0xA1, 0xAD), range(0xAE, 0x100))


def byte_alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printed ones for themselves, others from 256 on."""
    kept = [b for r in PRINTED for b in r]
    others = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair:
    """Two tokenizers made of the contents of their files, with the bytes of each of their tokens."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        import tiktoken

        spec = json.loads(a_json)
        special = {x["id"] for x in spec["added_tokens"] if x["special"]}
        alphabet = byte_alphabet()
        bytes_of = {i: bytes(alphabet[c] for c in entry) for entry, i in spec["model"]["vocab"].items() if i not in special}
        self.a_bytes = [bytes_of.get(i, b"") for i in range(max(bytes_of) + 1)]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        ranked = all(spec["model"]["vocab"][x + y] == 256 + k for k, (x, y) in enumerate(merges)) and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"]["use_regex"]
        # ids in the order of merges are ranks, which the other library takes four times as fast
        self._ranks = tiktoken.Encoding("a", pat_str=SPLIT_A, mergeable_ranks={b: i for i, b in bytes_of.items()}, special_tokens={}) if ranked else None
        self._json, self._whole = a_json, None
        self._b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("B has pieces that go on behind a word's end")
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else b"" if self._b.is_control(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("ids are written as 16 bits")
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))

    def a(self, text: str) -> np.ndarray:
        if self._ranks:
            try:
                return self._ranks.encode_to_numpy(text, disallowed_special=()).astype(np.int64)
            except BaseException as e:  # a run of blanks may be too long for its matcher, which then panics
                if not isinstance(e, Exception) and type(e).__name__ != "PanicException":
                    raise
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_str(self._json.decode())
            self._whole.encode_special_tokens = True
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, np.int64)

    def b(self, text: str) -> np.ndarray:
        return np.array(self._b.encode(text, num_threads=1), np.int64)

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids by A of space+text and by B of text; none if the bytes of either differ from space+text."""
        a, b, want = self.a(" " + text), self.b(text), (" " + text).encode()
        if b"".join(map(self.a_bytes.__getitem__, a.tolist())) != want or b"".join(map(self.b_bytes.__getitem__, b.tolist())) != want:
            return None
        return a, b


def fragment(a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> dict:
    """The fragment of tokens in order, with their end offsets: head and tail are (ids of A, ids of B); groups holds those
    between as text. Without a common end all is tail, and head is none."""
    a_in, b_in = np.isin(a_end, b_end, assume_unique=True), np.isin(b_end, a_end, assume_unique=True)
    i, j = np.flatnonzero(a_in), np.flatnonzero(b_in)
    if not len(i):
        return {"head": None, "groups": "", "tail": (a.tolist(), b.tolist()), "links": np.zeros((0, 2), np.int64)}
    cuts = list(zip(i.tolist(), j.tolist(), strict=True))
    la, lb = a.tolist(), b.tolist()
    groups = [written_group(la[p + 1 : x + 1], lb[q + 1 : y + 1]) for (p, q), (x, y) in zip(cuts, cuts[1:], strict=False)]
    return {"head": (la[: i[0] + 1], lb[: j[0] + 1]), "groups": ";".join(groups), "tail": (la[i[-1] + 1 :], lb[j[-1] + 1 :]), "links": np.stack([a[i], b[j]], axis=1)}


def written_group(a: list[int], b: list[int]) -> str:
    return f"{','.join(map(str, a))}|{','.join(map(str, b))}"


def compose(x: dict, y: dict) -> dict:
    """x followed by y. Where y has a common end, x's open tail and y's head are one closed group, or a longer head."""
    if y["head"] is None:
        return {**x, "tail": (x["tail"][0] + y["tail"][0], x["tail"][1] + y["tail"][1])}
    joined = (x["tail"][0] + y["head"][0], x["tail"][1] + y["head"][1])
    if x["head"] is None:
        return {**y, "head": joined}
    return {"head": x["head"], "groups": ";".join(g for g in (x["groups"], written_group(*joined), y["groups"]) if g), "tail": y["tail"]}


def _common(pair: Pair, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Ends of the tokens of A and of B, of both, and the tokens of A and of B that end there; texts may follow one another."""
    a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    seen = np.zeros(int(a_end[-1]) + 1 if len(a) else 1, bool)
    seen[a_end] = True
    j = np.flatnonzero(seen[b_end])
    common = b_end[j]
    return a_end, b_end, common, np.searchsorted(a_end, common), j


def _gather(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of each stretch, stretch after stretch."""
    before = np.cumsum(size) - size
    return np.repeat(begin - before, size) + np.arange(int(size.sum()))


class _Lists:
    """Lists of numbers, one after the other, that grow."""

    def __init__(self):
        self.values, self.start, self.n = np.zeros(4096, np.int64), np.zeros(1025, np.int64), 0

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        used = self.start[self.n]
        for name, wanted in (("values", used + len(values)), ("start", self.n + len(sizes) + 1)):
            held = getattr(self, name)
            if wanted > len(held):
                setattr(self, name, np.concatenate([held, np.zeros(max(len(held), int(wanted) - len(held)), np.int64)]))
        self.values[used : used + len(values)] = values
        self.start[self.n + 1 : self.n + len(sizes) + 1] = used + np.cumsum(sizes)
        self.n += len(sizes)

    def of(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All values of lists k, and the sizes of these."""
        size = self.start[k + 1] - self.start[k]
        return self.values[_gather(self.start[k], size)], size


def _edged(word: str) -> bool:
    return not word or word.strip() != word


class _Words:
    """What a task knows of words: tokens of A and of B, links, whether both spell it. Bounded: it starts anew when full."""

    def __init__(self, pair: Pair):
        self.pair = pair
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.a, self.b, self.links, self.ok = _Lists(), _Lists(), _Lists(), _Lists()

    def _learn(self, words: list[str]) -> None:
        """All words in one call of each tokenizer: they begin anew at each of the spaces between."""
        pair = self.pair
        got = pair.tokens(" ".join(words)) if words else None
        if got is None:
            if len(words) > 1:
                for half in (words[: len(words) // 2], words[len(words) // 2 :]):
                    self._learn(half)
            elif words:
                one = np.zeros(1, np.int64)
                for part in (self.a, self.b, self.links):
                    part.extend(one[:0], one)
                self.ok.extend(one, one + 1)
            return
        a, b = got
        a_end, b_end, common, i, j = _common(pair, a, b)
        ends = np.cumsum([len(w.encode()) + 1 for w in words])
        per = lambda e: np.bincount(np.searchsorted(ends, e), minlength=len(words))
        self.a.extend(a, per(a_end))
        self.b.extend(b, per(b_end))
        self.links.extend(a[i] * len(pair.b_bytes) + b[j], per(common))
        self.ok.extend(np.ones(len(words), np.int64), np.ones(len(words), np.int64))

    def _known(self, words: list[str], blanks: bool) -> np.ndarray:
        """Numbers of distinct words, new ones learned. blanks: some may have a blank at an end, and can't be joined with others."""
        new = [w for w in words if w not in self.at]
        edged = [w for w in new if _edged(w)] if blanks else []
        for call in ([w for w in new if not _edged(w)] if edged else new, *([w] for w in edged)):
            first = self.ok.n
            self._learn(call)
            self.at.update(zip(call, range(first, self.ok.n), strict=True))
        out = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        for w in [*(w for w in new if len(w) > LONGEST), *(w for w in edged if len(w) <= LONGEST)]:
            del self.at[w]
        return out

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the words of all texts, and where each text's begin (one more than texts)."""
        if self.ok.n > WORDS:
            self.clear()
        parts = pc.split_pattern(texts, " ")
        words, start = parts.flatten().dictionary_encode(), np.asarray(parts.offsets, np.int64) - parts.offsets[0].as_py()
        distinct, index = words.dictionary.to_pylist(), words.indices.to_numpy()
        # a blank beside a space: only spaces between other characters part words, so these texts are parted anew
        edged = np.array([_edged(w) for w in distinct], bool)
        if not edged.any():
            return self._known(distinct, False)[index], start
        row = np.repeat(np.arange(len(texts)), np.diff(start))
        again = np.unique(row[edged[index]])
        redone = [_BREAK.split(t) for t in texts.take(pa.array(again)).to_pylist()]
        kept = np.unique(index[~np.isin(row, again)])
        numbers = np.zeros(len(distinct), np.int64)
        every = list(dict.fromkeys([*(distinct[k] for k in kept), *(w for p in redone for w in p)]))
        found = self._known(every, True)
        numbers[kept] = found[: len(kept)]
        place = dict(zip(every, found.tolist(), strict=True))
        flat = np.concatenate([numbers[index], np.array([place[w] for p in redone for w in p], np.int64)])
        begin, size = start[:-1].copy(), np.diff(start)
        size[again] = [len(p) for p in redone]
        begin[again] = len(index) + np.cumsum(size[again]) - size[again]
        return flat[_gather(begin, size)], np.concatenate([[0], np.cumsum(size)])


def _slices(batch):
    """(from, to) of rows, few enough and short enough to be held at once."""
    sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
    at = 0
    while at < len(sizes):
        to, held = at, 0
        while to < len(sizes) and to - at < ROWS and (to == at or held + sizes[to] <= CHARS):
            held, to = held + sizes[to], to + 1
        yield at, to
        at = to


def _scores(pairs: np.ndarray, known: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of each pair its count in the corpus, and whether that is its B id's highest."""
    keys, counts, best = known
    if not len(keys):
        return np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
    k = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
    there = keys[k] == pairs
    return np.where(there, counts[k], 0), np.where(there, best[k], 0)


def _sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0)])
    return total[start[1:]] - total[start[:-1]]


def load(spark: SparkSession, a_path: str | None = None, b_path: str | None = None):
    """The contents of both files, for all tasks: two vocabularies, whatever the corpus."""
    files = [open(p, "rb").read() for p in (a_path or f"{TOKENIZERS}/byte_bpe_50k.json", b_path or f"{TOKENIZERS}/piece_bpe_32k.model")]  # noqa: SIM115
    return spark.sparkContext.broadcast(tuple(files))


def _ranges(docs: DataFrame) -> DataFrame:
    """(key, doc_id, k, text, skip, take) of texts of over RANGE characters: the words around each range, how many of their
    bytes come before it, and how many it has."""
    kind = kind_of(docs)
    size = RANGE

    def cut(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                key, doc, text = (batch.column(c)[r].as_py() for c in ("key", "doc_id", "text"))
                borders, safe = [0], [0]
                for at in range(size, len(text) - 1, size):
                    # the last space before the border that parts words, not far from it; else the range goes on
                    near = None
                    for near in _BREAK.finditer(text, max(at - size // 4, safe[-1] + 1), at):  # noqa: B007
                        pass
                    if near:
                        borders.append(at)
                        safe.append(near.start())
                borders.append(len(text))
                for k, (low, high) in enumerate(zip(borders, borders[1:], strict=False)):
                    after = _BREAK.search(text, high)
                    begin, end = safe[k] + (k > 0), after.start() if after else len(text)
                    # offsets count the space ahead of the words
                    skip = len(text[begin:low].encode()) + 1 if k else 0
                    yield pa.RecordBatch.from_pydict({"key": [key], "doc_id": pa.array([doc], batch.schema.field("doc_id").type), "k": pa.array([k], pa.int32()), "text": [text[begin:end]], "skip": [skip], "take": [len(text[low:high].encode()) + (k == 0)]})

    long = docs.where(F.char_length("text") > RANGE).select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    return long.mapInArrow(cut, f"key long, doc_id {kind}, k int, text string, skip long, take long")


_FRAGMENT_NAMES = ["closed", "head_a", "head_b", "groups", "tail_a", "tail_b", "n_a", "n_b", "n_links"]
_FRAGMENT = "closed boolean, head_a array<int>, head_b array<int>, groups string, tail_a array<int>, tail_b array<int>, n_a long, n_b long, n_links long"


def _fragments(docs: DataFrame, files) -> DataFrame:
    """A fragment for each range of the long texts, dealt out to all tasks, with its links; ok: its bytes are spelled alike."""
    kind = kind_of(docs)

    def told(batches):
        pair = Pair(*files.value)
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                got = pair.tokens(r["text"])
                row = {c: r[c] for c in ("key", "doc_id", "k")} | {"ok": got is not None}
                if got:
                    ids, sizes = got, (pair.a_size, pair.b_size)
                    ends = [np.cumsum(s[i]) for i, s in zip(ids, sizes, strict=True)]
                    own = [(e > r["skip"]) & (e <= r["skip"] + r["take"]) for e in ends]
                    (a, b), (ea, eb) = ([x[o] for x, o in zip(z, own, strict=True)] for z in (ids, ends))
                    f = fragment(a, ea, b, eb)
                    head, links = f["head"] or ([], []), f["links"]
                    row |= {"closed": f["head"] is not None, "head_a": head[0], "head_b": head[1], "groups": f["groups"], "tail_a": f["tail"][0], "tail_b": f["tail"][1], "n_a": len(a), "n_b": len(b), "n_links": len(links), "links": (links[:, 0] * len(pair.b_bytes) + links[:, 1]).tobytes()}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    ints = pa.list_(pa.int32())
    schema = pa.schema([("key", pa.int64()), ("doc_id", _arrow(docs)), ("k", pa.int32()), ("ok", pa.bool_()), ("closed", pa.bool_()), ("head_a", ints), ("head_b", ints), ("groups", pa.string()), ("tail_a", ints), ("tail_b", ints), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("links", pa.binary())])
    rows = _ranges(docs).repartition(F.xxhash64("key", "k")).mapInArrow(told, f"key long, doc_id {kind}, k int, ok boolean, {_FRAGMENT}, links binary")
    return written(rows, "fragments")


def _spelled(fragments: DataFrame) -> DataFrame:
    """Fragments of texts all of whose ranges are spelled alike."""
    return fragments.join(fragments.where("not ok").select("key").distinct(), "key", "left_anti")


def _arrow(docs: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(docs.schema["doc_id"].dataType)


def pair_counts(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """(pair, n): how often two ids are linked in all texts; pair is the id of A times B's number of ids, plus the id of B."""
    docs, files = docs.select("doc_id", "text"), load(docs.sparkSession, a_path, b_path)
    return _summed(_tokenized(docs, files), _spelled(_fragments(docs, files)))


def _binary(values: np.ndarray, size: np.ndarray, kind: str) -> pa.Array:
    """A binary value for each stretch of numbers."""
    data = values.astype(kind)
    offsets = np.concatenate([[0], np.cumsum(size)]) * data.itemsize
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _counted(pairs: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(pairs, return_inverse=True)
    out = np.zeros(len(keys), np.int64)
    np.add.at(out, at, n)
    return keys, out


def _tokenized(docs: DataFrame, files) -> DataFrame:
    """The tokens of all texts of up to RANGE characters, written once: rows (doc_id, a, b) of ids, with empty ones where the bytes
    differ, and rows (pair, n) of what a task has counted."""
    kind, schema = kind_of(docs), pa.schema([("doc_id", _arrow(docs)), ("a", pa.binary()), ("b", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())])

    def told(batches):
        words = _Words(Pair(*files.value))
        seen = np.zeros(0, np.int64)

        def flush():
            k = np.flatnonzero(seen)
            links, size = words.links.of(k)
            pair, n = _counted(links, np.repeat(seen[k], size))
            for at in range(0, len(pair), 100_000):
                p, c = pair[at : at + 100_000], n[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.nulls(len(p), schema.field("doc_id").type), pa.nulls(len(p), pa.binary()), pa.nulls(len(p), pa.binary()), pa.array(p), pa.array(c)], schema=schema)

        for batch in batches:
            for low, high in _slices(batch):
                if words.ok.n > WORDS:
                    yield from flush()
                    seen = np.zeros(0, np.int64)
                part, start = words.of(batch.column("text").slice(low, high - low))
                size = np.diff(start)
                fine = _sums(words.ok.of(part)[0], start) == size
                seen = np.concatenate([seen, np.zeros(max(0, words.ok.n - len(seen)), np.int64)])
                part, size = part[np.repeat(fine, size)], np.where(fine, size, 0)
                seen += np.bincount(part, minlength=len(seen))
                start = np.concatenate([[0], np.cumsum(size)])
                columns = [_binary(ids, _sums(n, start), IDS) for ids, n in (words.a.of(part), words.b.of(part))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, high - low), *columns, pa.nulls(high - low, pa.int64()), pa.nulls(high - low, pa.int64())], schema=schema)
        yield from flush()

    rows = docs.where(f"text <> '' and char_length(text) <= {RANGE}").mapInArrow(told, f"doc_id {kind}, a binary, b binary, pair long, n long")
    return written(rows, "tokens")


def _summed(tokens: DataFrame, fragments: DataFrame) -> DataFrame:
    def linked(batches):
        for batch in batches:
            pairs = np.frombuffer(b"".join(x for x in batch.column("links").to_pylist() if x), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _counted(pairs, np.ones(len(pairs), np.int64))], ["pair", "n"])

    rows = tokens.where("pair is not null").select("pair", "n").unionByName(fragments.select("links").mapInArrow(linked, "pair long, n long"))
    return rows.groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """Per document: doc_id, n_a, n_b (tokens), n_groups, n_links, n_best (links whose pair is the most frequent of its B
    id's, ties included), count_sum (the counts of its links' pairs) and groups as text: `a1,a2|b1;a3|b2,b3`.

    docs: doc_id, text; other columns are ignored. Rows with one doc_id are documents of their own. Texts that are null,
    empty, or not spelled alike by both tokenizers (as those with U+2581) have no tokens: zeros and an empty text. Long
    texts are cut into ranges that any task may hold; a stretch without a space stays in one piece.
    """
    docs = docs.select("doc_id", "text")
    kind, files = kind_of(docs), load(docs.sparkSession, a_path, b_path)
    fragments, tokens = _fragments(docs, files), _tokenized(docs, files)
    spelled = _spelled(fragments)
    n_pieces = len(Pair(*files.value).b_bytes)
    counts = written(_summed(tokens, spelled), "pair-counts").toPandas().sort_values("pair")
    keys, n = counts["pair"].to_numpy(np.int64), counts["n"].to_numpy(np.int64)
    most = np.zeros(n_pieces, np.int64)
    np.maximum.at(most, keys % n_pieces, n)
    known = docs.sparkSession.sparkContext.broadcast((keys, n, (n == most[keys % n_pieces]).astype(np.int64)))
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]

    def told(batches):
        pair = Pair(*files.value)
        shown = [np.array([f"{i}{sign}" for sign in ends for i in range(len(table))], object) for table, ends in ((pair.a_bytes, ",|"), (pair.b_bytes, ",;"))]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                (a, a_start), (b, b_start) = (_numbers(batch.column(c)) for c in ("a", "b"))
                a_end, b_end, common, i, j = _common(pair, a, b)
                # texts begin anew at the ends of those before them
                ends = np.concatenate([[0], a_end])[a_start[1:]]
                l_start = np.concatenate([[0], np.searchsorted(common, ends, side="right")])
                count, best = _scores(a[i] * len(pair.b_bytes) + b[j], known.value)
                # tokens of both, group by group, each with the sign that follows it
                sign_a, sign_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
                sign_a[i], sign_b[j] = 1, 1
                order = np.empty(len(a) + len(b), object)
                order[np.arange(len(a)) + np.concatenate([[0], j + 1])[np.searchsorted(common, a_end)]] = shown[0][a + sign_a * len(pair.a_bytes)]
                order[np.arange(len(b)) + (i + 1)[np.searchsorted(common, b_end)]] = shown[1][b + sign_b * len(pair.b_bytes)]
                flat, to = order.tolist(), (a_start + b_start).tolist()
                texts = ["".join(flat[x:y])[:-1] for x, y in zip(to, to[1:], strict=False)]
                links = np.diff(l_start)
                columns = [np.diff(a_start), np.diff(b_start), links, links, _sums(best, l_start), _sums(count, l_start)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns), pa.array(texts, pa.string())], ["doc_id", *names, "groups"])

    def scored_links(links: pd.Series) -> pd.DataFrame:
        got = [_scores(np.frombuffer(x, np.int64), known.value) for x in links]
        return pd.DataFrame({"n_best": [int(best.sum()) for _, best in got], "count_sum": [int(c.sum()) for c, _ in got]})

    short = tokens.where("pair is null").select("doc_id", "a", "b").mapInArrow(told, f"doc_id {kind}, {', '.join(f'{c} long' for c in names)}, groups string")
    zero = [F.lit(0).cast("long").alias(c) for c in names]
    score = F.pandas_udf(scored_links, "n_best long, count_sum long")
    level = spelled.withColumn("s", score("links")).select("key", "k", *_FRAGMENT_NAMES, "s.*")
    long = fragments.where("k = 0").select("key", "doc_id").join(_composed(level), "key", "left")
    long = long.select("doc_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_a", "n_b")], F.coalesce("n_links", F.lit(0)).alias("n_groups"), *[F.coalesce(c, F.lit(0)).alias(c) for c in names[3:]], F.coalesce("groups", F.lit("")).alias("groups"))
    none = docs.where("text is null or text = ''").select("doc_id", *zero, F.lit("").alias("groups"))
    return short.unionByName(none).unionByName(long)


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all rows, and where each row's begin."""
    size = pc.binary_length(column).to_numpy() // np.dtype(IDS).itemsize
    return np.frombuffer(b"".join(column.to_pylist()), IDS).astype(np.int64), np.concatenate([[0], np.cumsum(size)]).astype(np.int64)


def _composed(level: DataFrame) -> DataFrame:
    """One row for each key: FAN neighbouring fragments become one, level by level."""

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("k")
        parts = [{"head": (list(r.head_a), list(r.head_b)) if r.closed else None, "groups": r.groups, "tail": (list(r.tail_a), list(r.tail_b))} for r in rows.itertuples()]
        total = parts[0]
        for p in parts[1:]:
            total = compose(total, p)
        one = rows.iloc[:1].copy()
        head = total["head"] or ([], [])
        one["closed"], one["groups"] = total["head"] is not None, total["groups"]
        for c, v in (("head_a", head[0]), ("head_b", head[1]), ("tail_a", total["tail"][0]), ("tail_b", total["tail"][1])):
            one[c] = pd.Series([v], index=one.index)
        for c in ("n_a", "n_b", "n_links", "n_best", "count_sum"):
            one[c] = rows[c].sum()
        one["k"] = one["k"] // FAN
        return one.drop(columns="up")

    schema = f"key long, k int, {_FRAGMENT}, n_best long, count_sum long"
    most = level.agg(F.max("k")).first()[0] or 0
    while most > 0:
        level = level.withColumn("up", F.floor(F.col("k") / FAN)).groupBy("key", "up").applyInPandas(join, schema)
        most //= FAN
    # the head has nothing before it now: it is a group itself
    lists = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    first = F.concat(lists("head_a"), F.lit("|"), lists("head_b"))
    return level.withColumn("groups", F.when(F.col("groups") == "", first).otherwise(F.concat_ws(";", first, "groups")))
