"""Evaluation texts leaking into training text (problem 9).

Windows of a fixed number of words are embedded by the CGK random walk, which maps their edit distance (in words)
to Hamming distance; repeated bit-sampling of the embedding gives candidate pairs of a corpus window and an item
window, in as many tables as the target recall needs; an exact edit distance decides.

Texts are compared disregarding case, punctuation, white space, words broken at line ends, and citation markers
between words. Whether brackets with a year are a marker or part of the passage can't always be told; such a text is
read both ways. A corpus window with more words that no item has than edits are allowed can't match, so it is skipped
before the embedding; this loses nothing.

Items are small and fixed in most uses. While their index has at most ``map_side_bytes`` it is sent to all tasks once
and the corpus is read without any shuffle; beyond it windows are joined by their buckets, with equal results.

Null and empty texts, and texts shorter than a window, match nothing. Repeated rows give equal matches; ids repeated
on different rows are taken as one document. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Container, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 12
SAMPLED = 8
MAP_SIDE_BYTES = 64 << 20
VOCABULARY_BYTES = 32 << 20

_BRACKETS = re.compile(r"\[\d[\d,;\s–-]*\]|\(([^()]*)\)")
_SURE = re.compile(r"refs?$|pmid|pmc\d|\bdoi\b|\b10\.\d{4}|\bet\s+al\b.*\b(?:19|20)\d\d[a-z]?\b", re.DOTALL)
_YEAR = re.compile(r"\b(?:19|20)\d\d[a-z]?\b")
_BREAK = re.compile(r"(?<=[^\W_])[-‐‑­]\s*\n\s*(?=[^\W_])")
_INNER = re.compile(r"(?<=\w)['’­​](?=\w)")
_WORD = re.compile(r"[^\W_]+")


_MARK = "\ue000"
_WORD_OR_MARK = re.compile(rf"[^\W_]+|{_MARK}")
Reading = tuple[list[str], list[bool] | None]


def readings(text: str | None, known: Container[str] | None = None) -> list[Reading]:
    """The words of ``text`` as they are compared, without citation markers; a second time where brackets with a year may be markers or not.

    Numbers in square brackets, identifiers, search tokens and author-year citations with "et al." are markers for
    certain. Other brackets with a year are dropped in the first reading and kept in the second, which also tells which of
    its words stand in such brackets: windows without any of them are those of the first reading. A word broken at a line
    end is joined, unless only its parts are ``known``."""
    low = (text or "").lower()
    kept: list[list[str]] = []
    if "(" in low or "[" in low:

        def drop(m: re.Match) -> str:
            inner = m[1]
            if inner is None or _SURE.search(inner):
                return " "
            if not _YEAR.search(inner):
                return m[0]
            kept.append(_words(inner, known))
            return f" {_MARK} "

        low = _BRACKETS.sub(drop, low.replace(_MARK, " "))
    if not kept:
        return [(_words(low, known), None)]
    tokens = _WORD_OR_MARK.findall(_joined_lines(low, known))
    words, inside, bracket = [], [], iter(kept)
    for t in tokens:
        more = next(bracket) if t == _MARK else [t]
        words += more
        inside += [t == _MARK] * len(more)
    return [([t for t in tokens if t != _MARK], None), (words, inside)]


def _joined_lines(low: str, known: Container[str] | None) -> str:
    """Without apostrophes and the like inside words, and with words that are broken at line ends as one or two."""
    if "\n" in low:

        def join(m: re.Match) -> str:
            if known is None:
                return ""
            a, b = _parts(low, m)
            return " " if a + b not in known and a in known and b in known else ""

        low = _BREAK.sub(join, low)
    return _INNER.sub("", low)


def _parts(low: str, m: re.Match) -> tuple[str, str]:
    """The letters and digits on both sides of a break."""
    start, end = m.start(), m.end()
    while start and low[start - 1].isalnum():
        start -= 1
    while end < len(low) and low[end].isalnum():
        end += 1
    return low[start : m.start()], low[m.end() : end]


def _words(low: str, known: Container[str] | None) -> list[str]:
    return _WORD.findall(_joined_lines(low, known))


def broken_words(text: str) -> list[str]:
    """Both parts and the joined form of each word of ``text`` that is broken at a line end."""
    low = text.lower()
    return sorted({w for m in _BREAK.finditer(low) for a, b in [_parts(low, m)] for w in (a, b, a + b)})


def word_code(word: str) -> int:
    """A 63-bit code of a word, never 0."""
    return (xxhash.xxh64_intdigest(word) >> 1) | 1


class Cgk:
    """CGK random walks on windows of codes, and bit-sampling of their output.

    One edit moves a walk for a few steps in expectation, so windows within ``edits`` differ in about ``6 * edits`` of
    the ``3 * window`` symbols, but with a long tail: now and then a walk never comes back into step. The number of
    tables therefore follows from the target recall, and they are spread over independent walks."""

    def __init__(self, window: int = WINDOW, edits: int = 0, recall: float = 0.95, sampled: int = SAMPLED, seed: int = 42):
        self.window, self.edits, self.steps = window, edits, 3 * window
        agree = max(0.1, 1 - 6.0 * edits / self.steps) ** sampled
        wanted = 1 if edits == 0 else max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))
        self.walks = 1 if edits == 0 else 6 * edits
        self.per_walk = -(-wanted // self.walks)
        self.tables = self.walks * self.per_walk
        rng = np.random.default_rng(seed)
        self.mul = rng.integers(1, 2**63, (self.walks, self.steps), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.add = rng.integers(0, 2**64, (self.walks, self.steps), dtype=np.uint64)
        self.positions = [np.sort(rng.choice(self.steps, sampled, replace=False)) for _ in range(self.tables)]
        self.mix = rng.integers(1, 2**63, (self.tables, sampled), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def embed(self, windows: np.ndarray, walk: int = 0) -> np.ndarray:
        """(n, window) codes to (n, 3 * window) symbols; 0 pads behind the end."""
        n = len(windows)
        padded = np.concatenate([windows.astype(np.uint64), np.zeros((n, 1), np.uint64)], axis=1)
        at, rows = np.zeros(n, np.int64), np.arange(n)
        out = np.empty((n, self.steps), np.uint64)
        for j in range(self.steps):
            out[:, j] = symbol = padded[rows, at]
            step = (symbol * self.mul[walk, j] + self.add[walk, j]) >> np.uint64(63)
            at = np.minimum(at + step.astype(np.int64), self.window)
        return out

    def buckets(self, windows: np.ndarray) -> np.ndarray:
        """(n, tables) bucket numbers."""
        out = np.empty((len(windows), self.tables), np.int64)
        for walk in range(self.walks):
            symbols = self.embed(windows, walk)
            for t in range(walk * self.per_walk, (walk + 1) * self.per_walk):
                h = np.full(len(windows), t + 1, np.uint64)
                for k, p in enumerate(self.positions[t]):
                    h = (h ^ symbols[:, p]) * self.mix[t, k]
                    h ^= h >> np.uint64(31)
                out[:, t] = h.view(np.int64)
        return out


def edit_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances of pairs of windows, all pairs at once."""
    n, w = a.shape
    row = np.tile(np.arange(w + 1), (n, 1))
    for i in range(w):
        prev = row.copy()
        row[:, 0] = i + 1
        for j in range(w):
            row[:, j + 1] = np.minimum(np.minimum(row[:, j] + 1, prev[:, j + 1] + 1), prev[:, j] + (a[:, i] != b[:, j]))
    return row[:, w]


def window_starts(owner: np.ndarray, window: int, foreign: np.ndarray | None, most: int, wanted: np.ndarray | None) -> np.ndarray:
    """Where windows of consecutive words of one owner begin, with at most ``most`` of the ``foreign`` words and at least one of
    the ``wanted`` ones, if those are given."""
    n = len(owner) - window + 1
    if n <= 0:
        return np.empty(0, np.int64)
    keep = owner[:n] == owner[window - 1 :]
    for words, least, top in ((foreign, 0, most), (wanted, 1, window)):
        if words is not None:
            upto = np.concatenate([[0], np.cumsum(words)])
            held = upto[window:] - upto[:-window]
            keep &= (held >= least) & (held <= top)
    return np.flatnonzero(keep)


def wanted_words(read: list[tuple[int, Reading]]) -> np.ndarray | None:
    """Which words a window must hold one of: any of first readings, those in brackets of second ones."""
    if all(inside is None for _, (_, inside) in read):
        return None
    return np.concatenate([np.ones(len(ws), bool) if inside is None else np.array(inside, bool) for _, (ws, inside) in read])


def owners(words: list[list[str]]) -> np.ndarray:
    return np.repeat(np.arange(len(words)), [len(ws) for ws in words]) if words else np.empty(0, np.int64)


class ItemIndex:
    """The windows of all items, sorted by bucket in each table."""

    def __init__(self, items: list[tuple[int, str | None]], cgk: Cgk):
        read = [(i, r) for i, t in items for r in readings(t)]
        self.codes = {w: word_code(w) for _, (ws, _) in read for w in ws}
        flat = np.array([self.codes[w] for _, (ws, _) in read for w in ws], np.int64)
        owner = owners([ws for _, (ws, _) in read])
        self.cgk = cgk
        starts = window_starts(owner, cgk.window, None, 0, wanted_words(read))
        self.windows = flat[starts[:, None] + np.arange(cgk.window)]
        self.item = np.array([i for i, _ in read], np.int64)[owner[starts]]
        buckets = cgk.buckets(self.windows)
        self.order = [np.argsort(buckets[:, t], kind="stable").astype(np.int32) for t in range(cgk.tables)]
        self.sorted = [buckets[o, t] for t, o in enumerate(self.order)]

    @staticmethod
    def size(words: int, cgk: Cgk) -> int:
        """Bytes of an index over so many words: each window with its item, and place and bucket in each table; words with codes."""
        return words * (8 * cgk.window + 8 + 12 * cgk.tables + 100)

    def matches(self, docs: list[tuple[int, str | None]]) -> list[tuple[int, int, int]]:
        """(doc, item, least edits) for a batch of documents."""
        if not len(self.windows):
            return []
        read = [(d, r) for d, t in docs for r in readings(t, self.codes)]
        words = [w for _, (ws, _) in read for w in ws]
        codes = np.array([self.codes.get(w, 0) for w in words], np.int64)
        owner, window = owners([ws for _, (ws, _) in read]), self.cgk.window
        starts = window_starts(owner, window, codes == 0, self.cgk.edits, wanted_words(read))
        if not len(starts):
            return []
        at = starts[:, None] + np.arange(window)
        # words that no item has get their own codes, where they are looked at
        for k in np.unique(at[codes[at] == 0]):
            codes[k] = word_code(words[k])
        wins, own = codes[at], owner[starts]
        buckets = self.cgk.buckets(wins)
        pairs = []
        for t in range(self.cgk.tables):
            lo, hi = np.searchsorted(self.sorted[t], buckets[:, t], "left"), np.searchsorted(self.sorted[t], buckets[:, t], "right")
            n = hi - lo
            left = np.repeat(np.arange(len(wins)), n)
            offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pairs.append(left * len(self.windows) + self.order[t][np.repeat(lo, n) + offset])
        left, right = np.divmod(np.unique(np.concatenate(pairs)), len(self.windows))
        a, b = wins[left], self.windows[right]
        edits = np.where((a == b).all(axis=1), 0, 1)
        if self.cgk.edits:
            some = np.flatnonzero(edits)
            edits[some] = edit_distances(a[some], b[some])
        ok = edits <= self.cgk.edits
        best: dict[tuple[int, int], int] = {}
        for d, i, e in zip(own[left[ok]], self.item[right[ok]], edits[ok]):
            key = (read[d][0], int(i))
            best[key] = min(int(e), best.get(key, 99))
        return [(d, i, e) for (d, i), e in best.items()]


_MATCH = "doc_id bigint, item_id bigint, edits int"


def leaks(docs: DataFrame, items: DataFrame, edits: int = 0, window: int = WINDOW, recall: float = 0.95, map_side_bytes: int = MAP_SIDE_BYTES) -> DataFrame:
    """(doc_id, item_id, edits): documents with a window of the item within ``edits``, with the least number found.

    ``docs`` has doc_id and text, ``items`` item_id and text. Windows without edits are always found; others with
    the probability ``recall``, which tests measure against brute force."""
    cgk = Cgk(window, edits, recall)
    size = items.select(F.sum(F.size(F.split("text", r"\s+"))).alias("n")).first().n or 0
    # two readings at most
    if ItemIndex.size(2 * size, cgk) <= map_side_bytes:
        index = ItemIndex([(r.item_id, r.text) for r in items.select(F.col("item_id").cast("bigint"), "text").collect()], cgk)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ids, texts = b.column(0), b.column(1)
                for at in range(0, b.num_rows, 512):
                    got = index.matches(list(zip(ids[at : at + 512].to_pylist(), texts[at : at + 512].to_pylist())))
                    yield pa.RecordBatch.from_pandas(pd.DataFrame(got, columns=["doc_id", "item_id", "edits"]).astype({"doc_id": "int64", "item_id": "int64", "edits": "int32"}), preserve_index=False)

        found = docs.select(F.col("doc_id").cast("bigint"), "text").where("doc_id is not null and text is not null").mapInArrow(scan, _MATCH)
    else:
        found = _joined(docs, items, cgk)
    return found.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))


def _vocabulary(items: DataFrame) -> DataFrame:
    """(word): the distinct words of the items."""

    @F.pandas_udf("array<string>")
    def words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted({w for ws, _ in readings(t) for w in ws}))

    return items.where("text is not null").select(F.explode(words("text")).alias("word")).distinct()


def item_codes(items: DataFrame) -> np.ndarray | None:
    """The sorted codes of all words of the items, or None where they have more than ``VOCABULARY_BYTES``; then no window is skipped early."""

    @F.pandas_udf("bigint")
    def coded(words: pd.Series) -> pd.Series:
        return words.map(word_code)

    codes = _vocabulary(items).select(coded("word").alias("code"))
    if codes.count() * 8 > VOCABULARY_BYTES:
        return None
    return np.sort(np.array([r.code for r in codes.toLocalIterator()], np.int64))


def _known_parts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(id, known): the parts and joined forms of a document's broken words that are words of items."""

    @F.pandas_udf("array<string>")
    def broken(texts: pd.Series) -> pd.Series:
        return texts.map(broken_words)

    known = _vocabulary(items)
    parts = docs.where(F.contains("text", F.lit("\n"))).select("id", F.explode(broken("text")).alias("word")).distinct()
    return parts.join(known, "word").groupBy("id").agg(F.collect_set("word").alias("known"))


def _joined(docs: DataFrame, items: DataFrame, cgk: Cgk) -> DataFrame:
    """Matches by a join on buckets, for item tables that are too large to send around."""

    vocabulary = item_codes(items)

    def side(df: DataFrame, id_col: str) -> DataFrame:
        skip = vocabulary is not None and id_col == "doc_id"

        def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                read = [(i, r) for i, t, k in zip(pdf["id"], pdf["text"], pdf["known"]) for r in readings(t, None if k is None else frozenset(k))]
                codes = np.array([word_code(w) for _, (ws, _) in read for w in ws], np.int64)
                owner = owners([ws for _, (ws, _) in read])
                starts = window_starts(owner, cgk.window, ~np.isin(codes, vocabulary) if skip else None, cgk.edits, wanted_words(read))
                if not len(starts):
                    continue
                wins, ids = codes[starts[:, None] + np.arange(cgk.window)], np.array([i for i, _ in read], np.int64)[owner[starts]]
                # equal windows of one id are in equal buckets
                first = np.unique(np.column_stack([ids, wins]), axis=0, return_index=True)[1]
                wins, ids = wins[first], ids[first]
                buckets = cgk.buckets(wins)
                for t in range(cgk.tables):
                    yield pd.DataFrame({"t": np.int32(t), "bucket": buckets[:, t], "id": ids, "w": list(wins)})

        rows = df.select(F.col(id_col).cast("bigint").alias("id"), "text").where("id is not null and text is not null")
        rows = rows.join(_known_parts(rows, items), "id", "left") if id_col == "doc_id" else rows.withColumn("known", F.lit(None).cast("array<string>"))
        return rows.mapInPandas(cut, "t int, bucket bigint, id bigint, w array<bigint>").withColumnsRenamed({"id": id_col, "w": f"{id_col}_w"})

    @F.pandas_udf("int")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(edit_distances(np.stack(a), np.stack(b)) if len(a) else [], dtype="int32")

    pairs = side(docs, "doc_id").join(side(items, "item_id"), ["t", "bucket"]).dropDuplicates(["doc_id", "item_id", "doc_id_w", "item_id_w"])
    same = F.col("doc_id_w") == F.col("item_id_w")
    exact = pairs.where(same).select("doc_id", "item_id", F.lit(0).alias("edits"))
    if not cgk.edits:
        return exact
    near = pairs.where(~same).select("doc_id", "item_id", distance("doc_id_w", "item_id_w").alias("edits")).where(F.col("edits") <= cgk.edits)
    return exact.unionByName(near)
