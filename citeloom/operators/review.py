"""Selection and review of citations."""

from __future__ import annotations

import json
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions.evidence_text import evaluated
from citeloom.functions.numbers import expand_numbers

#: Words by which authors speak of their own work.
SELF_REFERENCE = r"(?i)\b(?:our (?:lab|group|team|previous|earlier|own)|our|we|in our hands)\b"
TITLE_MATCH = 0.85
TITLES_A_CELL = 4000
BIGRAM_BINS = 1024


def speaks_of_itself(text: Column) -> Column:
    return F.coalesce(text.rlike(SELF_REFERENCE), F.lit(False))


def bare_title(title: Column) -> Column:
    """Letters, digits and single spaces of a title."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9 ]+", ""))


def _bigrams(titles: list[str]) -> np.ndarray:
    """(n, bins) counts of numbered bigrams (the second ``on`` of a title is another than its first), hashed to bins."""
    out = np.zeros((len(titles), BIGRAM_BINS), np.float32)
    for row, t in zip(out, titles):
        seen: dict[str, int] = {}
        for k in range(len(t) - 1):
            g = t[k : k + 2]
            seen[g] = seen.get(g, 0) + 1
            row[hash((g, seen[g])) % BIGRAM_BINS] += 1
    return out


def _letter_counts(titles: list[str], letters: dict[str, int]) -> np.ndarray:
    """(n, letters) how often each letter occurs."""
    out = np.zeros((len(titles), len(letters)), np.int16)
    for row, t in zip(out, titles):
        row[:] = np.bincount([letters[c] for c in t], minlength=len(letters))
    return out


def common_letters(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many letters rows a[left[k]] and b[right[k]] of `_letter_counts` have in common in any order: no common subsequence is longer."""
    return np.minimum(a[left], b[right]).sum(1, dtype=np.int64)


def common_lengths(xs: list[str], ys: list[str], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of xs[left[k]] and ys[right[k]], bit-parallel, all pairs at once."""
    letters = {c: n for n, c in enumerate(sorted({c for y in ys for c in y}))}
    words = max(1, -(-max(map(len, xs), default=0) // 64))
    masks = np.zeros((len(xs), len(letters) + 1, words), np.uint64)
    for row, x in zip(masks, xs):
        for k, c in enumerate(x):
            if c in letters:
                row[letters[c], k // 64] |= np.uint64(1 << k % 64)
    codes = np.full((len(ys), max(map(len, ys), default=0)), len(letters))
    for row, y in zip(codes, ys):
        row[: len(y)] = [letters[c] for c in y]
    open_bits = [np.full(len(left), 2**64 - 1, np.uint64) for _ in range(words)]
    for k in range(codes.shape[1]):
        found = masks[left, codes[right, k]]
        carry = np.zeros(len(left), np.uint64)
        for w in range(words):
            v = open_bits[w]
            hit = v & found[:, w]
            part = v + hit
            total = part + carry
            carry = ((part < v) | (total < part)).astype(np.uint64)
            open_bits[w] = total | (v & ~found[:, w])
    return sum(np.bitwise_count(~v).astype(np.int64) for v in open_bits)


def like_titles(xs: list[str], ys: list[str], least: float) -> list[tuple[int, int, float]]:
    """(i, j, ratio) of all bare titles with a ratio of ``least`` or more by matching blocks.

    Matching blocks are a common subsequence, so a ratio allows for (1 - ratio) of both lengths in lost and added
    letters. Each changes at most three bigrams. Pairs that share too few bigrams, letters in any order or letters in order are
    left out before the ratio is taken; this loses nothing."""
    out: list[tuple[int, int, float]] = []
    n, m = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    a, b = _bigrams(xs), _bigrams(ys)
    letters = {c: k for k, c in enumerate(sorted({c for t in (*xs, *ys) for c in t}))}
    counts_a, counts_b = _letter_counts(xs, letters), _letter_counts(ys, letters)
    for at in range(0, len(xs), 256):
        both = n[at : at + 256, None] + m[None]
        edits = np.floor((1 - least) * both + 1e-9)
        near = np.abs(n[at : at + 256, None] - m[None]) <= edits
        near &= a[at : at + 256] @ b.T >= (both - 2 - 3 * edits) / 2
        left, right = np.nonzero(near)
        for some in range(0, len(left), 50_000):
            i, j = left[some : some + 50_000], right[some : some + 50_000]
            mixed = both[i, j] - 2 * common_letters(counts_a[at : at + 256], counts_b, i, j) <= edits[i, j]
            i, j = i[mixed], j[mixed]
            kept = both[i, j] - 2 * common_lengths(xs[at : at + 256], ys, i, j) <= edits[i, j]
            ratios = ((int(p) + at, int(q), SequenceMatcher(None, xs[p + at], ys[q]).ratio()) for p, q in zip(i[kept], j[kept]))
            out += [r for r in ratios if r[2] >= least]
    return out


def fuzzy_title_matches(left: DataFrame, right: DataFrame, least: float = TITLE_MATCH) -> DataFrame:
    """(left_id, right_id, ratio) of rows (id, title, year) with like titles and years at most one apart; a year of 0 fits any.

    All titles whose years fit are compared, each distinct one once. A title without a letter or digit matches nothing."""

    def named(df: DataFrame, name: str) -> DataFrame:
        rows = df.select(F.col("id").alias(f"{name}_id"), bare_title(F.col("title")).alias(f"{name}_title"), F.coalesce("year", F.lit(0)).cast("int").alias(f"{name}_year"))
        return rows.where(F.col(f"{name}_title") != "")

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        y = F.col(f"{name}_year")
        text = lambda *ys: F.array(*[v.cast("string") for v in ys])
        if name == "left":
            when = F.when(y == 0, F.array(F.lit("any"))).otherwise(F.concat(F.filter(text(y - 1, y, y + 1), lambda v: v != "0"), F.array(F.lit("none"))))
        else:
            when = F.concat(F.when(y == 0, F.array(F.lit("none"))).otherwise(text(y)), F.array(F.lit("any")))
        return rows.select(f"{name}_title", f"{name}_year").distinct().withColumn("key", F.explode(when))

    def cells(cols: tuple[str, str], rows: DataFrame, own: str, other: str) -> DataFrame:
        mine = F.pmod(F.xxhash64(*cols), F.col(own)).cast("int").alias(own)
        return rows.join(sizes, "key").select(*cols, "key", mine, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other))

    def compared(xs: pd.DataFrame, ys: pd.DataFrame) -> pd.DataFrame:
        got = like_titles(list(xs["left_title"]), list(ys["right_title"]), least) if len(xs) and len(ys) else []
        i, j = [g[0] for g in got], [g[1] for g in got]
        pairs = pd.concat([xs[["left_title", "left_year"]].iloc[i].reset_index(drop=True), ys[["right_title", "right_year"]].iloc[j].reset_index(drop=True)], axis=1)
        return pairs.assign(ratio=np.array([g[2] for g in got], dtype="float64"))

    lefts, rights = named(left, "left"), named(right, "right")
    l_keys, r_keys = keyed(lefts, "left"), keyed(rights, "right")
    parts = lambda df, name: df.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TITLES_A_CELL).cast("int").alias(name))
    # crowded years are split on both sides; a part of one and a part of the other meet in one cell
    sizes = parts(l_keys, "i").join(parts(r_keys, "j"), "key")
    met = cells(("left_title", "left_year"), l_keys, "i", "j").groupBy("key", "i", "j").cogroup(cells(("right_title", "right_year"), r_keys, "j", "i").groupBy("key", "i", "j"))
    pairs = met.applyInPandas(compared, "left_title string, left_year int, right_title string, right_year int, ratio double")
    return pairs.join(lefts, ["left_title", "left_year"]).join(rights, ["right_title", "right_year"]).select("left_id", "right_id", "ratio")


def keyword_ranking(rows: DataFrame, keywords: list[str], text: Column, least: int = 2) -> DataFrame:
    """Rows with at least ``least`` of the keywords in ``text``, with their share in per cent and the keywords found."""
    found = F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(F.lower(text), k))
    scored = rows.withColumn("found", found).where(F.size("found") >= least)
    return scored.withColumn("score", F.round(F.size("found") * 100.0 / max(len(keywords), 1), 6))


def recent_then_ranked(rows: DataFrame, day: str, since: Column, most: int, keywords: list[str], text: Column) -> DataFrame:
    """The newest rows of a window, ranked after they were cut: a better but older row is not seen."""
    cut = rows.where(F.col(day) >= since).orderBy(F.desc(day), "row_id").limit(most)
    return keyword_ranking(cut, keywords, text)


def adjacent_clusters(fields: DataFrame) -> DataFrame:
    """Fields (doc_id, ord, start, end) with the number of the run of fields that touch each other."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    fresh = F.when(F.lag("end").over(w) == F.col("start"), 0).otherwise(1)
    return fields.withColumn("_new", fresh).withColumn("cluster", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def next_unresolved(rows: DataFrame) -> DataFrame:
    """For each row (doc_id, pos, resolved) the next unresolved position, else the document's first one."""
    ahead = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    open_pos = F.when(~F.col("resolved"), F.col("pos"))
    first = rows.groupBy("doc_id").agg(F.min(open_pos).alias("_first"))
    return rows.withColumn("_next", F.min(open_pos).over(ahead)).join(first, "doc_id").select("doc_id", "pos", "resolved", F.coalesce("_next", "_first").alias("next_pos"))


def adoptable(numbers: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc_id, adopt): documents in which every citation group is well-formed and every number is an entry.

    ``numbers`` has doc_id and the group's text, ``entries`` doc_id and number. All or nothing."""
    strict = expand_numbers(F.col("text"))
    lenient = expand_numbers(F.col("text"), True)
    groups = numbers.select("doc_id", (strict == lenient).alias("well"), F.explode_outer(strict).alias("number"))
    known = entries.select("doc_id", "number", F.lit(True).alias("known")).distinct()
    joined = groups.join(known, ["doc_id", "number"], "left")
    return joined.groupBy("doc_id").agg(F.every(F.col("well") & F.coalesce("known", F.lit(False))).alias("adopt"))


def to_author_date(text: Column, labels: Column, delimiter: str = "; ") -> Column:
    """A bracket group with labels (a map by number) in place of numbers, each once; ``ref n`` where one is missing."""
    return F.array_join(F.array_distinct(F.transform(expand_numbers(text), lambda n: F.coalesce(F.element_at(labels, n), F.concat(F.lit("ref "), n.cast("string"))))), delimiter)


def enriched(entries: DataFrame, found: DataFrame) -> DataFrame:
    """Entries (entry_id, pmid, doi, title, year, journal) with what was found: identifiers filled, the rest replaced (K8)."""
    e, f = entries.alias("e"), found.alias("f")
    both = e.join(f, F.col("e.entry_id") == F.col("f.entry_id"), "left")
    fill = lambda c: F.coalesce(F.nullif(f"e.{c}", F.lit("")), f"f.{c}", F.lit("")).alias(c)
    swap = lambda c, none: F.coalesce(F.nullif(f"f.{c}", F.lit(none)), f"e.{c}").alias(c)
    return both.select("e.entry_id", fill("pmid"), fill("doi"), swap("title", ""), swap("year", 0), swap("journal", ""), F.col("f.entry_id").isNotNull().alias("enriched"))


def rebuilt_selection(slots: Column, accepted: Column) -> Column:
    """The selection of a review as one list, slot by slot, without what was rejected (K7)."""
    return F.flatten(F.transform(slots, lambda s: F.filter(s, lambda k: F.array_contains(accepted, k))))


def known_answers(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Answers (sent_id, pos, key) with their candidate; unknown keys are dropped."""
    by_key = candidates.groupBy("sent_id", "key").agg(F.min("cand_id").alias("cand_id"))
    return answers.join(by_key, ["sent_id", "key"]).select("sent_id", "pos", "cand_id")


def assign_without_repeats(picks: DataFrame) -> DataFrame:
    """(sent_id, marker, cand_id): each marker in order takes its best candidate that no earlier marker took.

    ``picks`` has sent_id, marker, rank, cand_id. A sentence's picks are few; they are folded inside one row."""
    grouped = picks.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("marker", "rank", "cand_id"))).alias("ps"))
    kind = "array<struct<marker:int,cand_id:bigint>>"
    fold = F.aggregate(
        "ps",
        F.array().cast(kind),
        lambda taken, p: F.when(F.exists(taken, lambda t: (t["marker"] == p["marker"]) | (t["cand_id"] == p["cand_id"])), taken).otherwise(F.concat(taken, F.array(F.struct(p["marker"].cast("int").alias("marker"), p["cand_id"].cast("bigint").alias("cand_id"))))),
    )
    return grouped.select("sent_id", F.inline(fold))


def truncated_item(item: Column, authors: Column, max_bytes: int = 16_384, most: int = 30) -> Column:
    """(authors, truncated): a large item keeps its first authors only."""
    large = (F.octet_length(item) > max_bytes) & (F.size(authors) > most)
    return F.struct(F.when(large, F.slice(authors, 1, most)).otherwise(authors).alias("authors"), large.alias("truncated"))


def lenient_json(text: str | None) -> str | None:
    """The first JSON object in an answer: alone, in a fenced block, or the first balanced braces outside strings."""
    if not text:
        return None
    decoder = json.JSONDecoder()
    for at, c in enumerate(text):
        if c == "{":
            try:
                value, _ = decoder.raw_decode(text, at)
                return json.dumps(value)
            except ValueError:
                continue
    return None


def lenient_json_column(text: Column) -> Column:
    @F.pandas_udf("string")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lenient_json)

    return F.coalesce(F.when(F.try_parse_json(text).isNotNull() & F.btrim(text).startswith("{"), text), found(text))


def claim_message(claim: Column, sub_claim: Column, section: Column, preceding: Column, following: Column, n_refs: Column) -> Column:
    """The text by which a claim is asked about, with its context."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    many = F.array_join(F.transform(preceding, lambda s: quoted(s)), " ")
    return F.concat_ws(
        "\n", F.concat(F.lit("CLAIM: "), n_refs.cast("string"), F.when(n_refs == 1, " reference").otherwise(" references")), quoted(claim), F.when(F.coalesce(sub_claim, F.lit("")) != "", F.concat(F.lit("Part: "), quoted(sub_claim))),
        line("Section: ", section), line("Preceding: ", many), line("Following: ", F.array_join(F.transform(following, lambda s: quoted(s)), " ")),
    )


def review_filters(level: Column, resolved: Column, warnings: Column, kind: Column) -> Column:
    """Which views of a review show a citation (B7): of low confidence, unresolved, with warnings, suggested by the author."""
    shown = F.array(F.when(level == "LOW", "low"), F.when(~F.coalesce(resolved, F.lit(False)), "unresolved"), F.when(F.size(warnings) > 0, "warnings"), F.when(kind == "SUGGESTED", "suggested"))
    return F.array_compact(shown)
