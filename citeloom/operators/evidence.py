"""Evidence of citations: verdicts, merges, slots, quality checks, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions.evidence_text import PASSAGE_CHARS, normalised, passage_places

CONFIDENCE = ("LOW", "MEDIUM", "HIGH")


def backed_verdict(verdict: Column, quote_found: Column) -> Column:
    """Unknown answers are unverified; support without a found quote is partial."""
    v = F.lower(F.coalesce(verdict, F.lit("")))
    return F.when((v == "supports") & ~F.coalesce(quote_found, F.lit(False)), "partial").when(v.isin("supports", "partial", "not_supported"), v).otherwise("unverified")


def fold_verdicts(verdicts: Column, retracted: Column, level: Column, score: Column) -> Column:
    """Level, score, status and warnings from an array of (verdict, has_quote, quote_found)."""
    failing = F.exists(verdicts, lambda v: v["verdict"] == "not_supported")
    invented = F.exists(verdicts, lambda v: v["has_quote"] & ~v["quote_found"])
    known = F.filter(verdicts, lambda v: v["verdict"] != "unverified")
    bad = failing | invented | retracted
    good = (F.size(known) > 0) & F.forall(known, lambda v: v["verdict"] == "supports")
    some = F.size(known) > 0
    by = lambda a, b, c, d: F.when(bad, a).when(good, b).when(some, c).otherwise(d)
    none = F.size(verdicts) <= 0
    warnings = F.array_compact(F.array(F.when(failing, "not_supported"), F.when(F.exists(verdicts, lambda v: v["has_quote"] & ~v["quote_found"] & (v["verdict"] != "not_supported")), "quote_not_found"), F.when(F.exists(verdicts, lambda v: v["verdict"] == "unverified"), "unverified")))
    return F.struct(
        F.when(none, level).otherwise(by(F.lit("LOW"), F.lit("HIGH"), F.lit("MEDIUM"), level)).alias("level"),
        F.when(none, score).otherwise(by(F.least(score, F.lit(39.0)), F.greatest(score, F.lit(80.0)), F.least(F.greatest(score, F.lit(40.0)), F.lit(69.0)), score)).alias("score"),
        F.when(none, "not_checked").otherwise(by(F.lit("mismatch"), F.lit("verified"), F.lit("partial"), F.lit("not_checked"))).alias("status"),
        F.when(none, F.array().cast("array<string>")).otherwise(warnings).alias("warnings"),
    )


def merge_marker_evidence(markers: DataFrame, keys: list[str]) -> DataFrame:
    """One row per sentence from its markers (level, score, scored): the least level over all, the mean score over scored ones."""
    order = F.array_position(F.array(*[F.lit(c) for c in CONFIDENCE]), F.col("level"))
    merged = markers.groupBy(*keys).agg(F.min(order).alias("_o"), F.avg(F.when(F.col("scored"), F.col("score"))).alias("score"), F.count(F.lit(1)).alias("n_markers"))
    return merged.select(*keys, F.element_at(F.array(*[F.lit(c) for c in CONFIDENCE]), F.greatest("_o", F.lit(1)).cast("int")).alias("level"), "score", "n_markers")


def overused(selections: DataFrame, key: str, least: int = 3) -> DataFrame:
    """Works in at least ``least`` selections, with their number; a sentence that selects one twice counts twice."""
    return selections.where(F.col(key) != "").groupBy(key).agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") >= least)


def author_concentration(selections: DataFrame, group: str, author: str, share: float = 0.4, least: int = 5) -> DataFrame:
    """First authors with at least ``share`` of a group's selections that have authors, in groups of ``least`` and more (D3)."""
    counts = selections.where(F.col(author).isNotNull()).groupBy(group, author).agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy(group).agg(F.sum("n").alias("total"))
    return counts.join(total, group).where((F.col("total") >= least) & (F.col("n") / F.col("total") >= share))


def is_preprint(source: Column, types: Column, doi: Column) -> Column:
    kinds = F.coalesce(F.exists(types, lambda t: F.lower(t) == "preprint"), F.lit(False))
    return (F.coalesce(source, F.lit("")) == "biorxiv") | kinds | F.coalesce(F.lower(doi).startswith("10.1101/"), F.lit(False))


def is_valid(title: Column, pmid: Column, doi: Column) -> Column:
    """Whether a citation names a work at all."""
    return F.coalesce(title != "", F.lit(False)) | F.coalesce(pmid != "", F.lit(False)) | F.coalesce(doi != "", F.lit(False))


def is_complete(*fields: Column) -> Column:
    """Whether all fields that a style prints are there."""
    return F.forall(F.array(*[F.coalesce(f.cast("string"), F.lit("")) for f in fields]), lambda v: ~v.isin("", "0"))


def slot_ranges(n_selected: Column, sizes: Column, n_slots: Column) -> Column:
    """Which selections belong to which slot, as (first, end) from 0 (K6).

    Given sizes count if they fit; else one slot owns all, or each slot one and the last filled one the surplus."""
    span = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("end"))
    fits = F.coalesce((F.size(sizes) == n_slots) & (F.aggregate(sizes, F.lit(0), lambda a, x: a + x) == n_selected), F.lit(False))
    given = F.transform(F.sequence(F.lit(1), F.greatest(n_slots, F.lit(1))), lambda i: span(F.aggregate(F.slice(sizes, 1, i - 1), F.lit(0), lambda a, x: a + x), F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x)))
    each = F.transform(F.sequence(F.lit(0), F.greatest(n_slots, F.lit(1)) - 1), lambda i: span(F.least(i, n_selected), F.when(i == F.least(n_slots, n_selected) - 1, n_selected).otherwise(F.least(i + 1, n_selected))))
    return F.when(n_slots <= 0, F.array().cast("array<struct<first:int,end:int>>")).when(fits, given).otherwise(each)


def guard_reasons(failed: Column, newer: Column, damaged: Column, foreign: Column, tracked_changes: Column, n_entries: Column, n_matched: Column, min_ratio: float = 0.5) -> Column:
    """Why a document must not be exported; the first two reasons stand alone."""
    ratio = n_matched / F.greatest(n_entries, F.lit(1))
    rest = F.array_compact(
        F.array(F.when(damaged > 0, "damaged"), F.when(foreign > 0, "foreign"), F.when((n_entries > 0) & (ratio < min_ratio), "few_matches"), F.when(tracked_changes > 0, "tracked_changes"))
    )
    return F.when(failed, F.array(F.lit("analysis_failed"))).when(newer, F.array(F.lit("newer_version"))).otherwise(rest)


def looks_stripped(stored: Column, found: Column) -> Column:
    """Whether at least half of the stored entry hashes are still in a document without fields; repeats count."""
    return (F.size(stored) > 0) & (F.size(F.filter(stored, lambda h: F.array_contains(found, h))) * 2 >= F.size(stored))


def swap_preprints(selected: DataFrame, published: DataFrame) -> DataFrame:
    """Selections (sel_id, doi, is_preprint) with the journal version (preprint_doi, published_doi) in place of a preprint."""
    versions = published.where("published_doi <> ''").groupBy("preprint_doi").agg(F.min("published_doi").alias("published_doi"))
    joined = selected.join(versions, (F.col("doi") == F.col("preprint_doi")) & F.col("is_preprint"), "left")
    return joined.select("sel_id", F.coalesce("published_doi", "doi").alias("doi"), F.col("published_doi").isNotNull().alias("swapped"), (F.col("is_preprint") & F.col("published_doi").isNull()).alias("warned"))


def document_mode(failed: Column, newer: Column, foreign: Column, tracked: Column, stripped: Column, legacy: Column) -> Column:
    """The first that holds."""
    return F.when(failed, "analysis_failed").when(newer, "newer_version").when(foreign, "foreign").when(tracked, "tracked").when(stripped, "stripped").when(legacy, "legacy").otherwise("fresh")


def quoted(quotes: DataFrame, quote_id: str, texts: DataFrame, text_id: str, size: int = 8, least: float = 0.8) -> DataFrame:
    """(text_id, quote_id, share, occurs): the share of each quote's windows of ``size`` words that stand in a text.

    A shorter quote is one window, so all of it must stand there. Windows are compared as 64-bit hashes of their words, and
    a text's window counts once. Quotes and texts without a word give no row."""
    words = lambda df, key: df.select(key, F.split(normalised(F.col("text")), " ").alias("w")).where("w[0] <> ''")
    cut = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.xxhash64(F.slice("w", i, n)))
    q = words(quotes, quote_id).withColumn("size", F.least(F.size("w"), F.lit(size)))
    q = q.withColumn("n", F.size("w") - F.col("size") + 1).select(quote_id, "size", "n", F.explode(cut(F.col("size"))).alias("s"))
    # at most ``size`` different lengths of windows
    sizes = [r.size for r in q.select("size").distinct().collect()]
    none = F.array().cast("array<struct<size:int,s:bigint>>")
    sized = lambda n: lambda s: F.struct(F.lit(n).alias("size"), s.alias("s"))
    windows = [F.when(F.size("w") >= n, F.transform(F.array_distinct(cut(F.lit(n))), sized(n))).otherwise(none) for n in sizes]
    t = words(texts, text_id).select(text_id, F.inline(F.concat(*windows) if windows else none))
    hits = q.join(t, ["size", "s"]).groupBy(text_id, quote_id, "n").agg(F.count(F.lit(1)).alias("hits"))
    share = F.col("hits") / F.col("n")
    return hits.select(text_id, quote_id, F.round(share, 6).alias("share"), (share >= least).alias("occurs"))


def chosen_passages(scored: DataFrame, key: str, idx: str) -> DataFrame:
    """(key, idx, section, score, text): the best passages of each document within the budget, cut where they are long.

    ``scored`` has key, idx, section, text and score. Only places, scores and lengths of a document's passages come together;
    texts join the few that are chosen."""
    text = F.when(F.length("text") > PASSAGE_CHARS, F.concat(F.rtrim(F.substring("text", 1, PASSAGE_CHARS)), F.lit("…"))).otherwise(F.rtrim("text"))
    cut = scored.select(key, idx, "section", "score", text.alias("text"))
    lengths = cut.groupBy(key).agg(F.collect_list(F.struct(F.col("score").cast("int").alias("score"), F.col(idx).alias("idx"), F.length("text").alias("n"))).alias("p"))
    picked = lengths.select(key, F.explode(passage_places(F.col("p"))).alias(idx))
    return picked.join(cut, [key, idx]).select(key, F.col(idx).alias("idx"), "section", F.col("score").cast("int").alias("score"), "text")
