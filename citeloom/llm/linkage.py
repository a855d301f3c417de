"""Matching entities across sources without keys (problem 6): probabilistic record linkage.

Bibliography entries and candidate works meet in several blocking passes; every pair is compared on partial, noisy
attributes at a few agreement levels; expectation-maximisation over the counts of comparison patterns estimates the
match and non-match probabilities of each level; the posterior is the pair's confidence. All but the few hundred
pattern counts stays in the JVM and in DataFrames.

Entries with equal text are linked once and expanded at the end, so copies neither skew a block nor multiply pairs.
A block with more than ``CROWDED`` entries is dealt out in hashed parts, each of which meets all of its candidates.

An entry without raw text is read from its parsed fields; one without any text matches nothing. Missing attributes of
a candidate are a level of their own. Of an entry's matches only those of its best work are kept, in whichever
databases they stand. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import cut_lineage

CROWDED = 2_000

#: Letters with diacritics and their plain letters.
_ACCENTS = "àáâãäåāăąçćčďèéêëēėęěğģìíîïīįıķłļñńňņòóôõöøōőřśşšťţùúûüūůűųýÿźżž"
_PLAIN = "aaaaaaaaacccdeeeeeeeegg" + "iiiiiii" + "kll" + "nnnn" + "oooooooo" + "r" + "sss" + "tt" + "uuuuuuuu" + "yy" + "zzz"

#: Agreement levels per attribute, from disagreement upwards.
LEVELS = {"title": 5, "gene": 3, "author": 3, "year": 4, "place": 5, "part": 3, "journal": 3}


def folded(text: Column) -> Column:
    """Lower case without diacritics; '' for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.translate(F.replace(F.replace(low, F.lit("ß"), F.lit("ss")), F.lit("æ"), F.lit("ae")), _ACCENTS, _PLAIN)


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda t: t != "")


def hashes(words: Column) -> Column:
    """Each word as 64 bits, which is shorter to send and faster to compare."""
    return F.transform(words, lambda w: F.xxhash64(w))


def squeezed(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")


def joined_symbols(text: Column) -> Column:
    """Symbols of letters and a number, also where a space or hyphen stands between: ``abc 12`` as ``abc12``."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b([a-z]{3,6}[\s\-‐]?\d{1,2})\b"), F.lit(1)), lambda t: F.regexp_replace(t, r"[\s\-‐]", ""))


def part_of_work(text: Column) -> Column:
    """Whether a title names a reply, a comment, a correction or a further part of a work; '' for the work itself."""
    return (
        F.when(text.rlike(r"\b(?:a|author'?s?|in) reply\b|\breply to\b"), "reply")
        .when(text.rlike(r"\bcomments? (?:on|to)\b|\bcommentary\b"), "comment")
        .when(text.rlike(r"\b(?:erratum|corrigendum|correction|retraction)\b"), "correction")
        .when(text.rlike(r"\bpart (?:ii|2|two)\b"), "part2")
        .when(text.rlike(r"\bpart (?:iii|3|three)\b"), "part3")
        .otherwise("")
    )


def first_author(low: Column) -> Column:
    """The author that an entry begins with, behind its number: up to the first punctuation or digit after a word of
    three letters, or of two if there is none, so that initials and "St." may stand before."""
    cut = lambda n: F.regexp_extract(low, rf"^\P{{L}}*([^\d,;:(\[]*?\p{{L}}{{{n},}}[^\d,;:.(\[]*)", 1)
    return F.coalesce(*(F.nullif(cut(n), F.lit("")) for n in (3, 2, 1)), F.lit(""))


def prepared_entries(entries: DataFrame) -> DataFrame:
    """One row per distinct entry text, with what pairs are compared on."""
    parsed = F.concat_ws(" ", "authors_str", "title", "journal", F.col("year").cast("string"))
    text = F.coalesce(F.when(F.btrim("raw_text") != "", F.col("raw_text")), F.when(F.btrim(parsed) != "", parsed))
    rows = entries.select(F.col("entry_id"), text.alias("text")).where("text is not null")
    return rows


def _entry_features(texts: DataFrame) -> DataFrame:
    low = folded(F.col("text"))
    e = texts.select("text_key", "text", low.alias("low"))
    e = e.withColumns({"e_tokens": tokens(F.col("low")), "numbers": F.regexp_extract_all("low", F.lit(r"(?<![a-z0-9])(\d{1,5})(?![a-z0-9])"), F.lit(1)), "symbols": joined_symbols(F.col("low"))})
    e = e.withColumns(
        {
            "years": F.array_distinct(F.transform(F.filter("numbers", lambda n: n.rlike(r"^(?:1[89]|20)\d\d$")), lambda n: n.cast("int"))),
            "lead": F.filter(tokens(first_author(F.col("low"))), lambda t: F.length(t) > 1),
            "e_head": squeezed(first_author(F.col("low"))),
            "e_part": part_of_work(F.col("low")),
        }
    )
    e = e.withColumns({"text_id": F.monotonically_increasing_id(), "e_words": hashes(F.concat("e_tokens", "symbols")), "e_keys": _entry_keys()})
    return e.drop("low", "text")


def _candidate_features(candidates: DataFrame) -> DataFrame:
    title, first = folded(F.col("title")), folded(F.try_element_at("authors.last_name", F.lit(1)))
    second = folded(F.try_element_at("authors.last_name", F.lit(2)))
    c = candidates.select(
        "cand_id",
        title.alias("c_title"),
        first.alias("first"),
        second.alias("second"),
        F.when(F.col("year") > 0, F.col("year")).alias("c_year"),
        F.when(F.btrim("volume") != "", F.btrim("volume")).alias("volume"),
        F.nullif(F.regexp_extract(F.coalesce("pages", F.lit("")), r"^\s*(\d+)", 1), F.lit("")).alias("page"),
        F.filter(tokens(folded(F.col("journal"))), lambda t: ~t.isin("of", "in", "the", "and", "for")).alias("c_journal"),
    )
    longest = lambda name: F.array_max(F.transform(tokens(F.col(name)), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    return c.withColumns(
        {
            "c_part": part_of_work(F.col("c_title")),
            "c_words": hashes(F.array_distinct(F.filter(tokens(F.regexp_replace("c_title", r"^comments? on:?\s*|:\s*a reply\W*$|,\s*part (?:ii+|[23])\W*$", "")), lambda t: F.length(t) > 1))),
            "c_symbols": F.array_distinct(joined_symbols(F.col("c_title"))),
            "surname": squeezed(F.col("first")),
            # the first two authors are at times in another order
            "stems": F.array_distinct(F.array_compact(F.array(longest("first"), longest("second")))),
            "work": F.xxhash64(squeezed(F.col("c_title"))),
        }
    )


def _entry_keys() -> Column:
    """Blocking keys of entries: place in a journal and year, symbol and first author, year and first author."""
    years = F.transform("years", lambda y: y.cast("string"))
    plain = F.filter("numbers", lambda n: ~n.rlike(r"^(?:1[89]|20)\d\d$") | (F.size("numbers") > 3))
    pairs = F.array_distinct(F.flatten(F.transform(plain, lambda a, i: F.transform(F.slice(plain, i + 2, 3), lambda b: F.concat_ws("|", a, b)))))
    place = F.flatten(F.transform(pairs, lambda p: F.transform(years, lambda y: F.concat_ws("|", F.lit("P"), p, y))))
    start = F.flatten(F.transform("symbols", lambda g: F.transform("lead", lambda h: F.concat_ws("|", F.lit("G"), g, F.substring(h, 1, 4)))))
    end = F.flatten(F.transform("symbols", lambda g: F.transform("lead", lambda h: F.concat_ws("|", F.lit("H"), g, F.right(h, F.lit(4))))))
    year = F.flatten(F.transform("lead", lambda h: F.transform(years, lambda y: F.concat_ws("|", F.lit("Y"), y, h))))
    undated = F.concat(F.transform(pairs, lambda p: F.concat_ws("|", F.lit("Q"), p)), F.transform("lead", lambda h: F.concat_ws("|", F.lit("Z"), h)))
    return F.array_distinct(hashes(F.concat(place, start, end, year, undated)))


def _candidate_keys(c: DataFrame) -> DataFrame:
    """The blocking keys of candidates as 64-bit hashes, one per row, like those of entries; two keys with one hash only add pairs."""
    # the year may be off by one; the candidate, which has one year, takes the three keys
    near = F.transform(F.array(*[F.col("c_year") + i for i in (-1, 0, 1)]), lambda y: y.cast("string"))
    place = F.when(F.col("volume").isNotNull() & F.col("page").isNotNull() & F.col("c_year").isNotNull(), F.transform(near, lambda y: F.concat_ws("|", F.lit("P"), "volume", "page", y)))
    by_stem = lambda key: F.flatten(F.transform("stems", key))
    start = by_stem(lambda a: F.transform("c_symbols", lambda g: F.concat_ws("|", F.lit("G"), g, F.substring(a, 1, 4))))
    end = by_stem(lambda a: F.transform("c_symbols", lambda g: F.concat_ws("|", F.lit("H"), g, F.right(a, F.lit(4)))))
    year = F.when(F.col("c_year").isNotNull(), by_stem(lambda a: F.transform(near, lambda y: F.concat_ws("|", F.lit("Y"), y, a))))
    # works without a year, a small share, also meet by place alone and by first author alone
    alone = F.concat(F.array(F.concat_ws("|", F.lit("Q"), F.coalesce("volume", F.lit("?")), F.coalesce("page", F.lit("?")))), F.transform("stems", lambda a: F.concat_ws("|", F.lit("Z"), a)))
    undated = F.when(F.col("c_year").isNull(), alone)
    none = F.array().cast("array<string>")
    keys = F.concat(*(F.coalesce(k, none) for k in (place, start, end, year, undated)))
    return c.select("cand_id", F.explode(F.array_distinct(hashes(keys))).alias("key"))


def _blocked(entry_keys: DataFrame, cand_keys: DataFrame) -> DataFrame:
    """(text_id, cand_id) of all that share a key."""
    crowded = cut_lineage(entry_keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWDED))
    if not crowded.isEmpty():
        parts = crowded.select("key", F.ceil(F.col("n") / CROWDED).cast("int").alias("parts"))
        sized = lambda side: side.join(parts, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        entry_keys = sized(entry_keys).select("text_id", F.xxhash64("key", F.pmod(F.xxhash64("text_id"), "parts")).alias("key"))
        every = F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)
        cand_keys = sized(cand_keys).select("cand_id", "key", F.explode(every).alias("part")).select("cand_id", F.xxhash64("key", "part").alias("key"))
    return entry_keys.join(cand_keys, "key").select("text_id", "cand_id").distinct()


def _levels() -> dict[str, Column]:
    """The agreement level of each attribute of a pair."""
    share = F.size(F.array_intersect("c_words", "e_words")) / F.greatest(F.size("c_words"), F.lit(1))
    title = F.when(share >= 0.95, 4).when(share >= 0.75, 3).when(share >= 0.5, 2).when(share >= 0.3, 1).otherwise(0)
    alike = lambda g, s: (F.regexp_extract(g, r"(\d+)$", 1) == F.regexp_extract(s, r"(\d+)$", 1)) & (F.levenshtein(g, s) <= 2)
    held = F.size(F.filter("c_symbols", lambda g: F.exists("symbols", lambda s: alike(g, s))))
    gene = F.when(F.size("c_symbols") == 0, 1).when(held == F.size("c_symbols"), 2).otherwise(0)
    near_name = F.exists("stems", lambda a: F.exists("lead", lambda t: F.levenshtein(t, a) <= F.when(F.length(a) > 6, 2).otherwise(1)))
    author = F.when(F.length("surname") == 0, 0).when(F.contains(F.col("e_head"), F.col("surname")), 2).when(near_name, 1).otherwise(0)
    year = (
        F.when(F.col("c_year").isNull() | (F.size("years") == 0), 1)
        .when(F.array_contains("years", F.col("c_year")), 3)
        .when(F.exists("years", lambda y: F.abs(y - F.col("c_year")) == 1), 2)
        .otherwise(0)
    )
    volume, page = F.array_contains("numbers", F.col("volume")), F.array_contains("numbers", F.col("page"))
    # an entry whose numbers are at most its own and a year says nothing of its place
    silent = F.size(F.filter("numbers", lambda n: ~n.rlike(r"^(?:1[89]|20)\d\d$"))) < 2
    place = F.when(silent, 2).when(volume & page, 4).when(volume & F.col("page").isNull(), 3).when(F.col("page").isNull(), 2).when(volume, 1).otherwise(0)
    part = F.when(F.col("c_part") == F.col("e_part"), 2).when(F.col("e_part") == "", 1).otherwise(0)
    known = lambda w: F.exists("e_tokens", lambda t: (F.length(t) >= 1) & F.startswith(w, t) & ((F.length(t) >= 3) | (F.length(w) == F.length(t)) | (t == "j")))
    seen = F.size(F.filter("c_journal", known)) / F.greatest(F.size("c_journal"), F.lit(1))
    journal = F.when(F.size("c_journal") == 0, 1).when(seen >= 0.75, 2).otherwise(0)
    return {"title": title, "gene": gene, "author": author, "year": year, "place": place, "part": part, "journal": journal}


def _contradiction() -> Column:
    """What rules a pair out whatever else agrees: another part of the work, another first page, another symbol number.

    A shortened title may lack its part or symbol; then only volume and first page together can tell."""
    numbered = lambda g, s: (F.regexp_extract(g, r"^(\D+)", 1) == F.regexp_extract(s, r"^(\D+)", 1)) & (g != s)
    lacks = F.size(F.array_intersect("c_symbols", "symbols")) < F.size("c_symbols")
    other = lacks & F.exists("c_symbols", lambda g: ~F.array_contains("symbols", g) & F.exists("symbols", lambda s: numbered(g, s)))
    part = F.when(F.col("e_part") != "", F.col("c_part") != F.col("e_part")).otherwise((F.col("c_part") != "") & (F.col("place") < 4))
    return part | F.col("place").isin(0, 1) | (other & (F.col("place") < 4))


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
    """Match rate and the m- and u-probabilities of each attribute's levels, by expectation-maximisation over pattern counts."""
    sizes = list(LEVELS.values())
    x = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    # the start: agreement is likelier among matches
    m = [np.linspace(1, 4, s) / np.linspace(1, 4, s).sum() for s in sizes]
    u = [np.linspace(4, 1, s) / np.linspace(4, 1, s).sum() for s in sizes]
    rate = 0.3
    for _ in range(rounds):
        odds = np.log(rate / (1 - rate)) + sum(np.log(m[k][x[:, k]]) - np.log(u[k][x[:, k]]) for k in range(len(sizes)))
        post = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        rate = float(np.clip((n * post).sum() / n.sum(), 1e-6, 1 - 1e-6))
        for k, s in enumerate(sizes):
            # a count of a half at each level keeps every probability positive
            m[k] = np.bincount(x[:, k], n * post, s) + 0.5
            u[k] = np.bincount(x[:, k], n * (1 - post), s) + 0.5
            m[k], u[k] = m[k] / m[k].sum(), u[k] / u[k].sum()
    return rate, m, u


def linked(entries: DataFrame, candidates: DataFrame, least: float = 0.5) -> DataFrame:
    """(entry_id, cand_id, confidence) of all pairs with a posterior of at least ``least`` for the entry's best work."""
    rows = prepared_entries(entries)
    keyed = rows.withColumn("text_key", F.sha2("text", 256))
    e = cut_lineage(_entry_features(keyed.groupBy("text_key").agg(F.first("text").alias("text"))))
    c = _candidate_features(candidates)
    pairs = _blocked(e.select("text_id", F.explode("e_keys").alias("key")), _candidate_keys(c))
    # candidates are the shorter records, so they travel to the entries
    compared = pairs.join(c, "cand_id").join(e.drop("text_key", "e_keys"), "text_id").withColumns(_levels())
    compared = compared.select("text_id", "cand_id", "work", *LEVELS, _contradiction().alias("ruled_out"))
    compared = cut_lineage(compared)
    names = list(LEVELS)
    counts = [(tuple(r[k] for k in names), r["n"]) for r in compared.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).collect()]
    if not counts:
        return entries.sparkSession.createDataFrame([], "entry_id bigint, cand_id bigint, confidence double")
    rate, m, u = estimate(counts)
    weight = F.lit(float(np.log(rate / (1 - rate))))
    for k, mk, uk in zip(names, m, u):
        weight = weight + F.element_at(F.array(*[F.lit(float(w)) for w in np.log(mk) - np.log(uk)]), F.col(k) + 1)
    scored = compared.select("text_id", "cand_id", "work", "ruled_out", weight.alias("weight")).where((F.col("weight") >= float(np.log(least / (1 - least)))) & ~F.col("ruled_out"))
    best = scored.groupBy("text_id").agg(F.max_by("work", F.struct("weight", (-F.col("cand_id")))).alias("work"))
    kept = scored.join(best, ["text_id", "work"]).select("text_id", "cand_id", (1 / (1 + F.exp(-F.col("weight")))).alias("confidence"))
    texts = e.select("text_key", "text_id").join(kept, "text_id").drop("text_id")
    return keyed.select("entry_id", "text_key").join(texts, "text_key").select("entry_id", "cand_id", "confidence")
