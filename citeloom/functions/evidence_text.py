"""Evidence in texts: keywords, stems, passage scores, quotes, bibliography fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no claim.
STOP_WORDS = (
    "the and for that with this these those from have has had are was were been being which their there than then into also such both "
    "each more most other some our its not but can may via upon during after before between within without using used shown show showed found "
    "however although whereas while where when they them here well known previous previously recent recently study studies results result data "
    "role roles effect effects level levels increase increased decrease decreased including important"
).split()
#: Sections whose passages count as evidence.
EVIDENCE_SECTION = r"(?i)result|discussion|conclusion|finding"
PASSAGE_CHARS = 1200


def claim_keywords(claim: Column, limit: int = 8) -> Column:
    """The first content words of a claim in lower case, each once."""
    words = F.transform(F.regexp_extract_all(claim, F.lit(r"([A-Za-z][A-Za-z0-9\-]{2,})"), F.lit(1)), F.lower)
    return F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*STOP_WORDS))), 1, limit)


def stems(text: Column) -> Column:
    """The first five letters of words of three and more, each once."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) >= 3), lambda w: F.substring(w, 1, 5)))


def passage_score(wanted: Column, paragraph: Column, section: Column) -> Column:
    """Distinct stems in common, and one point more in a section of evidence if there are any."""
    hits = F.size(F.array_intersect(wanted, stems(paragraph)))
    return hits + F.when((hits > 0) & F.coalesce(section, F.lit("")).rlike(EVIDENCE_SECTION), 1).otherwise(0)


def select_passages(passages: Column, most: int = 8, max_chars: int = 6000) -> Column:
    """From an array of (score, idx, section, text): the best within a budget of characters, in reading order.

    A passage that does not fit is skipped, a shorter one after it may still fit. Without any hit the first ones are taken."""
    any_hit = F.exists(passages, lambda p: p["score"] > 0)
    cut = F.transform(
        passages,
        lambda p: F.struct(
            F.when(any_hit, -p["score"]).otherwise(0).alias("rank"), p["idx"].alias("idx"), p["section"].alias("section"), p["score"].alias("score"),
            F.when(F.length(p["text"]) > PASSAGE_CHARS, F.concat(F.rtrim(F.substring(p["text"], 1, PASSAGE_CHARS)), F.lit("…"))).otherwise(F.rtrim(p["text"])).alias("text"),
        ),
    )
    kind = "struct<total:int,chosen:array<struct<idx:int,section:string,score:int,text:string>>>"
    picked = F.aggregate(
        F.array_sort(cut),
        F.from_json(F.lit('{"total":0,"chosen":[]}'), kind),
        lambda acc, p: F.when(
            (F.size(acc["chosen"]) < most) & (acc["total"] + F.length(p["text"]) <= max_chars),
            F.struct((acc["total"] + F.length(p["text"])).alias("total"), F.concat(acc["chosen"], F.array(F.struct(p["idx"].cast("int").alias("idx"), p["section"].alias("section"), p["score"].cast("int").alias("score"), p["text"].alias("text")))).alias("chosen")),
        ).otherwise(acc),
    )
    return F.array_sort(picked["chosen"])


def passage_places(passages: Column, most: int = 8, max_chars: int = 6000) -> Column:
    """The places of the passages that `select_passages` takes, from an array of (score, idx, n) with their lengths n."""
    any_hit = F.exists(passages, lambda p: p["score"] > 0)
    ranked = F.transform(passages, lambda p: F.struct(F.when(any_hit, -p["score"]).otherwise(0).alias("rank"), p["idx"].alias("idx"), p["n"].alias("n")))
    picked = F.aggregate(
        F.array_sort(ranked),
        F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("chosen")),
        lambda acc, p: F.when(
            (F.size(acc["chosen"]) < most) & (acc["total"] + p["n"] <= max_chars), F.struct((acc["total"] + p["n"]).alias("total"), F.concat(acc["chosen"], F.array(p["idx"].cast("int"))).alias("chosen"))
        ).otherwise(acc),
    )
    return picked["chosen"]


def normalised(text: Column) -> Column:
    """Words in lower case, apart by one space."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def evaluated(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, even where ``use`` reads it in a lambda for every element."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def shingles(words: Column, size: int = 8) -> Column:
    """All windows of ``size`` words; none where there are fewer."""

    def windows(w: Column) -> Column:
        n = F.size(w) - size + 1
        return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(w, i, size), " "))).otherwise(F.array().cast("array<string>"))

    return evaluated(words, windows)


def quote_occurs(quote: Column, text: Column, size: int = 8, least: float = 0.8) -> Column:
    """Whether a quote stands in a text, or at least a share of its windows does."""

    def occurs(qt: Column) -> Column:
        q, t = qt["q"], qt["t"]
        windows = shingles(F.split(q, " "), size)
        share = evaluated(windows, lambda ws: F.size(F.filter(ws, lambda w: F.contains(t, w))) / F.greatest(F.size(ws), F.lit(1)))
        return (q != "") & (t != "") & (F.contains(t, q) | ((F.size(windows) > 0) & (share >= least)))

    return evaluated(F.struct(normalised(quote).alias("q"), normalised(text).alias("t")), occurs)


def keyword_share(keywords: Column, text: Column) -> Column:
    """Keywords in a text as a percentage of all."""
    return F.size(F.filter(keywords, lambda k: F.contains(F.lower(text), F.lower(k)))) * 100.0 / F.greatest(F.size(keywords), F.lit(1))


def entry_year(body: Column) -> Column:
    return F.coalesce(F.regexp_extract(body, r"((?:19|20)\d{2})", 1).try_cast("int"), F.lit(0))


def entry_doi(body: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(body, r"(?i)doi:\s*(10\.\S+)", 1), r"\.+$", "")


def entry_pmid(body: Column) -> Column:
    return F.regexp_extract(body, r"PMID:\s*(\d+)", 1)


def entry_fields(body: Column) -> Column:
    """Authors, title, journal, year, volume and first page of an entry of the usual shape; blank where it has another."""
    segments = F.filter(F.transform(F.split(body, r"(?<=[.?!])\s+"), lambda t: F.btrim(t)), lambda s: s != "")
    bare = lambda i: F.coalesce(F.regexp_replace(F.try_element_at(segments, F.lit(i)), r"\.+$", ""), F.lit(""))
    place = lambda i: F.regexp_extract(body, r";\s*(\d+[A-Za-z]?)\s*(?:\([^)]*\))?\s*:\s*(\d+)", i)
    return F.struct(
        bare(1).alias("authors"), F.regexp_extract(F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit("")), r"^([A-Z][\w'\-]+)", 1).alias("first_author_last"), bare(2).alias("title"),
        bare(3).alias("journal"), F.coalesce(F.regexp_extract(body, r"\b((?:19|20)\d{2})\b", 1).try_cast("int"), F.lit(0)).alias("year"), place(1).alias("volume"), place(2).alias("first_page"),
    )
