"""Answers about suggested citations: matching, evaluation, checks, fallbacks, library sync.

Answers come as tables. What has to be decided in order, which answer belongs to which suggestion, is decided inside
one row per marker, whose suggestions and answers are as few as the marker's text holds; all else is joins and columns.

Nulls in a field mean that it is missing; a marker without suggestions or answers has an empty selection; repeated
answers are answers of their own; ties go to the earlier answer.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEAK = 50.0
#: Warnings that keep a selection from high confidence.
NOT_HIGH = ("suggested_unresolved", "suggested_ambiguous", "suggested_unscored")

WORK = "struct<key:string,pmid:string,doi:string,pmcid:string,title:string,surnames:array<string>,year:int,retracted:boolean>"
SUGGESTIONS = f"array<struct<raw:string,label:string,kind:string,value:string,author:string,coauthor:string,year:int,resolved:array<{WORK}>,ambiguous:boolean>>"
ANSWERS = f"array<struct<tag:string,score:double,work:{WORK}>>"
EVALUATION = "struct<selected:array<struct<key:string,score:double,place:int>>,warnings:array<struct<code:string,place:int>>,level:string>"


def _low(x: str | None) -> str:
    return (x or "").strip().lower()


def one_paper(a: dict, b: dict) -> bool:
    """Whether two works are one: the first identifier that both have decides, else the title."""
    for field in ("pmid", "doi", "pmcid"):
        if _low(a[field]) and _low(b[field]):
            return _low(a[field]) == _low(b[field])
    return bool(_low(a["title"])) and _low(a["title"]) == _low(b["title"])


def surname_fits(a: str | None, b: str | None) -> bool:
    """Equal, or equal in their last word, so particles don't matter."""
    x, y = _low(a).split(), _low(b).split()
    return bool(x and y) and x[-1] == y[-1]


def cited_by_name(work: dict, s: dict) -> bool:
    """Whether a work can be the author-year citation: year at most one off, authors among its own. A work without authors can't be refuted."""
    if s["year"] and work["year"] and abs(s["year"] - work["year"]) > 1:
        return False
    names = [n for n in (work["surnames"] if work["surnames"] is not None else []) if n]
    wanted = [w for w in (s["author"], s["coauthor"]) if w]
    return not names or all(any(surname_fits(n, w) for n in names) for w in wanted)


def carries_identifier(work: dict, s: dict) -> bool:
    """Whether a work has exactly the identifier that was suggested."""
    have = _low(work.get(s["kind"]))
    want = _low(s["value"])
    if s["kind"] == "doi":
        bare = lambda d: d.split("doi.org/")[-1].rstrip(".")
        have, want = bare(have), bare(want)
    return bool(have) and have == want


def tier(place: int, s: dict, answer: dict) -> int | None:
    """How an answer belongs to the suggestion at ``place``: 1 it names it, 2 it is one of its resolved works, 3 its author and year fit."""
    tag = " ".join(_low(answer["tag"]).split())
    if tag and tag in {" ".join(_low(x).split()) for x in (s["raw"], s["label"])} | {f"[{place + 1}]"}:
        return 1
    if not answer["work"]:
        return None
    if any(one_paper(answer["work"], r) for r in s["resolved"]):
        return 2
    return 3 if s["kind"] == "author_year" and tag != "ref" and cited_by_name(answer["work"], s) else None


def decide(s: dict, answer: dict | None) -> tuple[dict | None, float | None, str]:
    """(work, score, warning): what a suggestion cites given its answer.

    A resolved identifier is cited whatever the answer says; a score counts only for the work that is cited. Another
    paper is never cited in a suggestion's place."""
    work, score = (answer["work"], answer["score"]) if answer else (None, None)
    if s["kind"] != "author_year" and s["resolved"]:
        pinned = s["resolved"][0]
        if work is None:
            return pinned, score, ""
        return (work, score, "") if one_paper(work, pinned) else (pinned, None, "")
    if work is None:
        return None, None, "suggested_unresolved"
    if s["kind"] == "author_year":
        return (work, score, "") if cited_by_name(work, s) else (None, None, "suggested_unresolved")
    return (work, score, "") if carries_identifier(work, s) else (None, None, "suggested_alternative")


def assigned(suggestions: list[dict], answers: list[dict]) -> list[tuple[int | None, dict | None, float | None, str]]:
    """For each suggestion in order (answer's place, work, score, problem): the answer of the best tier, then the first.

    Each answer is used once, but stays free where nothing is cited by it."""
    free, out = set(range(len(answers))), []
    for place, s in enumerate(suggestions):
        fits = [(t, i) for i in sorted(free) if (t := tier(place, s, answers[i]))]
        at = min(fits)[1] if fits else None
        work, score, problem = decide(s, None if at is None else answers[at])
        if work:
            free.discard(at)
        out.append((at if work else None, work, score, problem))
    return out


def match_answers(suggestions: list[dict], answers: list[dict]) -> list[int | None]:
    """For each suggestion the place of the answer that it is cited by."""
    return [at for at, _, _, _ in assigned(suggestions, answers)]


def evaluate(suggestions: list[dict], answers: list[dict], extra: int, level: str | None) -> dict:
    """The selection of a marker: one work per suggestion in order, then ``extra`` further answers; with warnings and level."""
    chosen: list[tuple[dict, float, int]] = []
    warnings: list[dict] = []
    places = assigned(suggestions, answers)
    for place, (s, (_, work, score, problem)) in enumerate(zip(suggestions, places), 1):
        if work is None:
            codes = [problem] if problem == "suggested_unresolved" else [problem, "suggested_unresolved"]
        elif any(one_paper(work, c) for c, _, _ in chosen):
            codes = ["suggested_duplicate"]
        else:
            score = None if score is None else max(0.0, min(100.0, score))
            codes = ["suggested_unscored"] if score is None else ["suggested_weak_match"] if score < WEAK else []
            codes += ["suggested_ambiguous"] * bool(s["ambiguous"]) + ["retracted"] * bool(work["retracted"])
            chosen.append((work, score or 0.0, place))
        warnings += [{"code": c, "place": place} for c in codes]
    used, keys, wanted = {at for at, *_ in places}, {w["key"] for w, _, _ in chosen}, len(chosen) + extra
    for i, a in enumerate(answers):
        if len(chosen) < wanted and i not in used and a["work"] and a["work"]["key"] not in keys:
            keys.add(a["work"]["key"])
            chosen.append((a["work"], max(0.0, min(100.0, a["score"] or 0.0)), 0))
    level = (level or "LOW") if chosen else "LOW"
    if level == "HIGH" and any(w["code"] in NOT_HIGH for w in warnings):
        level = "MEDIUM"
    return {"selected": [{"key": w["key"], "score": s, "place": p} for w, s, p in chosen], "warnings": warnings, "level": level}


def evaluated_suggestions(suggestions: Column, answers: Column, extra: Column, level: Column) -> Column:
    """`evaluate` for columns of `SUGGESTIONS` and `ANSWERS`; extra -1 stands for one further work."""

    @F.pandas_udf(EVALUATION)
    def run(s: pd.Series, a: pd.Series, n: pd.Series, v: pd.Series) -> pd.DataFrame:
        rows = [evaluate(_plain(x), _plain(y), abs(int(k)), w) for x, y, k, w in zip(s, a, n, v)]
        return pd.DataFrame(rows, columns=["selected", "warnings", "level"])

    return run(suggestions, answers, F.coalesce(extra, F.lit(0)), level)


def matched_answers(suggestions: Column, answers: Column) -> Column:
    """`match_answers` for columns: for each suggestion the answer's place from 1, or 0 (C14)."""

    @F.pandas_udf("array<int>")
    def run(s: pd.Series, a: pd.Series) -> pd.Series:
        return pd.Series([[0 if i is None else i + 1 for i in match_answers(_plain(x), _plain(y))] for x, y in zip(s, a)], dtype="object")

    return run(suggestions, answers)


def _plain(rows: object) -> list[dict]:
    """Arrow's nested arrays as lists of dicts."""
    return [{k: (list(v) if hasattr(v, "__len__") and not isinstance(v, str | dict) else v) for k, v in r.items()} for r in (rows if rows is not None else [])]


# ---------------------------------------------------------------- columns and joins


def capped_level(level: Column, warnings: Column) -> Column:
    """High confidence with a suggestion that is unresolved, ambiguous or unscored becomes medium."""
    return F.when((level == "HIGH") & F.arrays_overlap(warnings, F.array(*[F.lit(w) for w in NOT_HIGH])), "MEDIUM").otherwise(level)


def fallback(suggestions: DataFrame) -> DataFrame:
    """What is cited where no answer came (L9): (…, cited, warning) for suggestions with n_resolved and ambiguous.

    Only a suggestion with a single, unambiguous work is cited."""
    sure = (F.col("n_resolved") == 1) & ~F.coalesce("ambiguous", F.lit(False))
    return suggestions.withColumns({"cited": sure, "warning": F.when(sure, "suggested_unscored").otherwise("suggested_unresolved")})


def second_answers(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, verdict, source): the answer by abstract, replaced by the one by full text where that helps.

    The full text is asked where there is no abstract (no first verdict) or the abstract supports in part; after a partial
    verdict its answer counts only if it supports with a found quote."""
    a = first.select(*keys, F.col("verdict").alias("v1"))
    b = second.select(*keys, F.col("verdict").alias("v2"), F.col("quote_found").alias("q2"))
    both = a.join(b, keys, "left")
    better = F.coalesce((F.col("v1") == "partial") & (F.col("v2") == "supports") & F.col("q2"), F.lit(False)) | (F.col("v1").isNull() & F.col("v2").isNotNull())
    verdict = F.when(better, F.col("v2")).otherwise(F.coalesce("v1", F.lit("unverified")))
    source = F.when(better, "full_text").when(F.col("v1").isNotNull(), "abstract").otherwise("")
    return both.select(*keys, verdict.alias("verdict"), source.alias("source"))


def checked(level: Column, score: Column, status: Column, retracted: Column) -> Column:
    """A retracted selection is of low confidence, scored 20 at most, and a mismatch."""
    return F.struct(F.when(retracted, "LOW").otherwise(level).alias("level"), F.when(retracted, F.least(score, F.lit(20.0))).otherwise(score).alias("score"), F.when(retracted, "mismatch").otherwise(status).alias("status"))


def verdict_titles(verdicts: DataFrame, selected: DataFrame) -> DataFrame:
    """Verdicts (group_id, key) with the title of the first selected work (group_id, pos, pmid, doi, title) of that key.

    A key that no work has stands for itself. Works are joined by each of their keys, so no group is collected."""
    keyed = selected.select("group_id", "pos", "title", F.explode(F.array_distinct(F.array_compact(F.array(*[F.nullif(c, F.lit("")) for c in ("pmid", "doi", "title")])))).alias("key"))
    first = keyed.groupBy("group_id", "key").agg(F.min_by("title", "pos").alias("title"))
    return verdicts.join(first, ["group_id", "key"], "left").select("group_id", "key", F.substring(F.coalesce("title", "key"), 1, 60).alias("title"))


def submitted(answers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Submitted answers (sent_id, pos, pmid, doi, title, level, score) as evidence.

    The work is found by PMID, else DOI, else title, without case; answers of unknown works are dropped. An unknown level is
    LOW, a missing score 0."""
    low = lambda c: F.lower(F.btrim(F.coalesce(c, F.lit(""))))
    known = candidates.select("cand_id", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), low(F.col(c)).alias("k")) for i, c in enumerate(("pmid", "doi", "title"))])).alias("x")).select("cand_id", "x.*").where("k <> ''")
    known = known.groupBy("rank", "k").agg(F.min("cand_id").alias("cand_id"))
    asked = answers.select("sent_id", "pos", "level", "score", F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), low(F.col(c)).alias("k")) for i, c in enumerate(("pmid", "doi", "title"))])).alias("x")).select("sent_id", "pos", "level", "score", "x.*")
    found = asked.where("k <> ''").join(known, ["rank", "k"]).groupBy("sent_id", "pos").agg(F.min_by("cand_id", "rank").alias("cand_id"), F.first("level").alias("level"), F.first("score").alias("score"))
    up = F.upper(F.btrim(F.coalesce("level", F.lit(""))))
    return found.select("sent_id", "pos", "cand_id", F.when(up.isin("HIGH", "MEDIUM", "LOW"), up).otherwise("LOW").alias("level"), F.coalesce(F.col("score").try_cast("double"), F.lit(0.0)).alias("score"))


def library_sync(picks: DataFrame, how: str) -> DataFrame:
    """Accepted picks as rows for the library, once per work, with the way they were added before their source (K5).

    Picks from the library itself and those that name no work are left out; ``picks`` has key, title, pmid, doi, source."""
    source = F.lower(F.coalesce(F.nullif("source", F.lit("")), F.lit("literature")))
    named = F.coalesce(F.greatest(*[F.length(c) for c in ("title", "pmid", "doi")]), F.lit(0)) > 0
    rows = picks.where(named & (source != "user_library")).withColumn("source", F.concat(F.lit(f"{how}_"), source))
    whole = F.struct(*[F.col(c) for c in rows.columns])
    return rows.groupBy("key").agg(F.min_by(whole, "pick_id").alias("_r")).select("_r.*")


def seen_records(rounds: DataFrame) -> DataFrame:
    """(key, record): what is known of each work after all rounds of a dialogue.

    Searches keep the first record of a work, fetches of a single record replace it: the last fetch wins, else the first
    search. ``rounds`` has key, step, fetched and record."""
    rank = F.struct(F.col("fetched"), F.when(F.col("fetched"), F.col("step")).otherwise(-F.col("step")))
    return rounds.groupBy("key").agg(F.max_by("record", rank).alias("record"))
