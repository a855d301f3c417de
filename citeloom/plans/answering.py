"""Queries of answers, tracked documents and searches over the test tables, each with its SQL equivalent where SQL can express it.

Answers, fields and search results have no source in the tables; they are derived from ids, in Spark and SQL alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions import identity as idn
from citeloom.functions import numbers as num
from citeloom.operators import answers as ans
from citeloom.operators import documents as doc
from citeloom.operators import evidence as evd
from citeloom.operators import library as lib
from citeloom.operators import markers as mk
from citeloom.operators import review as rv
from citeloom.operators import searching as sch
from citeloom.operators import tracked as trk
from citeloom.plans.reference import _ENTRIES, _GROUPS, _HEADS
from citeloom.session import read_table
from citeloom.sources import docx, records

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- answers


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers that cite, with their suggestions by the grammar and answers that agree with them more or less."""
    rows = read_table(spark, sf_dir, "markers").where("kind = 'SUGGESTED'").select("marker_id", "extra_search", F.try_element_at(mk.markers_column(F.col("text")), F.lit(1)).alias("m")).where("m is not null")
    m = F.col("marker_id")
    blank = F.lit("")
    held = lambda s, kind: F.when(s["kind"] == kind, s["value"]).otherwise(blank)
    work = lambda s, retracted: F.struct(
        s["value"].alias("key"), held(s, "pmid").alias("pmid"), held(s, "doi").alias("doi"), held(s, "pmcid").alias("pmcid"), s["value"].alias("title"),
        F.array(F.coalesce(s["author"], blank), F.coalesce(s["coauthor"], blank)).alias("surnames"), F.coalesce(s["year"], F.lit(0)).alias("year"), retracted.alias("retracted"),
    )
    suggestions = F.transform(
        "m.suggestions",
        lambda s, i: F.struct(
            s["raw"].alias("raw"), mk.suggestion_label(s).alias("label"), s["kind"].alias("kind"), s["value"].alias("value"), F.coalesce(s["author"], blank).alias("author"), F.coalesce(s["coauthor"], blank).alias("coauthor"),
            F.coalesce(s["year"], F.lit(0)).alias("year"), F.when((m + i) % 3 != 0, F.array(work(s, (m % 11 == 0)))).otherwise(F.array().cast(f"array<{ans.WORK}>")).alias("resolved"), ((m + i) % 5 == 0).alias("ambiguous"),
        ),
    )
    answers = F.transform("m.suggestions", lambda s, i: F.struct(F.when((m + i) % 4 == 0, F.concat(F.lit("["), (i + 1).cast("string"), F.lit("]"))).when((m + i) % 4 == 1, s["raw"]).otherwise(blank).alias("tag"), F.when((m + i) % 7 != 0, ((m * 7 + i) % 101).cast("double")).alias("score"), work(s, F.lit(False)).alias("work")))
    return rows.select("marker_id", "extra_search", suggestions.cast(ans.SUGGESTIONS).alias("suggestions"), answers.cast(ans.ANSWERS).alias("answers"))


@query()
def answer_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which answer belongs to which suggestion, by tag, paper, or author and year: C14, H35."""
    rows = _asked(spark, sf_dir).select("marker_id", F.posexplode(ans.matched_answers(F.col("suggestions"), F.col("answers"))).alias("p", "answer"))
    return rows.select("marker_id", (F.col("p") + 1).alias("suggestion"), "answer")


@query()
def suggested_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works cited by each marker with scores, warnings and level: L3, L8."""
    e = _asked(spark, sf_dir).select("marker_id", ans.evaluated_suggestions(F.col("suggestions"), F.col("answers"), F.col("extra_search"), F.lit("HIGH")).alias("e"))
    return e.select("marker_id", "e.level", F.array_join(F.transform("e.selected", lambda s: s["key"]), "; ").alias("cited"), F.array_join(F.transform("e.warnings", lambda w: w["code"]), "; ").alias("warnings"))


@query("SELECT marker_id, CASE WHEN marker_id % 3 = 0 AND (marker_id % 4 IN (0, 1, 2)) THEN 'MEDIUM' WHEN marker_id % 3 = 0 THEN 'HIGH' ELSE 'LOW' END AS level FROM markers")
def confidence_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High confidence falls with suggestions that are not settled: L8."""
    m = F.col("marker_id")
    codes = F.when(m % 4 == 0, F.array(F.lit("suggested_unresolved"))).when(m % 4 == 1, F.array(F.lit("retracted"), F.lit("suggested_unscored"))).when(m % 4 == 2, F.array(F.lit("suggested_ambiguous"))).otherwise(F.array(F.lit("retracted")))
    return read_table(spark, sf_dir, "markers").select("marker_id", ans.capped_level(F.when(m % 3 == 0, "HIGH").otherwise("LOW"), codes).alias("level"))


@query("SELECT marker_id, marker_id % 4 = 1 AND marker_id % 5 <> 0 AS cited, CASE WHEN marker_id % 4 = 1 AND marker_id % 5 <> 0 THEN 'suggested_unscored' ELSE 'suggested_unresolved' END AS warning FROM markers WHERE kind = 'SUGGESTED'")
def resolved_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is cited without any answer: L9."""
    m = F.col("marker_id")
    rows = read_table(spark, sf_dir, "markers").where("kind = 'SUGGESTED'").select("marker_id", (m % 4).alias("n_resolved"), F.when(m % 5 == 0, True).alias("ambiguous"))
    return ans.fallback(rows).select("marker_id", "cited", "warning")


@query(
    """WITH a AS (SELECT row_id, CASE WHEN trim(coalesce(abstract, '')) = '' THEN NULL WHEN row_id % 3 = 0 THEN 'partial' WHEN row_id % 3 = 1 THEN 'supports' ELSE 'not_supported' END AS v1,
CASE WHEN row_id % 5 < 2 THEN 'supports' WHEN row_id % 5 < 4 THEN 'partial' END AS v2, row_id % 7 <> 0 AS q2 FROM references_library),
b AS (SELECT *, coalesce(v1 = 'partial' AND v2 = 'supports' AND q2, false) OR (v1 IS NULL AND v2 IS NOT NULL) AS better FROM a)
SELECT row_id, CASE WHEN better THEN v2 ELSE coalesce(v1, 'unverified') END AS verdict, CASE WHEN better THEN 'full_text' WHEN v1 IS NOT NULL THEN 'abstract' ELSE '' END AS source FROM b"""
)
def second_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The answer by abstract or, where that helps, by full text: L6."""
    r = F.col("row_id")
    rows = read_table(spark, sf_dir, "references_library")
    first = rows.select("row_id", F.when(F.btrim(F.coalesce("abstract", F.lit(""))) != "", F.when(r % 3 == 0, "partial").when(r % 3 == 1, "supports").otherwise("not_supported")).alias("verdict"))
    second = rows.where(r % 5 < 4).select("row_id", F.when(r % 5 < 2, "supports").otherwise("partial").alias("verdict"), (r % 7 != 0).alias("quote_found"))
    return ans.second_answers(first, second, ["row_id"])


@query("SELECT row_id, CASE WHEN coalesce(is_retracted, false) THEN 'LOW' ELSE 'HIGH' END AS level, CASE WHEN coalesce(is_retracted, false) THEN least(row_id % 101, 20)::DOUBLE ELSE (row_id % 101)::DOUBLE END AS score, CASE WHEN coalesce(is_retracted, false) THEN 'mismatch' ELSE 'verified' END AS status FROM references_library")
def deterministic_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retracted works against any other finding: L7."""
    c = ans.checked(F.lit("HIGH"), (F.col("row_id") % 101).cast("double"), F.lit("verified"), F.coalesce("is_retracted", F.lit(False)))
    return read_table(spark, sf_dir, "references_library").select("row_id", c.alias("c")).select("row_id", "c.level", "c.score", "c.status")


_SEL = "sel AS (SELECT doc_id AS group_id, entry_id AS pos, coalesce(pmid, '') AS pmid, coalesce(doi, '') AS doi, coalesce(title, '') AS title FROM bib_entries)"
_VKEY = "CASE entry_id % 4 WHEN 0 THEN coalesce(pmid, '') WHEN 1 THEN coalesce(doi, '') WHEN 2 THEN coalesce(title, '') ELSE 'nobody' || entry_id END"


@query(
    f"""WITH {_SEL}, keyed AS (SELECT group_id, pos, title, pmid AS key FROM sel UNION ALL SELECT group_id, pos, title, doi FROM sel UNION ALL SELECT group_id, pos, title, title FROM sel),
first AS (SELECT group_id, key, arg_min(title, pos) AS title FROM keyed WHERE key <> '' GROUP BY ALL), v AS (SELECT doc_id AS group_id, {_VKEY} AS key FROM bib_entries)
SELECT v.group_id, v.key, substr(coalesce(f.title, v.key), 1, 60) AS title FROM v LEFT JOIN first f ON f.group_id = v.group_id AND f.key = v.key"""
)
def verdict_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with the title of the work they are about: C19."""
    e = read_table(spark, sf_dir, "bib_entries")
    text = lambda c: F.coalesce(c, F.lit(""))
    selected = e.select(F.col("doc_id").alias("group_id"), F.col("entry_id").alias("pos"), *[text(c).alias(c) for c in ("pmid", "doi", "title")])
    i = F.col("entry_id") % 4
    key = F.when(i == 0, text("pmid")).when(i == 1, text("doi")).when(i == 2, text("title")).otherwise(F.concat(F.lit("nobody"), F.col("entry_id").cast("string")))
    return ans.verdict_titles(e.select(F.col("doc_id").alias("group_id"), key.alias("key")), selected)


@query(
    """WITH k AS (SELECT cand_id, 0 AS rank, lower(trim(coalesce(journal, ''))) AS k FROM candidates UNION ALL SELECT cand_id, 2, lower(trim(coalesce(title, ''))) FROM candidates),
known AS (SELECT rank, k, min(cand_id) AS cand_id FROM k WHERE k <> '' GROUP BY ALL),
asked AS (SELECT doc_id, entry_id, 0 AS rank, lower(trim(coalesce(pmid, ''))) AS k FROM bib_entries UNION ALL SELECT doc_id, entry_id, 1, lower(trim(coalesce(doi, ''))) FROM bib_entries UNION ALL SELECT doc_id, entry_id, 2, lower(trim(coalesce(title, ''))) FROM bib_entries)
SELECT a.doc_id AS sent_id, a.entry_id AS pos, arg_min(cand_id, a.rank) AS cand_id, CASE a.entry_id % 4 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS level, CASE WHEN a.entry_id % 3 = 0 THEN 0e0 ELSE (a.entry_id % 90)::DOUBLE END AS score
FROM asked a JOIN known USING (rank, k) WHERE k <> '' GROUP BY a.doc_id, a.entry_id"""
)
def submitted_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted answers found among known works by PMID, DOI or title: L2, R8."""
    i = F.col("entry_id")
    level = F.when(i % 4 == 0, "high").when(i % 4 == 1, " Medium ").when(i % 4 == 2, "sure")
    asked = read_table(spark, sf_dir, "bib_entries").select(F.col("doc_id").alias("sent_id"), i.alias("pos"), "pmid", "doi", "title", level.alias("level"), F.when(i % 3 != 0, (i % 90).cast("string")).otherwise("n/a").alias("score"))
    known = read_table(spark, sf_dir, "candidates").select("cand_id", F.col("journal").alias("pmid"), F.lit("").alias("doi"), "title")
    return ans.submitted(asked, known)


@query(
    """WITH p AS (SELECT cand_id AS pick_id, title AS key, title, lower(coalesce(nullif(source, ''), 'literature')) AS source FROM candidates WHERE cand_id % 3 <> 0 AND length(coalesce(title, '')) > 0)
SELECT key, min(pick_id) AS pick_id, 'accepted_' || arg_min(source, pick_id) AS source FROM p WHERE source <> 'user_library' GROUP BY key"""
)
def library_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted picks on their way into the library: K5."""
    blank = F.lit("")
    picks = read_table(spark, sf_dir, "candidates").where("cand_id % 3 <> 0").select(F.col("cand_id").alias("pick_id"), F.col("title").alias("key"), "title", blank.alias("pmid"), blank.alias("doi"), "source")
    return ans.library_sync(picks, "accepted").select("key", "pick_id", "source")


@query(
    """WITH r AS (SELECT coalesce(lib_key, '') AS key, row_id AS step, row_id % 4 = 0 AS fetched, title AS record FROM references_library)
SELECT key, arg_max(record, CASE WHEN fetched THEN 1000000000 + step ELSE -step END) AS record FROM r WHERE record IS NOT NULL GROUP BY key"""
)
def seen_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of works after searches and fetches: R15."""
    rows = read_table(spark, sf_dir, "references_library").where("title is not null")
    return ans.seen_records(rows.select(F.coalesce("lib_key", F.lit("")).alias("key"), F.col("row_id").alias("step"), (F.col("row_id") % 4 == 0).alias("fetched"), F.col("title").alias("record")))


# ---------------------------------------------------------------- tracked documents

_FIELDS = """fields AS (SELECT doc_id, payload_id AS ord, citation_id AS cid, payload_id % 17 <> 0 AS readable, payload_id % 13 = 0 AS odd, payload_id % 7 = 0 AS in_table, CASE WHEN payload_id % 5 <> 0 THEN '[' || payload_id % 9 || ']' END AS plain, '[' || payload_id % CASE WHEN payload_id % 11 = 0 THEN 8 ELSE 9 END || ']' AS visible, payload_id % 19 = 0 AS empty FROM cite_payloads),
items AS (SELECT doc_id, payload_id AS ord, 0 AS pos, 'r' || payload_id % 50 AS record FROM cite_payloads WHERE payload_id % 19 <> 0),
entry AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY entry_id) AS INT) AS place, 'r' || entry_id % 50 AS record, entry_id, raw_text FROM bib_entries WHERE raw_text IS NOT NULL),
listed AS (SELECT doc_id, place, record, CASE WHEN entry_id % 3 = 0 THEN sha1('older') WHEN entry_id % 3 = 1 THEN sha1(raw_text) ELSE '' END AS hash, entry_id % 23 = 0 AS uncited FROM entry),
texts AS (SELECT doc_id, place, raw_text AS text FROM entry WHERE entry_id % 29 <> 0)"""


def _tracked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    p = read_table(spark, sf_dir, "cite_payloads")
    i = F.col("payload_id")
    shown = lambda n: F.concat(F.lit("["), n.cast("string"), F.lit("]"))
    fields = p.select(
        "doc_id", i.alias("ord"), F.col("citation_id").alias("cid"), (i % 17 != 0).alias("readable"), F.when(i % 13 == 0, F.array(F.lit("odd"))).otherwise(F.array().cast("array<string>")).alias("problems"), (i % 7 == 0).alias("in_table"),
        F.when(i % 5 != 0, shown(i % 9)).alias("plain"), F.when(i % 11 == 0, shown(i % 8)).otherwise(shown(i % 9)).alias("visible"), F.when(i % 19 == 0, 0).otherwise(1).alias("n_items"), F.lit("numeric").alias("render"), F.array((i % 9).cast("int")).alias("numbers"),
    )
    items = p.where("payload_id % 19 <> 0").select("doc_id", i.alias("ord"), F.lit(0).alias("pos"), F.concat(F.lit("r"), (i % 50).cast("string")).alias("record"))
    e = F.col("entry_id")
    entries = read_table(spark, sf_dir, "bib_entries").where("raw_text is not null").withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("entry_id")))
    entries = entries.withColumn("record", F.concat(F.lit("r"), (e % 50).cast("string")))
    listed = entries.select("doc_id", "place", "record", F.when(e % 3 == 0, F.sha1(F.lit("older"))).when(e % 3 == 1, F.sha1("raw_text")).otherwise("").alias("hash"), (e % 23 == 0).alias("uncited"))
    texts = entries.where("entry_id % 29 <> 0").select("doc_id", "place", F.col("raw_text").alias("text"))
    return fields, items, listed, texts


@query(
    f"""WITH {_FIELDS}, good AS (SELECT * FROM fields WHERE readable),
copies AS (SELECT *, row_number() OVER (PARTITION BY doc_id, cid, in_table ORDER BY ord) AS c FROM good),
firsts AS (SELECT i.doc_id, i.record, min({{'ord': i.ord, 'pos': i.pos}}) AS f FROM items i JOIN good g ON g.doc_id = i.doc_id AND g.ord = i.ord WHERE NOT g.in_table GROUP BY ALL),
numbers AS (SELECT doc_id, record, row_number() OVER (PARTITION BY doc_id ORDER BY f) AS number FROM firsts),
sizes AS (SELECT * FROM (SELECT doc_id, count(*) FILTER (WHERE NOT uncited) AS n_listed FROM listed GROUP BY doc_id) JOIN (SELECT doc_id, count(*) AS n_texts FROM texts GROUP BY doc_id) USING (doc_id))
SELECT doc_id, 'damaged' AS kind, ord::VARCHAR AS at FROM fields WHERE NOT readable UNION ALL SELECT doc_id, 'payload', ord::VARCHAR FROM good WHERE odd
UNION ALL SELECT doc_id, 'duplicate', ord::VARCHAR FROM copies WHERE c > 1 AND NOT in_table UNION ALL SELECT doc_id, 'table', ord::VARCHAR FROM good WHERE in_table
UNION ALL SELECT doc_id, 'hand_edited', ord::VARCHAR FROM good WHERE NOT in_table AND coalesce(plain, '') <> '' AND visible <> plain UNION ALL SELECT doc_id, 'unresolved', ord::VARCHAR FROM good WHERE NOT in_table AND empty
UNION ALL SELECT doc_id, 'entry_mismatch', n_texts::VARCHAR FROM sizes WHERE n_listed <> n_texts
UNION ALL SELECT l.doc_id, 'entry_edited', number::VARCHAR FROM listed l JOIN sizes s ON s.doc_id = l.doc_id AND n_listed = n_texts JOIN texts t ON t.doc_id = l.doc_id AND t.place = l.place JOIN numbers n ON n.doc_id = l.doc_id AND n.record = l.record WHERE text <> '' AND hash <> '' AND sha1(text) <> hash
UNION ALL SELECT l.doc_id, 'uncited', l.record FROM listed l LEFT JOIN numbers n ON n.doc_id = l.doc_id AND n.record = l.record WHERE n.record IS NULL AND NOT uncited"""
)
def tracked_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does not fit between fields and bibliographies, in nine kinds: K10, E12."""
    return trk.reconciled(*_tracked(spark, sf_dir))


@query(
    f"""WITH {_FIELDS}, n AS (SELECT *, CASE WHEN empty THEN '[?]' ELSE '[' || ord % 10 || ']' END AS text, CASE WHEN empty THEN CAST([] AS BIGINT[]) ELSE [ord % 10] END AS new, [ord % 9] AS numbers, coalesce(plain <> '' AND visible <> plain, false) AS edited FROM fields WHERE readable)
SELECT doc_id, ord, CASE WHEN in_table AND new <> numbers THEN 'blocked' WHEN in_table THEN 'leave' WHEN empty AND ord % 2 = 0 THEN 'open' WHEN text <> visible THEN 'rewrite' ELSE 'leave' END AS action,
CASE WHEN in_table OR (empty AND ord % 2 = 0) THEN visible ELSE text END AS new_text, new <> numbers AND NOT empty AND NOT in_table AS moved, edited AND text <> visible AND NOT in_table AND NOT (empty AND ord % 2 = 0) AS edit_lost FROM n"""
)
def tracked_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each citation field under new numbers: K11."""
    fields = _tracked(spark, sf_dir)[0].where("readable")
    none = F.col("n_items") == 0
    new = F.when(none, F.array().cast("array<int>")).otherwise(F.array((F.col("ord") % 10).cast("int")))
    text = F.when(none, "[?]").otherwise(F.concat(F.lit("["), (F.col("ord") % 10).cast("string"), F.lit("]")))
    out = trk.rewritten(fields, new, text, F.lit("numeric"), F.lit(False), F.col("ord") % 2 == 0)
    return out.select("doc_id", "ord", "action", "new_text", "moved", "edit_lost")


@query(
    """WITH b AS (SELECT record_uuid AS record, arg_min(title, entry_id) AS entry_title FROM bib_entries WHERE coalesce(record_uuid, '') <> '' AND entry_id % 2 = 0 AND title IS NOT NULL GROUP BY 1)
SELECT entry_id, e.record_uuid AS record, b.entry_title IS NOT NULL AS known, coalesce(b.entry_title, e.journal) AS title FROM bib_entries e LEFT JOIN b ON b.record = e.record_uuid"""
)
def cluster_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited items with the entry of their record, else their own data: C7."""
    e = read_table(spark, sf_dir, "bib_entries")
    items = e.select("entry_id", F.col("record_uuid").alias("record"), F.col("journal").alias("title"))
    entries = e.where("entry_id % 2 = 0 and title is not null").select("entry_id", F.col("record_uuid").alias("record"), F.col("title").alias("entry_title"))
    return trk.cluster_items(items, entries).select("entry_id", "record", "known", "title")


@query(
    """WITH s AS (SELECT DISTINCT doc_id, coalesce(sent_id, '') AS sent_id FROM markers), e AS (SELECT doc_id, coalesce(sent_id, '') AS sent_id, max(marker_id % 101) AS score FROM markers WHERE kind = 'SUGGESTED' GROUP BY ALL)
SELECT s.doc_id, s.sent_id, score FROM s LEFT JOIN e ON e.doc_id = s.doc_id AND e.sent_id = s.sent_id"""
)
def sentence_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked sentences with their evidence, if any: C3."""
    m = read_table(spark, sf_dir, "markers").withColumn("sent_id", F.coalesce("sent_id", F.lit("")))
    evidence = m.where("kind = 'SUGGESTED'").groupBy("doc_id", "sent_id").agg(F.max(F.col("marker_id") % 101).alias("score"))
    return trk.joined_evidence(m.select("doc_id", "sent_id").distinct(), evidence, ["doc_id", "sent_id"])


@query("SELECT entry_id, CASE WHEN entry_id % 3 <> 0 THEN string_split(trim(body), ' ')[1] END AS first, CASE WHEN entry_id % 3 <> 0 THEN sha1(string_split(trim(body), ' ')[1]) END AS hash FROM bib_entries WHERE trim(body) <> ''")
def positional_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and hashes side by side where there are as many of both: C18."""
    words = F.split(F.btrim("body"), " ")
    hashes = F.transform("w", lambda x: F.sha1(x))
    rows = read_table(spark, sf_dir, "bib_entries").where("trim(body) <> ''").select("entry_id", words.alias("w"))
    fits = F.when(F.col("entry_id") % 3 == 0, F.concat("w", F.array(F.lit("more")))).otherwise(F.col("w"))
    z = rows.select("entry_id", fits.alias("o"), F.col("w"), hashes.alias("h")).select("entry_id", trk.zipped(F.col("o"), F.col("w"), F.col("h")).alias("z"))
    return z.select("entry_id", F.try_element_at("z", F.lit(1))["w"].alias("first"), F.try_element_at("z", F.lit(1))["h"].alias("hash"))


@query("SELECT doc_id, count(*) FILTER (WHERE original_number IS NULL) AS n_new, count(*) FILTER (WHERE original_number IS NOT NULL) AS n_existing, count(*) FILTER (WHERE original_number <> n) AS n_moved FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY entry_id) AS n FROM bib_entries) GROUP BY doc_id")
def renumber_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New, kept and moved references of each document: D10."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("entry_id"))
    return trk.renumber_preview(read_table(spark, sf_dir, "bib_entries").select("doc_id", n.alias("number"), F.col("original_number").alias("old_number")))


@query("SELECT marker_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id NULLS FIRST, start_off DESC NULLS LAST, marker_id DESC) AS write_no FROM markers")
def write_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order in which markers are written, the last of a paragraph first: F8."""
    return trk.write_order(read_table(spark, sf_dir, "markers"), "sent_id", "start_off", "marker_id").select("marker_id", "write_no")


_WORDING = "CASE WHEN entry_id % 3 = 0 OR title IS NULL THEN coalesce(body, '') ELSE title END"


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY entry_id) AS place, entry_id || '. ' || {_WORDING} AS text FROM bib_entries")
def merged_bibliography_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new entries of each document as one numbered list: H33."""
    e = read_table(spark, sf_dir, "bib_entries").select("doc_id", F.col("entry_id").alias("number"), "body", F.col("title").alias("rendered"), (F.col("entry_id") % 3 == 0).alias("verbatim"))
    return trk.merged_bibliography(e, False)


@query(f"SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY substr(regexp_replace(lower({_WORDING}), '[^a-z0-9 ]+', '', 'g'), 1, 80), entry_id) AS place, {_WORDING} AS text FROM bib_entries")
def merged_bibliography_by_author(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old and new entries of each document in alphabetical order: H33, F6."""
    e = read_table(spark, sf_dir, "bib_entries").select("doc_id", F.col("entry_id").alias("number"), "body", F.col("title").alias("rendered"), (F.col("entry_id") % 3 == 0).alias("verbatim"))
    return trk.merged_bibliography(e, True)


@query(
    """WITH l AS (SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS p, trim(unnest(string_split(text, chr(10)))) AS t FROM documents),
s AS (SELECT doc_id, CAST(max(p) AS INT) AS first FROM l GROUP BY doc_id), b AS (SELECT l.*, CASE WHEN regexp_matches(t, '^[A-Z][a-z]+$') THEN 'Heading1' ELSE '' END AS style FROM l JOIN s USING (doc_id) WHERE p < first),
n AS (SELECT doc_id, max(p) AS last FROM b WHERE t <> '' GROUP BY doc_id),
r AS (SELECT b.doc_id, p, CASE WHEN p = last AND length(t) < 80 AND NOT regexp_matches(t, '^\\[?(\\d+)[.\\s)\\]]+\\s*(.+)') THEN 3 WHEN style <> '' THEN 2 WHEN t = 'References' THEN 1 END AS rank FROM b JOIN n USING (doc_id))
SELECT s.doc_id, coalesce(max({'rank': rank, 'p': p}).p, -1) AS heading_idx FROM s LEFT JOIN r ON r.doc_id = s.doc_id AND rank IS NOT NULL GROUP BY s.doc_id"""
)
def bibliography_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heading above each document's last block: R6."""
    paras = doc.paragraphs(read_table(spark, sf_dir, "documents"))
    styled = paras.select("doc_id", "para_index", F.when(F.col("text").rlike("^[A-Z][a-z]+$"), "Heading1").otherwise("").alias("style"), "text", F.lit(False).alias("in_field"))
    spans = paras.groupBy("doc_id").agg(F.max("para_index").alias("first")).withColumn("heading_text", F.lit("References"))
    return trk.bibliography_heading(styled, spans)


# ---------------------------------------------------------------- searches

_BARE_DOI = "lower(regexp_replace(trim(coalesce(doi, '')), '^https?://(?:dx\\.)?doi\\.(?:org|example)/', '', 'i'))"


@query(
    f"""SELECT 'name' AS form, row_id FROM references_library WHERE year = 1990 AND len(list_filter(authors, lambda a: lower(string_split_regex(trim(coalesce(a.last_name, '')), '\\s+')[-1]) = 'zeinustberg')) > 0
UNION ALL SELECT 'pmid', row_id FROM references_library WHERE trim(pmid) = '60005747' UNION ALL SELECT 'year', row_id FROM references_library WHERE year = 1999 AND coalesce(trim(pmid), '') <> ''
UNION ALL SELECT 'doi', row_id FROM references_library WHERE {_BARE_DOI} = '10.5555/none'"""
)
def fielded_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library rows by fielded queries: B16, J6."""
    rows = read_table(spark, sf_dir, "references_library")
    forms = {"name": 'AUTH:"Zeinustberg" AND PUB_YEAR:1990', "pmid": "EXT_ID:60005747 AND SRC:MED", "year": "PUB_YEAR:1999 AND SRC:MED", "doi": 'DOI:"https://doi.org/10.5555/none"'}
    tagged = F.array_compact(F.array(*[F.when(sch.field_query(q), F.lit(name)) for name, q in forms.items()]))
    return rows.select(F.explode(tagged).alias("form"), "row_id")


@query(
    """WITH h AS (SELECT 'y' || year AS query, pmid, row_id, coalesce(title, '') AS title FROM references_library WHERE trim(pmid) <> '' AND year > 0), t AS (SELECT query, count(*) AS total FROM h GROUP BY query)
SELECT query, rank, pmid, total FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY length(title) DESC, row_id) AS rank FROM h) JOIN t USING (query) WHERE rank <= 20"""
)
def search_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results with rank and total, as a table that later joins read: A11, J2."""
    rows = read_table(spark, sf_dir, "references_library").where("trim(pmid) <> '' and year > 0")
    return sch.search_snapshot(rows, F.concat(F.lit("y"), F.col("year").cast("string")), [F.length(F.coalesce("title", F.lit(""))).desc(), F.col("row_id")], 20)


_LAST = "lower(string_split_regex(trim(coalesce({0}, '')), '\\s+')[-1])"
_LADDER = f"""asked AS (SELECT DISTINCT coalesce(authors[2].last_name, '') || '|' || year AS ask_id, {_LAST.format('authors[2].last_name')} AS name, year FROM references_library WHERE year > 0),
people AS (SELECT row_id AS work_id, year, {_LAST.format('a.last_name')} AS name, max(pos = 1) AS first FROM (SELECT row_id, year, unnest(authors) AS a, generate_subscripts(authors, 1) AS pos FROM references_library) GROUP BY ALL),
met AS (SELECT ask_id, work_id, CASE WHEN p.first AND p.year = a.year THEN 1 WHEN p.first THEN 2 WHEN p.year = a.year THEN 3 ELSE 4 END AS level FROM asked a JOIN people p ON p.name = a.name AND p.year BETWEEN a.year - 1 AND a.year + 1 WHERE a.name <> ''),
ladder AS (SELECT * FROM met WHERE (ask_id, level) IN (SELECT ask_id, min(level) FROM met GROUP BY ask_id))"""


def _ladder(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    library = read_table(spark, sf_dir, "references_library")
    asked = library.where("year > 0").select(F.try_element_at("authors.last_name", F.lit(2)).alias("author"), "year")
    asked = asked.select(F.concat_ws("|", F.coalesce("author", F.lit("")), F.col("year").cast("string")).alias("ask_id"), "author", "year").distinct()
    works = library.select(F.col("row_id").alias("work_id"), "authors", "year")
    return asked, sch.author_year_ladder(asked, works)


@query(f"WITH {_LADDER} SELECT ask_id, level, work_id FROM ladder")
def author_year_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by author and year, first authors and exact years before others: C12."""
    return _ladder(spark, sf_dir)[1]


@query(
    f"""WITH {_LADDER}, lib AS (SELECT ask_id, 0 AS src, work_id AS pos, 'w' || work_id AS key FROM ladder WHERE work_id % 4 = 0), idx AS (SELECT ask_id, 1 AS src, work_id AS pos, 'w' || work_id AS key FROM ladder WHERE work_id % 2 = 0),
near AS (SELECT * FROM lib UNION ALL SELECT * FROM idx), far AS (SELECT ask_id, 2 AS src, work_id AS pos, 'w' || work_id AS key FROM ladder WHERE ask_id NOT IN (SELECT ask_id FROM near)),
once AS (SELECT ask_id, key, min({{'src': src, 'pos': pos}}) AS place FROM (SELECT * FROM near UNION ALL SELECT * FROM far) GROUP BY ALL), n AS (SELECT ask_id, count(*) AS n FROM once GROUP BY ask_id), t AS (SELECT ask_id, count(*) + 5 AS t FROM idx GROUP BY ask_id)
SELECT ask_id, rank, key, greatest(n, coalesce(t, 0)) AS total, n > 1 AS ambiguous FROM (SELECT *, row_number() OVER (PARTITION BY ask_id ORDER BY place, key) AS rank FROM once) JOIN n USING (ask_id) LEFT JOIN t USING (ask_id) WHERE rank <= 10"""
)
def author_year_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works by author and year from the library and the index, further databases only where both have none: C12, R11."""
    found = _ladder(spark, sf_dir)[1].select("ask_id", F.col("work_id").alias("pos"), F.concat(F.lit("w"), F.col("work_id").cast("string")).alias("key"))
    indexed = found.where("pos % 2 = 0")
    total = indexed.groupBy("ask_id").agg((F.count(F.lit(1)) + 5).alias("total"))
    return sch.author_year_cascade(None, found.where("pos % 4 = 0"), indexed.join(total, "ask_id"), found)


@query("SELECT cand_id FROM candidates WHERE lower(coalesce(journal, '')) = 'quillham letters in synaptic biology'")
def in_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprints of one category: B11."""
    return read_table(spark, sf_dir, "candidates").where(sch.in_category(F.col("journal"), "Quillham_Letters_in_Synaptic_Biology")).select("cand_id")


_D = "[" + ", ".join(f"'{d}'" for d in sch.DOMAINS) + "]"


@query(
    f"""WITH d AS (SELECT doc_id, list_filter([{_D}[CAST(doc_id % 14 AS INT) + 1], CASE WHEN doc_id % 3 = 0 THEN 'Genomics' ELSE 'astronomy' END, {_D}[CAST(doc_id % 5 AS INT) + 1], {_D}[CAST(doc_id % 9 AS INT) + 1]], lambda x: doc_id % 6 <> 1) AS ds FROM documents),
m AS (SELECT doc_id, list_transform(list_filter(list_transform(ds, lambda x: lower(x)), lambda x: list_contains({_D}, x)), lambda x: replace(x, ' ', '_')) AS ms FROM d)
SELECT doc_id, CASE WHEN len(ms) > 0 THEN array_to_string(ms[1:3], ',') ELSE '' END AS categories FROM m"""
)
def preprint_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preprint categories to search for a document's domains: R12."""
    d, known = F.col("doc_id"), F.array(*[F.lit(x) for x in sch.DOMAINS])
    nth = lambda n: F.element_at(known, (d % n + 1).cast("int"))
    domains = F.when(d % 6 != 1, F.array(nth(14), F.when(d % 3 == 0, "Genomics").otherwise("astronomy"), nth(5), nth(9))).otherwise(F.array().cast("array<string>"))
    return read_table(spark, sf_dir, "documents").select("doc_id", F.array_join(sch.categories_of(domains), ",").alias("categories"))


@query(
    """WITH n AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS a, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, round(max(a - n * 3600e0) OVER (PARTITION BY user_id ORDER BY n) + n * 3600e0, 3) AS slot FROM n"""
)
def call_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When calls may go, an hour apart for each user: I3."""
    return sch.call_slots(read_table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 3600.0).select("event_id", F.round("slot", 3).alias("slot"))


@query()
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls of tools with their arguments by schema, or what is wrong with them: J9, J10."""
    names = [*sch.TOOLS, *sch.ANSWER_TOOLS, "no_such_tool"]
    tool = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    args = F.when(F.col("event_id") % 5 == 0, "not json").otherwise(F.to_json(F.struct(F.col("event_type").alias("query"), F.lit(5).alias("max_results"), F.lit("dropped").alias("more"))))
    return sch.parsed_calls(read_table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), tool.alias("tool"), args.alias("args")))


# ---------------------------------------------------------------- operators of earlier modules that had no query


@query("SELECT marker_id, CASE marker_id % 5 WHEN 0 THEN 'ris' WHEN 1 THEN 'endnote_xml' WHEN 2 THEN 'unsupported: .docx' WHEN 3 THEN 'ris' ELSE 'unsupported: .bib' END AS importer FROM markers")
def importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The importer of a file by its name: A6."""
    path = F.element_at(F.array(*[F.lit(x) for x in ("a/b.ris", "b.XML", "c.docx", "d.e.RIS", "f.bib")]), (F.col("marker_id") % 5 + 1).cast("int"))
    return read_table(spark, sf_dir, "markers").select("marker_id", records.importer_of(path).alias("importer"))


@query(
    """SELECT entry_id, CASE WHEN regexp_matches(v, '^(?i)(?:pmid:?\\s*)?\\d{1,9}$') THEN 'pmid' WHEN regexp_matches(v, '^(?i)(?:pmcid:?\\s*)?pmc\\s?\\d{4,9}$') THEN 'pmcid' WHEN regexp_matches(v, '^(?i)(?:doi:?\\s*|https?://\\S+/)?10\\.\\d{4,9}/\\S+$') THEN 'doi'
WHEN regexp_matches(v, '^(?i)https?://') THEN 'url' ELSE 'text' END AS kind FROM (SELECT entry_id, trim(coalesce(CASE entry_id % 3 WHEN 0 THEN pmid WHEN 1 THEN doi ELSE title END, '')) AS v FROM bib_entries)"""
)
def identifier_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What kind of identifier was typed: B18."""
    i = F.col("entry_id") % 3
    typed = F.when(i == 0, F.col("pmid")).when(i == 1, F.col("doi")).otherwise(F.col("title"))
    return read_table(spark, sf_dir, "bib_entries").select("entry_id", idn.identifier_kind(typed).alias("kind"))


@query(
    """WITH f AS (SELECT doc_id, marker_id AS ord, marker_id * 10 AS s, CASE WHEN marker_id % 3 = 0 THEN marker_id * 10 + 10 ELSE marker_id * 10 + 7 END AS e FROM markers),
n AS (SELECT *, CASE WHEN lag(e) OVER (PARTITION BY doc_id ORDER BY ord) = s THEN 0 ELSE 1 END AS fresh FROM f) SELECT doc_id, ord, sum(fresh) OVER (PARTITION BY doc_id ORDER BY ord)::BIGINT AS cluster FROM n"""
)
def adjacent_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that touch each other as one cluster: E8, E13."""
    m = F.col("marker_id")
    fields = read_table(spark, sf_dir, "markers").select("doc_id", m.alias("ord"), (m * 10).alias("start"), F.when(m % 3 == 0, m * 10 + 10).otherwise(m * 10 + 7).alias("end"))
    return rv.adjacent_clusters(fields).select("doc_id", "ord", "cluster")


@query(
    """WITH l AS (SELECT *, loaded_at::DATE AS day FROM references_library WHERE loaded_at IS NOT NULL AND loaded_at >= TIMESTAMP '2015-01-01'), c AS (SELECT * FROM l ORDER BY loaded_at DESC, row_id LIMIT 500),
f AS (SELECT row_id, list_filter(['gut', 'permeability', 'mice'], lambda k: contains(lower(concat_ws(' ', title, abstract)), k)) AS found FROM c)
SELECT row_id, round(len(found) * 100e0 / 3, 6) AS score FROM f WHERE len(found) >= 2"""
)
def recent_then_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest records of a window, then ranked by keywords: A18, J4."""
    rows = read_table(spark, sf_dir, "references_library")
    got = rv.recent_then_ranked(rows, "loaded_at", F.lit("2015-01-01").cast("timestamp"), 500, ["gut", "permeability", "mice"], F.concat_ws(" ", "title", "abstract"))
    return got.select("row_id", "score")


@query(
    """WITH p AS (SELECT lower(trim(doi)) AS doi, CAST(row_id AS VARCHAR) AS version, CASE WHEN row_id % 2 = 0 THEN 'NA' WHEN row_id % 3 = 0 THEN NULL ELSE '10.5555/' || row_id END AS published_doi FROM references_library WHERE trim(doi) <> '' AND row_id < 1000000000)
SELECT doi, max(CAST(version AS BIGINT))::VARCHAR AS version, coalesce(nullif(arg_max(coalesce(published_doi, ''), CAST(version AS BIGINT)), 'NA'), '') AS published_doi FROM p GROUP BY doi"""
)
def last_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last version of each preprint: A19, J5."""
    r = F.col("row_id")
    published = F.when(r % 2 == 0, "NA").when(r % 3 == 0, None).otherwise(F.concat(F.lit("10.5555/"), r.cast("string")))
    rows = read_table(spark, sf_dir, "references_library").where("trim(doi) <> ''").select(F.lower(F.btrim("doi")).alias("doi"), r.cast("string").alias("version"), published.alias("published_doi"))
    return records.last_versions(rows)


@query("SELECT doc_id, CASE WHEN n <= 1200 THEN text ELSE CASE WHEN s > 0 THEN '…' || ltrim(substr(text, s + 1, e - s), ' ') ELSE substr(text, s + 1, e - s) END END AS part FROM (SELECT doc_id, text, length(text) AS n, length(text) AS e, length(text) - 1200 AS s FROM documents WHERE text IS NOT NULL)")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stretch of each text around its end: H9."""
    t = F.col("text")
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", doc.snippet(t, F.length(t), F.lit(0)).alias("part"))


@query(
    """SELECT marker_id, 'CLAIM: ' || extra_search || CASE WHEN extra_search = 1 THEN ' reference' ELSE ' references' END || chr(10) || '"' || text || '"' || CASE WHEN coalesce(sent_id, '') <> '' THEN chr(10) || 'Part: "' || sent_id || '"' ELSE '' END
|| chr(10) || 'Section: ' || kind || chr(10) || 'Preceding: "' || kind || '" "' || text || '"' AS message FROM markers WHERE text IS NOT NULL AND kind IS NOT NULL AND extra_search IS NOT NULL"""
)
def claim_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts by which claims are asked about: H10."""
    rows = read_table(spark, sf_dir, "markers").where("text is not null and kind is not null and extra_search is not null")
    none = F.array().cast("array<string>")
    return rows.select("marker_id", rv.claim_message(F.col("text"), F.col("sent_id"), F.col("kind"), F.array("kind", "text"), none, F.col("extra_search")).alias("message"))


@query("SELECT marker_id, CASE WHEN marker_id % 4 = 3 THEN 'a 2+ b' ELSE '(' || CASE marker_id % 4 WHEN 0 THEN '1-3, 9' WHEN 1 THEN '1-3,9' ELSE '2, 9' END || ')' END AS renumbered FROM markers")
def superscript_renumbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Superscript runs under new numbers, with what stands around them: H17, H19."""
    i = F.col("marker_id") % 4
    text = F.when(i == 0, "(4, 5, 6, 9)").when(i == 1, "(4-6,9)").when(i == 2, "(5, 9)").otherwise("a 2+ b")
    mapping = F.create_map(*[F.lit(x) for x in (4, 1, 5, 2, 6, 3)])
    return read_table(spark, sf_dir, "markers").select("marker_id", num.renumber_superscript(text, mapping).alias("renumbered"))


@query("SELECT marker_id, marker_id % 4 <> 3 AS numeric FROM markers")
def strictly_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a bracket group holds numbers only: R13."""
    i = F.col("marker_id") % 4
    text = F.when(i == 0, "4, 5-7").when(i == 1, "12").when(i == 2, "9–7;1").otherwise("4, 5a, x6")
    return read_table(spark, sf_dir, "markers").select("marker_id", num.strictly_numeric(text).alias("numeric"))


@query(
    """WITH s AS (SELECT marker_id, CAST(marker_id % 5 AS INT) AS n, CASE marker_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS slots FROM markers),
x AS (SELECT marker_id, n, slots, CAST(unnest(range(slots)) AS INT) AS i FROM s)
SELECT marker_id, i AS slot, CASE WHEN n = 4 AND slots = 2 THEN i * 3 ELSE least(i, n) END AS first, CASE WHEN n = 4 AND slots = 2 THEN CASE i WHEN 0 THEN 3 ELSE 4 END WHEN i = least(slots, n) - 1 THEN n ELSE least(i + 1, n) END AS "end" FROM x"""
)
def slot_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which selections belong to which slot: K6."""
    m = F.col("marker_id")
    sizes = F.when(m % 3 == 1, F.array(F.lit(3), F.lit(1)))
    rows = read_table(spark, sf_dir, "markers").select("marker_id", F.posexplode(evd.slot_ranges((m % 5).cast("int"), sizes, F.when(m % 3 == 0, 1).when(m % 3 == 1, 2).otherwise(3))).alias("slot", "r"))
    return rows.select("marker_id", "slot", F.col("r.first").alias("first"), F.col("r.end").alias("end"))


@query("SELECT doc_id, CASE WHEN doc_id % 29 = 0 THEN 'analysis_failed' WHEN doc_id % 23 = 0 THEN 'newer_version' WHEN doc_id % 19 = 0 THEN 'foreign' WHEN doc_id % 7 = 0 THEN 'tracked' WHEN doc_id % 5 = 0 THEN 'stripped' WHEN doc_id % 3 = 0 THEN 'legacy' ELSE 'fresh' END AS mode FROM documents")
def document_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a document is treated: R3."""
    d = F.col("doc_id")
    return read_table(spark, sf_dir, "documents").select("doc_id", evd.document_mode(*[d % n == 0 for n in (29, 23, 19, 7, 5, 3)]).alias("mode"))


@query("SELECT marker_id, CASE marker_id % 3 WHEN 0 THEN 'Smith 2000; ref 7' WHEN 1 THEN 'Smith 2000' ELSE 'Smith 2000; Roe 2001; ref 3' END AS label FROM markers")
def author_date_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracket groups as author-date labels: R5, H31."""
    i = F.col("marker_id") % 3
    text = F.when(i == 0, "1, 7").when(i == 1, "1;1").otherwise("1-3")
    labels = F.create_map(F.lit(1), F.lit("Smith 2000"), F.lit(2), F.lit("Roe 2001"))
    return read_table(spark, sf_dir, "markers").select("marker_id", rv.to_author_date(text, labels).alias("label"))


@query(
    """SELECT row_id, CASE WHEN n > 3 AND octet_length(encode(coalesce(abstract, ''))) > 900 THEN 3 ELSE n END AS kept, n > 3 AND octet_length(encode(coalesce(abstract, ''))) > 900 AS truncated FROM (SELECT row_id, abstract, len(authors) AS n FROM references_library WHERE authors IS NOT NULL)"""
)
def truncated_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large items with their first authors only: H39."""
    rows = read_table(spark, sf_dir, "references_library").where("authors is not null")
    t = rows.select("row_id", rv.truncated_item(F.coalesce("abstract", F.lit("")), F.col("authors"), 900, 3).alias("t"))
    return t.select("row_id", F.size("t.authors").alias("kept"), "t.truncated")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN json_extract_string(props, '$.k') WHEN 1 THEN json_extract_string(props, '$.k') WHEN 2 THEN json_extract_string(props, '$.k') END AS k FROM events")
def lenient_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects in answers: alone, fenced, amid text, or none: H40."""
    i, p = F.col("event_id") % 4, F.col("props")
    text = F.when(i == 0, p).when(i == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(i == 2, F.concat(F.lit('Well {"x: '), p, F.lit(" } so"))).otherwise("no { json")
    return read_table(spark, sf_dir, "events").select("event_id", F.get_json_object(rv.lenient_json_column(text), "$.k").alias("k"))


@query("SELECT entry_id, array_to_string(list_filter(['record/' || nullif(trim(coalesce(record_uuid, '')), ''), 'https://doi.org/' || nullif(regexp_replace(" + _BARE_DOI + ", '^doi:\\s*', ''), ''), 'https://pubmed.ncbi.nlm.nih.gov/' || nullif(trim(coalesce(pmid, '')), '')], lambda u: u IS NOT NULL), ' ') AS uris FROM bib_entries WHERE coalesce(record_uuid, '') = trim(coalesce(record_uuid, '')) AND coalesce(pmid, '') = trim(coalesce(pmid, ''))")
def record_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The addresses under which entries' works are known: H37."""
    rows = read_table(spark, sf_dir, "bib_entries").where("coalesce(record_uuid, '') = trim(coalesce(record_uuid, '')) and coalesce(pmid, '') = trim(coalesce(pmid, ''))")
    return rows.select("entry_id", F.array_join(idn.record_uris(F.col("record_uuid"), F.col("doi"), F.col("pmid")), " ").alias("uris"))


@query(
    """SELECT marker_id, array_to_string(CASE WHEN marker_id % 4 = 0 THEN ['SUGGESTED'] WHEN marker_id % 4 = 1 AND contains(coalesce(text, ''), '(REF)') THEN ['REF'] WHEN marker_id % 4 = 1 AND contains(coalesce(text, ''), '(REFS)') THEN ['REFS'] WHEN marker_id % 4 < 3 THEN ['REF', 'REF'] ELSE [] END, ',') AS kinds FROM markers"""
)
def legacy_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marker kinds of sentences from older projects: R1."""
    i = F.col("marker_id") % 4
    kinds = F.when(i == 0, F.array(F.lit("SUGGESTED"))).when(i == 1, F.array().cast("array<string>"))
    text = F.when(i == 1, F.col("text"))
    return read_table(spark, sf_dir, "markers").select("marker_id", F.array_join(mk.legacy_kinds(kinds, F.when(i < 3, "REF"), F.lit(2), text), ",").alias("kinds"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'all' WHEN doc_id % 2 = 0 THEN 'legacy' ELSE 'ids' END AS grammar FROM documents")
def run_grammars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grammar by which a project is exported: R2."""
    d = F.col("doc_id")
    return read_table(spark, sf_dir, "documents").select("doc_id", mk.run_grammar(F.when(d % 3 == 0, "all"), d % 2 == 0, F.lit("ids")).alias("grammar"))


@query()
def stripped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without their markers, by the full grammar: B2."""
    return read_table(spark, sf_dir, "sentences").select("block_id", mk.stripped(F.col("raw_text")).alias("text"))


@query()
def prescan_by_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers per document by what has to be done for them, by the full grammar: D5, B5."""
    return mk.prescan(mk.marker_rows(read_table(spark, sf_dir, "documents"), ["doc_id"], "text"), ["doc_id"])


@query("SELECT doc_id, 'citation' AS kind, 1::BIGINT AS n_fields, 0::BIGINT AS incomplete, '' AS problems FROM documents WHERE doc_id % 2 = 1 UNION ALL SELECT doc_id, 'foreign', 1, 0, '' FROM documents WHERE doc_id % 2 = 0")
def docx_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of Word files by whose they are, with their problems: A4, A5, R7."""
    rows = read_table(spark, sf_dir, "documents").select("doc_id", docx.with_field(F.when(F.col("doc_id") % 2 == 1, "ADDIN MY.CITE {}").otherwise("ADDIN ZOTERO_ITEM {}"), F.lit("[1]")).alias("content"))
    fields = docx.fields(rows, "doc_id", "content")
    kinds = fields.groupBy("doc_id").agg(F.first(docx.field_kind(F.col("code"))).alias("kind"))
    return docx.field_problems(fields, "doc_id").join(kinds, "doc_id").select("doc_id", "kind", "n_fields", "incomplete", F.array_join("problems", ",").alias("problems"))


_STYLE_ROWS = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x).lower() for x in row) + ")" for row in num.STYLES)


@query(f"SELECT * FROM (VALUES {_STYLE_ROWS}) AS s(style, prefix, suffix, delimiter, collapse, superscript, author_date, number_prefix, number_suffix)")
def style_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of citations read from style files, which are written from the table of styles first: A20."""
    attr = lambda name, c: F.concat(F.lit(f' {name}="'), records.escape_xml(F.col(c)), F.lit('"'))
    head = F.concat(F.lit('<style xmlns="http://purl.org/net/xbiblio/csl"><citation'), F.when(F.col("collapse"), ' collapse="citation-number"').otherwise(""), F.lit("><layout"), attr("prefix", "prefix"), attr("suffix", "suffix"), attr("delimiter", "delimiter"), F.when(F.col("superscript"), ' vertical-align="sup"').otherwise(""), F.lit(">"))
    xml = F.concat(head, F.lit("<group"), attr("prefix", "number_prefix"), attr("suffix", "number_suffix"), F.lit('><text variable="citation-number"/></group></layout></citation></style>'))
    rows = num.styles(spark).select("style", "author_date", num.style_layouts(xml, F.col("author_date"), F.lit(False)).alias("l"))
    return rows.select("style", "l.prefix", "l.suffix", "l.delimiter", "l.collapse", "l.superscript", "author_date", "l.number_prefix", "l.number_suffix")


@query(
    """SELECT row_id, substr(coalesce(abstract, ''), 1, 2000) AS abstract, array_to_string(list_transform(authors[1:6], lambda a: trim(concat_ws(' ', a.last_name, a.initials))), ', ') || CASE WHEN len(authors) > 6 THEN ' et al.' ELSE '' END AS authors, array_to_string(coalesce(mesh_terms, [])[1:10], '; ') AS mesh FROM references_library WHERE authors IS NOT NULL"""
)
def summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works as they are shown in short: B14."""
    rows = read_table(spark, sf_dir, "references_library").where("authors is not null")
    return rows.select("row_id", *records.summary(F.col("abstract"), F.col("authors"), F.col("mesh_terms")))


@query(f"SELECT entry_id, coalesce(record_uuid, '') AS uuid, regexp_replace({_BARE_DOI}, '/+$', '') AS doi, coalesce(pmid, '') AS pmid FROM bib_entries WHERE coalesce(record_uuid, '') = trim(coalesce(record_uuid, '')) AND coalesce(pmid, '') = trim(coalesce(pmid, '')) AND NOT starts_with({_BARE_DOI}, 'doi:')")
def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What entries' works are, read back from their addresses: H37."""
    rows = read_table(spark, sf_dir, "bib_entries").where("coalesce(record_uuid, '') = trim(coalesce(record_uuid, '')) and coalesce(pmid, '') = trim(coalesce(pmid, ''))").where(~idn.library_doi(F.col("doi")).startswith("doi:"))
    return rows.select("entry_id", idn.identity_from_uris(idn.record_uris(F.col("record_uuid"), F.col("doi"), F.col("pmid"))).alias("i")).select("entry_id", "i.*")


@query("SELECT marker_id, concat_ws(',', CASE WHEN marker_id % 3 = 0 THEN 'low' END, CASE WHEN marker_id % 4 <> 1 THEN 'unresolved' END, CASE WHEN marker_id % 5 = 0 THEN 'warnings' END, CASE WHEN kind = 'SUGGESTED' THEN 'suggested' END) AS views FROM markers")
def review_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views of a review in which each marker is shown: B7."""
    m = F.col("marker_id")
    warnings = F.when(m % 5 == 0, F.array(F.lit("w"))).otherwise(F.array().cast("array<string>"))
    views = rv.review_filters(F.when(m % 3 == 0, "LOW").otherwise("HIGH"), F.when(m % 4 == 1, True), warnings, F.col("kind"))
    return read_table(spark, sf_dir, "markers").select("marker_id", F.array_join(views, ",").alias("views"))


@query(f"WITH {_ENTRIES}, {_GROUPS[len(_HEADS) + 2 :]}, v AS (SELECT DISTINCT doc_id, number FROM numbered) SELECT doc_id, para_index, group_no, number FROM cited SEMI JOIN v USING (doc_id, number)")
def in_text_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed numbers that are entries of the document's bibliography: C10."""
    return doc.in_text_citations(doc.paragraphs(read_table(spark, sf_dir, "documents")))


@query("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\(REFS?\\)')) AS BIGINT) AS n_fields, md5(regexp_replace(text, '\\(REFS?\\)', '', 'g')) AS rest FROM documents WHERE regexp_matches(text, '\\(REFS?\\)')")
def docx_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word files with a field in place of each marker, read again: A4, A24."""
    docs = read_table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\(REFS?\)"))
    files = docs.select("doc_id", docx.with_citations(F.col("text"), r"\(REFS?\)", "ADDIN MY.CITE {}", "").alias("content"))
    n = docx.fields(files, "doc_id", "content").where(docx.field_kind(F.col("code")) == "citation").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_fields"))
    rest = docx.paragraphs(files, "doc_id", "content").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("para_index", "text"))).alias("p"))
    return n.join(rest, "doc_id").select("doc_id", "n_fields", F.md5(F.array_join(F.transform("p", lambda p: p["text"]), "\n")).alias("rest"))


@query(
    """WITH f AS (SELECT title AS k, arg_min({'journal': journal, 'year': year, 'n': len(authors)}, cand_id) AS f FROM candidates WHERE title IS NOT NULL GROUP BY title)
SELECT entry_id, coalesce(nullif(trim(journal), ''), f.f.journal, '') AS journal, coalesce(nullif(year, 0), f.f.year, 0) AS year, CASE WHEN entry_id % 2 = 0 THEN 1 ELSE f.f.n END AS n_authors FROM bib_entries e LEFT JOIN f ON f.k = e.title"""
)
def review_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries filled from the works of the same title: K4."""
    c = read_table(spark, sf_dir, "candidates").where("title is not null").groupBy("title").agg(F.min_by(F.struct("journal", "year", "authors"), "cand_id").alias("f")).select("title", "f.*")
    one = F.array(F.struct(F.lit("x").alias("last_name"), F.lit("").alias("first_name"), F.lit("").alias("initials")))
    e = read_table(spark, sf_dir, "bib_entries").withColumn("authors", F.when(F.col("entry_id") % 2 == 0, one))
    ids = e.select("entry_id", F.col("title").alias("k"))
    found = ids.join(c, F.col("k") == F.col("title")).select("entry_id", "journal", "year", "authors")
    out = lib.review_merged(e.select("entry_id", "journal", "year", "authors"), found, "entry_id", ["journal"])
    return out.select("entry_id", "journal", "year", F.when(F.col("authors").isNotNull(), F.size("authors")).alias("n_authors"))


@query(
    """WITH p AS (SELECT trim(pmid) AS pmid, min(pmcid) AS c FROM references_library WHERE trim(pmid) <> '' AND pmcid <> '' GROUP BY 1), d AS (SELECT trim(doi) AS doi, min(pmcid) AS c FROM references_library WHERE trim(doi) <> '' AND pmcid <> '' GROUP BY 1)
SELECT row_id AS work_id, coalesce(nullif(CASE WHEN row_id % 3 = 0 THEN r.pmcid END, ''), p.c, d.c, '') AS pmcid FROM references_library r LEFT JOIN p ON p.pmid = trim(r.pmid) LEFT JOIN d ON d.doi = trim(r.doi)"""
)
def full_text_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-text identifiers: given, by PMID, by DOI: R9."""
    rows = read_table(spark, sf_dir, "references_library").select("row_id", "pmcid", F.btrim("pmid").alias("pmid"), F.btrim("doi").alias("doi"))
    works = rows.select(F.col("row_id").alias("work_id"), "pmid", "doi", F.when(F.col("row_id") % 3 == 0, F.col("pmcid")).alias("pmcid"))
    return lib.full_text_id(works, rows.select("pmid", "pmcid"), rows.select("doi", "pmcid"))


@query("SELECT doc_id, count(DISTINCT title) FILTER (WHERE entry_id % 3 <> 0 AND coalesce(title, '') <> '') AS addable, count(*) FILTER (WHERE entry_id % 3 <> 0) AS accepted, count(*) AS total, bool_and(entry_id % 3 <> 0) AS all_accepted FROM bib_entries GROUP BY doc_id")
def addable_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted selections of each document and the distinct works among them: D11."""
    ok = F.col("entry_id") % 3 != 0
    named = F.when(ok & (F.coalesce("title", F.lit("")) != ""), F.col("title"))
    return read_table(spark, sf_dir, "bib_entries").groupBy("doc_id").agg(F.count_distinct(named).alias("addable"), F.count_if(ok).alias("accepted"), F.count(F.lit(1)).alias("total"), F.every(ok).alias("all_accepted"))


@query(
    """WITH k AS (SELECT DISTINCT title FROM references_library WHERE title IS NOT NULL), c AS (SELECT cand_id, CASE WHEN coalesce(trim(c.title), '') = '' THEN 'skipped' WHEN k.title IS NOT NULL THEN 'updated' ELSE 'imported' END AS status FROM candidates c LEFT JOIN k ON k.title = c.title)
SELECT status, count(*) AS n FROM c GROUP BY status"""
)
def import_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of an import are new, known or skipped: D8."""
    known = read_table(spark, sf_dir, "references_library").select("title", F.lit(True).alias("known")).where("title is not null").distinct()
    status = F.when(F.coalesce(F.btrim("title"), F.lit("")) == "", "skipped").when(F.col("known"), "updated").otherwise("imported")
    return read_table(spark, sf_dir, "candidates").join(known, "title", "left").groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT doc_id, CASE WHEN s + b = 0 THEN 'none' WHEN s >= b THEN 'superscript' ELSE 'bracket' END AS style FROM (SELECT doc_id, len(regexp_extract_all(text, '[a-z]\\.[0-9]+')) AS s, len(regexp_extract_all(text, '\\[[0-9]')) AS b FROM documents WHERE text IS NOT NULL)"""
)
def style_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document's citations are raised or bracketed, by vote: D6."""
    n = lambda pattern: F.size(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
    return read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", doc.style_vote(n(r"[a-z]\.[0-9]+"), n(r"\[[0-9]")).alias("style"))


@query()
def sub_claims_by_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each marker of a text stands for, up to its neighbours, by the full grammar: H7."""
    rows = read_table(spark, sf_dir, "sentences").where(F.contains("raw_text", F.lit("("))).select("block_id", "raw_text", mk.markers_column(F.col("raw_text")).alias("ms"))
    parts = rows.select("block_id", F.posexplode(doc.sub_claims_at(F.col("raw_text"), F.col("ms"))).alias("p", "c"))
    return parts.select("block_id", (F.col("p") + 1).alias("marker"), "c.before", "c.after")
