"""Queries of selection and review, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import identity as idn
from citeloom.operators import documents as doc
from citeloom.operators import review as rv
from citeloom.plans.reference import _GROUPS, _HEADS, _ENTRIES
from citeloom.session import read_table

KEYWORDS = ["gut", "permeability", "microglia", "secretion", "aged rats"]


def self_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of text in which authors speak of their own work: B17."""
    return read_table(spark, sf_dir, "sentences").select("block_id", rv.speaks_of_itself(F.col("raw_text")).alias("own"))


def keyword_overlap_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library rows by the share of keywords in them, the best thirty: F5, H25."""
    rows = read_table(spark, sf_dir, "references_library")
    ranked = rv.keyword_ranking(rows, KEYWORDS, F.concat_ws(" ", "title", "abstract"))
    return ranked.orderBy(F.desc("score"), "row_id").limit(30).select("row_id", "score", F.array_join("found", " ").alias("found"))


def fuzzy_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and candidate works with like titles: C9, H26."""
    left = read_table(spark, sf_dir, "bib_entries").select(F.col("entry_id").alias("id"), "title", "year")
    right = read_table(spark, sf_dir, "candidates").select(F.col("cand_id").alias("id"), "title", "year")
    return rv.fuzzy_title_matches(left, right)


def legacy_adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents all of whose bracketed numbers are entries of their bibliography: K9."""
    paras = doc.paragraphs(read_table(spark, sf_dir, "documents"))
    body = paras.join(doc.references_start(paras), "doc_id", "left").where("heading_idx is null or para_index < heading_idx")
    groups = body.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(doc.BRACKET), F.lit(1))).alias("text"))
    return rv.adoptable(groups, doc.bibliography_entries(paras).select("doc_id", "number"))


def next_unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next open marker after each marker: F9."""
    rows = read_table(spark, sf_dir, "markers").select("doc_id", F.col("marker_id").alias("pos"), (F.col("marker_id") % 3 != 0).alias("resolved"))
    return rv.next_unresolved(rows)


def enrich_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries enriched by the candidate of the same title: K8."""
    entries = read_table(spark, sf_dir, "bib_entries").select("entry_id", F.coalesce("pmid", F.lit("")).alias("pmid"), F.coalesce("doi", F.lit("")).alias("doi"), "title", "year", "journal")
    works = read_table(spark, sf_dir, "candidates").select(idn.title_words(F.col("title")).alias("k"), "cand_id", "title", "year", "journal").where("k <> ''")
    best = works.groupBy("k").agg(F.min_by(F.struct("title", "year", "journal"), "cand_id").alias("w"))
    found = entries.select("entry_id", idn.title_words(F.col("title")).alias("k")).join(best, "k").select("entry_id", F.lit("").alias("pmid"), F.lit("").alias("doi"), "w.title", "w.year", "w.journal")
    return rv.enriched(entries, found)


_T = "trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g'))"
_TEXT = "lower(concat_ws(' ', title, abstract))"
_FOUND = "list_filter([" + ", ".join(f"'{k}'" for k in KEYWORDS) + f"], lambda k: contains({_TEXT}, k))"

QUERIES = {f.__name__: f for f in (self_reference, keyword_overlap_topk, fuzzy_title_match, legacy_adoption, next_unresolved, enrich_entries)}
ORACLES = {
    "self_reference": "SELECT block_id, coalesce(regexp_matches(raw_text, '(?i)\\b(?:our (?:lab|group|team|previous|earlier|own)|our|we|in our hands)\\b'), false) AS own FROM sentences",
    "keyword_overlap_topk": f"WITH f AS (SELECT row_id, {_FOUND} AS found FROM references_library) SELECT row_id, round(len(found) * 100e0 / {len(KEYWORDS)}, 6) AS score, array_to_string(found, ' ') AS found FROM f WHERE len(found) >= 2 ORDER BY score DESC, row_id LIMIT 30",
    "legacy_adoption": f"WITH {_ENTRIES}, {_GROUPS[len(_HEADS) + 2 :]}, k AS (SELECT DISTINCT doc_id, number, true AS known FROM numbered) SELECT c.doc_id, bool_and(coalesce(known, false)) AS adopt FROM cited c LEFT JOIN k ON k.doc_id = c.doc_id AND k.number = c.number GROUP BY c.doc_id",
    "next_unresolved": "WITH r AS (SELECT doc_id, marker_id AS pos, marker_id % 3 <> 0 AS resolved FROM markers) SELECT doc_id, pos, resolved, coalesce(min(CASE WHEN NOT resolved THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(CASE WHEN NOT resolved THEN pos END) OVER (PARTITION BY doc_id)) AS next_pos FROM r",
    "enrich_entries": f"WITH w AS (SELECT {_T} AS k, arg_min({{'title': title, 'year': year, 'journal': journal}}, cand_id) AS w FROM candidates WHERE {_T} <> '' GROUP BY 1) SELECT entry_id, coalesce(pmid, '') AS pmid, coalesce(doi, '') AS doi, coalesce(nullif(w.w.title, ''), e.title) AS title, coalesce(nullif(w.w.year, 0), e.year) AS year, coalesce(nullif(w.w.journal, ''), e.journal) AS journal, w.k IS NOT NULL AS enriched FROM (SELECT *, {_T} AS k FROM bib_entries) e LEFT JOIN w ON w.k = e.k",
}
