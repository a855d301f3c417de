"""Queries of the training-data operators of this subpackage and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import copies, leakage, linkage, names, packing, pii, sentences, survivor
from citeloom.session import cut_lineage, read_table


def _given_names(spark: SparkSession, sf_dir: str) -> tuple[str, ...]:
    """Widespread given names and those that the literature databases spell out."""
    return pii.learned_names(read_table(spark, sf_dir, "candidates").select(F.explode("authors.first_name").alias("v")))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of rows that name the same person or the same organisation."""
    return names.same_entity_pairs(p1_entities(spark, sf_dir))


def p1_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity of every row."""
    rows = read_table(spark, sf_dir, "author_names")
    return names.resolve(rows, frozenset(_given_names(spark, sf_dir)))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving row of each field of each group of copies in the reference library."""
    library = read_table(spark, sf_dir, "references_library")
    return survivor.library_survivors(library, copies.library_groups(library), read_table(spark, sf_dir, "source_trust"))


def p2_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p2_found, with rows that vote by the trust in their origin instead of the best one deciding alone."""
    library = read_table(spark, sf_dir, "references_library")
    return survivor.library_survivors(library, copies.library_groups(library), read_table(spark, sf_dir, "source_trust"), survivor.vote_weights)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every further copy of a reference with the smallest row id of its group."""
    groups = copies.library_groups(read_table(spark, sf_dir, "references_library"))
    return groups.where("row_id <> first_row_id")


def p4_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per canonical record with its number of copies."""
    library = read_table(spark, sf_dir, "references_library")
    keyed = library.select(F.col("row_id").alias("id"), copies.reference_key(F.col("doi"), F.col("title"), F.col("pmid")).alias("key"))
    return copies.collapse(keyed).select(F.col("first_id").alias("first_row_id"), "copies")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bibliography entry with every candidate that is the work it cites."""
    return p6_links(spark, sf_dir).select("entry_id", "cand_id")


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p6_found, with the confidence of each pair."""
    return linkage.linked(read_table(spark, sf_dir, "bib_entries"), read_table(spark, sf_dir, "candidates"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of every stored stretch of text."""
    return sentences.sentence_rows(read_table(spark, sf_dir, "sentences"), "block_id", F.col("raw_text"))


#: Setting that names the ranks file of the public tokenizer whose tokens measure the documents, and where it is by default.
TOKENIZER = ("spark.citeloom.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, in tokens of a public tokenizer."""
    counts = cut_lineage(packing.token_counts(read_table(spark, sf_dir, "documents"), "doc_id", "text", spark.conf.get(*TOKENIZER)))
    return packing.containers(counts)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold at least twelve consecutive words of an evaluation item."""
    found = leakage.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"), edits=1)
    return found.where("edits = 0").select("doc_id", "item_id")


def p9_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a window of an evaluation item within two word edits, with the least number of edits."""
    return leakage.leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items"), edits=2)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places of personal data in all documents."""
    return pii.found_places(read_table(spark, sf_dir, "documents"), "doc_id", F.col("text"), _given_names(spark, sf_dir))


def p10_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with typed placeholders in place of personal data."""
    return read_table(spark, sf_dir, "documents").select("doc_id", pii.redacted(F.col("text"), _given_names(spark, sf_dir)).alias("text"))


QUERIES = {"p1_found": p1_found, "p1_entities": p1_entities, "p2_found": p2_found, "p2_consensus": p2_consensus, "p4_found": p4_found, "p4_counts": p4_counts, "p6_found": p6_found, "p6_links": p6_links, "p7_found": p7_found, "p8_containers": p8_containers, "p9_found": p9_found, "p9_near": p9_near, "p10_found": p10_found, "p10_redacted": p10_redacted}

_BARE = "regexp_replace(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '^[^\\p{{L}}\\p{{N}}]+', ''), '^https?://[^/]*/', ''), '^(?:doi|pmid)[^\\p{{L}}\\p{{N}}]*', '')"
_KEYED = f"""
bare AS (SELECT row_id, {_BARE.format('doi')} AS d, {_BARE.format('pmid')} AS p, title FROM references_library WHERE row_id IS NOT NULL),
part AS (
  SELECT row_id, regexp_matches(d, '^10\\.\\d{{3,9}}\\s*/') AS d_doi, regexp_matches(p, '^10\\.\\d{{3,9}}\\s*/') AS p_doi,
    regexp_replace(d, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS x, regexp_replace(p, '[^\\p{{L}}\\p{{N}}]+', '', 'g') AS y,
    coalesce(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '') AS t FROM bare),
flag AS (SELECT *, (p_doi AND NOT d_doi) OR (regexp_matches(x, '^\\d+$') AND NOT d_doi AND NOT regexp_matches(y, '^\\d+$')) AS swapped FROM part),
keyed AS (SELECT row_id, CASE WHEN swapped THEN y ELSE x END AS doi_key, CASE WHEN swapped THEN x ELSE y END AS pmid_key, t FROM flag),
runs AS (SELECT row_id, min(row_id) OVER (PARTITION BY doi_key, pmid_key, t) AS first_row_id FROM keyed)"""

_SQUEEZED = "coalesce(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', '', 'g'), '')"
_FILLERS = ", ".join(f"'{x}'" for x in survivor.FILLERS)
_ORIGIN = f"regexp_replace({_SQUEEZED.format('source')}, '^(?:accepted|manualadd)', '')"
_P2 = f"""WITH {_KEYED},
sized AS (SELECT *, count(*) OVER (PARTITION BY first_row_id) AS n FROM runs),
trusted AS (SELECT {_ORIGIN} AS origin, max(trust) AS trust FROM source_trust GROUP BY 1),
member AS (SELECT s.first_row_id, l.row_id, coalesce(t.trust, -2147483648) AS trust, l.added_at, l.abstract, l.journal_abbrev, l.journal
  FROM sized s JOIN (SELECT *, {_ORIGIN} AS origin FROM references_library) l USING (row_id) LEFT JOIN trusted t USING (origin) WHERE s.n > 1),
long AS (
  SELECT first_row_id, 'abstract' AS field_name, row_id, trust, added_at FROM member
  WHERE {_SQUEEZED.format('abstract')} NOT IN ({_FILLERS}) AND NOT regexp_matches(abstract, '{survivor.NOTICES}')
    AND regexp_matches(abstract, '[.!?。！？।]["''”’»)\\]]*\\s*$') AND NOT regexp_matches(abstract, '{survivor.CUT_MARK}')
    AND NOT regexp_matches(abstract, '[\\s(=<>]\\d+\\.\\s*$')
    AND length(regexp_replace(abstract, '[^(]', '', 'g')) = length(regexp_replace(abstract, '[^)]', '', 'g'))
  UNION ALL
  SELECT first_row_id, 'journal_abbrev', row_id, trust, added_at FROM member
  WHERE {_SQUEEZED.format('journal_abbrev')} NOT IN ({_FILLERS}) AND NOT regexp_matches(journal_abbrev, '{survivor.CUT_MARK}')
    AND {_SQUEEZED.format('journal_abbrev')} <> {_SQUEEZED.format('journal')}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY first_row_id, field_name ORDER BY trust DESC, added_at DESC NULLS LAST, row_id) AS r FROM long)
SELECT first_row_id, field_name, row_id FROM ranked WHERE r = 1"""

ORACLES = {
    "p2_found": _P2,
    "p4_found": f"WITH {_KEYED} SELECT first_row_id, row_id FROM runs WHERE row_id <> first_row_id",
    "p4_counts": f"WITH {_KEYED} SELECT first_row_id, count(*) AS copies FROM runs GROUP BY first_row_id",
}
