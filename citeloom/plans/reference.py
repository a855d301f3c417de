"""Queries of the reference's own operators over the test tables, each with its SQL equivalent where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions import evidence_text as ev
from citeloom.functions import identity as idn
from citeloom.functions import numbers as num
from citeloom.operators import documents as doc
from citeloom.operators import evidence as evd
from citeloom.operators import flatten
from citeloom.operators import library as lib
from citeloom.operators import markers as mk
from citeloom.operators import numbering as nb
from citeloom.operators import segmentation as seg
from citeloom.session import cut_lineage, read_table
from citeloom.sources import docx, fulltext, records, stores

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


def _q(text: str) -> str:
    return text.replace("'", "''")


# SQL fragments that several queries share
_DOI = "lower(regexp_replace(trim(coalesce(doi, '')), '^https?://(?:dx\\.)?doi\\.(?:org|example)/', '', 'i'))"
_PMC = "CASE WHEN regexp_matches(upper(trim(coalesce(pmcid, ''))), '^\\d+$') THEN 'PMC' || upper(trim(pmcid)) WHEN regexp_matches(upper(trim(coalesce(pmcid, ''))), '^PMC\\d+$') THEN upper(trim(pmcid)) ELSE '' END"
_TITLE = "trim(regexp_replace(lower(coalesce(title, '')), '[^a-z0-9]+', ' ', 'g'))"
_KEY = f"CASE WHEN coalesce(pmid, '') <> '' THEN 'pmid:' || trim(pmid) WHEN {_DOI} <> '' THEN 'doi:' || {_DOI} WHEN {_TITLE} <> '' THEN 'title:' || substr({_TITLE}, 1, 240) ELSE '' END"
_LINES = "lines AS (SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS para_index, trim(unnest(string_split(text, chr(10)))) AS text FROM documents)"
_HEADS = f"{_LINES}, heads AS (SELECT doc_id, min(para_index) AS heading_idx FROM lines WHERE regexp_matches(text, '^(?i)(?:References|Bibliography|Literature Cited|Works Cited)\\s*$') GROUP BY doc_id)"
_BOUNDS = f"""{_HEADS},
after_head AS (SELECT l.*, heading_idx FROM lines l JOIN heads USING (doc_id) WHERE para_index > heading_idx),
stops AS (SELECT doc_id, min(para_index) AS stop FROM after_head WHERE NOT regexp_matches(text, '^\\[?(\\d+)[.\\s)\\]]+\\s*(.+)') AND text <> '' GROUP BY doc_id),
inside AS (SELECT a.* FROM after_head a LEFT JOIN stops USING (doc_id) WHERE regexp_matches(text, '^\\[?(\\d+)[.\\s)\\]]+\\s*(.+)') AND (stop IS NULL OR para_index < stop)),
bounds AS (SELECT h.doc_id, heading_idx, coalesce(first_entry, -1) AS first_entry, coalesce(last_entry, -1) AS last_entry FROM heads h
  LEFT JOIN (SELECT doc_id, min(para_index) AS first_entry, max(para_index) AS last_entry FROM inside GROUP BY doc_id) USING (doc_id))"""
_ENTRIES = f"""{_BOUNDS},
entries AS (SELECT doc_id, para_index, TRY_CAST(regexp_extract(text, '^\\[?(\\d+)[.\\s)\\]]+\\s*(.+)', 1) AS INT) AS number, trim(regexp_extract(text, '^\\[?(\\d+)[.\\s)\\]]+\\s*(.+)', 2)) AS body FROM inside),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, number ORDER BY para_index) AS copy_no FROM entries WHERE number IS NOT NULL)"""
_EXPAND = "list_filter(flatten(list_transform(string_split_regex(inner_text, '[;,]\\s*'), lambda t: CASE WHEN regexp_matches(trim(t), '^\\d+\\s*[-–]\\s*\\d+$') THEN CASE WHEN TRY_CAST(regexp_extract(trim(t), '^(\\d+)', 1) AS INT) <= TRY_CAST(regexp_extract(trim(t), '(\\d+)$', 1) AS INT) THEN range(TRY_CAST(regexp_extract(trim(t), '^(\\d+)', 1) AS INT), TRY_CAST(regexp_extract(trim(t), '(\\d+)$', 1) AS INT) + 1) ELSE range(TRY_CAST(regexp_extract(trim(t), '^(\\d+)', 1) AS INT), TRY_CAST(regexp_extract(trim(t), '(\\d+)$', 1) AS INT) - 1, -1) END WHEN regexp_matches(trim(t), '^\\d+$') THEN [CAST(trim(t) AS BIGINT)] ELSE [] END)), lambda n: n IS NOT NULL)"
_GROUPS = f"""{_HEADS},
found AS (SELECT l.doc_id, para_index, regexp_extract_all(text, '\\[(\\d+(?:\\s*[,;\\-–]\\s*\\d+)*)\\]', 1) AS g FROM lines l LEFT JOIN heads USING (doc_id) WHERE heading_idx IS NULL OR para_index < heading_idx),
groups AS (SELECT doc_id, para_index, CAST(unnest(range(len(g))) AS INT) AS group_no, unnest(g) AS inner_text FROM found WHERE len(g) > 0),
cited AS (SELECT doc_id, para_index, group_no, CAST(unnest({_EXPAND}) AS INT) AS number FROM groups)"""


# ---------------------------------------------------------------- library

SEARCH = "kluv28 gut permeability 10.5555"


def _score_sql(tokens: list[str]) -> str:
    who = "lower(array_to_string(list_transform(coalesce(authors, []), lambda a: trim(concat_ws(' ', a.last_name, a.initials))), ' '))"
    parts = []
    for t in tokens:
        parts += [f"CASE WHEN contains(lower(coalesce({c}, '')), '{_q(t)}') THEN {p}e0 ELSE 0e0 END" for c, p in (("title", 12.0), ("abstract", 5.0))]
        parts += [f"CASE WHEN contains({who}, '{_q(t)}') THEN 3e0 ELSE 0e0 END", f"CASE WHEN contains(lower(coalesce(journal, '')), '{_q(t)}') THEN 2e0 ELSE 0e0 END"]
        parts += [f"CASE WHEN lower(pmid) = '{_q(t)}' THEN 30e0 ELSE 0e0 END", f"CASE WHEN {_DOI} <> '' AND contains({_DOI}, '{_q(t)}') THEN 20e0 ELSE 0e0 END"]
    return " + ".join(parts) + " + CASE WHEN coalesce(year, 0) <> 0 THEN least(greatest(year - 1990, 0), 40) * 0.02e0 ELSE 0e0 END"


@query(
    f"""WITH recent AS (SELECT * FROM references_library ORDER BY updated_at DESC NULLS LAST, row_id LIMIT 3000),
scored AS (SELECT *, {_score_sql(lib.query_tokens(SEARCH))} AS score FROM recent)
SELECT row_id, round(score, 6) AS score FROM scored WHERE score > 0 ORDER BY score DESC, coalesce(year, 0) DESC, updated_at DESC NULLS LAST, row_id LIMIT 10"""
)
def library_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranked search in the newest rows of the library: H24, F1-F3, J1."""
    return lib.search(read_table(spark, sf_dir, "references_library"), SEARCH).select("row_id", F.round("score", 6).alias("score"))


@query(
    f"""WITH scored AS (SELECT *, {_score_sql(lib.query_tokens(SEARCH))} AS score FROM references_library)
SELECT row_id, round(score, 6) AS score FROM scored WHERE score > 0.8 ORDER BY score DESC, coalesce(year, 0) DESC, updated_at DESC NULLS LAST, row_id LIMIT 50"""
)
def library_topk_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the whole library, rows with a hit only."""
    found = lib.search(read_table(spark, sf_dir, "references_library"), SEARCH, 50, None, True)
    return found.select("row_id", F.round("score", 6).alias("score"))


@query("SELECT row_id FROM references_library ORDER BY updated_at DESC NULLS LAST, row_id LIMIT 50")
def library_recency_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An empty search gives the newest rows: F2, F3."""
    return lib.search(read_table(spark, sf_dir, "references_library"), "", 80).select("row_id")


@query(
    f"""SELECT row_id, {_KEY} AS library_key, {_DOI} AS library_doi, regexp_replace({_DOI}, '^doi:\\s*', '') AS item_doi, regexp_replace({_DOI}, '\\.+$', '') AS resolver_doi, {_PMC} AS library_pmcid,
coalesce(nullif(pmid, ''), nullif(doi, ''), nullif(title, ''), '') AS plain_key, substr({_TITLE}, 1, 60) AS title_alias FROM references_library"""
)
def identity_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key functions side by side: H27."""
    c = F.col
    return read_table(spark, sf_dir, "references_library").select(
        "row_id", idn.library_key(c("pmid"), c("doi"), c("title")).alias("library_key"), idn.library_doi(c("doi")).alias("library_doi"), idn.item_doi(c("doi")).alias("item_doi"), idn.resolver_doi(c("doi")).alias("resolver_doi"),
        idn.library_pmcid(c("pmcid")).alias("library_pmcid"), idn.plain_key(c("pmid"), c("doi"), c("title")).alias("plain_key"), F.substring(idn.title_words(c("title")), 1, 60).alias("title_alias"),
    )


_ASKED_IDS = f"""asked AS (SELECT row_id AS ask_id, 'pmid' AS kind, trim(pmid) AS value FROM references_library WHERE library_id = 'lib-commons' AND trim(coalesce(pmid, '')) <> '' UNION ALL SELECT row_id, 'doi', {_DOI} FROM references_library WHERE library_id = 'lib-commons' AND trim(coalesce(doi, '')) <> '' UNION ALL SELECT row_id, 'pmcid', {_PMC} FROM references_library WHERE library_id = 'lib-commons' AND trim(coalesce(pmcid, '')) <> '')"""


@query(
    f"""WITH {_ASKED_IDS},
known AS (SELECT 'pmid' AS kind, trim(coalesce(pmid, '')) AS value, row_id, updated_at FROM references_library UNION ALL SELECT 'doi', {_DOI}, row_id, updated_at FROM references_library UNION ALL SELECT 'pmcid', {_PMC}, row_id, updated_at FROM references_library),
best AS (SELECT *, row_number() OVER (PARTITION BY kind, value ORDER BY updated_at DESC NULLS LAST, row_id) AS r FROM known WHERE value <> '')
SELECT ask_id, kind, row_id FROM asked JOIN best USING (kind, value) WHERE r = 1"""
)
def identifier_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of the shared library among all rows, the last updated row wins: C1."""
    library = read_table(spark, sf_dir, "references_library")
    asked = library.where("library_id = 'lib-commons'")
    ask = lambda kind: asked.where(F.btrim(kind) != "").select(F.col("row_id").alias("ask_id"), F.lit(kind).alias("kind"), F.col(kind).alias("value"))
    return lib.identifier_lookup(ask("pmid").unionByName(ask("doi")).unionByName(ask("pmcid")), library)


_LASTWORD = "lower(list_last(string_split_regex(trim(coalesce({}, '')), '\\s+')))"


def _author_year_asked(library: DataFrame) -> DataFrame:
    last = lambda i: F.try_element_at("authors.last_name", F.lit(i))
    return library.where("library_id = 'lib-commons'").select(F.col("row_id").alias("ask_id"), last(1).alias("author"), F.when(F.col("row_id") % 2 == 0, last(2)).alias("coauthor"), "year")


@query(
    f"""WITH recent AS (SELECT row_id, year, authors, row_number() OVER (PARTITION BY year ORDER BY updated_at DESC NULLS LAST, row_id) AS r FROM references_library WHERE year > 0),
named AS (SELECT row_id, year, list_transform(authors, lambda a: {_LASTWORD.format('a.last_name')}) AS names FROM recent WHERE r <= 50),
flat AS (SELECT row_id, year, names, unnest(names) AS name, unnest(range(len(names))) AS pos FROM named),
people AS (SELECT row_id, year, name, min(pos) AS pos, any_value(names) AS names FROM flat GROUP BY row_id, year, name),
asked AS (SELECT row_id AS ask_id, year, {_LASTWORD.format('authors[1].last_name')} AS name, CASE WHEN row_id % 2 = 0 AND trim(authors[2].last_name) <> '' THEN {_LASTWORD.format('authors[2].last_name')} END AS second FROM references_library WHERE library_id = 'lib-commons'),
hit AS (SELECT ask_id, row_id, CASE WHEN pos = 0 THEN 1 ELSE 2 END AS priority FROM asked JOIN people USING (year, name) WHERE name <> '' AND (second IS NULL OR list_contains(names, second))),
best AS (SELECT *, min(priority) OVER (PARTITION BY ask_id) AS b FROM hit)
SELECT DISTINCT ask_id, row_id, priority FROM best WHERE priority = b"""
)
def author_year_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Author-year citations in the library, first authors before any author: C2, H35."""
    library = read_table(spark, sf_dir, "references_library")
    return lib.author_year_lookup(_author_year_asked(library), library)


@query(
    f"""WITH named AS (SELECT row_id, year, list_transform(authors, lambda a: {_LASTWORD.format('a.last_name')}) AS names FROM references_library WHERE year > 0),
flat AS (SELECT row_id, year, names, unnest(names) AS name, unnest(range(len(names))) AS pos FROM named),
people AS (SELECT row_id, year, name, min(pos) AS pos, any_value(names) AS names FROM flat GROUP BY row_id, year, name),
asked AS (SELECT row_id AS ask_id, year, {_LASTWORD.format('authors[1].last_name')} AS name, CASE WHEN row_id % 2 = 0 AND trim(authors[2].last_name) <> '' THEN {_LASTWORD.format('authors[2].last_name')} END AS second FROM references_library WHERE library_id = 'lib-commons'),
hit AS (SELECT ask_id, row_id, CASE WHEN pos = 0 THEN 1 ELSE 2 END AS priority FROM asked JOIN people USING (year, name) WHERE name <> '' AND (second IS NULL OR list_contains(names, second))),
best AS (SELECT *, min(priority) OVER (PARTITION BY ask_id) AS b FROM hit)
SELECT DISTINCT ask_id, row_id, priority FROM best WHERE priority = b"""
)
def author_year_lookup_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all rows of a year."""
    library = read_table(spark, sf_dir, "references_library")
    return lib.author_year_lookup(_author_year_asked(library), library, None)


def _origin(c: str) -> str:
    return f"regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z]', '', 'g'), '^(?:accepted|manualadd)', '')"


@query(
    f"""WITH pool AS (SELECT {_TITLE} AS value, cand_id AS row_id, CASE source WHEN 'pubmed' THEN 1 WHEN 'europepmc' THEN 2 WHEN 'biorxiv' THEN 3 END AS priority, source FROM candidates),
best AS (SELECT value, priority, source, min(row_id) AS row_id FROM pool WHERE value <> '' AND priority IS NOT NULL GROUP BY ALL), first_hit AS (SELECT *, row_number() OVER (PARTITION BY value ORDER BY priority) AS r FROM best)
SELECT ask_id, value, priority, source, row_id FROM (SELECT entry_id AS ask_id, {_TITLE} AS value FROM bib_entries) JOIN first_hit USING (value) WHERE r = 1 AND value <> ''"""
)
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of entries through the sources in order, the first hit wins: C11, C12, D14, R11."""
    works = read_table(spark, sf_dir, "candidates").select(idn.title_words(F.col("title")).alias("value"), F.col("cand_id").alias("row_id"), "source")
    asked = read_table(spark, sf_dir, "bib_entries").select(F.col("entry_id").alias("ask_id"), idn.title_words(F.col("title")).alias("value"))
    return lib.cascade(asked, [(name, works.where(F.col("source") == name).drop("source")) for name in ("pubmed", "europepmc", "biorxiv")])


@query(
    f"""WITH asked AS (SELECT doc_id AS request_id, {_TITLE} AS value, row_number() OVER (PARTITION BY doc_id ORDER BY entry_id) - 1 AS pos FROM bib_entries WHERE {_TITLE} <> ''),
snap AS (SELECT {_TITLE} AS value, min(cand_id) AS row_id FROM candidates WHERE {_TITLE} <> '' GROUP BY 1)
SELECT request_id, CAST(pos AS INT) AS pos, value, row_id FROM asked LEFT JOIN snap USING (value)"""
)
def fetch_in_request_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records asked for by a document's titles, in the order of the request; missing ones keep their place: A13, C13."""
    title = idn.title_words(F.col("title"))
    entries = read_table(spark, sf_dir, "bib_entries").where(title != "").select(F.col("doc_id").alias("request_id"), "entry_id", title.alias("value"))
    asked = entries.withColumn("pos", F.row_number().over(Window.partitionBy("request_id").orderBy("entry_id")) - 1)
    snapshot = read_table(spark, sf_dir, "candidates").where(title != "").select(title.alias("value"), F.col("cand_id").alias("row_id"))
    return lib.in_request_order(asked, snapshot)


@query(
    """WITH c AS (SELECT cand_id, lower(trim(coalesce(journal, ''))) AS journal, CAST(year AS VARCHAR) AS year, trim(coalesce(volume, '')) AS volume, split_part(coalesce(pages, ''), '-', 1) AS page, lower(coalesce(authors[1].last_name, '')) AS author FROM candidates),
once AS (SELECT journal, year, volume, page, author, min(cand_id) AS match_id FROM c GROUP BY ALL HAVING count(*) = 1)
SELECT cand_id, match_id FROM c JOIN once USING (journal, year, volume, page, author) WHERE journal <> '' AND year <> '' AND volume <> '' AND page <> '' AND author <> ''"""
)
def citation_match_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that journal, year, volume, first page and author name uniquely: A14."""
    c = read_table(spark, sf_dir, "candidates").select(
        "cand_id", F.lower(F.btrim(F.coalesce("journal", F.lit("")))).alias("journal"), F.col("year").cast("string").alias("year"), F.btrim(F.coalesce("volume", F.lit(""))).alias("volume"),
        F.split_part(F.coalesce("pages", F.lit("")), F.lit("-"), F.lit(1)).alias("page"), F.lower(F.coalesce(F.try_element_at("authors.last_name", F.lit(1)), F.lit(""))).alias("author"),
    )
    keys = ["journal", "year", "volume", "page", "author"]
    return lib.unique_matches(c, c.withColumnRenamed("cand_id", "match_id"), keys, "cand_id", "match_id")


@query(
    f"""WITH k AS (SELECT {_PMC} AS pmc, trim(coalesce(pmid, '')) AS pmid, {_DOI} AS doi FROM references_library),
by_pmc AS (SELECT pmc, min(pmid) AS pmid FROM k WHERE pmc <> '' AND pmid <> '' GROUP BY pmc), by_doi AS (SELECT doi, min(pmid) AS pmid FROM k WHERE doi <> '' AND pmid <> '' GROUP BY doi)
SELECT row_id, coalesce(a.pmid, b.pmid) AS pmid FROM (SELECT row_id, {_PMC} AS pmc, {_DOI} AS doi FROM references_library WHERE trim(coalesce(pmid, '')) = '') r
LEFT JOIN by_pmc a ON a.pmc = r.pmc LEFT JOIN by_doi b ON b.doi = r.doi WHERE coalesce(a.pmid, b.pmid) IS NOT NULL"""
)
def pmcid_to_pmid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing PMIDs by PMCID, else by DOI: A15, R9."""
    library = read_table(spark, sf_dir, "references_library").select("row_id", F.btrim(F.coalesce("pmid", F.lit(""))).alias("pmid"), idn.library_pmcid(F.col("pmcid")).alias("pmc"), idn.library_doi(F.col("doi")).alias("doi"))
    by = lambda k, name: library.where((F.col(k) != "") & (F.col("pmid") != "")).groupBy(k).agg(F.min("pmid").alias(name))
    found = library.where("pmid = ''").select("row_id", "pmc", "doi").join(by("pmc", "p1"), "pmc", "left").join(by("doi", "p2"), "doi", "left")
    return found.select("row_id", F.coalesce("p1", "p2").alias("pmid")).where("pmid is not null")


def _keyed(library: DataFrame) -> DataFrame:
    rows = library.withColumn("key", idn.library_key(F.col("pmid"), F.col("doi"), F.col("title"))).where("key <> ''")
    return lib.last_per_key(rows, "row_id")


_SIDES = f"""keyed AS (SELECT *, {_KEY} AS key FROM references_library), last_row AS (SELECT *, library_id = 'lib-commons' AS inc, row_number() OVER (PARTITION BY key, library_id = 'lib-commons' ORDER BY row_id DESC) AS r FROM keyed WHERE key <> ''),
s AS (SELECT * FROM last_row WHERE r = 1 AND NOT inc), i AS (SELECT * FROM last_row WHERE r = 1 AND inc)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    library = read_table(spark, sf_dir, "references_library")
    return _keyed(library.where("library_id <> 'lib-commons' or library_id is null")), _keyed(library.where("library_id = 'lib-commons'"))


@query(
    f"""WITH {_SIDES.replace("library_id = 'lib-commons'", "coalesce(library_id = 'lib-commons', false)")}
SELECT coalesce(i.key, s.key) AS key, CASE WHEN i.key IS NOT NULL AND s.key IS NOT NULL THEN 'updated' WHEN i.key IS NOT NULL THEN 'inserted' ELSE 'kept' END AS status,
CASE WHEN i.key IS NOT NULL THEN i.row_id ELSE s.row_id END AS row_id, CASE WHEN i.key IS NOT NULL THEN coalesce(nullif(i.pmcid, ''), nullif(s.pmcid, ''), '') ELSE coalesce(s.pmcid, '') END AS pmcid,
CASE WHEN i.key IS NOT NULL THEN i.abstract ELSE s.abstract END AS abstract FROM s FULL JOIN i ON s.key = i.key"""
)
def library_upsert_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared library overwrites the others' rows; only a PMCID survives a blank: K1, K3."""
    return lib.upsert_overwrite(*_sides(spark, sf_dir)).select("key", "status", "row_id", "pmcid", "abstract")


@query(
    f"""WITH {_SIDES.replace("library_id = 'lib-commons'", "coalesce(library_id = 'lib-commons', false)")}
SELECT coalesce(s.key, i.key) AS key, coalesce(nullif(s.abstract, ''), nullif(i.abstract, ''), '') AS abstract, coalesce(nullif(s.year, 0), nullif(i.year, 0), 0) AS year,
CASE WHEN contains(lower(coalesce(s.source, '')), 'embedded') THEN coalesce(nullif(i.source, ''), nullif(s.source, ''), '') ELSE coalesce(nullif(s.source, ''), nullif(i.source, ''), '') END AS source,
greatest(coalesce(len(s.authors), 0), coalesce(len(i.authors), 0)) AS n_authors, coalesce(s.is_retracted, false) OR coalesce(i.is_retracted, false) AS is_retracted FROM s FULL JOIN i ON s.key = i.key"""
)
def library_upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared library fills what the others' rows lack: K2, K4."""
    merged = lib.upsert_merge(*_sides(spark, sf_dir))
    return merged.select("key", "abstract", "year", "source", F.coalesce(F.size("authors"), F.lit(0)).alias("n_authors"), "is_retracted")


@query(
    f"""WITH t AS (SELECT row_id, {_KEY} AS key, updated_at FROM references_library), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY row_id) AS n FROM t WHERE key <> '') SELECT row_id, key FROM r WHERE n = 1"""
)
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each library key: D14, G1."""
    rows = read_table(spark, sf_dir, "references_library").select("row_id", idn.library_key(F.col("pmid"), F.col("doi"), F.col("title")).alias("key")).where("key <> ''")
    return lib.first_per(rows, ["key"], [F.col("row_id")]).select("row_id", "key")


@query("""WITH t AS (SELECT journal, journal_abbrev, row_number() OVER (PARTITION BY journal ORDER BY length(journal_abbrev), journal_abbrev) AS r FROM references_library WHERE coalesce(trim(journal_abbrev), '') <> '') SELECT journal, journal_abbrev FROM t WHERE r = 1""")
def shortest_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest abbreviation of each journal: D12."""
    rows = read_table(spark, sf_dir, "references_library").select("journal", "journal_abbrev").where("trim(journal_abbrev) <> ''")
    return lib.first_per(rows, ["journal"], [F.length("journal_abbrev"), F.col("journal_abbrev")])


COMPILED = '(kluv28[ti] OR "gut permeability"[tiab]) AND 2000:2020[dp]'


@query(
    """SELECT row_id FROM references_library WHERE (contains(lower(coalesce(title, '')), 'kluv28') OR contains(lower(coalesce(title, '')), 'gut permeability') OR contains(lower(coalesce(abstract, '')), 'gut permeability')) AND coalesce(year BETWEEN 2000 AND 2020, false)"""
)
def compiled_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's query language as a predicate: B15, B16, J2, J6."""
    return read_table(spark, sf_dir, "references_library").where(lib.compile_query(COMPILED)).select("row_id")


_VALID = "coalesce(title <> '', false) OR coalesce(pmid <> '', false) OR coalesce(doi <> '', false)"


@query(
    f"""SELECT row_id, {_VALID} AS valid, coalesce(source, '') = 'biorxiv' OR coalesce(len(list_filter(publication_types, lambda t: lower(t) = 'preprint')) > 0, false) OR coalesce(lower(doi) LIKE '10.1101/%', false) AS preprint,
coalesce(title, '') NOT IN ('', '0') AND coalesce(journal, '') NOT IN ('', '0') AND coalesce(CAST(year AS VARCHAR), '') NOT IN ('', '0') AND coalesce(volume, '') NOT IN ('', '0') AND coalesce(pages, '') NOT IN ('', '0') AS complete FROM references_library"""
)
def record_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether rows name a work, are preprints, and have all that a style prints: B8-B10."""
    c = F.col
    return read_table(spark, sf_dir, "references_library").select(
        "row_id", evd.is_valid(c("title"), c("pmid"), c("doi")).alias("valid"), evd.is_preprint(c("source"), c("publication_types"), c("doi")).alias("preprint"), evd.is_complete(c("title"), c("journal"), c("year"), c("volume"), c("pages")).alias("complete")
    )


_LABEL = "CASE WHEN coalesce(len(authors), 0) = 0 THEN CAST(coalesce(year, 0) AS VARCHAR) WHEN len(authors) > 2 THEN coalesce(authors[1].last_name, '') || ' et al., ' || coalesce(year, 0) WHEN len(authors) = 2 THEN coalesce(authors[1].last_name, '') || ' & ' || coalesce(authors[2].last_name, '') || ', ' || coalesce(year, 0) ELSE coalesce(authors[1].last_name, '') || ', ' || coalesce(year, 0) END"


@query(f"SELECT row_id, {_LABEL} AS label FROM references_library")
def author_date_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by first author and year: H30, H31."""
    return read_table(spark, sf_dir, "references_library").select("row_id", idn.first_author_year(F.col("authors"), F.col("year")).alias("label"))


@query(
    """SELECT row_id, regexp_replace(array_to_string(list_transform(coalesce(authors, [])[1:6], lambda a: trim(concat_ws(' ', a.last_name, a.initials))), ', ') || CASE WHEN len(authors) > 6 THEN ' et al.' ELSE '' END || '. ' || coalesce(title, ''), '([^.])$', '\\1.')
|| ' ' || coalesce(nullif(journal_abbrev, ''), journal, '') || '.' || CASE WHEN coalesce(year, 0) <> 0 THEN ' ' || year ELSE '' END || CASE WHEN coalesce(volume, '') <> '' THEN ';' || volume || CASE WHEN coalesce(issue, '') <> '' THEN '(' || issue || ')' ELSE '' END ELSE '' END
|| CASE WHEN coalesce(pages, '') <> '' THEN ':' || pages ELSE '' END || '.' || CASE WHEN coalesce(doi, '') <> '' THEN ' doi:' || doi ELSE '' END || CASE WHEN coalesce(pmid, '') <> '' THEN ' PMID: ' || pmid ELSE '' END AS entry FROM references_library"""
)
def bibliography_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as bibliography entries: H32, B14."""
    t = lambda c: F.coalesce(F.col(c), F.lit(""))
    opt = lambda c, *parts: F.when(t(c) != "", F.concat(*parts)).otherwise("")
    people = F.coalesce("authors", F.array().cast("array<struct<last_name:string,first_name:string,initials:string>>"))
    names = F.array_join(F.transform(F.slice(people, 1, 6), lambda a: F.btrim(F.concat_ws(" ", a["last_name"], a["initials"]))), ", ")
    head = F.concat(names, F.when(F.size(people) > 6, " et al.").otherwise(""), F.lit(". "), t("title"))
    head = F.when(head.endswith("."), head).otherwise(F.concat(head, F.lit(".")))
    place = F.concat(opt("volume", F.lit(";"), t("volume"), opt("issue", F.lit("("), t("issue"), F.lit(")"))), opt("pages", F.lit(":"), t("pages")))
    year = F.when(F.coalesce("year", F.lit(0)) != 0, F.concat(F.lit(" "), F.col("year").cast("string"))).otherwise("")
    line = F.concat(head, F.lit(" "), F.coalesce(F.nullif("journal_abbrev", F.lit("")), "journal", F.lit("")), F.lit("."), year, place, F.lit("."), opt("doi", F.lit(" doi:"), t("doi")), opt("pmid", F.lit(" PMID: "), t("pmid")))
    return read_table(spark, sf_dir, "references_library").select("row_id", line.alias("entry"))


@query("SELECT pmid, count(*) AS uses FROM references_library WHERE pmid <> '' GROUP BY pmid HAVING count(*) >= 3")
def qa_overused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Works that are selected three times and more: D2."""
    return evd.overused(read_table(spark, sf_dir, "references_library"), "pmid")


@query(
    """WITH c AS (SELECT library_id, authors[1].last_name AS author, count(*) AS n FROM references_library WHERE authors[1].last_name IS NOT NULL GROUP BY ALL), t AS (SELECT *, sum(n) OVER (PARTITION BY library_id) AS total FROM c)
SELECT library_id, author, n, CAST(total AS BIGINT) AS total FROM t WHERE total >= 5 AND n / total >= 0.15"""
)
def qa_author_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First authors with a large share of a library: D3."""
    rows = read_table(spark, sf_dir, "references_library").select("library_id", F.try_element_at("authors.last_name", F.lit(1)).alias("author"))
    return evd.author_concentration(rows, "library_id", "author", share=0.15)


@query(
    f"""SELECT {_origin('source')} AS origin, CASE WHEN regexp_matches(lower(coalesce(source, '')), '^\\s*accepted') THEN 'accepted' WHEN regexp_matches(lower(coalesce(source, '')), '^\\s*manual') THEN 'manual' ELSE 'own' END AS way, count(*) AS n,
count(*) FILTER (WHERE is_retracted) AS retracted, count(*) FILTER (WHERE is_review) AS reviews, count(DISTINCT {_KEY}) AS works FROM references_library GROUP BY ALL"""
)
def import_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by origin and the way they came: D1, D8, D11, K5."""
    origin = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("source", F.lit(""))), "[^a-z]", ""), "^(?:accepted|manualadd)", "")
    low = F.lower(F.coalesce("source", F.lit("")))
    way = F.when(low.rlike(r"^\s*accepted"), "accepted").when(low.rlike(r"^\s*manual"), "manual").otherwise("own")
    rows = read_table(spark, sf_dir, "references_library").select(origin.alias("origin"), way.alias("way"), "is_retracted", "is_review", idn.library_key(F.col("pmid"), F.col("doi"), F.col("title")).alias("k"))
    return rows.groupBy("origin", "way").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_retracted").alias("retracted"), F.count_if("is_review").alias("reviews"), F.count_distinct("k").alias("works"))


@query(
    """WITH pre AS (SELECT row_id, lower(trim(doi)) AS doi, title FROM references_library WHERE coalesce(source, '') = 'biorxiv'), pub AS (SELECT trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS t, min(lower(trim(doi))) AS published FROM references_library WHERE coalesce(source, '') <> 'biorxiv' AND trim(coalesce(doi, '')) <> '' GROUP BY 1),
v AS (SELECT p.doi AS preprint_doi, min(b.published) AS published_doi FROM pre p JOIN pub b ON b.t = trim(regexp_replace(lower(p.title), '[^a-z0-9]+', ' ', 'g')) WHERE p.doi <> '' AND b.published <> p.doi GROUP BY 1)
SELECT row_id AS sel_id, coalesce(published_doi, doi) AS doi, published_doi IS NOT NULL AS swapped, published_doi IS NULL AS warned FROM pre LEFT JOIN v ON v.preprint_doi = pre.doi"""
)
def preprint_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preprints replaced by a journal version of the same title: C15, L7."""
    library = read_table(spark, sf_dir, "references_library")
    low = F.lower(F.btrim("doi"))
    pre = library.where("coalesce(source, '') = 'biorxiv'").select(F.col("row_id").alias("sel_id"), low.alias("doi"), idn.title_words(F.col("title")).alias("t"), F.lit(True).alias("is_preprint"))
    pub = library.where("coalesce(source, '') <> 'biorxiv' and trim(doi) <> ''").groupBy(idn.title_words(F.col("title")).alias("t")).agg(F.min(low).alias("published_doi"))
    published = pre.where("doi <> ''").select(F.col("doi").alias("preprint_doi"), "t").join(pub, "t").where("published_doi <> preprint_doi")
    return evd.swap_preprints(pre, published)


# ---------------------------------------------------------------- documents


@query(f"WITH {_LINES} SELECT doc_id, para_index, text FROM lines WHERE text <> ''")
def document_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as paragraphs: A1, B3."""
    return doc.paragraphs(read_table(spark, sf_dir, "documents")).where("text <> ''")


@query(
    f"""WITH {_LINES}, h AS (SELECT *, length(text) > 0 AND length(text) < 30 AND NOT regexp_matches(text, '[.!?,;:]$') AND regexp_matches(text, '^[A-Z]') AND NOT regexp_matches(text, '\\d') AS heading FROM lines),
f AS (SELECT *, last_value(CASE WHEN heading THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY para_index ROWS UNBOUNDED PRECEDING) AS section FROM h)
SELECT doc_id, para_index, coalesce(section, '') AS section, md5(text) AS text_hash FROM f WHERE NOT heading AND text <> ''"""
)
def section_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs under their last heading: E5, C17."""
    filled = doc.fill_sections(doc.paragraphs(read_table(spark, sf_dir, "documents")))
    return filled.select("doc_id", "para_index", "section", F.md5("text").alias("text_hash"))


@query(f"WITH {_BOUNDS} SELECT doc_id, heading_idx, first_entry, last_entry FROM bounds")
def bibliography_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the bibliography of each document stands: H11, H12, B4, R6."""
    return doc.bibliography_bounds(doc.paragraphs(read_table(spark, sf_dir, "documents")))


@query(f"WITH {_ENTRIES} SELECT doc_id, para_index, number, body, copy_no FROM numbered")
def bibliography_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbered entries of bibliographies, repeated numbers marked: D13, H13."""
    return doc.bibliography_entries(doc.paragraphs(read_table(spark, sf_dir, "documents")))


@query(f"WITH {_GROUPS} SELECT doc_id, para_index, group_no, number FROM cited")
def bracket_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed citation numbers before the bibliography, ranges expanded: H11, H15, F7."""
    return doc.bracket_citations(doc.paragraphs(read_table(spark, sf_dir, "documents")))


@query(
    f"""WITH {_ENTRIES}, {_GROUPS[len(_HEADS) + 2 :]}
SELECT e.doc_id, count(DISTINCT e.number) AS n_entries, count(DISTINCT CASE WHEN c.number IS NOT NULL THEN e.number END) AS n_matched FROM (SELECT DISTINCT doc_id, number FROM numbered) e LEFT JOIN (SELECT DISTINCT doc_id, number FROM cited) c ON c.doc_id = e.doc_id AND c.number = e.number GROUP BY e.doc_id"""
)
def match_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a bibliography and how many of them are cited: B6, C5, D7."""
    paras = doc.paragraphs(read_table(spark, sf_dir, "documents"))
    entries = doc.bibliography_entries(paras).select("doc_id", "number").distinct()
    cited = doc.bracket_citations(paras).select("doc_id", "number").distinct().withColumn("hit", F.lit(1))
    return entries.join(cited, ["doc_id", "number"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entries"), F.count("hit").alias("n_matched"))


@query(
    """SELECT doc_id, len(regexp_extract_all(text, '\\((REFS?)\\)', 1)) AS n_placeholders, len(regexp_extract_all(text, '\\[\\d+(?:\\s*[,;\\-–]\\s*\\d+)*\\]')) AS n_brackets, len(string_split(text, '[?]')) - 1 AS n_unresolved, md5(trim(regexp_replace(text, '\\s*\\(REFS?\\)', '', 'g'))) AS stripped_hash FROM documents WHERE text IS NOT NULL"""
)
def placeholder_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search tokens, bracket groups and unresolved citations per document, and the text without tokens: B2, D6, D15."""
    count = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0)))
    return read_table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", count(doc.PLACEHOLDER).alias("n_placeholders"), count(doc.BRACKET).alias("n_brackets"), (F.size(F.split("text", r"\[\?\]")) - 1).alias("n_unresolved"), F.md5(doc.strip_placeholders(F.col("text"))).alias("stripped_hash")
    )


@query(
    f"""WITH f AS (SELECT doc_id, regexp_extract_all(text, '(?i){_q(mk.NATIVE)}', 1) AS g FROM documents) SELECT doc_id, CAST(unnest(range(len(g))) + 1 AS INT) AS ord, unnest(g) AS inside FROM f WHERE len(g) > 0"""
)
def markers_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers of search tokens, PMIDs and PMCIDs, without Python: H1, B1."""
    return mk.native_markers(read_table(spark, sf_dir, "documents"), ["doc_id"], "text")


@query()
def markers_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All markers of all documents by the full grammar: H1-H4."""
    rows = mk.marker_rows(read_table(spark, sf_dir, "documents"), ["doc_id"], "text")
    return rows.select("doc_id", "ord", "text", "kind", "start", "end", "extra_search", F.array_join(F.transform("suggestions", lambda s: s["value"]), "; ").alias("suggested"))


@query(
    """SELECT doc_id, count(*) FILTER (WHERE kind IN ('REF', 'REFS')) AS n_search, count(*) FILTER (WHERE kind = 'SUGGESTED' AND NOT regexp_matches(text, '[A-Za-zÀ-ž] *(?:et al\\.?)?,? (?:19|20)\\d\\d')) AS n_by_id,
count(*) FILTER (WHERE kind = 'SUGGESTED' AND regexp_matches(text, '[A-Za-zÀ-ž] *(?:et al\\.?)?,? (?:19|20)\\d\\d')) AS n_author_year, CAST(sum(greatest(extra_search, 0)) AS BIGINT) AS n_extra FROM markers GROUP BY doc_id"""
)
def marker_prescan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers per document by what has to be done for them: D5, B5."""
    named = F.col("text").rlike(r"[A-Za-zÀ-ž] *(?:et al\.?)?,? (?:19|20)\d\d")
    suggested = F.col("kind") == "SUGGESTED"
    return read_table(spark, sf_dir, "markers").groupBy("doc_id").agg(
        F.count_if(F.col("kind").isin("REF", "REFS")).alias("n_search"), F.count_if(suggested & ~named).alias("n_by_id"), F.count_if(suggested & named).alias("n_author_year"), F.sum(F.greatest("extra_search", F.lit(0))).alias("n_extra")
    )


@query()
def sentences_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of all paragraphs, numbered through the document: H6, E1, E2."""
    return seg.numbered_sentences(doc.paragraphs(read_table(spark, sf_dir, "documents")).where("text <> ''"))


@query(
    """WITH o AS (SELECT *, CASE WHEN section IS NOT DISTINCT FROM lag(section) OVER (PARTITION BY doc_id ORDER BY para_index, block_id) AND row_number() OVER (PARTITION BY doc_id ORDER BY para_index, block_id) > 1 THEN 0 ELSE 1 END AS fresh FROM sentences),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY para_index, block_id ROWS UNBOUNDED PRECEDING) AS section_run FROM o), u AS (SELECT * FROM r WHERE trim(raw_text) <> ''),
c AS (SELECT block_id, list(raw_text) OVER (PARTITION BY doc_id, section_run ORDER BY para_index, block_id ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS p, list(raw_text) OVER (PARTITION BY doc_id, para_index ORDER BY para_index, block_id ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING) AS f FROM u)
SELECT block_id, md5(coalesce(array_to_string(p, '|'), '')) AS preceding, md5(coalesce(array_to_string(f, '|'), '')) AS following FROM c"""
)
def claim_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands around each sentence: E6, E7, C16."""
    runs = doc.section_runs(read_table(spark, sf_dir, "sentences"), ["para_index", "block_id"])
    ctx = doc.claim_context(runs, ["para_index", "block_id"], "section_run", "para_index", "raw_text")
    return ctx.select("block_id", F.md5(F.array_join("preceding", "|")).alias("preceding"), F.md5(F.array_join("following", "|")).alias("following"))


_STOP = ", ".join(f"'{w}'" for w in ev.STOP_WORDS)


def _distinct_sql(listed: str) -> str:
    return f"list_filter({listed}, lambda x, i: list_position({listed}, x) = i)"


@query(
    f"""WITH w AS (SELECT block_id, list_filter(list_transform(regexp_extract_all(clean_text, '([A-Za-z][A-Za-z0-9\\-]{{2,}})', 1), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})) AS k FROM sentences WHERE clean_text IS NOT NULL)
SELECT block_id, array_to_string(({_distinct_sql('k')})[1:8], ' ') AS keywords FROM w"""
)
def claim_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content words of claims: H8."""
    rows = read_table(spark, sf_dir, "sentences").where("clean_text is not null")
    return rows.select("block_id", F.array_join(ev.claim_keywords(F.col("clean_text")), " ").alias("keywords"))


@query(
    """WITH p AS (SELECT block_id, list_transform(string_split_regex(raw_text, '\\(REFS?\\)'), lambda x: trim(x)) AS parts FROM sentences), n AS (SELECT block_id, parts, CAST(unnest(range(1, len(parts))) AS INT) AS ord FROM p WHERE len(parts) > 1)
SELECT block_id, ord, parts[ord] AS before, parts[ord + 1] AS after FROM n"""
)
def sub_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts of sentences around their search tokens: H7."""
    rows = read_table(spark, sf_dir, "sentences").select("block_id", F.posexplode(doc.sub_claims(F.col("raw_text"))).alias("p", "s"))
    return rows.select("block_id", (F.col("p") + 1).alias("ord"), "s.before", "s.after")


@query(
    """WITH n AS (SELECT entry_id, body, list_filter(list_transform(string_split_regex(regexp_replace(body, '([.?!])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '') AS seg FROM bib_entries WHERE body IS NOT NULL)
SELECT entry_id, coalesce(regexp_replace(seg[1], '\\.+$', ''), '') AS authors, coalesce(regexp_replace(seg[2], '\\.+$', ''), '') AS title, coalesce(regexp_replace(seg[3], '\\.+$', ''), '') AS journal,
coalesce(TRY_CAST(regexp_extract(body, '\\b((?:19|20)\\d{2})\\b', 1) AS INT), 0) AS year, regexp_extract(body, ';\\s*(\\d+[A-Za-z]?)\\s*(?:\\([^)]*\\))?\\s*:\\s*(\\d+)', 1) AS volume, regexp_extract(body, ';\\s*(\\d+[A-Za-z]?)\\s*(?:\\([^)]*\\))?\\s*:\\s*(\\d+)', 2) AS first_page,
regexp_replace(regexp_extract(body, '(?i)doi:\\s*(10\\.\\S+)', 1), '\\.+$', '') AS doi, regexp_extract(body, 'PMID:\\s*(\\d+)', 1) AS pmid FROM n"""
)
def entry_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of bibliography entries: H13, H14."""
    body = F.col("body")
    rows = read_table(spark, sf_dir, "bib_entries").where("body is not null").select("entry_id", ev.entry_fields(body).alias("f"), ev.entry_doi(body).alias("doi"), ev.entry_pmid(body).alias("pmid"))
    return rows.select("entry_id", "f.authors", "f.title", "f.journal", "f.year", "f.volume", "f.first_page", "doi", "pmid")


_WINDOWS = " UNION ALL ".join(f"SELECT doc_id, {k} AS size, unnest(list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' '))) AS s FROM d WHERE len(w) >= {k}" for k in range(1, 9))


@query(
    f"""WITH q AS (SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM eval_items), qs AS (SELECT item_id, least(len(w), 8) AS size, len(w) - least(len(w), 8) + 1 AS n, unnest(list_transform(range(1, len(w) - least(len(w), 8) + 2), lambda i: array_to_string(w[i:i + least(len(w), 8) - 1], ' '))) AS s FROM q WHERE w <> ['']),
d AS (SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM documents), ds AS (SELECT DISTINCT * FROM ({_WINDOWS}) WHERE size IN (SELECT size FROM qs) AND s IN (SELECT s FROM qs)),
h AS (SELECT doc_id, item_id, n, count(*) AS hits FROM qs JOIN ds USING (size, s) GROUP BY ALL) SELECT doc_id, item_id, round(hits / n, 6) AS share, hits / n >= 0.8 AS occurs FROM h"""
)
def quote_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out texts as quotes in documents, by windows of eight words or all of a shorter quote: H23."""
    return evd.quoted(read_table(spark, sf_dir, "eval_items"), "item_id", read_table(spark, sf_dir, "documents"), "doc_id")


_STEMS = "list_distinct(list_transform(list_filter(regexp_extract_all(lower({}), '([a-z0-9]+)', 1), lambda x: length(x) >= 3), lambda x: substr(x, 1, 5)))"


@query(
    f"""WITH {_LINES}, t AS (SELECT doc_id, {_STEMS.format('text')} AS wanted FROM lines WHERE para_index = 0), s AS (SELECT l.doc_id, l.para_index, len(list_intersect(t.wanted, {_STEMS.format('l.text')})) AS score FROM lines l JOIN t USING (doc_id) WHERE l.para_index > 0 AND l.text <> '')
SELECT doc_id, para_index, score FROM s WHERE score > 0"""
)
def passage_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs by the stems of the document's title in them: H21, H22."""
    paras = doc.paragraphs(read_table(spark, sf_dir, "documents")).where("text <> '' or para_index = 0")
    title = paras.where("para_index = 0").select("doc_id", ev.stems(F.col("text")).alias("wanted"))
    scored = paras.where("para_index > 0").join(title, "doc_id").select("doc_id", "para_index", ev.passage_score(F.col("wanted"), F.col("text"), F.lit("")).alias("score"))
    return scored.where("score > 0")


@query()
def passage_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best passages of each document within a budget of characters: F4, E11, J8."""
    paras = doc.fill_sections(doc.paragraphs(read_table(spark, sf_dir, "documents")))
    title = doc.paragraphs(read_table(spark, sf_dir, "documents")).where("para_index = 0").select("doc_id", ev.stems(F.col("text")).alias("wanted"))
    scored = paras.join(title, "doc_id").select("doc_id", "para_index", "section", "text", ev.passage_score(F.col("wanted"), F.col("text"), F.col("section")).alias("score"))
    return evd.chosen_passages(scored, "doc_id", "para_index")


@query(
    f"""WITH {_ENTRIES}, stored AS (SELECT doc_id, list(sha1(trim(raw_text))) AS s FROM bib_entries GROUP BY doc_id), found AS (SELECT doc_id, list(sha1(trim(body))) AS f FROM numbered GROUP BY doc_id)
SELECT doc_id, len(s) AS n_stored, coalesce(len(list_filter(s, lambda h: list_contains(f, h))), 0) AS n_found, coalesce(len(list_filter(s, lambda h: list_contains(f, h))), 0) * 2 >= len(s) AS stripped FROM stored LEFT JOIN found USING (doc_id)"""
)
def entry_hash_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored entry hashes that a document still holds: B19, H36, G5."""
    stored = read_table(spark, sf_dir, "bib_entries").select("doc_id", F.sha1(F.btrim("raw_text")).alias("h"))
    found = doc.bibliography_entries(doc.paragraphs(read_table(spark, sf_dir, "documents"))).select("doc_id", F.sha1(F.btrim("body")).alias("h")).distinct().withColumn("hit", F.lit(1))
    counts = stored.join(found, ["doc_id", "h"], "left").groupBy("doc_id").agg(F.count("h").alias("n_stored"), F.count("hit").alias("n_found"))
    return counts.withColumn("stripped", F.col("n_found") * 2 >= F.col("n_stored"))


# ---------------------------------------------------------------- numbers and numbering


@query(f"""WITH {_GROUPS} SELECT doc_id, para_index, group_no, array_to_string({_EXPAND}, ',') AS numbers FROM groups""")
def number_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracket groups as numbers: H15."""
    paras = doc.paragraphs(read_table(spark, sf_dir, "documents"))
    body = paras.join(doc.references_start(paras), "doc_id", "left").where("heading_idx is null or para_index < heading_idx")
    groups = body.select("doc_id", "para_index", F.posexplode(F.regexp_extract_all("text", F.lit(doc.BRACKET), F.lit(1))).alias("group_no", "inner"))
    return groups.select("doc_id", "para_index", "group_no", F.array_join(num.expand_numbers(F.col("inner")).cast("array<string>"), ",").alias("numbers"))


@query(
    """WITH d AS (SELECT DISTINCT doc_id, original_number AS n FROM bib_entries WHERE original_number IS NOT NULL), g AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM d), r AS (SELECT doc_id, island, min(n) AS a, max(n) AS b FROM g GROUP BY ALL),
t AS (SELECT doc_id, a, CASE WHEN b - a >= 2 THEN a || '-' || b WHEN b > a THEN a || ', ' || b ELSE CAST(a AS VARCHAR) END AS c FROM r) SELECT doc_id, string_agg(c, ', ' ORDER BY a) AS ranges FROM t GROUP BY doc_id"""
)
def number_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entry numbers of each document as compact ranges: H16, E9, G3."""
    rows = read_table(spark, sf_dir, "bib_entries").where("original_number is not null").groupBy("doc_id").agg(F.array_sort(F.collect_set("original_number")).alias("n"))
    return rows.select("doc_id", num.format_numbers(F.col("n").cast("array<int>")).alias("ranges"))


_STYLE_ROWS = ", ".join("(" + ", ".join(("'" + _q(v) + "'") if isinstance(v, str) else str(v).lower() for v in r) + ")" for r in num.STYLES)


@query(
    f"""WITH styles(style, prefix, suffix, delimiter, collapse, superscript, author_date, number_prefix, number_suffix) AS (VALUES {_STYLE_ROWS}),
d AS (SELECT DISTINCT doc_id, original_number AS n FROM bib_entries WHERE original_number IS NOT NULL), g AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM d), r AS (SELECT doc_id, min(n) AS a, max(n) AS b FROM g GROUP BY doc_id, island),
chunks AS (SELECT doc_id, true AS collapse, unnest(CASE WHEN b - a >= 2 THEN [a || '-' || b] WHEN b > a THEN [CAST(a AS VARCHAR), CAST(b AS VARCHAR)] ELSE [CAST(a AS VARCHAR)] END) AS c FROM r UNION ALL SELECT doc_id, false, CAST(n AS VARCHAR) FROM d)
SELECT doc_id, style AS style_name, prefix || list_reduce(list(number_prefix || c || number_suffix ORDER BY TRY_CAST(split_part(c, '-', 1) AS INT)), lambda a, b: a || delimiter || b) || suffix AS rendered FROM chunks JOIN styles USING (collapse) WHERE NOT author_date GROUP BY doc_id, style, prefix, suffix, delimiter"""
)
def render_clusters_by_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cited numbers of each document in every numeric style: H18, A20."""
    rows = read_table(spark, sf_dir, "bib_entries").where("original_number is not null").groupBy("doc_id").agg(F.collect_set("original_number").cast("array<int>").alias("n"))
    pairs = rows.withColumn("st", F.explode(F.array(*[F.struct(*[F.lit(v).alias(k.split()[0]) for k, v in zip(num.STYLE_SCHEMA.split(", "), s)]) for s in num.STYLES if not s[6]])))
    return pairs.select("doc_id", F.col("st.style").alias("style_name"), num.render_numbers(F.col("n"), F.col("st")).alias("rendered"))


_MKEY = "lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))"
_FIRST = f"first_place AS (SELECT doc_id, {_MKEY} AS key, min({{'sent_id': coalesce(sent_id, ''), 'start_off': coalesce(start_off, -1), 'marker_id': marker_id}}) AS p FROM markers WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY ALL), numbered AS (SELECT doc_id, key, row_number() OVER (PARTITION BY doc_id ORDER BY p.sent_id, p.start_off, p.marker_id) AS number FROM first_place)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "markers").where("trim(text) <> ''")
    return rows.select("doc_id", F.lower(F.btrim(F.regexp_replace("text", r"\s+", " "))).alias("key"), F.coalesce("sent_id", F.lit("")).alias("sent"), F.coalesce("start_off", F.lit(-1)).alias("off"), "marker_id")


@query(f"WITH {_FIRST} SELECT doc_id, key, number FROM numbered")
def numbering_first_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in order of first citation: E3, E4, C6."""
    return nb.number_by_first_occurrence(_events(spark, sf_dir), ["sent", "off", "marker_id"])


@query(
    f"""WITH {_FIRST}, listed AS (SELECT doc_id, lower(trim(raw_text)) AS key, min(original_number) AS o FROM bib_entries WHERE trim(coalesce(raw_text, '')) <> '' GROUP BY ALL), rest AS (SELECT l.* FROM listed l ANTI JOIN numbered n ON n.doc_id = l.doc_id AND n.key = l.key), top AS (SELECT doc_id, max(number) AS top FROM numbered GROUP BY doc_id)
SELECT doc_id, key, number, true AS cited FROM numbered UNION ALL SELECT r.doc_id, r.key, coalesce(top, 0) + row_number() OVER (PARTITION BY r.doc_id ORDER BY o ASC NULLS LAST, r.key), false FROM rest r LEFT JOIN top USING (doc_id)"""
)
def numbering_seed_uncited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that nothing cites keep their order after the cited ones: K12, G6."""
    numbered = nb.number_by_first_occurrence(_events(spark, sf_dir), ["sent", "off", "marker_id"])
    entries = read_table(spark, sf_dir, "bib_entries").where("trim(raw_text) <> ''").select("doc_id", F.lower(F.btrim("raw_text")).alias("key"), "original_number")
    return nb.seed_uncited(numbered, entries)


@query()
def numbering_alias_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities of entries under record id, PMID, DOI and title, folded in order: C8."""
    c = F.col
    events = read_table(spark, sf_dir, "bib_entries").select("doc_id", F.col("entry_id").alias("event_id"), "original_number", idn.aliases(c("record_uuid"), c("pmid"), c("doi"), c("title")).alias("aliases"))
    return nb.fold_aliases(events.withColumn("original_number", F.coalesce("original_number", F.lit(2**31 - 1))), "original_number")


@query(
    """WITH m AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY marker_id) AS place FROM markers), s AS (SELECT doc_id, text, marker_id AS slot_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, marker_id) AS place FROM markers)
SELECT m.doc_id, m.place, m.text, CASE WHEN coalesce(m.text = s.text, false) THEN slot_id END AS slot_id, coalesce(m.text = s.text, false) AS matched FROM m LEFT JOIN s ON m.doc_id = s.doc_id AND m.place = s.place"""
)
def plan_join_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markers joined with slots by place, guarded by their text: C4."""
    rows = read_table(spark, sf_dir, "markers")
    markers = rows.select("doc_id", "text", F.row_number().over(Window.partitionBy("doc_id").orderBy("marker_id")).alias("place"))
    slots = rows.select("doc_id", "text", F.col("marker_id").alias("slot_id"), F.row_number().over(Window.partitionBy("doc_id").orderBy("ord", "marker_id")).alias("place"))
    return nb.marker_plan(markers, slots)


@query(
    """SELECT entry_id, doc_id, sort_key, row_number() OVER (PARTITION BY doc_id ORDER BY sort_key, raw_text, entry_id) AS place FROM (SELECT entry_id, doc_id, raw_text, substr(regexp_replace(lower(raw_text), '[^a-z0-9 ]', '', 'g'), 1, 80) AS sort_key FROM bib_entries WHERE raw_text IS NOT NULL)"""
)
def alphabetic_bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of each document with their place in its unnumbered bibliography: F6, H33.

    A long bibliography may lie in several range partitions; its places count on from the entries before them."""
    order = ["doc_id", "sort_key", "raw_text", "entry_id"]
    keyed = read_table(spark, sf_dir, "bib_entries").where("raw_text is not null").select("entry_id", "doc_id", "raw_text", nb.alphabetic_key(F.col("raw_text")).alias("sort_key"))
    ranged = cut_lineage(keyed.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("r", F.row_number().over(Window.partitionBy("part", "doc_id").orderBy(*order[1:])))
    # one row per document and partition
    sizes = ranged.groupBy("part", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", "doc_id", F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return inside.join(before, (inside["part"] == before["part"]) & inside["doc_id"].eqNullSafe(before["doc_id"])).select("entry_id", inside["doc_id"], "sort_key", (F.col("before") + F.col("r")).alias("place"))


# ---------------------------------------------------------------- evidence

_VERDICTS = """v AS (SELECT doc_id, CASE marker_id % 5 WHEN 0 THEN 'supports' WHEN 1 THEN 'partial' WHEN 2 THEN 'supports' WHEN 3 THEN CASE WHEN doc_id % 2 = 0 THEN 'not_supported' ELSE 'partial' END ELSE '' END AS raw, marker_id % 7 <> 0 AS found, marker_id % 3 <> 0 AS quoted, extra_search FROM markers),
b AS (SELECT *, CASE WHEN raw = 'supports' AND NOT found THEN 'partial' WHEN raw IN ('supports', 'partial', 'not_supported') THEN raw ELSE 'unverified' END AS verdict FROM v)"""


@query(
    f"""WITH {_VERDICTS}, a AS (SELECT doc_id, bool_or(verdict = 'not_supported') AS failing, bool_or(quoted AND NOT found) AS invented, bool_or(quoted AND NOT found AND verdict <> 'not_supported') AS invented_only, count(*) FILTER (WHERE verdict <> 'unverified') AS known, bool_and(verdict IN ('supports', 'unverified')) AS good, bool_or(verdict = 'unverified') AS unknown FROM b GROUP BY doc_id),
s AS (SELECT *, CASE WHEN failing OR invented THEN 'mismatch' WHEN known > 0 AND good THEN 'verified' WHEN known > 0 THEN 'partial' ELSE 'not_checked' END AS status FROM a)
SELECT doc_id, status, CASE status WHEN 'mismatch' THEN 'LOW' WHEN 'verified' THEN 'HIGH' ELSE 'MEDIUM' END AS level, CASE status WHEN 'mismatch' THEN 39e0 WHEN 'verified' THEN 80e0 ELSE 60e0 END AS score,
concat_ws(',', CASE WHEN failing THEN 'not_supported' END, CASE WHEN invented_only THEN 'quote_not_found' END, CASE WHEN unknown THEN 'unverified' END) AS warnings FROM s"""
)
def verdict_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a document's citations folded into its confidence: L4, L5, D16. The verdicts are derived from ids, as answers have no source."""
    m = F.col("marker_id")
    rows = read_table(spark, sf_dir, "markers")
    raw = F.when((m % 5 == 3) & (F.col("doc_id") % 2 == 0), "not_supported").when((m % 5).isin(1, 3), "partial").when(m % 5 == 4, "").otherwise("supports")
    v = rows.select("doc_id", F.struct(evd.backed_verdict(raw, m % 7 != 0).alias("verdict"), (m % 3 != 0).alias("has_quote"), (m % 7 != 0).alias("quote_found")).alias("v"))
    # equal verdicts are merged first, so a document's array holds at most a dozen
    grouped = v.distinct().groupBy("doc_id").agg(F.collect_list("v").alias("vs"))
    folded = grouped.select("doc_id", evd.fold_verdicts(F.col("vs"), F.lit(False), F.lit("MEDIUM"), F.lit(60.0)).alias("f"))
    return folded.select("doc_id", "f.status", "f.level", "f.score", F.array_join("f.warnings", ",").alias("warnings"))


@query(
    """WITH e AS (SELECT doc_id, coalesce(sent_id, '') AS sent_id, CASE marker_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS o, CAST(marker_id % 101 AS DOUBLE) AS score, marker_id % 4 <> 0 AS scored FROM markers)
SELECT doc_id, sent_id, ['LOW', 'MEDIUM', 'HIGH'][min(o)] AS level, round(avg(CASE WHEN scored THEN score END), 6) AS score, count(*) AS n_markers FROM e GROUP BY ALL"""
)
def merge_marker_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of a sentence's markers merged: the least level, the mean score of scored ones: D4."""
    m = F.col("marker_id")
    rows = read_table(spark, sf_dir, "markers").select("doc_id", F.coalesce("sent_id", F.lit("")).alias("sent_id"), F.when(m % 3 == 0, "LOW").when(m % 3 == 1, "MEDIUM").otherwise("HIGH").alias("level"), (m % 101).cast("double").alias("score"), (m % 4 != 0).alias("scored"))
    return evd.merge_marker_evidence(rows, ["doc_id", "sent_id"]).withColumn("score", F.round("score", 6))


@query(
    """WITH e AS (SELECT doc_id, CASE WHEN marker_id % 11 = 0 THEN 'leave' WHEN marker_id % 2 = 0 AND marker_id % 5 <> 0 THEN 'cite' WHEN kind = 'SUGGESTED' THEN 'leave' ELSE 'unresolved' END AS action FROM markers)
SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE action = 'cite') AS cited, count(*) FILTER (WHERE action = 'leave') AS left_alone, count(*) FILTER (WHERE action = 'unresolved') AS unresolved, bool_and(action <> 'unresolved') AS all_resolved FROM e GROUP BY doc_id"""
)
def export_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export does with each document's markers: B7, B12, D9-D11."""
    m = F.col("marker_id")
    status = F.when(m % 11 == 0, "skipped").when(m % 2 == 0, "accepted").otherwise("pending")
    rows = read_table(spark, sf_dir, "markers").select("doc_id", nb.export_action(status, m % 5 != 0, F.col("kind")).alias("action"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("action") == "cite").alias("cited"), F.count_if(F.col("action") == "leave").alias("left_alone"), F.count_if(F.col("action") == "unresolved").alias("unresolved"), F.every(F.col("action") != "unresolved").alias("all_resolved"))


@query(
    f"""WITH {_ENTRIES}, {_GROUPS[len(_HEADS) + 2 :]}, n AS (SELECT doc_id, count(DISTINCT number) AS n_entries FROM numbered GROUP BY doc_id), c AS (SELECT e.doc_id, count(DISTINCT e.number) AS n_matched FROM numbered e JOIN cited USING (doc_id, number) GROUP BY e.doc_id)
SELECT d.doc_id, concat_ws(',', CASE WHEN coalesce(n_entries, 0) > 0 AND coalesce(n_matched, 0) / coalesce(n_entries, 1) < 0.5 THEN 'few_matches' END, CASE WHEN contains(text, 'ADDIN ') THEN 'tracked_changes' END) AS reasons FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""
)
def export_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why documents must not be exported: B13, D7."""
    docs = read_table(spark, sf_dir, "documents")
    paras = doc.paragraphs(docs)
    entries = doc.bibliography_entries(paras).select("doc_id", "number").distinct()
    n = entries.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_entries"))
    c = entries.join(doc.bracket_citations(paras).select("doc_id", "number").distinct(), ["doc_id", "number"]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_matched"))
    rows = docs.select("doc_id", F.contains("text", F.lit("ADDIN ")).cast("int").alias("changes")).join(n, "doc_id", "left").join(c, "doc_id", "left")
    zero = lambda name: F.coalesce(name, F.lit(0))
    reasons = evd.guard_reasons(F.lit(False), F.lit(False), F.lit(0), F.lit(0), zero("changes"), zero("n_entries"), zero("n_matched"))
    return rows.select("doc_id", F.array_join(reasons, ",").alias("reasons"))


_OBJECT = "nullif(regexp_extract({0}, '(?s)(\\{{.*\\}})', 1), '')"
_PLAIN = "replace(replace(replace(replace(replace(replace(replace(payload, '&quot;', '\"'), '&#34;', '\"'), '&#39;', chr(39)), '&apos;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_WHOLE = f"coalesce(json_valid({_OBJECT.format('payload')}), false) OR coalesce(CASE WHEN trim(payload) LIKE '\"%' AND json_valid(trim(payload)) THEN json_valid({_OBJECT.format('(CAST(trim(payload) AS JSON) ->> chr(36))')}) END, false) OR (contains(payload, '&quot;') AND coalesce(json_valid({_OBJECT.format(_PLAIN)}), false))"


@query(
    f"""WITH r AS (SELECT payload_id, doc_id, citation_id, payload, row_number() OVER (PARTITION BY doc_id, citation_id ORDER BY payload_id) AS copy_no, coalesce({_WHOLE}, false) AS whole FROM cite_payloads)
SELECT payload_id, 'duplicate' AS issue FROM r WHERE citation_id <> '' AND copy_no > 1 UNION ALL SELECT payload_id, CASE WHEN contains(coalesce(payload, ''), '{{') THEN 'damaged' ELSE 'empty' END FROM r WHERE NOT whole UNION ALL SELECT payload_id, 'no id' FROM r WHERE coalesce(citation_id, '') = ''"""
)
def reconcile_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of stored citation payloads, which are parsed: A25, E12."""
    rows = read_table(spark, sf_dir, "cite_payloads").select("payload_id", "doc_id", "citation_id", "payload", flatten.json_in_text(F.col("payload")).isNull().alias("broken"))
    numbered = rows.withColumn("copy_no", F.row_number().over(Window.partitionBy("doc_id", "citation_id").orderBy("payload_id")))
    empty = ~F.coalesce(F.contains("payload", F.lit("{")), F.lit(False))
    issues = F.array_compact(F.array(F.when((F.col("citation_id") != "") & (F.col("copy_no") > 1), "duplicate"), F.when(F.col("broken"), F.when(empty, "empty").otherwise("damaged")), F.when(F.coalesce("citation_id", F.lit("")) == "", "no id")))
    return numbered.select("payload_id", F.explode(issues).alias("issue"))


@query(
    """WITH n AS (SELECT max(ts) AS now FROM events), f AS (SELECT user_id || '|' || event_type AS key, event_id, ts FROM events, n WHERE ts >= now - INTERVAL 30 DAYS), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) AS r FROM f) SELECT key, event_id AS value, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM r WHERE r = 1"""
)
def cache_ttl_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live entry of each cache key: A23, I2, H42."""
    events = read_table(spark, sf_dir, "events").select(F.concat_ws("|", "user_id", "event_type").alias("key"), F.col("event_id").alias("value"), "ts")
    now = events.agg(F.max("ts")).first()[0]
    live = stores.live_cache(events, F.lit(now))
    return live.select("key", "value", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


# ---------------------------------------------------------------- sources

_NAMES_SQL = "array_to_string(list_transform(coalesce(authors, []), lambda a: trim(concat_ws(', ', nullif(a.last_name, ''), nullif(a.first_name, '')))), '; ')"


_SPACED = "trim(regexp_replace(coalesce(title, ''), '[\\s\\x{00A0}]+', ' ', 'g'))"


_ONE_LINE = "trim(regexp_replace(coalesce({0}, ''), '\\s+', ' ', 'g'))"
_RIS_PMID = f"CASE WHEN regexp_matches({_ONE_LINE.format('pmid')}, '^\\d+$') THEN {_ONE_LINE.format('pmid')} ELSE regexp_extract({_ONE_LINE.format('pmid')}, '\\b(\\d{{7,9}})\\b', 1) END"
_RIS_PAGES = "concat_ws('-', nullif(trim(split_part(coalesce(pages, ''), '-', 1)), ''), nullif(trim(split_part(coalesce(pages, ''), '-', 2)), ''))"


def _spaced(c: str) -> F.Column:
    return F.btrim(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\s\x{00A0}]+", " "))


def _names(c: str) -> F.Column:
    return F.array_join(F.transform(c, lambda a: F.concat_ws(", ", F.nullif(a["last_name"], F.lit("")), F.nullif(a["first_name"], F.lit("")))), "; ")


@query(f"""SELECT row_id, {_SPACED} AS title, {_NAMES_SQL} AS authors, coalesce(year, 0) AS year, coalesce(journal, '') AS journal, {_ONE_LINE.format('doi')} AS doi, {_RIS_PMID} AS pmid, {_RIS_PAGES} AS pages FROM references_library WHERE {_SPACED} <> ''""")
def parse_ris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library rows written as RIS and read again: A7, A8, H28, H34."""
    c = F.col
    files = read_table(spark, sf_dir, "references_library").where(_spaced("title") != "").select("row_id", records.to_ris(_spaced("title"), c("authors"), c("year"), c("journal"), c("doi"), c("pmid"), c("pages")).alias("text"))
    return records.ris_candidates(files, "row_id", "text").select("row_id", "title", _names("authors").alias("authors"), "year", "journal", "doi", "pmid", "pages")


@query(
    f"""SELECT row_id, trim(coalesce(pmid, '')) AS pmid, {_SPACED} AS title, coalesce(len(authors), 0) AS n_authors, coalesce(year, 0) AS year, coalesce(journal, '') AS journal, coalesce(is_review, false) AS is_review, coalesce(is_retracted, false) AS is_retracted, trim(coalesce(journal_abbrev, '')) AS journal_abbrev, trim(coalesce(doi, '')) AS doi, 'AIM' || CASE WHEN {_SPACED.replace('title', 'abstract')} <> '' THEN ': ' || {_SPACED.replace('title', 'abstract')} ELSE '' END || chr(10) || 'End.' AS abstract, array_to_string(coalesce(mesh_terms, []), '; ') AS mesh FROM references_library"""
)
def parse_pubmed_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Library rows written as article XML and read again: A12."""
    x = lambda c: records.escape_xml(F.btrim(F.coalesce(F.col(c), F.lit(""))))
    tag = lambda t, v: F.concat(F.lit(f"<{t}>"), v, F.lit(f"</{t}>"))
    people = F.array_join(F.transform(F.coalesce("authors", F.array().cast("array<struct<last_name:string,first_name:string,initials:string>>")), lambda a: tag("Author", F.concat(tag("LastName", records.escape_xml(a["last_name"])), tag("ForeName", records.escape_xml(a["first_name"]))))), "")
    types = F.concat(F.when(F.col("is_review"), "<PublicationType>Review</PublicationType>").otherwise(""), F.when(F.col("is_retracted"), "<PublicationType>Retracted Publication</PublicationType>").otherwise(""), F.lit("<PublicationType>Journal Article</PublicationType>"))
    article = tag("Article", F.concat(tag("Journal", F.concat(tag("JournalIssue", tag("PubDate", tag("Year", F.coalesce("year", F.lit(0)).cast("string")))), tag("Title", x("journal")), tag("ISOAbbreviation", x("journal_abbrev")))), tag("ArticleTitle", records.escape_xml(_spaced("title"))), tag("AuthorList", people), tag("PublicationTypeList", types), F.lit('<ELocationID EIdType="pii">no</ELocationID><ELocationID EIdType="doi">'), x("doi"), F.lit('</ELocationID><Abstract><AbstractText Label="AIM">'), records.escape_xml(_spaced("abstract")), F.lit("</AbstractText><AbstractText>End.</AbstractText></Abstract>")))
    mesh = tag("MeshHeadingList", F.array_join(F.transform(F.coalesce("mesh_terms", F.array().cast("array<string>")), lambda m: tag("MeshHeading", tag("DescriptorName", records.escape_xml(m)))), ""))
    xml = tag("PubmedArticle", tag("MedlineCitation", F.concat(tag("PMID", x("pmid")), article, mesh)))
    rows = records.pubmed_articles(read_table(spark, sf_dir, "references_library").select("row_id", xml.alias("xml")), "row_id", "xml")
    return rows.select("row_id", "pmid", "title", F.coalesce(F.size("authors"), F.lit(0)).alias("n_authors"), "year", "journal", "is_review", "is_retracted", "journal_abbrev", F.coalesce("doi", F.lit("")).alias("doi"), "abstract", F.array_join("mesh_terms", "; ").alias("mesh"))


@query(
    """SELECT cand_id, regexp_replace(title, '\\.+$', '') AS title, coalesce(year, 0) AS year, coalesce(journal, '') AS journal, coalesce(len(authors), 0) AS n_authors, coalesce(list_contains(list_transform(publication_types, lambda t: lower(t)), 'review'), false) AS is_review FROM candidates WHERE coalesce(title, '') <> '' AND regexp_replace(title, '\\.+$', '') <> ''"""
)
def parse_europepmc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate works written as search hits in JSON and read again: A16."""
    people = F.struct(F.transform("authors", lambda a: F.struct(a["last_name"].alias("lastName"), a["first_name"].alias("firstName"), a["initials"].alias("initials"))).alias("author"))
    hit = F.to_json(F.struct("title", F.col("year").cast("string").alias("pubYear"), people.alias("authorList"), F.struct(F.struct(F.col("journal").alias("title")).alias("journal")).alias("journalInfo"), F.struct(F.col("publication_types").alias("pubType")).alias("pubTypeList")))
    rows = records.europepmc_hits(read_table(spark, sf_dir, "candidates").select("cand_id", hit.alias("j")), "cand_id", "j")
    return rows.select("cand_id", "title", "year", "journal", F.size("authors").alias("n_authors"), "is_review")


@query(f"""SELECT cand_id, coalesce(title, '') AS title, {_NAMES_SQL} AS authors, coalesce(year, 0) AS year FROM candidates WHERE coalesce(title, '') <> ''""")
def csl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate works as JSON items and back: H29, H38."""
    c = F.col
    items = read_table(spark, sf_dir, "candidates").where("title <> ''").select("cand_id", records.csl_item(c("cand_id").cast("string"), c("title"), c("authors"), c("year"), c("journal"), c("volume"), F.lit(""), F.lit("")).alias("item"))
    works = items.select("cand_id", records.csl_work(F.col("item")).alias("w"))
    return works.select("cand_id", "w.title", _names("w.authors").alias("authors"), F.coalesce("w.year", F.lit(0)).alias("year"))


@query("""WITH l AS (SELECT doc_id, trim(unnest(string_split(text, chr(10)))) AS t FROM documents), k AS (SELECT doc_id, regexp_replace(t, '\\s+', ' ', 'g') AS t FROM l) SELECT doc_id, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM k WHERE length(t) >= 40 GROUP BY doc_id""")
def parse_jats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as full-text XML and read again: A17, H20."""
    paras = F.array_join(F.transform(F.split("text", "\n"), lambda p: F.concat(F.lit("<p>"), records.escape_xml(p), F.lit("</p>"))), "")
    xml = F.concat(F.lit("<article><front/><body><sec><title>Results</title>"), paras, F.lit("</sec></body><back><p>"), F.lit("x" * 50), F.lit("</p></back></article>"))
    rows = fulltext.fulltext_paragraphs(read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", xml.alias("xml")), "doc_id", "xml")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS INT) AS para_index, md5(unnest(string_split(text, chr(10)))) AS text_hash FROM documents WHERE text IS NOT NULL""")
def docx_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as Word files and scanned again: A1-A3, A24, E10."""
    files = read_table(spark, sf_dir, "documents").where("text is not null").select("doc_id", docx.to_docx(F.col("text")).alias("content"))
    return docx.paragraphs(files, "doc_id", "content").select("doc_id", "para_index", F.md5("text").alias("text_hash"))


@query("""SELECT row_id, substr(sha256(concat_ws('|', CAST(row_id AS VARCHAR), coalesce(title, ''))), 1, 12) AS stable_id, concat_ws(' ', CASE WHEN coalesce(doi, '') <> '' THEN 'doi' END, CASE WHEN coalesce(pmid, '') <> '' THEN 'pmid' END) AS has FROM references_library""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reproducible ids in place of random ones: H36, H41."""
    has = F.concat_ws(" ", F.when(F.coalesce("doi", F.lit("")) != "", "doi"), F.when(F.coalesce("pmid", F.lit("")) != "", "pmid"))
    return read_table(spark, sf_dir, "references_library").select("row_id", stores.stable_id(F.col("row_id").cast("string"), F.coalesce("title", F.lit(""))).alias("stable_id"), has.alias("has"))
