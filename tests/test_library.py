"""Search, lookups and upserts of the library."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from citeloom.functions import identity as idn
from citeloom.operators import library as lib

SCHEMA = "row_id long, pmid string, doi string, pmcid string, title string, abstract string, journal string, authors array<struct<last_name:string,first_name:string,initials:string>>, year int, mesh_terms array<string>, updated_at timestamp"


def rows(spark, *items):
    base = {"pmid": "", "doi": "", "pmcid": "", "title": "", "abstract": "", "journal": "", "authors": [], "year": 0, "mesh_terms": [], "updated_at": None}
    names = [c.split()[0] for c in ("row_id", *base)]
    return spark.createDataFrame([tuple({**base, "row_id": i, **x}[n] for n in names) for i, x in enumerate(items, 1)], SCHEMA)


def test_recency_alone_admits_rows(spark):
    df = rows(spark, {"title": "Spines", "year": 1980}, {"title": "Nothing", "year": 2020})
    assert [r.row_id for r in lib.search(df, "spines").collect()] == [1, 2]
    assert [r.row_id for r in lib.search(df, "spines", require_token_hit=True).collect()] == [1]


def test_repeated_tokens_count_repeatedly_and_limits(spark):
    df = rows(spark, {"title": "gut"}, {"abstract": "gut"})
    assert [round(r.score, 1) for r in lib.search(df, "gut gut").collect()] == [24.0, 10.0]
    assert lib.search(df, "gut", most=0).count() == 1
    assert lib.search(df, "", most=99).count() == 2


def test_search_plan_is_a_top_k(spark):
    df = rows(spark, {"title": "gut"})
    assert "TakeOrderedAndProject" in lib.search(df, "gut", recent=None)._jdf.queryExecution().executedPlan().toString()


def test_lookup_takes_the_last_update_and_any_doi_form(spark):
    df = rows(spark, {"doi": "10.1000/ABC", "updated_at": datetime(2020, 1, 1)}, {"doi": "https://doi.org/10.1000/abc", "updated_at": datetime(2021, 1, 1)}, {"pmid": "5"}, {"pmcid": "123"})
    asked = spark.createDataFrame([(1, "doi", "http://dx.doi.org/10.1000/Abc"), (2, "pmid", " 5 "), (3, "pmcid", "pmc123"), (4, "doi", "")], "ask_id long, kind string, value string")
    assert {(r.ask_id, r.row_id) for r in lib.identifier_lookup(asked, df).collect()} == {(1, 2), (2, 3), (3, 4)}


def test_author_year_prefers_first_authors_and_needs_the_coauthor(spark):
    a = lambda *ns: [(n, "", "") for n in ns]
    df = rows(spark, {"authors": a("van der Berg", "Smith"), "year": 2020}, {"authors": a("Smith", "Doe"), "year": 2020}, {"authors": a("Doe", "Lee"), "year": 2020})
    asked = spark.createDataFrame([(1, "Berg", None, 2020), (2, "Smith", None, 2020), (3, "Lee", None, 2020), (4, "Berg", "Jones", 2020), (5, "Berg", "Smith", 2020)], "ask_id long, author string, coauthor string, year int")
    got = {(r.ask_id, r.row_id, r.priority) for r in lib.author_year_lookup(asked, df).collect()}
    assert got == {(1, 1, 1), (2, 2, 1), (3, 3, 2), (5, 1, 1)}


def test_cascade_stops_at_the_first_source(spark):
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "")], "ask_id long, value string")
    s = lambda *x: spark.createDataFrame(list(x), "value string, row_id long")
    got = lib.cascade(asked, [("x", s(("a", 10))), ("y", s(("a", 20), ("b", 21)))]).collect()
    assert {(r.ask_id, r.source, r.row_id) for r in got} == {(1, "x", 10), (2, "y", 21)}


STORE = "key string, pmid string, pmcid string, title string, abstract string, source string, authors array<struct<last_name:string,first_name:string,initials:string>>, year int, is_retracted boolean, is_review boolean, added_at string"


def test_upserts(spark):
    a = lambda n: [(f"A{i}", "", "") for i in range(n)]
    stored = spark.createDataFrame([("k1", "1", "PMC1", "T", "long", "embedded", a(1), 0, False, False, "2020")], STORE)
    incoming = spark.createDataFrame([("k1", "1", "", "", "", "pubmed", a(12), 2020, True, None, "2021"), ("k2", "2", "", "N", "", "x", None, 0, False, False, "2021")], STORE)
    over = {r.key: r for r in lib.upsert_overwrite(stored, incoming).collect()}
    assert (over["k1"].status, over["k1"].abstract, over["k1"].pmcid, over["k1"].added_at) == ("updated", "", "PMC1", "2020")
    assert over["k2"].status == "inserted"
    merged = {r.key: r for r in lib.upsert_merge(stored, incoming).collect()}
    k = merged["k1"]
    assert (k.title, k.abstract, k.source, k.year, len(k.authors), k.is_retracted) == ("T", "long", "pubmed", 2020, 12, True)


@pytest.mark.parametrize(("query", "ids"), [("gut[ti] AND 2000:2010[dp]", [1]), ("gut OR bone", [1, 2, 3]), ('"bone mass"[ti]', [2]), ("(gut[ti] OR bone[ti]) AND Smith[1au]", [2]), ("Liver[MeSH]", [3])])
def test_query_language(spark, query, ids):
    df = rows(
        spark, {"title": "Gut", "year": 2005}, {"title": "Bone mass", "authors": [("Smith", "", "")], "year": 1999}, {"abstract": "gut", "mesh_terms": ["Liver"], "year": 2020}
    )
    assert sorted(r.row_id for r in df.where(lib.compile_query(query)).collect()) == ids


@pytest.mark.parametrize("query", ["", "(gut", "gut AND", ")"])
def test_broken_queries_are_errors(query, spark):
    with pytest.raises(ValueError):
        lib.compile_query(query)


def test_key_functions_differ(spark):
    r = spark.createDataFrame([("", "https://doi.org/10.1000/A", "T")], "pmid string, doi string, title string").select(
        idn.library_key(F.col("pmid"), F.col("doi"), F.col("title")).alias("a"), idn.plain_key(F.col("pmid"), F.col("doi"), F.col("title")).alias("b"), idn.review_key(F.col("pmid"), F.col("doi"), F.col("title")).alias("c")
    ).first()
    assert tuple(r) == ("doi:10.1000/a", "https://doi.org/10.1000/A", "doi:https://doi.org/10.1000/a")


@pytest.mark.parametrize(("text", "kind"), [("32879322", "pmid"), ("PMC123456", "pmcid"), ("10.1000/x", "doi"), ("https://doi.org/10.1000/x", "doi"), ("https://x.org", "url"), ("Smith 2020", "text"), (None, "text")])
def test_identifier_kind(spark, text, kind):
    assert spark.range(1).select(idn.identifier_kind(F.lit(text).cast("string")).alias("k")).first().k == kind


def test_whole_author_year_lookup_sees_older_rows_of_a_year(spark, tmp_path):
    from citeloom.plans import catalogue

    schema = "row_id long, library_id string, year int, updated_at timestamp, authors array<struct<last_name:string>>"
    rows = [(i, "lib-own", 2001, datetime(2024, 1, 1), [("Other",)]) for i in range(60)] + [(99, "lib-commons", 2001, datetime(2020, 1, 1), [("Smith",)])]
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/references_library.parquet")
    assert catalogue.QUERIES["author_year_lookup"](spark, str(tmp_path)).count() == 0
    assert [tuple(r) for r in catalogue.QUERIES["author_year_lookup_whole"](spark, str(tmp_path)).collect()] == [(99, 99, 1)]


def test_whole_alphabetic_bibliography_places_every_entry(spark, tmp_path):
    from citeloom.plans import catalogue

    spark.createDataFrame([(1, 7, "Cee"), (2, 7, "Aye"), (3, 7, "Bee"), (4, 7, "Aye"), (5, 8, "Zed"), (6, 8, None)], "entry_id long, doc_id long, raw_text string").write.parquet(f"{tmp_path}/bib_entries.parquet")
    got = catalogue.QUERIES["alphabetic_bibliography"](spark, str(tmp_path)).collect()
    assert {(r.entry_id, r.place) for r in got} == {(2, 1), (4, 2), (3, 3), (1, 4), (5, 1)}
