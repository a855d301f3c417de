"""Readers and writers of records and documents, streams."""

import sqlite3
from datetime import datetime

from pyspark.sql import functions as F

from citeloom.sources import docx, fulltext, records, stores
from citeloom.streaming import ttl


def test_ris_unterminated_record_and_fallbacks(spark):
    text = "TY  - JOUR\nT1  - One\nAU  - Doe, Jane Ann\nA1  - Smith\nY1  - 2001/02\nAN  - see 12345678\nSP  - 1\nEP  - 9\nER  - \nTY  - JOUR\nTI  - Two\nDO  - 10.1000/x"
    got = records.ris_candidates(spark.createDataFrame([(1, text), (2, None), (3, "")], "f int, t string"), "f", "t").orderBy("rec_no").collect()
    assert [(r.title, r.pmid, r.year, r.pages, r.doi) for r in got] == [("One", "12345678", 2001, "1-9", ""), ("Two", "", 0, "", "10.1000/x")]
    assert [tuple(a) for a in got[0].authors] == [("Doe", "Jane Ann", "JA"), ("Smith", "", "")]


def test_pubmed_title_with_inner_tags_and_broken_xml(spark):
    xml = "<PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>A b c</ArticleTitle><PublicationTypeList><PublicationType>Retraction of Publication</PublicationType><PublicationType>x</PublicationType></PublicationTypeList></Article></MedlineCitation></PubmedArticle>"
    got = records.pubmed_articles(spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "k int, x string"), "k", "x").orderBy("k").collect()
    assert (got[0].pmid, got[0].title, got[0].is_retracted) == ("7", "A b c", True)
    assert [r.title for r in got[1:]] == ["", ""]


def test_europepmc_author_string(spark):
    hit = '{"title":"T.","authorString":"Doe J, van Berg AB.","source":"PPR","pubYear":"2020","isOpenAccess":"Y"}'
    r = records.europepmc_hits(spark.createDataFrame([(1, hit), (2, "{}"), (3, "broken")], "k int, j string"), "k", "j").collect()
    assert len(r) == 1 and (r[0].title, r[0].journal, r[0].open_access) == ("T", "Preprint", True)
    assert [(a.last_name, a.initials) for a in r[0].authors] == [("Doe", "J"), ("van Berg", "AB")]


def test_endnote_record(spark):
    xml = "<record><titles><title>T</title></titles><contributors><authors><author>Doe, J.</author><author>B C</author></authors></contributors><dates><year>1999</year></dates><accession-num>PMID 55</accession-num></record>"
    r = records.endnote_records(spark.createDataFrame([(1, xml)], "k int, x string"), "k", "x").first()
    assert (r.title, r.year, r.pmid, [a.last_name for a in r.authors]) == ("T", 1999, "55", ["Doe", "C"])


def test_importer_and_last_version(spark):
    df = spark.createDataFrame([("a.RIS",), ("b.xml",), ("c.enl",)], "p string")
    assert [r.i for r in df.select(records.importer_of(F.col("p")).alias("i")).collect()] == ["ris", "endnote_xml", "unsupported: .enl"]
    v = spark.createDataFrame([("d", "1", "NA"), ("d", "10", "10.1/x"), ("d", "9", "NA")], "doi string, version string, published_doi string")
    assert [tuple(r) for r in records.last_versions(v).collect()] == [("d", "10", "10.1/x")]


JATS = """<article xmlns:x="urn:x"><body><sec><title>Results</title><p>%s</p><fig><p>%s</p></fig><sec><title>Time course</title><p>%s</p></sec></sec><p>short</p></body><back><p>%s</p></back></article>"""


def test_jats_sections(spark):
    long = "This paragraph is certainly longer than forty characters."
    df = spark.createDataFrame([("a", JATS % ((long,) * 4)), ("b", "<x"), ("c", None), ("d", "<a/>")], "k string, x string")
    got = fulltext.fulltext_paragraphs(df, "k", "x").orderBy("idx").collect()
    assert [(r.k, r.idx, r.section) for r in got] == [("a", 1, "Results"), ("a", 2, "Results > Time course")]


def test_docx_fields_and_styles(spark):
    data = docx.document_bytes(["Introduction", "It works "], ["Heading1", ""], {1: (" ADDIN X.CITE {} ", "[1]")})
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"no zip"))], "k int, b binary")
    assert [(r.para_index, r.style, r.text) for r in docx.paragraphs(df, "k", "b").orderBy("para_index").collect()] == [(0, "Heading1", "Introduction"), (1, "", "It works [1]")]
    f = docx.fields(df, "k", "b").withColumn("kind", docx.field_kind(F.col("code"))).collect()
    assert [(r.code.strip(), r.result_text, r.complete, r.kind) for r in f] == [("ADDIN X.CITE {}", "[1]", True, "citation")]
    assert docx.field_problems(docx.fields(df, "k", "b"), "k").first().problems == []


def test_cache_and_project(spark, tmp_path):
    t = datetime(2024, 3, 1)
    cache = spark.createDataFrame([("a", "old", datetime(2024, 1, 1)), ("b", "x", datetime(2024, 2, 20)), ("b", "y", datetime(2024, 2, 25))], "key string, value string, ts timestamp")
    assert [(r.key, r.value) for r in stores.live_cache(cache, F.lit(t)).collect()] == [("b", "y")]
    path = str(tmp_path / "p")
    stores.write_project(spark.createDataFrame([("n", "secret")], "name string, api_key string"), path)
    got = stores.read_project(spark, path, "name string").first()
    assert (got.name, got.version) == ("n", 2)


def test_legacy_library_file(spark, tmp_path):
    path = tmp_path / "lib.db"
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE references_library (key TEXT, pmid TEXT, title TEXT, authors_json TEXT, year INT)")
    con.execute("INSERT INTO references_library VALUES ('k', '1', 'T', '[{\"last_name\": \"Doe\"}]', 2020), ('l', '2', 'U', 'broken', NULL)")
    con.commit()
    con.close()
    (tmp_path / "bad.db").write_bytes(b"not a database")
    files = spark.read.format("binaryFile").load(str(tmp_path / "*.db"))
    got = {r.key: r for r in stores.library_files(files).collect()}
    assert (got["k"].authors[0].last_name, got["k"].year, got["l"].authors, got["l"].year) == ("Doe", 2020, [], 0)


def _drain(query):
    query.processAllAvailable()
    query.stop()


def test_streams_agree_with_batch(spark, data_dir, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    spark.read.parquet(f"{data_dir}/events.parquet").repartition(3).write.mode("overwrite").parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 5).parquet(str(src))
    _drain(ttl.windowed_counts(stream(), "ts", "event_type").writeStream.outputMode("update").format("memory").queryName("counts").start())
    assert spark.table("counts").count() > 0
    _drain(ttl.first_seen(stream(), "user_id", "ts", "1000 days").writeStream.format("memory").queryName("seen").start())
    assert spark.table("seen").count() == spark.read.parquet(str(src)).select("user_id").distinct().count()
