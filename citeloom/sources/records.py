"""Bibliographic records from text, XML and JSON, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: RIS tags by field, in order of preference.
RIS_FIELDS = {"title": ("TI", "T1", "CT"), "journal": ("JO", "JF", "JA", "T2"), "abstract": ("AB", "N2"), "volume": ("VL",), "issue": ("IS",), "doi": ("DO",), "year_text": ("PY", "Y1", "Y2", "DA")}
RIS_IDS = ("PM", "ID", "AN", "M1")


def importer_of(path: Column) -> Column:
    """The importer for a file by its suffix; other files are an error row, never an exception."""
    suffix = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(suffix == "ris", "ris").when(suffix == "xml", "endnote_xml").otherwise(F.concat(F.lit("unsupported: ."), suffix))


def parse_person(raw: Column) -> Column:
    """"Last, First" or "First Last" as last name, first name and initials."""
    name = F.regexp_replace(F.btrim(F.coalesce(raw, F.lit(""))), r"\.+$", "")
    words = F.split(name, r"\s+")
    comma = F.contains(name, F.lit(","))
    last = F.when(comma, F.btrim(F.split_part(name, F.lit(","), F.lit(1)))).otherwise(F.element_at(words, -1))
    first = F.when(comma, F.btrim(F.regexp_replace(name, r"^[^,]*,", ""))).otherwise(F.array_join(F.slice(words, 1, F.size(words) - 1), " "))
    initials = F.array_join(F.transform(F.filter(F.split(first, r"\s+"), lambda w: w.rlike(r"^\p{L}")), lambda w: F.upper(F.substring(w, 1, 1))), "")
    return F.struct(last.alias("last_name"), first.alias("first_name"), initials.alias("initials"))


def year_in(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(text, r"((?:19|20)\d{2})", 1).try_cast("int"), F.lit(0))


def ris_records(files: DataFrame, file_id: str, text: str) -> DataFrame:
    """Records of RIS texts: (file, rec_no, tags map of arrays). ``TY`` opens and ``ER`` closes a record; a last one may stay open.

    A record is cut out before its lines are read, so lines never meet in a window over a whole file."""
    parts = F.filter(F.split(F.col(text), r"(?m)^TY  - "), lambda p: F.btrim(p) != "")
    recs = files.select(file_id, F.posexplode(F.transform(parts, lambda p: F.element_at(F.split(p, r"(?m)^ER  - ?"), 1))).alias("rec_no", "body"))
    lines = F.transform(F.filter(F.split(F.concat(F.lit("TY  - "), F.col("body")), r"\r?\n"), lambda x: x.rlike(r"^[A-Z][A-Z0-9]  - ")), lambda x: F.struct(F.substring(x, 1, 2).alias("tag"), F.btrim(F.substring(x, 7, 100000)).alias("val")))
    return recs.select(file_id, (F.col("rec_no") + 1).alias("rec_no"), lines.alias("lines"))


def ris_candidates(files: DataFrame, file_id: str, text: str) -> DataFrame:
    """Records of RIS texts as works; those without title, PMID and DOI are left out."""
    r = ris_records(files, file_id, text)
    values = lambda tags: F.filter(F.transform(F.filter("lines", lambda x: x["tag"].isin(*tags)), lambda x: x["val"]), lambda v: v != "")
    first = lambda tags: F.coalesce(*[F.try_element_at(values((t,)), F.lit(1)) for t in tags], F.lit(""))
    ids = F.filter(F.transform(values(RIS_IDS), lambda v: F.when(v.rlike(r"^\d+$"), v).otherwise(F.regexp_extract(v, r"\b(\d{7,9})\b", 1))), lambda v: v != "")
    pages = F.concat_ws("-", F.nullif(first(("SP",)), F.lit("")), F.nullif(first(("EP",)), F.lit("")))
    out = r.select(
        file_id, "rec_no", *[first(tags).alias(name) for name, tags in RIS_FIELDS.items()], F.coalesce(F.try_element_at(ids, F.lit(1)), F.lit("")).alias("pmid"),
        F.when(pages != "", pages).otherwise(first(("PG",))).alias("pages"), F.transform(F.concat(values(("AU",)), values(("A1",))), parse_person).alias("authors"),
    )
    return out.withColumn("year", year_in(F.col("year_text"))).drop("year_text").where("title <> '' or pmid <> '' or doi <> ''")


def to_ris(title: Column, authors: Column, year: Column, journal: Column, doi: Column, pmid: Column, pages: Column) -> Column:
    """A work as a RIS record; blank fields give no line."""
    line = lambda tag, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{tag}  - "), F.regexp_replace(v, r"\s+", " ")))
    people = F.transform(authors, lambda a: F.concat(F.lit("AU  - "), F.concat_ws(", ", F.nullif(a["last_name"], F.lit("")), F.nullif(a["first_name"], F.lit("")))))
    fields = F.array_compact(F.array(line("TI", F.btrim(title)), line("PY", F.nullif(year, F.lit(0)).cast("string")), line("JO", journal), line("DO", doi), line("PM", pmid), line("SP", F.split_part(pages, F.lit("-"), F.lit(1))), line("EP", F.split_part(pages, F.lit("-"), F.lit(2)))))
    return F.concat(F.lit("TY  - JOUR\n"), F.array_join(F.concat(F.coalesce(people, F.array().cast("array<string>")), fields), "\n"), F.lit("\nER  - \n"))


def escape_xml(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    return out


#: The part of an article's XML that is read; everything else is skipped by the parser.
PUBMED_SCHEMA = (
    "MedlineCitation struct<PMID:string,MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:string>>>,Article:struct<Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,ELocationID:array<struct<_EIdType:string,_VALUE:string>>,Journal:struct<JournalIssue:struct<Volume:string,PubDate:struct<Year:string>>,Title:string,ISOAbbreviation:string>,"
    "ArticleTitle:string,AuthorList:struct<Author:array<struct<LastName:string,ForeName:string,Initials:string>>>,PublicationTypeList:struct<PublicationType:array<string>>,"
    "ArticleDate:struct<Year:string>>>, PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"
)


def pubmed_articles(df: DataFrame, key: str, xml: str) -> DataFrame:
    """Works from article XML. The title's inner tags are flattened; broken XML gives nulls, never an exception."""
    a = df.select(key, F.from_xml(F.col(xml), PUBMED_SCHEMA, {"rowTag": "PubmedArticle"}).alias("a"), F.col(xml).alias("_xml"))
    art = F.col("a.MedlineCitation.Article")
    ident = lambda kind: F.coalesce(F.try_element_at(F.transform(F.filter("a.PubmedData.ArticleIdList.ArticleId", lambda i: i["_IdType"] == kind), lambda i: i["_VALUE"]), F.lit(1)), F.lit(""))
    flat = F.regexp_replace(art["ArticleTitle"], r"<[^>]+>", "")
    types = art["PublicationTypeList"]["PublicationType"]
    return a.select(
        key,
        F.coalesce("a.MedlineCitation.PMID", F.lit("")).alias("pmid"),
        F.coalesce(F.btrim(flat), F.lit("")).alias("title"),
        F.filter(F.transform(art["AuthorList"]["Author"], lambda p: F.struct(p["LastName"].alias("last_name"), p["ForeName"].alias("first_name"), p["Initials"].alias("initials"))), lambda p: p["last_name"].isNotNull()).alias("authors"),
        F.coalesce(art["Journal"]["JournalIssue"]["PubDate"]["Year"].try_cast("int"), art["ArticleDate"]["Year"].try_cast("int"), F.lit(0)).alias("year"),
        F.coalesce(art["Journal"]["Title"], F.lit("")).alias("journal"),
        F.coalesce(art["Journal"]["ISOAbbreviation"], F.lit("")).alias("journal_abbrev"),
        # labelled parts of an abstract stand after one another
        F.coalesce(F.array_join(F.transform(art["Abstract"]["AbstractText"], lambda p: F.concat_ws(": ", F.nullif(p["_Label"], F.lit("")), F.btrim(F.regexp_replace(p["_VALUE"], r"<[^>]+>", "")))), "\n"), F.lit("")).alias("abstract"),
        F.coalesce(F.transform(F.col("a.MedlineCitation.MeshHeadingList.MeshHeading"), lambda m: m["DescriptorName"]), F.array().cast("array<string>")).alias("mesh_terms"),
        F.coalesce(F.try_element_at(F.transform(F.filter(art["ELocationID"], lambda i: i["_EIdType"] == "doi"), lambda i: i["_VALUE"]), F.lit(1)), ident("doi")).alias("doi"),
        F.coalesce(F.exists(types, lambda t: F.contains(F.lower(t), F.lit("review"))), F.lit(False)).alias("is_review"),
        F.coalesce(F.exists(types, lambda t: F.contains(F.lower(t), F.lit("retract"))), F.lit(False)).alias("is_retracted"),
    )


#: The part of a search hit's JSON that is read.
EUROPEPMC_SCHEMA = (
    "title string, pmid string, pmcid string, doi string, pubYear string, abstractText string, source string, journalInfo struct<volume:string,journal:struct<title:string>>, "
    "authorList struct<author:array<struct<lastName:string,firstName:string,initials:string,fullName:string>>>, authorString string, pubTypeList struct<pubType:array<string>>, isOpenAccess string"
)


def europepmc_hits(df: DataFrame, key: str, text: str) -> DataFrame:
    """Works from search hits; a hit without a title is left out. Structured authors come first, else the author string."""
    h = df.select(key, F.from_json(text, EUROPEPMC_SCHEMA).alias("h"))
    listed = F.transform("h.authorList.author", lambda p: F.struct(F.coalesce(p["lastName"], F.split_part(p["fullName"], F.lit(" "), F.lit(1))).alias("last_name"), F.coalesce(p["firstName"], F.lit("")).alias("first_name"), F.coalesce(p["initials"], F.lit("")).alias("initials")))
    typed = F.transform(F.split(F.regexp_replace("h.authorString", r"\.$", ""), r",\s*"), lambda p: F.struct(F.regexp_replace(p, r"\s+\S+$", "").alias("last_name"), F.lit("").alias("first_name"), F.regexp_extract(p, r"\s+(\S+)$", 1).alias("initials")))
    types = F.transform("h.pubTypeList.pubType", F.lower)
    out = h.select(
        key, F.regexp_replace("h.title", r"\.+$", "").alias("title"), F.coalesce("h.pmid", F.lit("")).alias("pmid"), F.coalesce("h.doi", F.lit("")).alias("doi"), F.coalesce("h.pmcid", F.lit("")).alias("pmcid"),
        F.coalesce(F.col("h.pubYear").try_cast("int"), F.lit(0)).alias("year"), F.coalesce("h.journalInfo.journal.title", F.when(F.col("h.source") == "PPR", "Preprint"), F.lit("")).alias("journal"),
        F.coalesce(listed, typed, F.array().cast("array<struct<last_name:string,first_name:string,initials:string>>")).alias("authors"), F.coalesce(F.array_contains(types, "review"), F.lit(False)).alias("is_review"),
        (F.coalesce("h.isOpenAccess", F.lit("")) == "Y").alias("open_access"),
    )
    return out.where("title is not null and title <> ''")


ENDNOTE_SCHEMA = (
    "titles struct<title:string>, contributors struct<authors:struct<author:array<string>>>, dates struct<year:string>, periodical struct<`full-title`:string>, `electronic-resource-num` string, `accession-num` string, abstract string, pages string, volume string, number string"
)


def endnote_records(df: DataFrame, key: str, xml: str) -> DataFrame:
    """Works from exported XML records, one record per row (split files with the row tag ``record``)."""
    r = df.select(key, F.from_xml(F.col(xml), ENDNOTE_SCHEMA, {"rowTag": "record"}).alias("r"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return r.select(
        key, text("r.titles.title").alias("title"), F.coalesce(F.transform("r.contributors.authors.author", parse_person), F.array().cast("array<struct<last_name:string,first_name:string,initials:string>>")).alias("authors"),
        year_in(text("r.dates.year")).alias("year"), text("r.periodical.full-title").alias("journal"), text("r.electronic-resource-num").alias("doi"), F.regexp_extract(text("r.accession-num"), r"(\d+)", 1).alias("pmid"), text("r.pages").alias("pages"),
    ).where("title <> '' or pmid <> '' or doi <> ''")


def summary(abstract: Column, authors: Column, mesh: Column) -> list[Column]:
    """A work in short (B14): 2000 characters of its abstract, six authors, ten subject terms."""
    names = F.array_join(F.transform(F.slice(authors, 1, 6), lambda a: F.btrim(F.concat_ws(" ", a["last_name"], a["initials"]))), ", ")
    people = F.concat(names, F.when(F.size(authors) > 6, " et al.").otherwise(""))
    terms = F.array_join(F.slice(F.coalesce(mesh, F.array().cast("array<string>")), 1, 10), "; ")
    return [F.substring(F.coalesce(abstract, F.lit("")), 1, 2000).alias("abstract"), people.alias("authors"), terms.alias("mesh")]


def csl_item(uuid: Column, title: Column, authors: Column, year: Column, journal: Column, volume: Column, doi: Column, pmid: Column) -> Column:
    """A work as a JSON item of a citation payload; the abstract never travels."""
    people = F.transform(authors, lambda a: F.struct(a["last_name"].alias("family"), F.coalesce(F.nullif(a["first_name"], F.lit("")), a["initials"]).alias("given")))
    return F.to_json(F.struct(uuid.alias("id"), F.lit("article-journal").alias("type"), title.alias("title"), people.alias("author"), F.struct(F.array(F.array(year)).alias("date-parts")).alias("issued"), journal.alias("container-title"), volume.alias("volume"), doi.alias("DOI"), pmid.alias("PMID")), {"ignoreNullFields": "true"})


def csl_work(item: Column) -> Column:
    """The work of a JSON item."""
    parsed = F.from_json(item, "id string, title string, author array<struct<family:string,given:string>>, issued struct<`date-parts`:array<array<int>>>, `container-title` string, volume string, DOI string, PMID string")
    return F.struct(
        parsed["id"].alias("uuid"), parsed["title"].alias("title"), F.transform(parsed["author"], lambda a: F.struct(a["family"].alias("last_name"), F.when(a["given"].rlike(r"^[A-Z]{1,2}$"), "").otherwise(a["given"]).alias("first_name"), F.when(a["given"].rlike(r"^[A-Z]{1,2}$"), a["given"]).otherwise("").alias("initials"))).alias("authors"),
        F.try_element_at(F.try_element_at(parsed["issued"]["date-parts"], F.lit(1)), F.lit(1)).alias("year"), parsed["container-title"].alias("journal"), parsed["volume"].alias("volume"), parsed["DOI"].alias("doi"), parsed["PMID"].alias("pmid"),
    )


def last_versions(df: DataFrame) -> DataFrame:
    """Of preprint records (doi, version, published_doi, ...) the last version of each DOI; "NA" stands for no published DOI."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    rows = df.groupBy("doi").agg(F.max_by(whole, F.col("version").try_cast("int")).alias("_r")).select("_r.*")
    return rows.withColumn("published_doi", F.when(F.upper("published_doi") == "NA", "").otherwise(F.coalesce("published_doi", F.lit(""))))
