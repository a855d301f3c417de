"""Identity of cited works: normalised identifiers and the different key functions (H27, H35-H37, section 1.3)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Resolver hosts whose address may stand before a DOI.
RESOLVER = r"(?i)^https?://(?:dx\.)?doi\.(?:org|example)/"


def blank_to_null(c: Column) -> Column:
    return F.when(F.btrim(c) != "", c)


def library_doi(doi: Column) -> Column:
    """Without resolver address, lower case; '' where missing."""
    return F.lower(F.regexp_replace(F.btrim(F.coalesce(doi, F.lit(""))), RESOLVER, ""))


def item_doi(doi: Column) -> Column:
    """As `library_doi`, also without a ``doi:`` prefix."""
    return F.regexp_replace(library_doi(doi), r"^doi:\s*", "")


def resolver_doi(doi: Column) -> Column:
    """As `library_doi`, also without closing full stops."""
    return F.regexp_replace(library_doi(doi), r"\.+$", "")


def library_pmcid(pmcid: Column) -> Column:
    """``PMC`` and digits in upper case; '' for anything else."""
    v = F.upper(F.btrim(F.coalesce(pmcid, F.lit(""))))
    v = F.when(v.rlike(r"^\d+$"), F.concat(F.lit("PMC"), v)).otherwise(v)
    return F.when(v.rlike(r"^PMC\d+$"), v).otherwise("")


def prefixed_pmcid(pmcid: Column) -> Column:
    """In upper case with the prefix ``PMC`` before whatever stands there; '' where missing."""
    v = F.upper(F.btrim(F.coalesce(pmcid, F.lit(""))))
    return F.when((v == "") | v.startswith("PMC"), v).otherwise(F.concat(F.lit("PMC"), v))


def title_words(title: Column) -> Column:
    """Letters and digits of a title in lower case, words apart by one space."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]+", " "))


def library_key(pmid: Column, doi: Column, title: Column) -> Column:
    """PMID, else DOI, else the title's first 240 characters; '' where all are missing."""
    t = title_words(title)
    return (
        F.when(F.coalesce(pmid, F.lit("")) != "", F.concat(F.lit("pmid:"), F.btrim(pmid)))
        .when(library_doi(doi) != "", F.concat(F.lit("doi:"), library_doi(doi)))
        .when(t != "", F.concat(F.lit("title:"), F.substring(t, 1, 240)))
        .otherwise("")
    )


def plain_key(pmid: Column, doi: Column, title: Column) -> Column:
    """The first of PMID, DOI and title that is there, as typed."""
    return F.coalesce(F.nullif(pmid, F.lit("")), F.nullif(doi, F.lit("")), F.nullif(title, F.lit("")), F.lit(""))


def review_key(pmid: Column, doi: Column, title: Column) -> Column:
    """Prefixed; DOI and title only trimmed and in lower case."""
    low = lambda c: F.lower(F.btrim(F.coalesce(c, F.lit(""))))
    return F.when(low(pmid) != "", F.concat(F.lit("pmid:"), low(pmid))).when(low(doi) != "", F.concat(F.lit("doi:"), low(doi))).when(low(title) != "", F.concat(F.lit("title:"), low(title))).otherwise("")


def aliases(uuid: Column, pmid: Column, doi: Column, title: Column) -> Column:
    """The alias keys of a work in order of trust; the title's are its first 60 normalised characters."""
    low = lambda c: F.lower(F.btrim(F.coalesce(c, F.lit(""))))
    t = F.substring(title_words(title), 1, 60)
    tagged = lambda tag, c: F.when(c != "", F.concat(F.lit(tag), c))
    return F.array_compact(F.array(tagged("uuid:", low(uuid)), tagged("pmid:", low(pmid)), tagged("doi:", low(doi)), tagged("title:", t)))


def same_paper(a: Column, b: Column) -> Column:
    """Whether two records are one paper: by PMID if both have one, else DOI, else PMCID, else the exact title in lower case."""
    low = lambda r, f: F.lower(F.btrim(F.coalesce(r[f], F.lit(""))))
    verdict = (low(a, "title") != "") & (low(a, "title") == low(b, "title"))
    for f in ("pmcid", "doi", "pmid"):
        verdict = F.when((low(a, f) != "") & (low(b, f) != ""), low(a, f) == low(b, f)).otherwise(verdict)
    return verdict


def last_word(name: Column) -> Column:
    """The last word of a surname in lower case."""
    return F.lower(F.element_at(F.split(F.btrim(F.coalesce(name, F.lit(""))), r"\s+"), -1))


def identifier_kind(text: Column) -> Column:
    """What kind of identifier was typed."""
    v = F.btrim(F.coalesce(text, F.lit("")))
    return (
        F.when(v.rlike(r"(?i)^(?:pmid:?\s*)?\d{1,9}$"), "pmid")
        .when(v.rlike(r"(?i)^(?:pmcid:?\s*)?pmc\s?\d{4,9}$"), "pmcid")
        .when(v.rlike(r"(?i)^(?:doi:?\s*|https?://\S+/)?10\.\d{4,9}/\S+$"), "doi")
        .when(v.rlike(r"(?i)^https?://"), "url")
        .otherwise("text")
    )


def record_uris(uuid: Column, doi: Column, pmid: Column) -> Column:
    """The addresses under which a work is known: record, DOI, PMID."""
    d = item_doi(doi)
    return F.array_compact(F.array(F.when(blank_to_null(uuid).isNotNull(), F.concat(F.lit("record/"), uuid)), F.when(d != "", F.concat(F.lit("https://doi.org/"), d)), F.when(blank_to_null(pmid).isNotNull(), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), F.btrim(pmid), F.lit("/")))))


def identity_from_uris(uris: Column) -> Column:
    """Record, DOI and PMID from a work's addresses, the first of each kind; '' where there is none."""
    after = lambda start: F.coalesce(F.try_element_at(F.transform(F.filter(uris, lambda u: F.startswith(u, F.lit(start))), lambda u: F.regexp_replace(F.substring(u, len(start) + 1, 100000), r"/+$", "")), F.lit(1)), F.lit(""))
    return F.struct(after("record/").alias("uuid"), after("https://doi.org/").alias("doi"), after("https://pubmed.ncbi.nlm.nih.gov/").alias("pmid"))


def first_author_year(authors: Column, year: Column) -> Column:
    """A label by first author and year; "et al." from three authors on."""
    y = F.coalesce(year, F.lit(0)).cast("string")
    last = lambda i: F.coalesce(F.try_element_at(authors, F.lit(i))["last_name"], F.lit(""))
    n = F.coalesce(F.size(authors), F.lit(0))
    return (
        F.when(n <= 0, y)
        .when(n > 2, F.concat(last(1), F.lit(" et al., "), y))
        .when(n == 2, F.concat(last(1), F.lit(" & "), last(2), F.lit(", "), y))
        .otherwise(F.concat(last(1), F.lit(", "), y))
    )
