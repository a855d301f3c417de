"""Searches of literature databases over snapshot tables: query forms, ladders, categories, tools."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions.identity import last_word, library_doi, prefixed_pmcid

CAP = 10
CATEGORIES = 3
#: Research domains that have a preprint category; its name has underscores for blanks.
DOMAINS = (
    "neuroscience", "cell biology", "molecular biology", "developmental biology", "immunology", "biochemistry", "genetics", "genomics", "bioinformatics",
    "cancer biology", "microbiology", "physiology", "biophysics", "systems biology",
)

_CLAUSE = re.compile(r'(DOI|EXT_ID|SRC|PMCID|AUTH|PUB_YEAR):(?:"([^"]*)"|(\S+))')


def field_query(query: str) -> Column:
    """The condition of a fielded query such as ``AUTH:"Smith" AND PUB_YEAR:2001`` over rows with doi, pmid, pmcid, authors and year.

    Clauses are joined by AND. A query with anything else in it is an error, not a silent mismatch."""
    rest = _CLAUSE.sub("", query).replace("AND", "").strip()
    clauses = _CLAUSE.findall(query)
    if rest or not clauses:
        raise ValueError(f"not understood: {query}")
    by_field: dict[str, Callable[[str], Column]] = {
        "DOI": lambda v: library_doi(F.col("doi")) == library_doi(F.lit(v)),
        "EXT_ID": lambda v: F.btrim("pmid") == v,
        "SRC": lambda v: F.lit(v != "MED") | (F.coalesce(F.btrim("pmid"), F.lit("")) != ""),
        "PMCID": lambda v: prefixed_pmcid(F.col("pmcid")) == prefixed_pmcid(F.lit(v)),
        "AUTH": lambda v: F.exists("authors", lambda a: last_word(a["last_name"]) == v.lower().split()[-1]),
        "PUB_YEAR": lambda v: F.col("year") == int(v),
    }
    out = F.lit(True)
    for field, quoted, bare in clauses:
        out = out & F.coalesce(by_field[field](quoted or bare), F.lit(False))
    return out


def search_snapshot(hits: DataFrame, query: Column, order: list[Column], most: int) -> DataFrame:
    """A search's answer as a table (query, rank, pmid, total): the best ``most`` hits and how many there were.

    The total is counted apart from the ranking, so only the best hits are ever sorted together."""
    keyed = hits.withColumn("query", query)
    total = keyed.groupBy("query").agg(F.count(F.lit(1)).alias("total"))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= most)
    return ranked.join(total, "query").select("query", "rank", "pmid", "total")


def author_year_ladder(asked: DataFrame, works: DataFrame) -> DataFrame:
    """(ask_id, level, work_id): the works of the first level with any, for asked (ask_id, author, year).

    Levels: first author and year, first author and a year off by one, any author and year, any author and a year off by one.
    Surnames agree by their last word. ``works`` has work_id, authors and year. Works are joined once by author and year."""
    people = works.select("work_id", "year", F.posexplode("authors").alias("pos", "a")).select("work_id", "year", (F.col("pos") == 0).alias("first"), last_word(F.col("a.last_name")).alias("name")).where("name <> ''")
    people = people.groupBy("work_id", "year", "name").agg(F.max("first").alias("first"))
    wanted = asked.select("ask_id", last_word(F.col("author")).alias("name"), F.explode(F.array(F.col("year") - 1, F.col("year"), F.col("year") + 1)).alias("year"), F.col("year").alias("own")).where("name <> ''")
    level = F.when(F.col("first") & (F.col("year") == F.col("own")), 1).when(F.col("first"), 2).when(F.col("year") == F.col("own"), 3).otherwise(4)
    met = wanted.join(people, ["name", "year"]).select("ask_id", "work_id", level.alias("level"))
    best = met.groupBy("ask_id").agg(F.min("level").alias("level"))
    return met.join(best, ["ask_id", "level"]).select("ask_id", "level", "work_id")


def author_year_cascade(asked: DataFrame, library: DataFrame, indexed: DataFrame, further: DataFrame, cap: int = CAP) -> DataFrame:
    """(ask_id, rank, key, total, ambiguous): works for an author and a year.

    The library's come first, then the index's by the ladder, each key once; the further database is asked only where both
    have nothing. ``library`` and ``further`` have ask_id, pos and key, ``indexed`` also the total of the search."""
    near = library.select("ask_id", F.lit(0).alias("src"), "pos", "key").unionByName(indexed.select("ask_id", F.lit(1).alias("src"), "pos", "key"))
    alone = further.join(near.select("ask_id").distinct(), "ask_id", "left_anti").select("ask_id", F.lit(2).alias("src"), "pos", "key")
    once = near.unionByName(alone).where("key <> ''").groupBy("ask_id", "key").agg(F.min(F.struct("src", "pos")).alias("place"))
    n = once.groupBy("ask_id").agg(F.count(F.lit(1)).alias("n"))
    total = indexed.groupBy("ask_id").agg(F.max("total").alias("t"))
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("ask_id").orderBy("place", "key"))).where(F.col("rank") <= cap)
    sized = ranked.join(n, "ask_id").join(total, "ask_id", "left")
    return sized.select("ask_id", "rank", "key", F.greatest("n", F.coalesce("t", F.lit(0))).alias("total"), (F.col("n") > 1).alias("ambiguous"))


def in_category(category: Column, wanted: str) -> Column:
    """Whether a preprint is of a category, without case and with blanks for underscores."""
    return F.lower(F.coalesce(category, F.lit(""))) == wanted.replace("_", " ").lower()


def categories_of(domains: Column) -> Column:
    """The preprint categories of research domains, three at most; where none is known, one blank for all."""
    mapped = F.transform(F.filter(F.transform(domains, F.lower), lambda d: d.isin(*DOMAINS)), lambda d: F.replace(d, F.lit(" "), F.lit("_")))
    return F.when(F.size(mapped) > 0, F.slice(mapped, 1, CATEGORIES)).otherwise(F.array(F.lit("")))


def call_slots(calls: DataFrame, group: str, at: str, tie: str, interval: float) -> DataFrame:
    """Calls with the second in which each may go, ``interval`` apart and never before it was asked for.

    The n-th slot is the greatest of all earlier requests shifted by their distance in calls, so a running maximum is enough."""
    w = Window.partitionBy(group).orderBy(at, tie)
    n = F.row_number().over(w)
    asked = F.unix_micros(F.col(at).cast("timestamp")) / 1e6
    shifted = calls.withColumns({"_n": n, "_s": asked - n * interval})
    return shifted.withColumn("slot", F.max("_s").over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_n") * interval).drop("_n", "_s")


# ---------------------------------------------------------------- tools

#: Schemas of the tools by which a dialogue searches, and of those by which it answers.
TOOLS = {
    "search_user_library": "query string, max_results int",
    "search_pubmed": "query string, max_results int",
    "fetch_articles": "pmids array<string>",
    "search_biorxiv": "keywords array<string>, category string",
    "fetch_biorxiv_preprint": "doi string",
    "search_europepmc": "query string, max_results int",
    "fetch_europepmc_article": "doi string, pmid string",
    "get_fulltext_passages": "pmcid string, pmid string, doi string, keywords array<string>",
}
ANSWER_TOOLS = {
    "submit_citations": "selected array<struct<pmid:string,doi:string,title:string,why:string>>, confidence string, confidence_score int, confidence_rationale string",
    "submit_suggested_evaluation": "selected array<struct<suggestion:string,pmid:string,doi:string,title:string,score:double,why:string>>, unresolved array<struct<suggestion:string,reason:string>>, alternatives array<struct<pmid:string,doi:string,title:string,why:string>>, confidence string, confidence_score int, confidence_rationale string",
    "select_citations": "selected array<struct<pmid:string,doi:string,title:string,score:double,why:string>>",
    "record_verdict": "verdict string, quote string, reason string",
}


def parsed_calls(calls: DataFrame) -> DataFrame:
    """Calls (call_id, tool, args as JSON) with their arguments as JSON of the tool's schema, or an error; never an exception."""
    known = TOOLS | ANSWER_TOOLS
    args = F.lit(None).cast("string")
    valid = F.coalesce(F.try_parse_json("args").isNotNull() & F.btrim("args").startswith("{"), F.lit(False))
    for tool, schema in known.items():
        args = F.when((F.col("tool") == tool) & valid, F.to_json(F.from_json("args", schema))).otherwise(args)
    unknown = ~F.coalesce(F.col("tool").isin(*known), F.lit(False))
    error = F.when(unknown, F.concat(F.lit("unknown tool: "), F.coalesce("tool", F.lit("")))).when(~valid, "arguments are no JSON object")
    return calls.select("call_id", "tool", F.when(error.isNull(), args).alias("args"), error.alias("error"))


def dispatch(tool: str, handlers: dict[str, Callable[..., DataFrame]], **args: object) -> DataFrame | dict[str, str]:
    """The table that a tool's handler gives for its arguments; a fault or an unknown tool is an error record, never an exception."""
    if tool not in handlers:
        return {"error": f"unknown tool: {tool}"}
    try:
        return handlers[tool](**args)
    except Exception as fault:  # noqa: BLE001
        return {"error": f"{tool}: {fault}"}
