"""The reference library: ranked search, lookups, cascades over sources, upserts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions import identity

#: Points of a token by the field it occurs in, and of equal identifiers.
TOKEN_POINTS = {"title": 12.0, "abstract": 5.0, "authors": 3.0, "journal": 2.0}
RECENT_ROWS = 3000
YEAR_ROWS = 50


def query_tokens(query: str) -> list[str]:
    """The tokens of a search; repeated ones count repeatedly."""
    return [t for t in re.findall(r"[a-z0-9][a-z0-9.\-_/]*", query.lower()) if len(t) > 1]


def author_text(authors: Column) -> Column:
    """All authors as "last initials" in lower case."""
    return F.lower(F.array_join(F.transform(F.coalesce(authors, F.array().cast("array<struct<last_name:string,first_name:string,initials:string>>")), lambda a: F.btrim(F.concat_ws(" ", a["last_name"], a["initials"]))), " "))


def token_score(tokens: list[str], row: dict[str, Column] | None = None) -> Column:
    """Points of a library row for the tokens, and a little for recency, which alone admits rows without any hit."""
    c = row or {k: F.col(k) for k in ("title", "abstract", "authors", "journal", "pmid", "doi", "year")}
    fields = {"title": F.lower(F.coalesce(c["title"], F.lit(""))), "abstract": F.lower(F.coalesce(c["abstract"], F.lit(""))), "authors": author_text(c["authors"]), "journal": F.lower(F.coalesce(c["journal"], F.lit("")))}
    doi = identity.library_doi(c["doi"])
    score = F.lit(0.0)
    for t in tokens:
        for name, points in TOKEN_POINTS.items():
            score = score + F.when(F.contains(fields[name], F.lit(t)), points).otherwise(0.0)
        score = score + F.when(F.lower(c["pmid"]) == t, 30.0).otherwise(0.0) + F.when((doi != "") & F.contains(doi, F.lit(t)), 20.0).otherwise(0.0)
    year = F.coalesce(c["year"], F.lit(0))
    return score + F.when(year != 0, F.least(F.greatest(year - 1990, F.lit(0)), F.lit(40)) * 0.02).otherwise(0.0)


def search(library: DataFrame, query: str, most: int = 10, recent: int | None = RECENT_ROWS, require_token_hit: bool = False) -> DataFrame:
    """The best rows for a query among the ``recent`` newest (None: among all), with their score.

    A query without tokens gives the newest rows. ``most`` is kept within 1 and 50. Rows tie by year, then by newness."""
    most = min(max(most, 1), 50)
    newest = (F.col("updated_at").desc_nulls_last(), F.col("row_id").asc())
    window = library.orderBy(*newest).limit(recent) if recent else library
    tokens = query_tokens(query)
    if not tokens:
        return window.withColumn("score", F.lit(0.0)).orderBy(*newest).limit(most)
    scored = window.withColumn("score", token_score(tokens)).where(F.col("score") > (0.8 if require_token_hit else 0.0))
    return scored.orderBy(F.col("score").desc(), F.coalesce("year", F.lit(0)).desc(), *newest).limit(most)


def newest_per(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    """Of rows with an equal, non-blank key the last updated; null times are oldest, ties go to the smaller row id."""
    keyed = df.withColumn(name, key).where(F.col(name) != "")
    whole = F.struct(*[F.col(c) for c in df.columns])
    best = keyed.groupBy(name).agg(F.max_by(whole, F.struct("updated_at", -F.col("row_id"))).alias("_r"))
    return best.select(name, "_r.*")


def identifier_lookup(asked: DataFrame, library: DataFrame) -> DataFrame:
    """(ask_id, kind, row_id) for identifiers (ask_id, kind, value) that the library knows."""
    slim = library.select("row_id", "pmid", "doi", "pmcid", "updated_at")
    known = [newest_per(slim, k).select(F.lit(kind).alias("kind"), F.col("key").alias("value"), "row_id") for kind, k in (("pmid", F.btrim(F.coalesce("pmid", F.lit("")))), ("doi", identity.library_doi(F.col("doi"))), ("pmcid", identity.library_pmcid(F.col("pmcid"))))]
    table = known[0].unionByName(known[1]).unionByName(known[2])
    norm = F.when(F.col("kind") == "doi", identity.library_doi(F.col("value"))).when(F.col("kind") == "pmcid", identity.library_pmcid(F.col("value"))).otherwise(F.btrim("value"))
    return asked.withColumn("value", norm).join(table, ["kind", "value"]).select("ask_id", "kind", "row_id")


def author_year_lookup(asked: DataFrame, library: DataFrame, per_year: int | None = YEAR_ROWS) -> DataFrame:
    """(ask_id, row_id, priority) for (ask_id, author, coauthor, year): rows of the year with that surname.

    The co-author must be among the authors too. Rows whose first author it is come first; only where there is none,
    rows with it as any author count. ``per_year`` takes only the newest rows of a year, None all."""
    rows = library.where(F.col("year") > 0).select("row_id", "year", "updated_at", F.transform("authors", lambda a: identity.last_word(a["last_name"])).alias("names"))
    if per_year:
        order = Window.partitionBy("year").orderBy(F.col("updated_at").desc_nulls_last(), "row_id")
        rows = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_year).drop("_n")
    named = rows.select("row_id", "year", "names", F.posexplode("names").alias("pos", "name")).groupBy("row_id", "year", "name").agg(F.min("pos").alias("pos"), F.first("names").alias("names"))
    want = asked.select("ask_id", "year", identity.last_word(F.col("author")).alias("name"), F.when(F.btrim("coauthor") != "", identity.last_word(F.col("coauthor"))).alias("second")).where("name <> ''")
    hit = want.join(named, ["year", "name"]).where(F.col("second").isNull() | F.array_contains("names", F.col("second")))
    hit = hit.select("ask_id", "row_id", F.when(F.col("pos") == 0, 1).otherwise(2).alias("priority"))
    best = hit.groupBy("ask_id").agg(F.min("priority").alias("priority"))
    return hit.join(best, ["ask_id", "priority"]).select("ask_id", "row_id", "priority").distinct()


def cascade(asked: DataFrame, sources: list[tuple[str, DataFrame]]) -> DataFrame:
    """(ask_id, value, priority, source, row_id): for each asked value the first source that has it, in their order.

    Each source has (value, row_id). Later sources only see what is left, so nothing is looked up twice."""
    out, rest = None, asked.select("ask_id", "value").where("value <> ''")
    for i, (name, table) in enumerate(sources, 1):
        best = table.where("value <> ''").groupBy("value").agg(F.min("row_id").alias("row_id"))
        hit = rest.join(best, "value").select("ask_id", "value", F.lit(i).alias("priority"), F.lit(name).alias("source"), "row_id")
        out = hit if out is None else out.unionByName(hit)
        rest = rest.join(best.select("value"), "value", "left_anti")
    return out


def first_per(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group, by sorting only what the group's best needs."""
    whole = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(*keys).agg(F.min_by(whole, F.struct(*order)).alias("_r")).select("_r.*")


def in_request_order(requests: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Requested values (request_id, pos, value) with their records (value, row_id); missing ones have no row id."""
    return requests.join(snapshot.groupBy("value").agg(F.min("row_id").alias("row_id")), "value", "left").select("request_id", "pos", "value", "row_id")


def unique_matches(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Pairs on equal, non-blank keys where exactly one row of ``right`` fits."""
    full = F.forall(F.array(*[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]), lambda v: v != "")
    once = right.where(full).groupBy(*keys).agg(F.min(right_id).alias(right_id), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    return left.where(full).join(once, keys).select(left_id, right_id)


# ---------------------------------------------------------------- upserts


def _fill(mine: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(mine, F.lit("")), F.nullif(other, F.lit("")), F.lit(""))


TEXT_COLUMNS = ("pmid", "doi", "title", "journal", "journal_abbrev", "volume", "issue", "pages", "abstract", "source")


def upsert_overwrite(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store after incoming rows replaced equal keys, with the status of each row.

    All columns are replaced but ``added_at``; a PMCID is kept where the incoming one is blank. An incoming blank
    erases anything else. Keys are unique on either side; reduce batches with `last_per_key` first."""
    s, i = stored.alias("s"), incoming.alias("i")
    both = s.join(i, F.col("s.key") == F.col("i.key"), "full_outer")
    new, old = F.col("i.key").isNotNull(), F.col("s.key").isNotNull()
    pick = lambda c: F.when(new, F.col(f"i.{c}")).otherwise(F.col(f"s.{c}"))
    cols = [c for c in stored.columns if c not in ("key", "added_at", "pmcid")]
    return both.select(
        F.coalesce("i.key", "s.key").alias("key"),
        F.when(new & old, "updated").when(new, "inserted").otherwise("kept").alias("status"),
        F.when(old, F.col("s.added_at")).otherwise(F.col("i.added_at")).alias("added_at"),
        F.when(new, _fill(F.col("i.pmcid"), F.col("s.pmcid"))).otherwise(F.coalesce("s.pmcid", F.lit(""))).alias("pmcid"),
        *[pick(c).alias(c) for c in cols],
    )


def upsert_merge(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The store after incoming rows filled what equal keys lacked.

    Non-blank texts stay, a missing year is filled, the longer author list wins, flags are joined by "or", and the origin
    stays unless it is an embedded one."""
    s, i = stored.alias("s"), incoming.alias("i")
    both = s.join(i, F.col("s.key") == F.col("i.key"), "full_outer")
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    embedded = F.contains(F.lower(F.coalesce("s.source", F.lit(""))), F.lit("embedded"))
    text = {c: _fill(F.col(f"s.{c}"), F.col(f"i.{c}")) for c in TEXT_COLUMNS if c in stored.columns}
    if "source" in text:
        text["source"] = F.when(embedded, _fill(F.col("i.source"), F.col("s.source"))).otherwise(text["source"])
    return both.select(
        F.coalesce("s.key", "i.key").alias("key"),
        *[v.alias(c) for c, v in text.items()],
        F.coalesce(F.nullif("s.year", F.lit(0)), F.nullif("i.year", F.lit(0)), F.lit(0)).alias("year"),
        F.when(n(F.col("i.authors")) > n(F.col("s.authors")), F.col("i.authors")).otherwise(F.col("s.authors")).alias("authors"),
        (F.coalesce("s.is_retracted", F.lit(False)) | F.coalesce("i.is_retracted", F.lit(False))).alias("is_retracted"),
        (F.coalesce("s.is_review", F.lit(False)) | F.coalesce("i.is_review", F.lit(False))).alias("is_review"),
        F.coalesce("s.added_at", "i.added_at").alias("added_at"),
    )


def last_per_key(batch: DataFrame, order: str) -> DataFrame:
    """A batch in which the last row of each key stands for all, as later rows overwrite earlier ones."""
    whole = F.struct(*[F.col(c) for c in batch.columns])
    return batch.groupBy("key").agg(F.max_by(whole, order).alias("_r")).select("_r.*")


# ---------------------------------------------------------------- search language of the sources

_TERM = re.compile(r'\s*(?:(AND|OR)\b|(\()|(\))|(\d{4}):(\d{4})\[(?:dp|PDAT)\]|"([^"]*)"(?:\[(\w+)\])?|([^\s()\[\]]+)(?:\[(\w+)\])?)')


def compile_query(query: str) -> Column:
    """A predicate over library rows from a query with field tags, phrases, year ranges, AND, OR and brackets.

    Tags: doi aid au 1au dp PDAT Title ti tiab MeSH. Words without an operator between them are joined by AND;
    an untagged word may stand in title or abstract."""
    tokens = [m for m in _TERM.finditer(query) if m[0].strip()]
    at = 0

    def field(value: str, tag: str | None) -> Column:
        v, tag = value.lower(), (tag or "tiab").lower()
        low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
        names = F.transform("authors", lambda a: F.lower(a["last_name"]))
        if tag in ("doi", "aid"):
            return identity.library_doi(F.col("doi")) == v
        if tag == "pmid":
            return F.btrim("pmid") == v
        if tag == "1au":
            return F.coalesce(F.try_element_at(names, F.lit(1)) == v, F.lit(False))
        if tag == "au":
            return F.coalesce(F.array_contains(names, v), F.lit(False))
        if tag in ("dp", "pdat"):
            return F.coalesce(F.col("year") == int(v), F.lit(False))
        if tag == "mesh":
            return F.coalesce(F.exists("mesh_terms", lambda t: F.lower(t) == v), F.lit(False))
        if tag in ("title", "ti"):
            return F.contains(low("title"), F.lit(v))
        return F.contains(low("title"), F.lit(v)) | F.contains(low("abstract"), F.lit(v))

    def either() -> Column:
        nonlocal at
        left = both()
        while at < len(tokens) and tokens[at][1] == "OR":
            at += 1
            left = left | both()
        return left

    def both() -> Column:
        nonlocal at
        left = atom()
        while at < len(tokens) and tokens[at][1] != "OR" and not tokens[at][3]:
            at += tokens[at][1] == "AND"
            left = left & atom()
        return left

    def atom() -> Column:
        nonlocal at
        if at >= len(tokens):
            raise ValueError(f"incomplete query: {query}")
        m = tokens[at]
        at += 1
        if m[2]:
            inner = either()
            if at >= len(tokens) or not tokens[at][3]:
                raise ValueError(f"open bracket in query: {query}")
            at += 1
            return inner
        if m[4]:
            return F.coalesce(F.col("year").between(int(m[4]), int(m[5])), F.lit(False))
        if m[6] is not None:
            return field(m[6], m[7])
        if m[8]:
            return field(m[8], m[9])
        raise ValueError(f"can't read query: {query}")

    if not tokens:
        raise ValueError("empty query")
    predicate = either()
    if at != len(tokens):
        raise ValueError(f"can't read query: {query}")
    return predicate


def review_merged(original: DataFrame, found: DataFrame, key: str, texts: list[str]) -> DataFrame:
    """Works of a review with what was found of them (K4): the original's fields win, blank ones are filled, authors only where it has none."""
    o, f = original.alias("o"), found.alias("f")
    both = o.join(f, F.col(f"o.{key}") == F.col(f"f.{key}"), "left")
    fill = lambda c: F.coalesce(F.nullif(F.btrim(f"o.{c}"), F.lit("")), F.col(f"f.{c}"), F.lit("")).alias(c)
    people = F.when(F.coalesce(F.size("o.authors"), F.lit(0)) > 0, F.col("o.authors")).otherwise(F.col("f.authors"))
    return both.select(f"o.{key}", *[fill(c) for c in texts], F.coalesce(F.nullif("o.year", F.lit(0)), "f.year", F.lit(0)).alias("year"), people.alias("authors"))


def full_text_id(works: DataFrame, by_pmid: DataFrame, by_doi: DataFrame) -> DataFrame:
    """(work_id, pmcid): the identifier of a work's full text (R9): the given one, else the one known for its PMID, else for its DOI."""
    p = by_pmid.where("pmid <> '' and pmcid <> ''").groupBy("pmid").agg(F.min("pmcid").alias("p_pmcid"))
    d = by_doi.where("doi <> '' and pmcid <> ''").groupBy("doi").agg(F.min("pmcid").alias("d_pmcid"))
    own = F.nullif(F.coalesce("pmcid", F.lit("")), F.lit(""))
    return works.join(p, "pmid", "left").join(d, "doi", "left").select("work_id", F.coalesce(own, "p_pmcid", "d_pmcid", F.lit("")).alias("pmcid"))
