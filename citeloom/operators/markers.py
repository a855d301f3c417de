"""Citation markers in running text: the full grammar.

The inside of a parenthetical is cut into tokens (words, numbers, DOIs, punctuation) that know whether a blank stands
before them. A recursive descent over the tokens reads a list of items: search tokens, identifiers, author-year
citations, numbers that continue a PMID and years that continue an author. A parenthetical is a marker if the list
takes all of it. Which words can be an author is a table of words and word shapes against places in a name. Pure
identifier lists and search tokens never leave the JVM (`native_markers`).

Null and empty texts have no markers; unbalanced brackets are ordinary text; texts are read whole.
"""

from __future__ import annotations

import re
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Particles of family names.
PARTICLES = frozenset("van von de del della der den la le du di da dos das el al ter ten zu af bin ibn".split())
#: Words that never begin an author's name.
NEVER_FIRST = frozenset(
    "figure fig figs figures table tables eq equation section sec chapter suppl supplementary supplement appendix panel vol volume issue since until "
    "before after during circa between through from by in on at to as of fy approximately approx about around est ca c n p pp no nos number total mean "
    "median unpublished personal".split()
)
#: Words that, alone before a year, are a date, a part of a document or a status.
NEVER_ALONE = frozenset(
    "january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec spring summer "
    "fall autumn winter monday tuesday wednesday thursday friday saturday sunday since until before after during circa between through from by in on at to as "
    "of fy year years quarter q1 q2 q3 q4 figure fig figs figures table tables eq equation section sec chapter suppl supplementary supplement appendix box panel "
    "page pages vol volume issue established founded copyright version release revised updated accessed retrieved published submitted received accepted effective "
    "expires deadline due born died approximately approx about around est ca c n p pp no nos number total mean median cohort batch class grant award protocol "
    "study pilot phase wave round cycle early late mid expected anticipated projected planned estimated target start starting beginning end ending recruitment "
    "baseline approved amended renewal resubmission post pre current present ongoing completed launched adopted enacted ratified signed".split()
)
#: First words of phrases that introduce a citation, which are no part of a longer name.
LEAD_WORDS = frozenset("see cf also from in as reviewed for but available biorxiv medrxiv preprint preprints eg".split())
#: Words that mark an organisation.
ORGANISATION = frozenset(
    "university universities institute institutes center centre inc ltd llc corp corporation company foundation hospital college department dept laboratory "
    "laboratories lab labs agency ministry school clinic gmbh atlas technologies biosciences pharmaceuticals unpublished organization organisation association "
    "society biobank reporter prize conference meeting committee council illustrator prism matlab biorender".split()
)
#: Phrases that may stand before an item, as words.
LEADS = [
    p.split()
    for p in (
        "see also", "see", "e g", "eg", "reviewed in", "reviewed by", "but see", "cf", "also", "for review see", "for reviews see", "for a review see", "for a reviews see",
        "for review", "for reviews", "for a review", "for a reviews", "as in", "from", "in", "biorxiv", "medrxiv", "preprint", "preprints", "available at",
    )
]
#: How a DOI is written, and the resolvers before it.
DOI = r"10\.\d{4,9}/(?:[^\s;,()\"'?#]|\([^\s()]*\))+"
RESOLVER = r"(?:https?://)?(?:dx\.)?doi\.(?:org|example)/|https?://(?:www\.)?(?:bio|med)rxiv\.org/content/"

_TOKEN = re.compile(rf"(?P<link>(?:{RESOLVER})(?={DOI}))|(?P<doi>{DOI})|(?P<number>\d+)|(?P<word>[^\W\d_]+(?:['’\-‐‑][^\W\d_]+)*)|(?P<mark>\S)", re.IGNORECASE)
_OUTER = re.compile(r"\((?:[^()]|\([^()]*\))*\)")
_INNER = re.compile(r"\([^()]*\)")


class Token(NamedTuple):
    kind: str
    text: str
    start: int
    end: int
    glued: bool


Item = dict


# ---------------------------------------------------------------- who can be an author

#: What a word or its shape stands for.
_SENSES = {"opener": NEVER_FIRST, "dated": NEVER_ALONE, "lead": LEAD_WORDS, "organisation": ORGANISATION}


def senses(word: str) -> set[str]:
    """The senses of a word that can speak against an author; a short word all in capitals is an acronym."""
    low = word.lower().strip("'’-")
    out = {sense for sense, words in _SENSES.items() if low in words}
    return out | {"acronym"} if word.isupper() and 2 <= len(word) <= 5 else out


def can_be_author(name: list[str], accompanied: bool) -> bool:
    """Whether the words of a name can be an author's; ``accompanied``: by "et al." or another author."""
    against = [{"organisation"} for _ in name]
    against[0] |= {"opener"} if len(name) == 1 else {"opener", "lead"}
    if len(name) == 1 and not accompanied:
        against[0] |= {"dated", "acronym"}
    return not any(senses(word) & bad for word, bad in zip(name, against))


# ---------------------------------------------------------------- the descent


class Reader:
    """Reads the inside of one parenthetical."""

    def __init__(self, inside: str, ids: bool, authors: bool):
        self.inside, self.ids, self.authors = inside, ids, authors
        self.tokens: list[Token] = []
        end = -1
        for m in _TOKEN.finditer(inside):
            self.tokens.append(Token(m.lastgroup, m[0], m.start(), m.end(), m.start() == end))
            end = m.end()

    def items(self) -> list[Item] | None:
        """The items of the list, or None if the inside is prose."""
        out: list[Item] = []
        at, n = 0, len(self.tokens)
        while True:
            found = self.item(at, out[-1] if out else None)
            if not found:
                return None
            item, at = found
            out.append(item)
            if at == n or (at == n - 1 and self.is_mark(at, ".")):
                return out
            if not (self.is_mark(at, ";,") or (self.is_word(at, "and") and not self.tokens[at].glued)):
                return None
            at += 1

    def item(self, at: int, before: Item | None) -> tuple[Item, int] | None:
        """(item, next token): the item at ``at``, behind any number of lead-in phrases."""
        for rule in (self.search_token, self.pmcid, self.pmid, self.doi, self.further_pmid, self.further_year, self.author_year):
            if found := rule(at, before):
                return found
        for phrase in LEADS:
            if end := self.phrase(at, phrase):
                if found := self.item(end, before):
                    return found
        return None

    # ---- tokens

    def is_word(self, at: int, *words: str) -> bool:
        return at < len(self.tokens) and self.tokens[at].kind == "word" and self.tokens[at].text.lower() in words

    def is_mark(self, at: int, marks: str) -> bool:
        return at < len(self.tokens) and self.tokens[at].kind == "mark" and self.tokens[at].text in marks

    def ends_here(self, at: int) -> bool:
        """Whether nothing is written onto the token before ``at``."""
        return at >= len(self.tokens) or not self.tokens[at].glued or (self.tokens[at].kind == "mark" and self.tokens[at].text != "_")

    def number(self, at: int, least: int, most: int) -> bool:
        return at < len(self.tokens) and self.tokens[at].kind == "number" and least <= len(self.tokens[at].text) <= most and self.ends_here(at + 1)

    def raw(self, start: int, end: int) -> str:
        return self.inside[self.tokens[start].start : self.tokens[end - 1].end]

    def phrase(self, at: int, words: list[str]) -> int | None:
        """Behind a lead-in phrase with its full stops, a comma or colon; something must follow behind a blank."""
        for w in words:
            if not self.is_word(at, w):
                return None
            at += 1
            if self.is_mark(at, ".") and self.tokens[at].glued and (len(w) == 1 or w in ("cf", "eg")):
                at += 1
        if self.is_mark(at, ",:"):
            at += 1
        return at if at < len(self.tokens) and not self.tokens[at].glued else None

    # ---- items

    def search_token(self, at: int, before: Item | None) -> tuple[Item, int] | None:
        if at < len(self.tokens) and self.tokens[at].text in ("REF", "REFS") and self.ends_here(at + 1):
            return {"kind": "REF", "raw": self.tokens[at].text, "value": self.tokens[at].text}, at + 1
        return None

    def pmcid(self, at: int, before: Item | None) -> tuple[Item, int] | None:
        if not self.ids:
            return None
        end = at
        if self.is_word(end, "pmcid"):
            end += 1
            end += self.is_mark(end, ":")
            end += self.is_word(end, "pmc")
        elif self.is_word(end, "pmc"):
            end += 1
        return ({"kind": "pmcid", "raw": self.raw(at, end + 1), "value": f"PMC{self.tokens[end].text}"}, end + 1) if end > at and self.number(end, 4, 9) else None

    def pmid(self, at: int, before: Item | None) -> tuple[Item, int] | None:
        if not self.ids or not self.is_word(at, "pmid", "pmids", "pubmed"):
            return None
        end = at + 1
        if self.is_word(at, "pubmed"):
            end += self.is_word(end, "id", "ids")
        end += self.is_mark(end, ":")
        return ({"kind": "pmid", "raw": self.raw(at, end + 1), "value": self.tokens[end].text}, end + 1) if self.number(end, 1, 9) else None

    def doi(self, at: int, before: Item | None) -> tuple[Item, int] | None:
        if not self.ids:
            return None
        end = at
        if self.is_word(end, "doi"):
            end += 1
            end += self.is_mark(end, ":")
        elif end < len(self.tokens) and self.tokens[end].kind == "link":
            end += 1
        if end >= len(self.tokens) or self.tokens[end].kind != "doi":
            return None
        # full stops at the end belong to the text around
        value = self.tokens[end].text.rstrip(".")
        cut = len(self.tokens[end].text) - len(value)
        if cut > 1 or (cut and end + 1 < len(self.tokens)):
            return None
        raw = self.raw(at, end + 1)
        return {"kind": "doi", "raw": raw[: len(raw) - cut], "value": value}, end + 1

    def further_pmid(self, at: int, before: Item | None) -> tuple[Item, int] | None:
        if not (self.ids and before and before["kind"] == "pmid" and self.number(at, 1, 9)) or (self.is_mark(at + 1, ".") and self.tokens[at + 1].glued):
            return None
        return {"kind": "pmid", "raw": self.tokens[at].text, "value": self.tokens[at].text}, at + 1

    def year(self, at: int) -> tuple[int, str, int] | None:
        """(year, letter behind it, next token)."""
        if at >= len(self.tokens) or self.tokens[at].kind != "number" or not re.fullmatch(r"(?:19|20)\d\d", self.tokens[at].text):
            return None
        year = int(self.tokens[at].text)
        if self.ends_here(at + 1):
            return year, "", at + 1
        letter = self.tokens[at + 1].text
        return (year, letter, at + 2) if len(letter) == 1 and "a" <= letter <= "z" and self.ends_here(at + 2) else None

    def further_year(self, at: int, before: Item | None) -> tuple[Item, int] | None:
        if not (self.authors and before and before["kind"] == "author_year") or not (read := self.year(at)):
            return None
        return _cited(before["author"], before["coauthor"], before["et_al"], read, self.raw(at, read[2])), read[2]

    def name(self, at: int) -> tuple[list[str], int] | None:
        """(words, next token) of up to three capitalised words, each behind any particles. Initials are no words of it."""
        words: list[str] = []
        end, capitals = at, 0
        while capitals < 3:
            k = end
            while k < len(self.tokens) and self.tokens[k].text in PARTICLES and (k == at or not self.tokens[k].glued):
                k += 1
            t = self.tokens[k] if k < len(self.tokens) else None
            if not t or t.kind != "word" or not t.text[0].isupper() or t.text.lower() in ("et", "al") or (k > at and t.glued):
                break
            if self.is_mark(k + 1, ".") and len(t.text) == 1:
                break
            words += [x.text for x in self.tokens[end : k + 1]]
            end, capitals = k + 1, capitals + 1
        return (words, end) if capitals else None

    def initials(self, at: int) -> int:
        """Behind up to three initials with full stops, at times behind a comma."""
        end = at + self.is_mark(at, ",")
        for n in range(3):
            t = self.tokens[end] if end < len(self.tokens) else None
            if not t or t.kind != "word" or len(t.text) != 1 or not ("A" <= t.text <= "Z") or not self.is_mark(end + 1, "."):
                return end if n else at
            end += 2
        return end

    def author_year(self, at: int, before: Item | None) -> tuple[Item, int] | None:
        if not self.authors or not (first := self.name(at)):
            return None
        words, end = first
        end = self.initials(end)
        et_al, second = False, None
        k = end + self.is_mark(end, ",")
        if self.is_word(k, "et"):
            k += 1 + self.is_mark(k + 1, ".")
            if not self.is_word(k, "al"):
                return None
            end, et_al = k + 1 + self.is_mark(k + 1, "."), True
        elif (self.is_word(k, "and") and self.tokens[k].text == "and") or self.is_mark(k, "&"):
            if second := self.name(k + 1):
                end = self.initials(second[1])
        if self.is_mark(end, ","):
            end += 1
        elif end < len(self.tokens) and self.tokens[end].glued:
            return None
        read = self.year(end)
        if not read or not can_be_author(words, et_al or bool(second)) or (second and not can_be_author(second[0], True)):
            return None
        return _cited(" ".join(words), " ".join(second[0]) if second else "", et_al, read, self.raw(at, read[2])), read[2]


def _cited(author: str, coauthor: str, et_al: bool, read: tuple[int, str, int], raw: str) -> Item:
    year, suffix, _ = read
    return {"kind": "author_year", "raw": raw, "value": f"{author} {year}{suffix}", "author": author, "coauthor": coauthor, "et_al": et_al, "year": year, "year_suffix": suffix}


def read_marker(inside: str, ids: bool = True, authors: bool = True) -> tuple[str, int, list[Item]] | None:
    """(kind, extra_search, items) of the inside of a parenthetical, or None for prose."""
    items = Reader(inside, ids, authors).items()
    if items is None:
        return None
    tokens = [x["value"] for x in items if x["kind"] == "REF"]
    cited = [x for x in items if x["kind"] != "REF"]
    if not cited:
        return ("REF" if tokens == ["REF"] else "REFS"), 0, []
    return "SUGGESTED", -1 if "REFS" in tokens else len(tokens), cited


def find_markers(text: str | None, ids: bool = True, authors: bool = True) -> list[dict]:
    """All markers of a text in order: text, kind, start, end, extra_search, suggestions.

    An inner pair counts where the outer one is prose. With both kinds off only the plain search tokens count."""
    out = []
    for outer in _OUTER.finditer(text or ""):
        spans = [outer.span()] + [(outer.start() + 1 + m.start(), outer.start() + 1 + m.end()) for m in _INNER.finditer(outer[0][1:-1])]
        for start, end in spans:
            body = text[start + 1 : end - 1]
            if not ids and not authors:
                read = (body, 0, []) if body in ("REF", "REFS") else None
            else:
                read = read_marker(body, ids, authors)
            if read:
                out.append({"text": text[start:end], "kind": read[0], "start": start, "end": end, "extra_search": read[1], "suggestions": read[2]})
                if (start, end) == outer.span():
                    break
    return out


def strip_markers(text: str | None, ids: bool = True, authors: bool = True) -> str:
    """``text`` without its markers and the blanks before them; '' for null."""
    kept, at = [], 0
    for m in find_markers(text, ids, authors):
        kept.append(text[at : m["start"]].rstrip())
        at = m["end"]
    return "".join([*kept, (text or "")[at:]]).strip()


# ---------------------------------------------------------------- columns and tables

MARKER_TYPE = (
    "array<struct<text:string,kind:string,start:int,end:int,extra_search:int,"
    "suggestions:array<struct<kind:string,raw:string,value:string,author:string,coauthor:string,et_al:boolean,year:int,year_suffix:string>>>>"
)


def markers_column(text: Column, ids: bool = True, authors: bool = True) -> Column:
    """All markers of a text; parentheses are looked for before Python is asked."""

    @F.pandas_udf(MARKER_TYPE)
    def found(texts: pd.Series) -> pd.Series:
        fields = ("kind", "raw", "value", "author", "coauthor", "et_al", "year", "year_suffix")
        full = lambda m: {**m, "suggestions": [{f: s.get(f) for f in fields} for s in m["suggestions"]]}
        return texts.map(lambda t: [full(m) for m in find_markers(t, ids, authors)])

    return found(text)


def stripped(text: Column, ids: bool = True, authors: bool = True) -> Column:
    """`strip_markers` of each text: B2. Texts without a bracket are trimmed in the JVM."""

    @F.pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else strip_markers(t, ids, authors))

    bracketed = F.contains(text, F.lit("("))
    return F.when(bracketed, strip(F.when(bracketed, text))).otherwise(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", ""))


def marker_rows(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One row per marker of ``text``: keys, ord from 1, and the marker's fields. Texts without a bracket are left out first."""
    some = df.where(F.contains(F.col(text), F.lit("("))).select(*keys, F.posexplode(markers_column(F.col(text))).alias("_p", "m"))
    return some.select(*keys, (F.col("_p") + 1).alias("ord"), "m.*")


def suggestion_label(s: Column) -> Column:
    """How a suggestion is shown, such as "PMID 12" or "Smith and Doe 2020a": H5."""
    names = F.when(F.coalesce(s["coauthor"], F.lit("")) != "", F.concat(s["author"], F.lit(" and "), s["coauthor"])).when(s["et_al"], F.concat(s["author"], F.lit(" et al."))).otherwise(s["author"])
    return F.when(s["kind"] == "pmid", F.concat(F.lit("PMID "), s["value"])).when(s["kind"] == "doi", F.concat(F.lit("doi:"), s["value"])).when(s["kind"] == "pmcid", s["value"]).otherwise(F.concat(names, F.lit(" "), s["year"].cast("string"), s["year_suffix"]))


def prescan(markers: DataFrame, keys: list[str]) -> DataFrame:
    """Per key how many of its markers ask for a search, cite by identifier, or cite an author and year: D5.

    A marker with any author-year item counts as that."""
    cites = F.exists("suggestions", lambda s: s["kind"] == "author_year")
    suggested = F.col("kind") == "SUGGESTED"
    return markers.groupBy(*keys).agg(F.count_if(~suggested).alias("n_search"), F.count_if(suggested & ~cites).alias("n_by_id"), F.count_if(suggested & cites).alias("n_author_year"))


def legacy_kinds(kinds: Column, marker_type: Column, count: Column, raw_text: Column) -> Column:
    """The kinds of a sentence's markers where older projects kept less (R1): as stored, else by the plain search tokens of
    the text, else its one kind as often as it was counted."""
    none = F.array().cast("array<string>")
    read = F.when(marker_type.isNotNull(), F.regexp_extract_all(F.coalesce(raw_text, F.lit("")), F.lit(r"\((REFS?)\)"), F.lit(1))).otherwise(none)
    repeated = F.when(marker_type.isNotNull(), F.array_repeat(marker_type, F.greatest(F.coalesce(count, F.lit(0)), F.lit(1)))).otherwise(none)
    stored = F.coalesce(kinds, none)
    return F.when(F.size(stored) > 0, stored).when(F.size(read) > 0, read).otherwise(repeated)


def run_grammar(of_run: Column, has_sentences: Column, current: Column) -> Column:
    """The grammar by which a project is exported (R2): the one its sentences were read by, the legacy one if none is known, else the current one."""
    return F.coalesce(of_run, F.when(has_sentences, F.lit("legacy")), current)


#: Parentheticals of search tokens and identifiers alone, as one pattern of the JVM.
_ID = r"(?:REFS?|(?:PMIDs?|PubMed IDs?)\s*:?\s*\d{1,9}|PMC\s?\d{4,9})"
NATIVE = rf"\(({_ID}(?:\s*[;,]\s*{_ID})*)\.?\)"


def native_markers(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, ord, inside) of markers made of search tokens, PMIDs and PMCIDs, found by built-in functions only."""
    found = df.select(*keys, F.posexplode(F.regexp_extract_all(text, F.lit(f"(?i){NATIVE}"), F.lit(1))).alias("_p", "inside"))
    return found.select(*keys, (F.col("_p") + 1).alias("ord"), "inside")
