"""Sentences of scientific English prose by boundary rules.

Every full stop, question or exclamation mark before white space is a candidate. Candidates inside closed
parentheses are dropped; the rest are tried against an ordered list of rules, the first that applies decides.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Abbreviations that do not end a sentence, without full stops, lower case.
ABBREVIATIONS = frozenset(
    ["et al"] + "eg ie vs cf etc viz dr prof mr mrs ms jr sr st fig figs eq eqs tab suppl supp ref refs sect sec ch vol no nos pt approx ca dept est max min "
    "natl acad sci proc biol chem phys med soc assoc univ int am j usa us uk".split()
)
_CANDIDATE = re.compile(r"[.!?]\s+")
_OPENERS = "([\"'"


def closed_parentheses(text: str) -> list[tuple[int, int]]:
    """Spans of outermost parentheses that have a partner, in order."""
    spans: list[tuple[int, int]] = []
    opened: list[int] = []
    for m in re.finditer(r"[()]", text):
        if m[0] == "(":
            opened.append(m.start())
        elif opened:
            start = opened.pop()
            while spans and spans[-1][0] > start:
                spans.pop()
            spans.append((start, m.start()))
    return spans


def _word_start(text: str, end: int) -> int:
    while end and not text[end - 1].isspace():
        end -= 1
    return end


def _token(text: str, dot: int) -> str:
    return text[_word_start(text, dot) : dot].lstrip(_OPENERS)


def _abbreviated(text: str, dot: int) -> bool:
    start = _word_start(text, dot)
    before = start
    while before and text[before - 1] == " ":
        before -= 1
    forms = (text[start:dot], text[_word_start(text, before) : dot] if before < start else "")
    return any(re.sub(r"\s+", " ", f.lstrip(_OPENERS).replace(".", "").lower()) in ABBREVIATIONS for f in forms)


#: In order; the first rule whose test holds decides whether the candidate ends a sentence.
RULES: list[tuple[Callable[[str, int, str, str], bool], bool]] = [
    (lambda text, dot, token, rest: text[dot] != ".", True),
    (lambda text, dot, token, rest: not token, True),
    (lambda text, dot, token, rest: bool(re.fullmatch(r"\d+\.\d+", token)), False),
    (lambda text, dot, token, rest: len(token) == 1 and token.isupper() and bool(re.match(r"[A-Z]\.", rest)), False),
    (lambda text, dot, token, rest: bool(re.fullmatch(r"(?:[A-Z]\.)+[A-Z]", token)), False),
    (lambda text, dot, token, rest: _abbreviated(text, dot), False),
    (lambda text, dot, token, rest: rest[:1].islower(), False),
]


def split_sentences(text: str | None) -> list[str]:
    """The sentences of a paragraph, trimmed; a text without any is one itself, null none."""
    if text is None:
        return []
    held = closed_parentheses(text)
    starts = [a for a, _ in held]
    cuts = [0]
    for m in _CANDIDATE.finditer(text):
        dot = m.start()
        around = bisect_left(starts, dot) - 1
        if around >= 0 and dot < held[around][1]:
            continue
        token, rest = _token(text, dot), text[m.end() : m.end() + 3]
        if next((ends for test, ends in RULES if test(text, dot, token, rest)), True):
            cuts.append(m.end())
    parts = [text[a:b].strip() for a, b in zip(cuts, [*cuts[1:], len(text)])]
    return [p for p in parts if p] or [text]


def sentence_array(text: Column) -> Column:
    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(split_sentences)

    return split(text)


def numbered_sentences(paras: DataFrame) -> DataFrame:
    """(doc_id, para_index, sent_index, sent_id, text): ids count through a document in reading order.

    A document's numbers follow from the counts of its paragraphs, so its sentences never meet in one window."""
    cut = paras.select("doc_id", "para_index", sentence_array(F.col("text")).alias("s"))
    before = F.coalesce(F.sum(F.size("s")).over(Window.partitionBy("doc_id").orderBy("para_index").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = cut.withColumn("before", before).select("doc_id", "para_index", "before", F.posexplode("s").alias("sent_index", "text"))
    return rows.select("doc_id", "para_index", "sent_index", F.format_string("S%03d", (F.col("before") + F.col("sent_index") + 1).cast("bigint")).alias("sent_id"), "text")
