"""Full texts in JATS XML as paragraphs with their chain of section titles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

#: Elements whose text is no running text.
SKIPPED = frozenset("ref-list table-wrap table fig fig-group supplementary-material disp-formula back ack fn-group glossary app-group boxed-text graphic media alternatives tex-math math".split())
SHORTEST = 40


def _tag(element: ElementTree.Element) -> str:
    return element.tag.rsplit("}", 1)[-1] if isinstance(element.tag, str) else ""


def _text(element: ElementTree.Element) -> str:
    return re.sub(r"\s+", " ", "".join(element.itertext())).strip()


def body_paragraphs(xml: str | None) -> Iterator[tuple[str, str]]:
    """(section chain, paragraph) of an article's body; broken XML and a missing body give nothing."""
    try:
        root = ElementTree.fromstring(xml or "")
    except ElementTree.ParseError:
        return
    body = next((e for e in root.iter() if _tag(e) == "body"), None)
    stack: list[tuple[ElementTree.Element, tuple[str, ...]]] = [(body, ())] if body is not None else []
    while stack:
        element, chain = stack.pop()
        tag = _tag(element)
        if tag == "p":
            text = _text(element)
            if len(text) >= SHORTEST:
                yield " > ".join(chain), text
            continue
        if tag == "sec":
            title = next((_text(t) for t in element if _tag(t) == "title"), "")
            chain = (*chain, title) if title else chain
        stack += [(child, chain) for child in reversed(element) if _tag(child) not in SKIPPED and _tag(child) != "title"]


def fulltext_paragraphs(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, idx, section, text), idx from 1 in reading order."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, s, t) for k, x in zip(pdf[key], pdf[xml]) for i, (s, t) in enumerate(body_paragraphs(x), 1)]
            yield pd.DataFrame(rows, columns=[key, "idx", "section", "text"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, xml).mapInPandas(walk, f"{key} {kind}, idx int, section string, text string")
