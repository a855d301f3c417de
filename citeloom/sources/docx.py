"""Word files as paragraphs, runs and fields, and back.

Files come as bytes (``spark.read.format("binaryFile")``) and are parsed by the standard library, one file per row.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_TEXT = {"tab": "\t", "br": "\n", "cr": "\n", "noBreakHyphen": "-"}
RUNS = "para_index int, run_index int, style string, text string, superscript boolean, deleted boolean, inserted boolean"
PARAGRAPHS = "para_index int, style string, text string"
FIELDS = "ord int, code string, result_text string, depth int, complete boolean, para_first int, para_last int"


def _body(data: bytes) -> ElementTree.Element | None:
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            return ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None


def _local(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def run_text(run: ElementTree.Element) -> str:
    """The text of a run: tabs, line breaks and hyphens as characters, anything else as nothing."""
    return "".join((c.text or "") if _local(c) in ("t", "delText") else _TEXT.get(_local(c), "") for c in run)


def _runs(parent: ElementTree.Element, deleted: bool = False, inserted: bool = False) -> Iterator[tuple[ElementTree.Element, bool, bool]]:
    """All runs below an element as they are seen at last: deleted ones are marked, fallbacks skipped."""
    for c in parent:
        tag = _local(c)
        if tag == "r":
            yield c, deleted, inserted
        elif tag in ("del", "moveFrom"):
            yield from _runs(c, True, inserted)
        elif tag in ("ins", "moveTo"):
            yield from _runs(c, deleted, True)
        elif tag not in ("Fallback", "pPr"):
            yield from _runs(c, deleted, inserted)


def scan_runs(data: bytes) -> list[tuple]:
    """Rows of `RUNS` of the body's paragraphs; a paragraph without runs has one blank row."""
    body = _body(data)
    out = []
    for p, para in enumerate(e for e in (body if body is not None else []) if _local(e) == "p"):
        style = para.find(f"{_W}pPr/{_W}pStyle")
        name = style.get(f"{_W}val", "") if style is not None else ""
        found = list(_runs(para))
        for r, (run, gone, new) in enumerate(found):
            up = run.find(f"{_W}rPr/{_W}vertAlign")
            out.append((p, r, name, run_text(run), up is not None and up.get(f"{_W}val") == "superscript", gone, new))
        if not found:
            out.append((p, 0, name, "", False, False, False))
    return out


def scan_paragraphs(data: bytes) -> list[tuple]:
    """Rows of `PARAGRAPHS`: the runs of each paragraph as one text, deleted ones left out."""
    texts: dict[int, list[str]] = {}
    styles: dict[int, str] = {}
    for p, _, style, text, _, deleted, _ in scan_runs(data):
        styles.setdefault(p, style)
        texts.setdefault(p, []).append("" if deleted else text)
    return [(p, styles[p], "".join(ts)) for p, ts in texts.items()]


def scan_fields(data: bytes) -> list[tuple]:
    """Rows of `FIELDS`: a stack over begin, separate and end marks; one that never ends stays incomplete."""
    body = _body(data)
    out: list[list] = []
    stack: list[tuple[int, bool]] = []
    for p, para in enumerate(e for e in (body if body is not None else []) if _local(e) == "p"):
        for simple in para.iter(f"{_W}fldSimple"):
            out.append([len(out), simple.get(f"{_W}instr", ""), "".join(run_text(r) for r, _, _ in _runs(simple)), len(stack), True, p, p])
        for run, _, _ in _runs(para):
            for c in run:
                tag = _local(c)
                if tag == "fldChar":
                    kind = c.get(f"{_W}fldCharType")
                    if kind == "begin":
                        out.append([len(out), "", "", len(stack), False, p, p])
                        stack.append((len(out) - 1, False))
                    elif kind == "separate" and stack:
                        stack[-1] = (stack[-1][0], True)
                    elif kind == "end" and stack:
                        at, _ = stack.pop()
                        out[at][4], out[at][6] = True, p
                elif tag == "instrText" and stack:
                    out[stack[-1][0]][1] += c.text or ""
                elif stack and stack[-1][1] and tag in ("t", *_TEXT):
                    out[stack[-1][0]][2] += (c.text or "") if tag == "t" else _TEXT[tag]
    return [tuple(r) for r in out]


def _scan(df: DataFrame, key: str, content: str, rows: object, schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *r) for k, b in zip(pdf[key], pdf[content]) if b is not None for r in rows(b)], columns=[key, *names])

    return df.select(key, content).mapInPandas(walk, f"{key} {df.schema[key].dataType.simpleString()}, {schema}")


def runs(df: DataFrame, key: str, content: str) -> DataFrame:
    """Runs of Word files; broken files have none."""
    return _scan(df, key, content, scan_runs, RUNS)


def fields(df: DataFrame, key: str, content: str) -> DataFrame:
    """Complex and simple fields of Word files, nested ones with their depth."""
    return _scan(df, key, content, scan_fields, FIELDS)


def paragraphs(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, para_index, style, text) of Word files without deleted runs, put together where a file is read."""
    return _scan(df, key, content, scan_paragraphs, PARAGRAPHS)


def field_kind(code: Column, own: str = "CITE") -> Column:
    """Whose field it is: our citation or bibliography, another manager's, or any other (A4)."""
    c = F.upper(F.btrim(F.coalesce(code, F.lit(""))))
    return (
        F.when(c.rlike(rf"^ADDIN \S+\.{own}\b"), "citation").when(c.rlike(r"^ADDIN \S+\.BIBL\b"), "bibliography").when(c.rlike(r"^(?:ADDIN (?:ZOTERO|EN\.|MENDELEY|CSL_)|CITATION|BIBLIOGRAPHY)"), "foreign").otherwise("other")
    )


def field_problems(df: DataFrame, key: str) -> DataFrame:
    """Counts and problems per document before it is saved."""
    agg = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_fields"), F.sum((~F.col("complete")).cast("int")).alias("incomplete"), F.sum((F.contains("result_text", F.lit("ADDIN"))).cast("int")).alias("leaked"))
    return agg.withColumn("problems", F.array_compact(F.array(F.when(F.col("incomplete") > 0, "incomplete"), F.when(F.col("leaked") > 0, "leaked code"))))


def document_bytes(lines: list[str], styles: list[str] | None = None, codes: dict[int, tuple[str, str]] | None = None) -> bytes:
    """A Word file of paragraphs; ``codes`` puts a field (code, result) behind a paragraph's text."""
    parts = []
    for i, line in enumerate(lines):
        style = f'<w:pPr><w:pStyle w:val="{escape(styles[i])}"/></w:pPr>' if styles and styles[i] else ""
        field = ""
        if codes and i in codes:
            char = lambda kind: f'<w:r><w:fldChar w:fldCharType="{kind}"/></w:r>'
            field = f"{char('begin')}<w:r><w:instrText>{escape(codes[i][0])}</w:instrText></w:r>{char('separate')}<w:r><w:t>{escape(codes[i][1])}</w:t></w:r>{char('end')}"
        clean = "".join(c for c in line if c in "\t\n" or ord(c) >= 32)
        parts.append(f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(clean)}</w:t></w:r>{field}</w:p>')
    xml = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{"".join(parts)}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def to_docx(text: Column) -> Column:
    """A text as a Word file, one paragraph per line."""

    @F.pandas_udf("binary")
    def build(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: document_bytes((t or "").split("\n")))

    return build(text)


def with_field(code: Column, result: Column) -> Column:
    """A Word file of one paragraph with one field."""

    @F.pandas_udf("binary")
    def build(codes: pd.Series, results: pd.Series) -> pd.Series:
        return pd.Series([document_bytes(["text "], None, {0: (c or "", r or "")}) for c, r in zip(codes, results)], dtype="object")

    return build(code, result)


def cited_document(text: str, marker: str, code: str, result: str) -> bytes:
    """A Word file of ``text`` in which each match of the pattern ``marker`` is a field of ``code`` that shows ``result``."""
    field = document_bytes([""], None, {0: (code, result)})
    with zipfile.ZipFile(io.BytesIO(field)) as z:
        xml = z.read("word/document.xml").decode()
    shown = xml[xml.index('<w:r><w:fldChar w:fldCharType="begin"/>') : xml.index("</w:p>")]
    clean = "".join(c for c in text if c in "\t\n" or ord(c) >= 32)
    run = lambda t: f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>'
    paras = "".join("<w:p>" + shown.join(run(t) for t in re.split(marker, line)) + "</w:p>" for line in clean.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{paras}</w:body></w:document>')
    return out.getvalue()


def with_citations(text: Column, marker: str, code: str, result: str) -> Column:
    """`cited_document` of each text; ``marker`` has no groups."""

    @F.pandas_udf("binary")
    def build(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else cited_document(t, marker, code, result))

    return build(text)


def without_references(paras: DataFrame, key: str, heading: str = r"(?i)^(?:References|Bibliography)\s*$") -> DataFrame:
    """Paragraphs up to the last heading of references, which goes with all behind it."""
    last = paras.where(F.col("text").rlike(heading)).groupBy(key).agg(F.max("para_index").alias("_h"))
    return paras.join(last, key, "left").where("_h is null or para_index < _h").drop("_h")
