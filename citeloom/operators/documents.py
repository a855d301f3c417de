"""Documents as paragraphs, sections, bibliographies and in-text citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.functions.evidence_text import evaluated
from citeloom.functions.numbers import expand_numbers

#: Headings of bibliographies, entries, bracketed citations.
REFERENCES_HEADING = r"(?i)^(?:References|Bibliography|Literature Cited|Works Cited)\s*$"
ENTRY = r"^\[?(\d+)[.\s)\]]+\s*(.+)"
BRACKET = r"\[(\d+(?:\s*[,;\-–]\s*\d+)*)\]"
PLACEHOLDER = r"\(REFS?\)"


def paragraphs(documents: DataFrame) -> DataFrame:
    """(doc_id, para_index, text) of every line, trimmed; blank ones keep their index."""
    lines = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("para_index", "text"))
    return lines.select("doc_id", "para_index", F.btrim("text").alias("text"))


def is_heading(text: Column, style: Column | None = None) -> Column:
    """Whether a paragraph is a heading (B3): styled as one, under 80 characters and without a closing full stop.

    Plain text has no styles; there a short line is one that starts with a capital and has no closing punctuation."""
    if style is not None:
        return F.coalesce(style, F.lit("")).startswith("Heading") & (F.length(text) < 80) & ~text.rlike(r"\.\s*$")
    return (F.length(text) > 0) & (F.length(text) < 30) & ~text.rlike(r"[.!?,;:]$") & text.rlike(r"^[A-Z]") & ~text.rlike(r"\d")


def fill_sections(paras: DataFrame) -> DataFrame:
    """Paragraphs with the last heading before them, by their style where they have one; headings themselves are left out."""
    heading = is_heading(F.col("text"), F.col("style") if "style" in paras.columns else None)
    upto = Window.partitionBy("doc_id").orderBy("para_index").rowsBetween(Window.unboundedPreceding, 0)
    filled = paras.withColumns({"heading": heading, "section": F.last(F.when(heading, F.col("text")), ignorenulls=True).over(upto)})
    return filled.where(~F.col("heading") & (F.col("text") != "")).select("doc_id", "para_index", F.coalesce("section", F.lit("")).alias("section"), "text")


def references_start(paras: DataFrame) -> DataFrame:
    """(doc_id, heading_idx) of the first heading of a bibliography."""
    return paras.where(F.col("text").rlike(REFERENCES_HEADING)).groupBy("doc_id").agg(F.min("para_index").alias("heading_idx"))


def bibliography_bounds(paras: DataFrame) -> DataFrame:
    """(doc_id, heading_idx, first_entry, last_entry): the run of blank or entry-shaped lines after the heading.

    -1 where no entry follows. Only two minima and a maximum per document are needed, so nothing is collected."""
    after = paras.join(references_start(paras), "doc_id").where("para_index > heading_idx")
    entry = F.col("text").rlike(ENTRY)
    stop = after.where(~entry & (F.col("text") != "")).groupBy("doc_id").agg(F.min("para_index").alias("stop"))
    inside = after.join(stop, "doc_id", "left").where(entry & (F.col("stop").isNull() | (F.col("para_index") < F.col("stop"))))
    bounds = inside.groupBy("doc_id").agg(F.min("para_index").alias("first_entry"), F.max("para_index").alias("last_entry"))
    return references_start(paras).join(bounds, "doc_id", "left").select("doc_id", "heading_idx", F.coalesce("first_entry", F.lit(-1)).alias("first_entry"), F.coalesce("last_entry", F.lit(-1)).alias("last_entry"))


def bibliography_entries(paras: DataFrame) -> DataFrame:
    """(doc_id, para_index, number, body, copy_no) of the entries; copy_no above 1 marks a repeated number."""
    inside = paras.join(bibliography_bounds(paras), "doc_id").where("para_index between first_entry and last_entry and text <> ''")
    rows = inside.select("doc_id", "para_index", F.regexp_extract("text", ENTRY, 1).try_cast("int").alias("number"), F.btrim(F.regexp_extract("text", ENTRY, 2)).alias("body")).where("number is not null")
    return rows.withColumn("copy_no", F.row_number().over(Window.partitionBy("doc_id", "number").orderBy("para_index")))


def bracket_citations(paras: DataFrame) -> DataFrame:
    """(doc_id, para_index, group_no, number) of bracketed numbers before the bibliography, ranges expanded."""
    body = paras.join(references_start(paras), "doc_id", "left").where("heading_idx is null or para_index < heading_idx")
    groups = body.select("doc_id", "para_index", F.posexplode(F.regexp_extract_all("text", F.lit(BRACKET), F.lit(1))).alias("group_no", "inner"))
    return groups.select("doc_id", "para_index", "group_no", F.explode(expand_numbers(F.col("inner"))).alias("number"))


def in_text_citations(paras: DataFrame) -> DataFrame:
    """`bracket_citations` whose number is an entry of the document's bibliography."""
    valid = bibliography_entries(paras).select("doc_id", "number").distinct()
    return bracket_citations(paras).join(valid, ["doc_id", "number"], "left_semi").select("doc_id", "para_index", "group_no", "number")


def claim_context(sentences: DataFrame, order: list[str], section_run: str, paragraph: str, text: str, before: int = 2, after: int = 1) -> DataFrame:
    """Sentences with up to two before them in the same run of a section and one after them in the same paragraph; blanks are skipped."""
    used = sentences.where(F.btrim(text) != "")
    back = Window.partitionBy("doc_id", section_run).orderBy(*order).rowsBetween(-before, -1)
    on = Window.partitionBy("doc_id", paragraph).orderBy(*order).rowsBetween(1, after)
    return used.withColumns({"preceding": F.collect_list(text).over(back), "following": F.collect_list(text).over(on)})


def section_runs(sentences: DataFrame, order: list[str]) -> DataFrame:
    """Sentences with the number of their run of one section, as equal names may recur."""
    w = Window.partitionBy("doc_id").orderBy(*order)
    fresh = F.when(F.lag("section").over(w).eqNullSafe(F.col("section")), 0).otherwise(1)
    return sentences.withColumn("_new", fresh).withColumn("section_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def sub_claims(text: Column) -> Column:
    """For each placeholder the text before it and after it, up to its neighbours (H7)."""
    return evaluated(F.transform(F.split(text, PLACEHOLDER), lambda t: F.btrim(t)), _around)


def _around(parts: Column) -> Column:
    n = F.size(parts) - 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.element_at(parts, i).alias("before"), F.element_at(parts, i + 1).alias("after")))).otherwise(F.array().cast("array<struct<before:string,after:string>>"))


def snippet(text: Column, anchor: Column, anchor_len: Column, most: int = 1200) -> Column:
    """A stretch of at most ``most`` characters around an anchor, with ellipses where it was cut (H9)."""
    n = F.length(text)
    half = F.greatest(F.lit(0), F.floor((F.lit(most) - anchor_len) / 2).cast("int"))
    end = F.least(n, F.greatest(F.lit(0), anchor - half) + most)
    start = F.greatest(F.lit(0), end - most)
    cut = F.substring(text, start + 1, end - start)
    left = F.when(start > 0, F.concat(F.lit("…"), F.ltrim(cut))).otherwise(cut)
    return F.when(n <= most, text).otherwise(F.when(end < n, F.concat(F.rtrim(left), F.lit("…"))).otherwise(left))


def strip_placeholders(text: Column) -> Column:
    """Without placeholders and the white space before them (B2)."""
    return F.btrim(F.regexp_replace(text, r"\s*\(REFS?\)", ""))


def sub_claims_at(text: Column, spans: Column) -> Column:
    """For each span (start, end) of a text what stands before and after it, up to its neighbours (H7); no spans, no parts."""
    n = F.length(text)

    def around(all_spans: Column) -> Column:
        near = lambda k, field, other: F.coalesce(F.try_element_at(all_spans, k)[field], other)

        def parts(s: Column, i: Column) -> Column:
            before = F.when(i > 0, near(F.when(i > 0, i), "end", F.lit(0))).otherwise(0)
            cut = lambda a, b: F.btrim(F.substring(text, a + 1, b - a))
            return F.struct(cut(before, s["start"]).alias("before"), cut(s["end"], near(i + 2, "start", n)).alias("after"))

        return F.transform(all_spans, parts)

    return evaluated(spans, around)


def style_vote(n_superscript: Column, n_bracket: Column) -> Column:
    """The shape of a document's citations: raised where there are as many raised as bracketed ones or more."""
    return F.when(F.coalesce(n_superscript, F.lit(0)) + F.coalesce(n_bracket, F.lit(0)) == 0, "none").when(F.coalesce(n_superscript, F.lit(0)) >= F.coalesce(n_bracket, F.lit(0)), "superscript").otherwise("bracket")
