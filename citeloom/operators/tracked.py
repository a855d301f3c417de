"""Tracked documents: fields as citations, reconciliation, rewriting, merged bibliographies.

``fields``: (doc_id, ord, cid, readable, problems, in_table, plain, visible, n_items, render, numbers), in order of the
document. ``items``: (doc_id, ord, pos, record). ``listed``: the bibliography field's (doc_id, place, record, hash, uncited).
``texts``: the bibliography's paragraphs (doc_id, place, text). Missing parts are empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.sources.stores import stable_id


def joined_evidence(sentences: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """Sentences with their evidence, if there is any."""
    return sentences.join(evidence, key, "left")


def cluster_items(items: DataFrame, entries: DataFrame) -> DataFrame:
    """Items (…, record, title) with the title of the bibliography entry of their record, else their own."""
    by_record = entries.where(F.coalesce("record", F.lit("")) != "").groupBy("record").agg(F.min_by("entry_title", "entry_id").alias("entry_title"))
    return items.join(by_record, "record", "left").withColumns({"known": F.col("entry_title").isNotNull(), "title": F.coalesce("entry_title", "title")}).drop("entry_title")


def zipped(left: Column, right: Column, others: Column) -> Column:
    """Three arrays side by side where the first two are of one length, else no rows."""
    return F.when(F.size(left) == F.size(right), F.arrays_zip(left, right, others))


def minted(fields: DataFrame) -> DataFrame:
    """Fields with ids of their own: a pasted copy in the body receives a new id, made from the old one and its place."""
    copy = F.row_number().over(Window.partitionBy("doc_id", "cid", "in_table").orderBy("ord"))
    pasted = ~F.col("in_table") & (copy > 1)
    return fields.withColumns({"copied": pasted, "cid": F.when(pasted, stable_id(F.col("cid"), copy.cast("string"))).otherwise(F.col("cid"))})


def record_numbers(fields: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, record, number): records numbered by their first citation in a readable field of the body."""
    cited = items.join(fields.where("readable and not in_table").select("doc_id", "ord"), ["doc_id", "ord"])
    first = cited.groupBy("doc_id", "record").agg(F.min(F.struct("ord", "pos")).alias("first"))
    return first.select("doc_id", "record", F.row_number().over(Window.partitionBy("doc_id").orderBy("first")).alias("number"))


def reconciled(fields: DataFrame, items: DataFrame, listed: DataFrame, texts: DataFrame, keep_uncited: bool = False) -> DataFrame:
    """(doc_id, kind, at): what does not fit between a document's fields and its bibliography.

    damaged, payload, duplicate, table, hand_edited and unresolved are of fields, at their place; entry_mismatch is of the
    bibliography; entry_edited and uncited are of its entries. Entry texts count only where their number is right."""
    issue = lambda df, kind, at: df.select("doc_id", F.lit(kind).alias("kind"), F.col(at).cast("string").alias("at"))
    good = fields.where("readable")
    body = good.where("not in_table")
    by_field = [
        issue(fields.where("not readable"), "damaged", "ord"),
        issue(good.select("doc_id", "ord", F.explode("problems")), "payload", "ord"),
        issue(minted(good).where("copied"), "duplicate", "ord"),
        issue(good.where("in_table"), "table", "ord"),
        issue(body.where("coalesce(plain, '') <> '' and not (visible <=> plain)"), "hand_edited", "ord"),
        issue(body.where("n_items = 0"), "unresolved", "ord"),
    ]
    sizes = listed.groupBy("doc_id").agg(F.count_if(~F.col("uncited")).alias("n_listed")).join(texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_texts")), "doc_id")
    placed = listed.join(sizes.where("n_listed = n_texts"), "doc_id").join(texts, ["doc_id", "place"])
    numbers = record_numbers(fields, items)
    edited = placed.where("text <> '' and coalesce(hash, '') <> ''").where(F.sha1("text") != F.col("hash")).join(numbers, ["doc_id", "record"])
    dropped = listed.join(numbers, ["doc_id", "record"], "left_anti").where(F.lit(not keep_uncited) & ~F.col("uncited"))
    by_entry = [issue(sizes.where("n_listed <> n_texts"), "entry_mismatch", "n_texts"), issue(edited, "entry_edited", "number"), issue(dropped, "uncited", "record")]
    out = by_field[0]
    for more in (*by_field[1:], *by_entry):
        out = out.unionByName(more)
    return out


def rewritten(fields: DataFrame, new_numbers: Column, text: Column, render: Column, author_date: Column, has_marker: Column) -> DataFrame:
    """What becomes of each field (K11): its text, whether numbers moved, whether a hand edit was kept or lost, what blocks it.

    A field without items into which a marker was typed is opened again. In author-date styles the author's wording stays.
    A field in a table is never rewritten; if it would have to change, it blocks."""
    none = F.col("n_items") == 0
    stored = F.when(author_date, F.array().cast("array<int>")).otherwise(new_numbers)
    edited = F.coalesce((F.coalesce("plain", F.lit("")) != "") & (F.col("visible") != F.col("plain")), F.lit(False))
    kept = author_date & edited & ~none
    final = F.when(kept, F.col("visible")).otherwise(text)
    moved = (stored != F.col("numbers")) & ~none
    blocked = F.col("in_table") & ((stored != F.col("numbers")) | (F.col("render") != render))
    opened = none & has_marker & ~F.col("in_table")
    change = (final != F.col("visible")) | (F.col("render") != render)
    return fields.withColumns(
        {
            "action": F.when(blocked, "blocked").when(F.col("in_table"), "leave").when(opened, "open").when(change, "rewrite").otherwise("leave"),
            "new_text": F.when(F.col("in_table") | opened, F.col("visible")).otherwise(final),
            "moved": moved & ~F.col("in_table"),
            "edit_kept": kept & ~F.col("in_table"),
            "edit_lost": edited & ~kept & (final != F.col("visible")) & ~F.col("in_table") & ~opened,
        }
    )


def merged_bibliography(entries: DataFrame, author_date: bool) -> DataFrame:
    """(doc_id, place, text): a document's old and new entries as one list.

    ``entries`` has doc_id, number, body (the entry's own wording), rendered (from its record) and verbatim: whether the wording
    was edited or adopted and is kept. Numbered lists are in order of their numbers, others by letters and digits."""
    wording = F.when(F.col("verbatim") | F.col("rendered").isNull(), F.coalesce("body", F.lit(""))).otherwise(F.col("rendered"))
    rows = entries.withColumn("wording", wording)
    if author_date:
        key = F.substring(F.regexp_replace(F.lower("wording"), "[^a-z0-9 ]+", ""), 1, 80)
        text, order = F.col("wording"), [key, F.col("number")]
    else:
        text, order = F.concat(F.col("number").cast("string"), F.lit(". "), F.col("wording")), [F.col("number")]
    return rows.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)).alias("place"), text.alias("text"))


def renumber_preview(assigned: DataFrame) -> DataFrame:
    """Per document how many references are new, were there, and moved (D10); ``assigned`` has number and old_number, null for new."""
    moved = F.col("old_number").isNotNull() & (F.col("old_number") != F.col("number"))
    return assigned.groupBy("doc_id").agg(F.count_if(F.col("old_number").isNull()).alias("n_new"), F.count_if(F.col("old_number").isNotNull()).alias("n_existing"), F.count_if(moved).alias("n_moved"))


def write_order(places: DataFrame, para: str, offset: str, tie: str) -> DataFrame:
    """Places with the order in which they are written: paragraphs forwards, offsets backwards, so that none shifts another (F8)."""
    w = Window.partitionBy("doc_id").orderBy(F.col(para), F.col(offset).desc(), F.col(tie).desc())
    return places.withColumn("write_no", F.row_number().over(w))


def bibliography_heading(paras: DataFrame, spans: DataFrame, stored: str = "heading_text") -> DataFrame:
    """(doc_id, heading_idx) before each bibliography field's first paragraph (doc_id, first, heading_text), -1 if none.

    The last short paragraph before it that is neither blank, an entry nor in a field; else the nearest styled heading; else the
    nearest paragraph whose text is the stored one. ``paras`` has doc_id, para_index, style, text and in_field."""
    before = paras.join(spans, "doc_id").where("para_index < first")
    entry = r"^\[?(\d+)[.\s)\]]+\s*(.+)"
    near = (F.col("para_index") == F.col("_last")) & (F.length("text") < 80) & ~F.col("text").rlike(entry) & ~F.col("in_field")
    last = before.where("text <> ''").groupBy("doc_id").agg(F.max("para_index").alias("_last"))
    rank = F.when(near, 3).when(F.col("style").startswith("Heading"), 2).when(F.col("text") == F.col(stored), 1)
    ranked = before.join(last, "doc_id").withColumn("rank", rank).where("rank is not null")
    best = ranked.groupBy("doc_id").agg(F.max(F.struct("rank", "para_index")).alias("b"))
    return spans.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("b.para_index", F.lit(-1)).alias("heading_idx"))
