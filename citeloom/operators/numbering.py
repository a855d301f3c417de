"""Citation numbering: first occurrence, uncited entries, alias identity, export plan."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.session import shuffle_parts


def number_by_first_occurrence(events: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, key, number): works numbered in the order of their first citation in a document.

    A work's first place is aggregated before anything is ranked, so a work cited often costs no more."""
    first = events.where("key is not null and key <> ''").groupBy("doc_id", "key").agg(F.min(F.struct(*order)).alias("_first"))
    return first.select("doc_id", "key", F.row_number().over(Window.partitionBy("doc_id").orderBy("_first", "key")).alias("number"))


def seed_uncited(numbered: DataFrame, entries: DataFrame) -> DataFrame:
    """`numbered` with the entries (doc_id, key, original_number) that nothing cites, after the cited ones in their old order.

    An entry that repeats a numbered work gets no number of its own."""
    listed = entries.where("key is not null and key <> ''").groupBy("doc_id", "key").agg(F.min("original_number").alias("original_number"))
    left = listed.join(numbered, ["doc_id", "key"], "left_anti")
    top = numbered.groupBy("doc_id").agg(F.max("number").alias("top"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("original_number").asc_nulls_last(), "key"))
    more = left.join(top, "doc_id", "left").select("doc_id", "key", (F.coalesce("top", F.lit(0)) + rank).alias("number"), F.lit(False).alias("cited"))
    return numbered.select("doc_id", "key", "number", F.lit(True).alias("cited")).unionByName(more)


def fold_aliases(events: DataFrame, order: str) -> DataFrame:
    """(event_id, canonical): identities under several aliases, each document read in order.

    The first alias that is known decides; new aliases then join its class, but never merge two known classes. Rows are
    sorted within partitions and read as a stream, so only the aliases of one document are held at a time.
    ``events`` has doc_id, event_id, aliases and the order column; an event without aliases is its own class."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, known = None, {}
        for pdf in batches:
            out = []
            for d, e, names in zip(pdf["doc_id"], pdf["event_id"], pdf["aliases"]):
                if d != doc:
                    doc, known = d, {}
                names = list(names)
                canonical = next((known[n] for n in names if n in known), names[0] if names else f"event:{e}")
                for n in names:
                    known.setdefault(n, canonical)
                out.append((e, canonical))
            yield pd.DataFrame(out, columns=["event_id", "canonical"])

    placed = events.select("doc_id", order, "event_id", "aliases").repartition(shuffle_parts(events.sparkSession), "doc_id").sortWithinPartitions("doc_id", order, "event_id")
    return placed.select("doc_id", "event_id", "aliases").mapInPandas(fold, "event_id bigint, canonical string")


def marker_plan(markers: DataFrame, slots: DataFrame) -> DataFrame:
    """Markers joined with their slots by document and place; a slot whose text differs is no match."""
    joined = markers.alias("m").join(slots.alias("s"), (F.col("m.doc_id") == F.col("s.doc_id")) & (F.col("m.place") == F.col("s.place")), "left")
    same = F.coalesce(F.col("m.text") == F.col("s.text"), F.lit(False))
    return joined.select("m.doc_id", "m.place", "m.text", F.when(same, F.col("s.slot_id")).alias("slot_id"), same.alias("matched"))


def export_action(status: Column, has_citations: Column, kind: Column) -> Column:
    """What happens to a marker on export: skipped ones stay; cited ones are cited; the rest stay or are unresolved."""
    return F.when(status == "skipped", "leave").when(status.isin("accepted", "modified") & has_citations, "cite").when(kind == "SUGGESTED", "leave").otherwise("unresolved")


def alphabetic_key(text: Column) -> Column:
    """The sort key of an unnumbered bibliography."""
    return F.substring(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""), 1, 80)
