"""Queries of the general training-data operators: packed values (3) and nested records (5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import flatten, segment
from citeloom.plans.reference import _OBJECT, _PLAIN
from citeloom.session import read_table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values packed in citation markers and in author strings, in order (problem 3)."""
    markers = read_table(spark, sf_dir, "markers")
    entries = read_table(spark, sf_dir, "bib_entries")
    whole = entries.select(F.explode(segment.quoted_whole_values(F.col("authors_str"))).alias("v"))
    in_quotes = markers.select(F.explode(segment.quoted_with_delimiters(F.col("text"))).alias("v"))
    given = read_table(spark, sf_dir, "candidates").select(F.explode("authors.first_name").alias("v"))
    in_markers = segment.packed_values(markers, "marker_id", "text", "markers.text", segment.split_marker, in_quotes)
    in_authors = segment.packed_values(entries, "entry_id", "authors_str", "bib_entries.authors_str", segment.author_values, whole, given)
    return in_markers.unionByName(in_authors)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cited items of the payloads with their URIs, authors and subject terms as flat rows (problem 5)."""
    return flatten.item_children(read_table(spark, sf_dir, "cite_payloads"))


def p5_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every list of the payloads, at any depth, as child tables with surrogate and parent keys."""
    return flatten.payload_nodes(read_table(spark, sf_dir, "cite_payloads"))


def p5_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema that all payloads share, inferred over the whole table."""
    payloads = read_table(spark, sf_dir, "cite_payloads").select(flatten.json_in_text(F.col("payload")).alias("doc"))
    return flatten.merged_schema(payloads, "doc")


def payload_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which payloads can be used, and with what problems: A25."""
    gate = flatten.payload_gate(read_table(spark, sf_dir, "cite_payloads"))
    return gate.select("payload_id", "tier", F.array_join("problems", ", ").alias("problems"))


QUERIES = {"payload_gate": payload_gate, "p3_found": p3_found, "p5_found": p5_found, "p5_tables": p5_tables, "p5_schema": p5_schema}

_LIST = "CASE WHEN coalesce(json_type({0}), 'NULL') = 'NULL' THEN CAST([] AS JSON[]) WHEN json_type({0}) = 'ARRAY' THEN from_json({0}, '[\"JSON\"]') ELSE [{0}] END"
_SCALAR = "CASE WHEN json_type({0}) IN ('OBJECT', 'ARRAY') THEN NULL ELSE {0} ->> '$' END"
_THERE = "CASE WHEN coalesce(json_type({0}), 'NULL') <> 'NULL' THEN {0} END"
_DOC = f"""d AS (SELECT payload_id, CASE WHEN json_valid({_OBJECT.format('payload')}) THEN {_OBJECT.format('payload')}
WHEN trim(payload) LIKE '\"%' AND json_valid(trim(payload)) AND json_valid({_OBJECT.format("(CAST(trim(payload) AS JSON) ->> '$')")}) THEN {_OBJECT.format("(CAST(trim(payload) AS JSON) ->> '$')")}
WHEN contains(payload, '&quot;') AND json_valid({_OBJECT.format(_PLAIN)}) THEN {_OBJECT.format(_PLAIN)} END::JSON AS doc FROM cite_payloads),
l AS (SELECT payload_id, coalesce({_THERE.format("(doc -> '$.citationItems')")}, doc -> '$.items') AS list FROM d WHERE doc IS NOT NULL),
i AS (SELECT payload_id, unnest({_LIST.format('list')}) AS item, generate_subscripts({_LIST.format('list')}, 1) AS item_pos FROM l),
r AS (SELECT payload_id, CAST(item_pos AS INT) AS item_pos, item, coalesce({_THERE.format("(item -> '$.itemData')")}, {_THERE.format("(item -> '$.item')")}) AS rec FROM i WHERE json_type(item) = 'OBJECT'),
c AS (SELECT payload_id, item_pos, 'uri' AS child, {_LIST.format("(item -> '$.uris')")} AS vs FROM r UNION ALL SELECT payload_id, item_pos, 'author', {_LIST.format("(rec -> '$.author')")} FROM r
UNION ALL SELECT payload_id, item_pos, 'mesh', flatten(list_transform(json_extract(rec, '$.custom.*.meshTerms'), lambda x: {_LIST.format('x')})) FROM r),
v AS (SELECT payload_id, item_pos, child, CAST(generate_subscripts(vs, 1) AS INT) AS child_pos, unnest(vs) AS v FROM c)"""
ORACLES = {
    "p5_found": f"""WITH {_DOC} SELECT payload_id, item_pos, 'item' AS child, 0::INT AS child_pos, coalesce({_SCALAR.format("(item -> '$.id')")}, {_SCALAR.format("(rec -> '$.id')")}, '') AS val FROM r
UNION ALL SELECT payload_id, item_pos, child, child_pos, coalesce(CASE WHEN child = 'author' THEN coalesce({_SCALAR.format("(v -> '$.family')")}, {_SCALAR.format("(v -> '$.literal')")}) END, {_SCALAR.format('v')}, '') FROM v""",
    "payload_gate": f"""WITH {_DOC}, n AS (SELECT payload_id, count(*) AS n, count(*) FILTER (WHERE coalesce({_SCALAR.format("(item -> '$.id')")}, {_SCALAR.format("(rec -> '$.id')")}, '') = '') AS nameless FROM r GROUP BY payload_id),
g AS (SELECT d.payload_id, CASE WHEN doc IS NULL THEN 'unreadable' WHEN coalesce(list_max(list_transform(json_extract(doc, '$.*.v'), lambda x: TRY_CAST(x ->> '$' AS INT))), 0) > 2 THEN 'newer' ELSE 'readable' END AS tier, coalesce(n, 0) AS n, coalesce(nameless, 0) AS nameless FROM d LEFT JOIN n USING (payload_id))
SELECT payload_id, tier, CASE WHEN tier = 'readable' THEN concat_ws(', ', CASE WHEN n = 0 THEN 'no items' END, CASE WHEN nameless > 0 THEN 'items without id' END) ELSE '' END AS problems FROM g""",
}
