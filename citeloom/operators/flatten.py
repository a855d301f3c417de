"""Deeply nested JSON records as related flat tables.

Records are parsed once into VARIANT, so no schema is fixed in advance. Level by level `list_levels` infers the merged
schema of all records, finds every list in it, also where some records hold a single value in its place, and
`nodes` explodes each into a child table whose rows carry a surrogate key, the key of the parent row and their
ordinal. All rows stay inside the JVM; only the schemas, whose size does not grow with the rows, come to the driver.

Null, empty and damaged records give no rows; a null or empty list has no children; repeated records are records of
their own under their ids. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType, VariantType

from citeloom.session import cut_lineage

#: Character references that JSON text inside markup carries; the ampersand comes last.
ENTITIES = (("&quot;", '"'), ("&#34;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def json_in_text(text: Column) -> Column:
    """The JSON object inside ``text`` as VARIANT, or null.

    Text around the object, character references, and an object written as a JSON string are
    accepted. Incomplete or missing JSON, an empty text and null give null; a duplicate key makes the object
    invalid.
    """
    plain = text
    for entity, char in ENTITIES:
        plain = F.replace(plain, F.lit(entity), F.lit(char))
    # an object written as a JSON string: the outer parse gives a string, the inner one the object
    inner = F.when(F.btrim(text).startswith('"'), F.try_variant_get(F.try_parse_json(F.btrim(text)), "$", "string"))
    readings = [text, inner, F.when(text.contains("&quot;"), plain)]
    return F.coalesce(*(F.try_parse_json(_object_part(x)) for x in readings))


def is_list(variant: Column) -> Column:
    return F.try_variant_get(variant, "$", "array<variant>").isNotNull()


def is_object(variant: Column) -> Column:
    return F.try_variant_get(variant, "$", "map<string, variant>").isNotNull()


def _object_part(text: Column) -> Column:
    """From the first opening brace to the last closing brace."""
    part = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(part != "", part)


def merged_schema(df: DataFrame, variant: str) -> DataFrame:
    """One row with the schema that all values of the VARIANT column ``variant`` share, as a DDL string.

    An empty table gives the schema of null (``VOID``)."""
    return df.agg(F.schema_of_variant_agg(F.col(variant)).alias("merged_schema"))


def at(variant: Column, path: str) -> Column:
    """The value at ``path`` as VARIANT; null where the path is absent or holds JSON null."""
    found = F.try_variant_get(variant, path, "variant")
    return F.when(~F.is_variant_null(found), found)


def as_list(variant: Column) -> Column:
    """An array of VARIANT: a list as it is, a single value as a list of one, null and absence as an empty list."""
    alone = F.when(variant.isNull(), F.array().cast("array<variant>")).otherwise(F.array(variant))
    return F.coalesce(F.try_variant_get(variant, "$", "array<variant>"), alone)


def as_text(variant: Column) -> Column:
    """A scalar as text; null where there is none."""
    return F.when(~is_object(variant) & ~is_list(variant), F.try_variant_get(variant, "$", "string"))


# ---------------------------------------------------------------- all lists of a record

Keys = tuple[str, ...]
Lists = dict[str, list[tuple[str, Keys]]]


def _step(variant: Column, keys: Keys, older: Mapping[str, str]) -> Column:
    """The value below ``keys``; where a key is absent, the one that ``older`` records use in its place is tried."""
    quoted = lambda k: f"$['{k}']" if "'" not in k else f'$["{k}"]'
    for key in keys:
        names = [key, *(old for old, new in older.items() if new == key)]
        variant = F.coalesce(*(at(variant, quoted(n)) for n in names))
    return variant


def _schema(ddl: str | None) -> DataType | None:
    """A VARIANT's schema as a data type; None for the schema of nothing."""
    return None if ddl in (None, "VOID") else DataType.fromDDL(ddl.replace("OBJECT<", "STRUCT<"))


def list_levels(level: DataFrame, older: Mapping[str, str]) -> Lists:
    """For each path of ``level`` (path, value) the lists in its values: (path of the list, keys to it).

    A field that is a list in some values and something else in others is a list; one that is an object in some is
    looked into."""
    found: dict[str, dict[Keys, None]] = {}

    def walk(path: str, keys: Keys, kind: DataType | None, doubtful: list[tuple[str, Keys]]) -> None:
        if isinstance(kind, ArrayType):
            found.setdefault(path, {})[keys] = None
        elif isinstance(kind, StructType):
            for f in kind.fields:
                if "'" in f.name and '"' in f.name:
                    continue  # no path can name such a key
                walk(path, (*keys, older.get(f.name, f.name)), f.dataType, doubtful)
        elif isinstance(kind, VariantType):
            doubtful.append((path, keys))

    objects = F.schema_of_variant_agg(F.when(is_object(F.col("value")), F.col("value")))
    doubtful: list[tuple[str, Keys]] = []
    for r in level.groupBy("path").agg(objects.alias("s"), F.bool_or(is_list(F.col("value"))).alias("lists")).collect():
        if r.lists:
            found.setdefault(r.path, {})[()] = None
        walk(r.path, (), _schema(r.s), doubtful)
    while doubtful:
        asked, doubtful = doubtful, []
        cols = []
        for k, (path, keys) in enumerate(asked):
            v = F.when(F.col("path") == path, _step(F.col("value"), keys, older))
            cols += [F.bool_or(is_list(v)).alias(f"l{k}"), F.schema_of_variant_agg(F.when(is_object(v), v)).alias(f"s{k}")]
        r = level.agg(*cols).first()
        for k, (path, keys) in enumerate(asked):
            walk(path, keys, ArrayType(VariantType()) if r[f"l{k}"] else _schema(r[f"s{k}"]), doubtful)
    name = lambda path, keys: ".".join([*([path] if path else []), *(keys or ("[]",))])
    return {path: [(name(path, keys), keys) for keys in some] for path, some in found.items()}


def nodes(records: DataFrame, older: Mapping[str, str] | None = None, wanted: Callable[[str], bool] = lambda path: True, depth: int | None = None) -> DataFrame:
    """The rows of all child tables: (root_id, path, row_key, parent_key, ordinals, value).

    ``records`` has root_id and value. ``path`` names the child table; ``ordinals`` holds the ordinals from the
    outermost list to the row, from 1. ``older`` maps keys of older records to the keys that replaced them. Lists
    whose path is not ``wanted`` are left out with all below them, and with ``depth`` those nested deeper; schemas are
    not inferred for what is left out. A list's JSON nulls keep their ordinals."""
    older = older or {}
    root = F.col("root_id").cast("string")
    level = records.where("value is not null").select("root_id", F.lit("").alias("path"), root.alias("row_key"), F.lit(None).cast("string").alias("parent_key"), F.array().cast("array<int>").alias("ordinals"), "value")
    out: DataFrame | None = None
    at_depth = 0
    while (depth is None or at_depth < depth) and (lists := {path: kept for path, some in list_levels(level, older).items() if (kept := [x for x in some if wanted(x[0])])}):
        at_depth += 1
        rows: Column | None = None
        for path, some in lists.items():
            element = lambda name, keys: lambda v, i: F.struct(F.lit(name).alias("child"), F.lit(".".join(keys) or "[]").alias("segment"), (i + 1).cast("int").alias("ordinal"), v.alias("element"))
            parts = F.concat(*(F.transform(as_list(_step(F.col("value"), keys, older)), element(name, keys)) for name, keys in some))
            rows = F.when(F.col("path") == path, parts) if rows is None else rows.when(F.col("path") == path, parts)
        exploded = level.select("root_id", F.col("row_key").alias("parent_key"), "ordinals", F.inline(rows))
        level = exploded.select(
            "root_id",
            F.col("child").alias("path"),
            F.concat("parent_key", F.lit("/"), F.col("segment"), F.lit("["), F.col("ordinal").cast("string"), F.lit("]")).alias("row_key"),
            "parent_key",
            F.concat("ordinals", F.array("ordinal")).alias("ordinals"),
            F.col("element").alias("value"),
        )
        out = level if out is None else out.unionByName(level)
    return level.where("false") if out is None else out


# ---------------------------------------------------------------- citation payloads

#: Keys of the older payload version and what replaced them.
OLDER_KEYS = {"items": "citationItems", "item": "itemData"}
ITEMS = "citationItems"
_CHILDREN = {"uri": rf"^{ITEMS}\.uris$", "author": rf"^{ITEMS}\.itemData\.author$", "mesh": rf"^{ITEMS}\.itemData\.custom\.[^.]+\.meshTerms$"}


def parsed_payloads(payloads: DataFrame, payload_id: str = "payload_id", payload: str = "payload") -> DataFrame:
    """(root_id, value): payloads with complete JSON, parsed once and kept."""
    parsed = payloads.select(F.col(payload_id).alias("root_id"), json_in_text(F.col(payload)).alias("value"))
    return cut_lineage(parsed.where("value is not null"))


def payload_nodes(payloads: DataFrame, payload_id: str = "payload_id", payload: str = "payload") -> DataFrame:
    """All child tables of citation payloads, of both versions, with their keys and scalar values as text."""
    rows = nodes(parsed_payloads(payloads, payload_id, payload), OLDER_KEYS)
    return rows.select("root_id", "path", "row_key", "parent_key", F.element_at("ordinals", -1).alias("ordinal"), as_text(F.col("value")).alias("val"))


def item_children(payloads: DataFrame, payload_id: str = "payload_id", payload: str = "payload") -> DataFrame:
    """Cited items with their URIs, authors and subject terms: (payload_id, item_pos, child, child_pos, val).

    Subject terms are the ``meshTerms`` of the application's own block, whichever key it has under ``custom``.
    The item itself has child_pos 0 and as value its ``id``, else its record's, else ''. URIs, authors and subject
    terms follow with their ordinals from 1. An author without a family name and a null element give ''.
    """
    pattern = "|".join(_CHILDREN.values())
    wanted = lambda path: path == ITEMS or bool(re.match(pattern, path))
    rows = nodes(parsed_payloads(payloads, payload_id, payload), OLDER_KEYS, wanted, depth=2)
    v = F.col("value")
    own = F.coalesce(as_text(at(v, "$.id")), as_text(at(_step(v, ("itemData",), OLDER_KEYS), "$.id")), F.lit(""))
    family = F.coalesce(as_text(at(v, "$.family")), as_text(at(v, "$.literal")), as_text(v), F.lit(""))
    kind = F.lit("item")
    for child, path in _CHILDREN.items():
        kind = F.when(F.col("path").rlike(path), child).otherwise(kind)
    of_items = rows.where((F.col("path") != ITEMS) | is_object(v)).withColumn("child", kind)
    val = F.when(F.col("child") == "item", own).when(F.col("child") == "author", family).otherwise(F.coalesce(as_text(v), F.lit("")))
    pos = F.when(F.col("child") == "item", 0).otherwise(F.try_element_at("ordinals", F.lit(2)))
    return of_items.select(F.col("root_id").alias("payload_id"), F.element_at("ordinals", 1).alias("item_pos"), "child", pos.alias("child_pos"), val.alias("val"))


#: The newest payload version that is understood.
PAYLOAD_VERSION = 2


def payload_gate(payloads: DataFrame, payload_id: str = "payload_id", payload: str = "payload") -> DataFrame:
    """(payload_id, tier, problems): whether a payload can be used, and what had to be overlooked.

    A payload of a newer version is not read further; one without items or with items without an id is read with that problem."""
    doc = payloads.select(F.col(payload_id).alias("payload_id"), json_in_text(F.col(payload)).alias("doc"))
    blocks = F.map_values(F.try_variant_get("doc", "$", "map<string, variant>"))
    version = F.array_max(F.transform(blocks, lambda b: F.try_variant_get(b, "$.v", "int")))
    items = F.filter(as_list(_step(F.col("doc"), (ITEMS,), OLDER_KEYS)), is_object)
    named = lambda i: F.coalesce(as_text(at(i, "$.id")), as_text(at(_step(i, ("itemData",), OLDER_KEYS), "$.id")), F.lit("")) != ""
    read = doc.select("payload_id", F.col("doc").isNull().alias("none"), F.coalesce(version, F.lit(0)).alias("v"), F.size(items).alias("n"), F.size(F.filter(items, lambda i: ~named(i))).alias("nameless"))
    tier = F.when(F.col("none"), "unreadable").when(F.col("v") > PAYLOAD_VERSION, "newer").otherwise("readable")
    problems = F.when(tier == "readable", F.array_compact(F.array(F.when(F.col("n") == 0, "no items"), F.when(F.col("nameless") > 0, "items without id")))).otherwise(F.array().cast("array<string>"))
    return read.select("payload_id", tier.alias("tier"), problems.alias("problems"))
