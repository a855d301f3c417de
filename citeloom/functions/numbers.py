"""Citation numbers as Column functions: expansion, ranges, renumbering, rendering."""

from __future__ import annotations

from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNRESOLVED = "[?]"
_RANGE = r"^(\d+)\s*[-–]\s*(\d+)$"


def expand_numbers(text: Column, lenient: bool = False) -> Column:
    """The numbers of a citation list: ranges expand in their direction, other tokens are dropped.

    With ``lenient`` the digits of a malformed token count as well. Null gives null, an empty text no numbers."""
    none = F.array().cast("array<int>")

    def numbers(token: Column) -> Column:
        low, high = F.regexp_extract(token, _RANGE, 1).try_cast("int"), F.regexp_extract(token, _RANGE, 2).try_cast("int")
        rest = F.transform(F.regexp_extract_all(token, F.lit(r"(\d+)"), F.lit(1)), lambda n: n.try_cast("int")) if lenient else none
        return F.when(token.rlike(_RANGE), F.sequence(low, high)).when(token.rlike(r"^\d+$"), F.array(token.try_cast("int"))).otherwise(rest)

    return F.flatten(F.transform(F.split(text, r"[;,]\s*"), lambda t: numbers(F.btrim(t))))


def range_chunks(numbers: Column) -> Column:
    """Consecutive numbers as chunks: runs of three and more become ``a-b``; pairs stay apart. The order is kept."""
    run = F.aggregate(
        numbers,
        F.array().cast("array<struct<first:int,last:int>>"),
        lambda runs, n: F.when((F.size(runs) > 0) & (F.element_at(runs, -1)["last"] == n - 1), F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(F.element_at(runs, -1)["first"].alias("first"), n.alias("last"))))).otherwise(
            F.concat(runs, F.array(F.struct(n.alias("first"), n.alias("last"))))
        ),
    )
    s = lambda c: c.cast("string")
    return F.flatten(
        F.transform(
            run,
            lambda r: F.when(r["last"] - r["first"] >= 2, F.array(F.concat(s(r["first"]), F.lit("-"), s(r["last"]))))
            .when(r["last"] > r["first"], F.array(s(r["first"]), s(r["last"])))
            .otherwise(F.array(s(r["first"]))),
        )
    )


def format_numbers(numbers: Column) -> Column:
    """Numbers as one compact text, ``1, 2, 4-6``."""
    return F.array_join(range_chunks(numbers), ", ")


def renumber(text: Column, mapping: Column) -> Column:
    """A bracket group under new numbers: unmapped numbers stay, repeats keep their first place."""
    moved = F.transform(expand_numbers(text), lambda n: F.coalesce(F.element_at(mapping, n), n))
    return format_numbers(F.array_distinct(moved))


def strictly_numeric(text: Column) -> Column:
    """Whether strict and lenient expansion agree, so the text holds no malformed token."""
    return expand_numbers(text) == expand_numbers(text, lenient=True)


def render_numbers(numbers: Column, style: Column) -> Column:
    """A numeric cluster in a style: sorted, distinct, collapsed where the style collapses; ``[?]`` where empty."""
    ordered = F.array_sort(F.array_distinct(numbers))
    chunks = F.when(style["collapse"], range_chunks(ordered)).otherwise(F.transform(ordered, lambda n: n.cast("string")))
    inner = F.call_function("array_join", F.transform(chunks, lambda c: F.concat(style["number_prefix"], c, style["number_suffix"])), style["delimiter"])
    return F.when(F.size(ordered) <= 0, UNRESOLVED).otherwise(F.concat(style["prefix"], inner, style["suffix"]))


def render_labels(labels: Column, style: Column) -> Column:
    """An author-date cluster: labels in order, each once; ``[?]`` where there are none."""
    distinct = F.array_distinct(labels)
    return F.when(F.size(distinct) <= 0, UNRESOLVED).otherwise(F.concat(style["prefix"], F.call_function("array_join", distinct, style["delimiter"]), style["suffix"]))


def digit_core(text: Column) -> Column:
    """A superscript run as (prefix, digits and separators, suffix)."""
    part = lambda i: F.regexp_extract(text, r"^(\D*)(\d(?:[\d\s,;\-–]*\d)?)(\D*)$", i)
    return F.struct(part(1).alias("prefix"), part(2).alias("core"), part(3).alias("suffix"))


def renumber_superscript(text: Column, mapping: Column) -> Column:
    """A superscript run under new numbers (H19): what stands around its digits stays; a run without ", " stays without."""
    core = digit_core(text)
    moved = renumber(core["core"], mapping)
    tight = F.when(F.contains(text, F.lit(", ")), moved).otherwise(F.replace(moved, F.lit(", "), F.lit(",")))
    return F.when(core["core"] != "", F.concat(core["prefix"], tight, core["suffix"])).otherwise(text)


#: The styles' affixes. Columns: style, prefix, suffix, delimiter, collapse, superscript, author_date, number affixes.
STYLES = [
    *[(s, "", "", ",", True, True, False, "", "") for s in ("nih_grant", "ama", "nlm", "cse_citation_seq", "nature", "cell", "acs")],
    ("nsf_grant", "[", "]", ", ", True, False, False, "", ""),
    ("plos_one", "[", "]", ",", True, False, False, "", ""),
    ("aps", " [", "]", ",", True, False, False, "", ""),
    ("ieee", "", "", ", ", False, False, False, "[", "]"),
    ("vancouver", "(", ")", ",", True, False, False, "", ""),
    *[(s, "(", ")", ", ", True, False, False, "", "") for s in ("science", "pnas")],
    *[(s, "(", ")", "; ", False, False, True, "", "") for s in ("apa", "cse_author_date", "elife", "elsevier_harvard", "chicago_author_date")],
]
STYLE_SCHEMA = "style string, prefix string, suffix string, delimiter string, collapse boolean, superscript boolean, author_date boolean, number_prefix string, number_suffix string"


def styles(spark: SparkSession) -> DataFrame:
    """The dimension of citation styles."""
    return spark.createDataFrame(STYLES, STYLE_SCHEMA)


LAYOUT = "struct<prefix:string,suffix:string,delimiter:string,collapse:boolean,superscript:boolean,number_prefix:string,number_suffix:string>"


def style_layout(xml: str | None, author_date: bool = False, superscript: bool = False) -> tuple[str, str, str, bool, bool, str, str]:
    """How a style file lays out citations (A20): affixes and delimiter, whether numbers are collapsed or raised, affixes of each number.

    The affixes of a number are those of all groups around it, where the citation has none. Raised numbers have no
    affixes. A file that can't be read gives the usual shape."""
    prefix, suffix, delimiter, collapse, inner = "", "", ",", False, ["", ""]
    local = lambda e: e.tag.rsplit("}", 1)[-1]
    try:
        cited = next((e for e in ElementTree.fromstring(xml or "").iter() if local(e) == "citation"), None)
        layout = None if cited is None else next((e for e in cited.iter() if local(e) == "layout"), None)
        collapse = cited is not None and cited.get("collapse") == "citation-number"
        if layout is not None:
            prefix, suffix, delimiter = layout.get("prefix", ""), layout.get("suffix", ""), layout.get("delimiter", ",")
            superscript = superscript or layout.get("vertical-align") == "sup"

            def around(node: ElementTree.Element) -> list[str] | None:
                """Affixes from the groups around the number below ``node``, outermost first."""
                for child in node:
                    if local(child) == "text" and child.get("variable") == "citation-number":
                        return [child.get("prefix", ""), child.get("suffix", "")]
                    if (found := around(child)) is not None:
                        return [child.get("prefix", "") + found[0], found[1] + child.get("suffix", "")] if local(child) == "group" else found
                return None

            if not prefix and not suffix:
                inner = around(layout) or inner
    except ElementTree.ParseError:
        prefix, suffix, delimiter = ("", "", ",") if superscript else ("[", "]", ", ")
    if author_date and not prefix and not suffix:
        prefix, suffix, delimiter = "(", ")", "; "
    if superscript:
        prefix, suffix, inner = "", "", ["", ""]
    return prefix, suffix, delimiter, collapse, superscript, *inner


def style_layouts(xml: Column, author_date: Column, superscript: Column) -> Column:
    """`style_layout` of a column of style files."""

    @F.pandas_udf(LAYOUT)
    def read(files: pd.Series, dated: pd.Series, raised: pd.Series) -> pd.DataFrame:
        rows = [style_layout(x, bool(d), bool(r)) for x, d, r in zip(files, dated, raised)]
        return pd.DataFrame(rows, columns=["prefix", "suffix", "delimiter", "collapse", "superscript", "number_prefix", "number_suffix"])

    return read(xml, author_date, superscript)


def follow_document_shape(style: Column, superscript: Column) -> Column:
    """New numeric citations take the shape that the document already has; author-date styles stay."""
    shape = lambda pre, suf, sep, up: F.struct(
        style["style"].alias("style"), F.lit(pre).alias("prefix"), F.lit(suf).alias("suffix"), F.lit(sep).alias("delimiter"), style["collapse"].alias("collapse"),
        F.lit(up).alias("superscript"), style["author_date"].alias("author_date"), F.lit("").alias("number_prefix"), F.lit("").alias("number_suffix"),
    )
    return F.when(style["author_date"], style).when(superscript, shape("", "", ",", True)).otherwise(shape("[", "]", ", ", False))
