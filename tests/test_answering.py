"""Answers about suggested citations, tracked documents, searches and tools."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.functions import numbers as num
from citeloom.operators import answers as ans
from citeloom.operators import markers as mk
from citeloom.operators import searching as sch
from citeloom.operators import tracked as trk


def work(key, pmid="", doi="", title="", names=(), year=0, retracted=False):
    return {"key": key, "pmid": pmid, "doi": doi, "pmcid": "", "title": title, "surnames": list(names), "year": year, "retracted": retracted}


def asked(kind, value, author="", year=0, resolved=(), ambiguous=False, coauthor=""):
    return {"raw": f"raw {value}", "label": f"label {value}", "kind": kind, "value": value, "author": author, "coauthor": coauthor, "year": year, "resolved": list(resolved), "ambiguous": ambiguous}


def said(w=None, tag="", score=80.0):
    return {"tag": tag, "score": score, "work": w}


def codes(e):
    return [(w["code"], w["place"]) for w in e["warnings"]]


def test_answers_are_matched_by_tag_then_paper_then_name():
    a, b, c = work("a", pmid="1"), work("b", doi="10.5/x", names=["Poe"]), work("c", names=["van Lind"], year=2000)
    questions = [asked("author_year", "Lind 2001", "Lind", 2001), asked("pmid", "1", resolved=[a]), asked("doi", "10.5/X", resolved=[work("b2", doi="10.5/X ")])]
    assert ans.match_answers(questions, [said(b), said(c), said(a, "RAW  1")]) == [1, 2, 0]
    assert ans.match_answers(questions, [said(c, "ref"), said(c, "[1]"), said(None, "[2]")]) == [1, 2, None]
    assert ans.match_answers(questions[:1] * 2, [said(c)]) == [0, None]
    assert ans.match_answers([], [said(a)]) == [] and ans.match_answers(questions, []) == [None] * 3


def test_a_resolved_identifier_is_pinned():
    a, other = work("a", pmid="1"), work("o", pmid="9")
    e = ans.evaluate([asked("pmid", "1", resolved=[a])], [said(other, "[1]", 90)], 0, "HIGH")
    assert ([s["key"] for s in e["selected"]], codes(e), e["level"]) == (["a"], [("suggested_unscored", 1)], "MEDIUM")
    e = ans.evaluate([asked("pmid", "1")], [said(other, "[1]", 90)], 0, "HIGH")
    assert (e["selected"], codes(e), e["level"]) == ([], [("suggested_alternative", 1), ("suggested_unresolved", 1)], "LOW")
    e = ans.evaluate([asked("doi", "https://doi.org/10.5/K.")], [said(work("k", doi="10.5/k"), "[1]", 120)], 0, "HIGH")
    assert (e["selected"], codes(e), e["level"]) == ([{"key": "k", "score": 100.0, "place": 1}], [], "HIGH")


def test_warnings_and_further_works():
    a = work("a", pmid="1", retracted=True)
    same = work("a2", pmid="1")
    questions = [asked("pmid", "1", resolved=[a], ambiguous=True), asked("pmid", "1", resolved=[same]), asked("author_year", "Roe 1990", "Roe", 1990)]
    answers = [said(a, "[1]", 30.0), said(work("z", names=["Doe"], year=1990), "[3]"), said(work("n", title="N")), said(work("n", title="n"))]
    e = ans.evaluate(questions, answers, 2, None)
    assert [s["key"] for s in e["selected"]] == ["a", "z", "n"]
    assert codes(e) == [("suggested_weak_match", 1), ("suggested_ambiguous", 1), ("retracted", 1), ("suggested_duplicate", 2), ("suggested_unresolved", 3)]
    assert ans.evaluate([], [], 1, "HIGH") == {"selected": [], "warnings": [], "level": "LOW"}


@pytest.mark.parametrize(
    ("w", "fits"),
    [(work("w", names=["Lind"], year=2001), True), (work("w", names=["de Lind"], year=2004), False), (work("w", names=["Roe"], year=2001), False), (work("w", year=2001), True), (work("w", names=["Lind"]), True)],
)
def test_author_and_year(w, fits):
    assert ans.cited_by_name(w, asked("author_year", "x", "Van Lind", 2002)) is fits


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=5), st.lists(st.integers(0, 4), max_size=6))
def test_no_answer_and_no_work_is_used_twice(qs, got):
    questions = [asked("pmid", str(q), resolved=[work(f"w{q}", pmid=str(q))] if q % 2 else []) for q in qs]
    answers = [said(work(f"w{g}", pmid=str(g))) for g in got]
    used = [i for i in ans.match_answers(questions, answers) if i is not None]
    assert len(used) == len(set(used))
    keys = [s["key"] for s in ans.evaluate(questions, answers, 3, "HIGH")["selected"]]
    assert len(keys) == len(set(keys))


def test_evaluation_columns_with_nulls_and_empty_tables(spark):
    row = [(1, [], [], 0, "HIGH"), (2, None, None, None, None), (3, [{**asked("pmid", "1"), "resolved": [work("a", pmid="1")]}], [{"tag": None, "score": None, "work": None}], -1, "HIGH")]
    df = spark.createDataFrame(row, f"id int, s {ans.SUGGESTIONS}, a {ans.ANSWERS}, n int, l string")
    e = ans.evaluated_suggestions(F.col("s"), F.col("a"), F.col("n"), F.col("l"))
    got = {r.id: (r.e.level, [s.key for s in r.e.selected]) for r in df.select("id", e.alias("e")).collect()}
    assert got == {1: ("LOW", []), 2: ("LOW", []), 3: ("MEDIUM", ["a"])}
    assert [list(r.m) for r in df.orderBy("id").select(ans.matched_answers(F.col("s"), F.col("a")).alias("m")).collect()] == [[], [], [0]]
    assert df.where("false").select(e).count() == 0


def test_second_answers(spark):
    first = spark.createDataFrame([(1, "partial"), (2, "partial"), (3, None), (4, "supports"), (5, None)], "id int, verdict string")
    second = spark.createDataFrame([(1, "supports", True), (2, "supports", False), (3, "partial", None), (4, "partial", True)], "id int, verdict string, quote_found boolean")
    got = {r.id: (r.verdict, r.source) for r in ans.second_answers(first, second, ["id"]).collect()}
    assert got == {1: ("supports", "full_text"), 2: ("partial", "abstract"), 3: ("partial", "full_text"), 4: ("supports", "abstract"), 5: ("unverified", "")}


def test_submitted_answers_prefer_pmid_then_doi(spark):
    known = spark.createDataFrame([(1, "11", "10.5/a", "T"), (2, None, "10.5/B", "t "), (3, "", None, "")], "cand_id long, pmid string, doi string, title string")
    asked_ = spark.createDataFrame([("s", 1, "11", "10.5/b", "", "high", "70"), ("s", 2, "99", "10.5/b", "x", None, None), ("s", 3, "", "", " T", "odd", "x"), ("s", 4, "", None, "", "LOW", "1")], "sent_id string, pos int, pmid string, doi string, title string, level string, score string")
    got = {r.pos: (r.cand_id, r.level, r.score) for r in ans.submitted(asked_, known).collect()}
    assert got == {1: (1, "HIGH", 70.0), 2: (2, "LOW", 0.0), 3: (1, "LOW", 0.0)}


def test_reconcile_without_any_fields(spark):
    fields = spark.createDataFrame([], "doc_id long, ord long, cid string, readable boolean, problems array<string>, in_table boolean, plain string, visible string, n_items int, render string, numbers array<int>")
    items = spark.createDataFrame([], "doc_id long, ord long, pos int, record string")
    listed = spark.createDataFrame([(1, 1, "r", None, False), (1, 2, "q", "", True)], "doc_id long, place int, record string, hash string, uncited boolean")
    texts = spark.createDataFrame([], "doc_id long, place int, text string")
    assert [tuple(r) for r in trk.reconciled(fields, items, listed, texts).collect()] == [(1, "uncited", "r")]
    assert trk.reconciled(fields, items, listed, texts, keep_uncited=True).count() == 0


def test_rewriting_keeps_author_date_wording(spark):
    rows = [(1, 1, "(A 1)", "(A, 1)", 1, False), (1, 2, "(A 1)", "(A 1)", 1, False), (1, 3, None, "[?]", 0, False), (1, 4, "(A 1)", "(A 1)", 1, True)]
    df = spark.createDataFrame([(d, o, p, v, n, t, "author-date", []) for d, o, p, v, n, t in rows], "doc_id long, ord long, plain string, visible string, n_items int, in_table boolean, render string, numbers array<int>")
    out = trk.rewritten(df, F.array(F.lit(7)), F.lit("(B 2)"), F.lit("author-date"), F.lit(True), F.lit(False)).orderBy("ord").collect()
    assert [(r.action, r.new_text, r.moved, r.edit_kept, r.edit_lost) for r in out] == [("leave", "(A, 1)", False, True, False), ("rewrite", "(B 2)", False, False, False), ("rewrite", "(B 2)", False, False, False), ("leave", "(A 1)", False, False, False)]


def test_slots_against_a_loop(spark):
    times = [0.0, 0.1, 0.15, 3.0, 3.05, 3.06, 9.9]
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(times)], "id long, u string, t double").withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
    got = [r.slot for r in sch.call_slots(df, "u", "ts", "id", 0.35).orderBy("id").collect()]
    want, free = [], 0.0
    for t in times:
        slot = max(t, free)
        want.append(slot)
        free = slot + 0.35
    assert got == pytest.approx(want)


def test_fielded_queries(spark):
    df = spark.createDataFrame([(1, "10.5/a", "7", "PMC1", [("van Lind",)], 2000), (2, None, None, None, None, None)], "id int, doi string, pmid string, pmcid string, authors array<struct<last_name:string>>, year int")
    hit = lambda q: [r.id for r in df.where(sch.field_query(q)).collect()]
    for q in ('DOI:"10.5/A"', "EXT_ID:7 AND SRC:MED", "PMCID:1", 'AUTH:"de Lind" AND PUB_YEAR:2000'):
        assert hit(q) == [1]
    assert hit("PUB_YEAR:1999") == []
    for q in ("", "lind", "DOI:x OR y"):
        with pytest.raises(ValueError, match="not understood"):
            sch.field_query(q)


def test_tools(spark):
    calls = spark.createDataFrame([(1, "fetch_articles", '{"pmids": ["1"], "x": 2}'), (2, "nothing", "{}"), (3, "record_verdict", "[1]"), (4, None, None)], "call_id int, tool string, args string")
    got = {r.call_id: (r.args, r.error) for r in sch.parsed_calls(calls).collect()}
    assert got == {1: ('{"pmids":["1"]}', None), 2: (None, "unknown tool: nothing"), 3: (None, "arguments are no JSON object"), 4: (None, "unknown tool: ")}
    handlers = {"one": lambda n: spark.range(n), "bad": lambda: 1 / 0}
    assert sch.dispatch("one", handlers, n=3).count() == 3
    assert sch.dispatch("bad", handlers)["error"].startswith("bad: ") and sch.dispatch("none", handlers) == {"error": "unknown tool: none"}


def test_categories_and_legacy_kinds(spark):
    df = spark.createDataFrame([(["Genomics", "x", "Cell Biology", "genetics", "physiology"], None, None, 0, None), ([], [], "REFS", 3, "none"), (None, ["REF"], "REF", None, "(REFS)"), (["x"], [], "REF", 1, "a (REF) b (REFS)")], "d array<string>, k array<string>, t string, n int, r string")
    got = df.select(sch.categories_of(F.col("d")).alias("c"), mk.legacy_kinds(F.col("k"), F.col("t"), F.col("n"), F.col("r")).alias("m")).collect()
    assert [r.c for r in got] == [["genomics", "cell_biology", "genetics"], [""], [""], [""]]
    assert [r.m for r in got] == [[], ["REFS"] * 3, ["REF"], ["REF", "REFS"]]


def test_superscripts(spark):
    df = spark.createDataFrame([("a4,5b",), ("4, 5",), ("-",), ("",), (None,)], "t string")
    got = df.select(num.renumber_superscript(F.col("t"), F.create_map(F.lit(4), F.lit(9))).alias("s")).collect()
    assert [r.s for r in got] == ["a9,5b", "9, 5", "-", "", None]


def test_heading_of_a_bibliography(spark):
    paras = spark.createDataFrame([(1, 0, "Heading1", "Old", False), (1, 1, "", "Works", False), (1, 2, "", "", False), (2, 0, "Heading2", "Refs", False), (2, 1, "", "1. an entry", False), (3, 0, "", "Kept", False), (3, 1, "", "x" * 90, False)], "doc_id long, para_index int, style string, text string, in_field boolean")
    spans = spark.createDataFrame([(1, 3, "Kept"), (2, 2, "Kept"), (3, 2, "Kept"), (4, 0, None)], "doc_id long, first int, heading_text string")
    assert {r.doc_id: r.heading_idx for r in trk.bibliography_heading(paras, spans).collect()} == {1: 1, 2: 0, 3: 0, 4: -1}


@pytest.mark.parametrize(
    ("inside", "kw", "want"),
    [
        ('<citation collapse="citation-number"><layout prefix="[" suffix="]" delimiter=", "/></citation>', {}, ("[", "]", ", ", True, False, "", "")),
        ('<citation><layout delimiter=", "><group><group prefix="[" suffix="]"><text variable="citation-number" prefix="n"/></group></group></layout></citation>', {}, ("", "", ", ", False, False, "[n", "]")),
        ('<citation><layout vertical-align="sup" prefix="(" suffix=")"/></citation>', {}, ("", "", ",", False, True, "", "")),
        ("<citation><layout/></citation>", {"author_date": True}, ("(", ")", "; ", False, False, "", "")),
        ("<info/>", {}, ("", "", ",", False, False, "", "")),
        ("<broken", {}, ("[", "]", ", ", False, False, "", "")),
        ("<broken", {"superscript": True}, ("", "", ",", False, True, "", "")),
    ],
)
def test_style_files(inside, kw, want):
    assert num.style_layout(f'<style xmlns="http://purl.org/net/xbiblio/csl">{inside}</style>', **kw) == want


def test_style_files_that_are_missing(spark):
    df = spark.createDataFrame([(None,), ("",)], "x string")
    assert [r.l.prefix for r in df.select(num.style_layouts(F.col("x"), F.lit(False), F.lit(False)).alias("l")).collect()] == ["[", "["]


def test_identities_of_foreign_addresses(spark):
    from citeloom.functions import identity as idn

    df = spark.createDataFrame([(["x/1", "https://doi.org/10.5/a", "record/u/", "https://doi.org/10.5/b"],), ([],), (None,)], "u array<string>")
    got = [tuple(r.i) for r in df.select(idn.identity_from_uris(F.col("u")).alias("i")).collect()]
    assert got == [("u", "10.5/a", ""), ("", "", ""), ("", "", "")]


def test_word_files_with_citations(spark):
    from citeloom.sources import docx

    df = spark.createDataFrame([(1, "a (REF) b (REF)\nline & <two>"), (2, "none"), (3, ""), (4, None)], "id int, t string")
    files = df.select("id", docx.with_citations(F.col("t"), r"\(REF\)", "ADDIN MY.CITE {}", "[1]").alias("content"))
    fields = docx.fields(files, "id", "content").collect()
    assert [(f.id, f.result_text, f.complete) for f in fields] == [(1, "[1]", True)] * 2
    paras = {(r.id, r.para_index): r.text for r in docx.paragraphs(files, "id", "content").collect()}
    assert paras == {(1, 0): "a [1] b [1]", (1, 1): "line & <two>", (2, 0): "none", (3, 0): ""}
    refs = spark.createDataFrame([(1, 0, "References"), (1, 1, "x"), (1, 2, "References"), (1, 3, "1. y"), (2, 0, "z")], "id int, para_index int, text string")
    assert sorted((r.id, r.para_index) for r in docx.without_references(refs, "id").collect()) == [(1, 0), (1, 1), (2, 0)]


def test_parts_around_markers(spark):
    from citeloom.operators import documents as dc

    df = spark.createDataFrame([("A b (REF) c (REFS).",), ("none",), (None,), ("(REF)",)], "t string")
    got = [None if r.c is None else [(x.before, x.after) for x in r.c] for r in df.select(dc.sub_claims_at(F.col("t"), mk.markers_column(F.col("t"))).alias("c")).collect()]
    assert got == [[("A b", "c"), ("c", ".")], [], [], [("", "")]]
    votes = spark.createDataFrame([(1, 1), (0, 2), (0, 0), (None, None)], "s int, b int")
    assert [r.v for r in votes.select(dc.style_vote(F.col("s"), F.col("b")).alias("v")).collect()] == ["superscript", "bracket", "none", "none"]


def test_payload_gate(spark):
    from citeloom.operators import flatten

    rows = [(1, '{"citationItems": [{"id": "a"}], "app": {"v": 2}}'), (2, '{"app": {"v": 3}, "citationItems": []}'), (3, '{"items": {"item": {"id": "b"}}}'), (4, '{"items": [{}, 5]}'), (5, "{"), (6, None), (7, "{}")]
    df = spark.createDataFrame(rows, "payload_id long, payload string")
    got = {r.payload_id: (r.tier, list(r.problems)) for r in flatten.payload_gate(df).collect()}
    assert got == {1: ("readable", []), 2: ("newer", []), 3: ("readable", []), 4: ("readable", ["items without id"]), 5: ("unreadable", []), 6: ("unreadable", []), 7: ("readable", ["no items"])}


def test_review_merge_and_full_text_ids(spark):
    from citeloom.operators import library as lib

    kind = "id int, title string, year int, authors array<struct<last_name:string>>"
    original = spark.createDataFrame([(1, "T", 0, []), (2, " ", 1990, [("A",)]), (3, None, None, None)], kind)
    found = spark.createDataFrame([(1, "U", 2001, [("B",)]), (2, "V", 1, [("C",)])], kind)
    got = {r.id: (r.title, r.year, None if r.authors is None else [a.last_name for a in r.authors]) for r in lib.review_merged(original, found, "id", ["title"]).collect()}
    assert got == {1: ("T", 2001, ["B"]), 2: ("V", 1990, ["A"]), 3: ("", 0, None)}
    works = spark.createDataFrame([(1, "1", "d", "PMC9"), (2, "1", "d", ""), (3, "x", "d", None), (4, None, None, None)], "work_id int, pmid string, doi string, pmcid string")
    p = spark.createDataFrame([("1", "PMC2"), ("1", "PMC1"), ("", "PMC0")], "pmid string, pmcid string")
    d = spark.createDataFrame([("d", "PMC5")], "doi string, pmcid string")
    assert {r.work_id: r.pmcid for r in lib.full_text_id(works, p, d).collect()} == {1: "PMC9", 2: "PMC1", 3: "PMC5", 4: ""}
