"""Documents, sentences, numbering, evidence."""

import pytest
from pyspark.sql import functions as F

from citeloom.functions import evidence_text as ev
from citeloom.operators import documents as doc
from citeloom.operators import evidence as evd
from citeloom.operators import numbering as nb
from citeloom.operators import segmentation as seg

TEXT = "Title of it\n\nIntroduction\nOne [1]. Two [2, 3-4].\n\nReferences\n\n1. A. B. 2020.\n2) C. D.\n\n2. E. F.\nAppendix\n3. G."


def paras(spark, text=TEXT):
    return doc.paragraphs(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string"))


def test_bounds_end_before_the_appendix(spark):
    assert [tuple(r) for r in doc.bibliography_bounds(paras(spark)).collect()] == [(1, 5, 7, 10)]


def test_entries_mark_repeated_numbers(spark):
    assert [(r.number, r.copy_no) for r in doc.bibliography_entries(paras(spark)).orderBy("para_index").collect()] == [(1, 1), (2, 1), (2, 2)]


def test_only_listed_numbers_are_citations(spark):
    assert sorted(r.number for r in doc.in_text_citations(paras(spark)).collect()) == [1, 2]


def test_heading_without_entries(spark):
    assert [tuple(r)[1:] for r in doc.bibliography_bounds(paras(spark, "References\nText")).collect()] == [(0, -1, -1)]


def test_sections_are_filled(spark):
    assert [r.section for r in doc.fill_sections(paras(spark, "Introduction\na b.\nMethods\nc d.\ne f.")).orderBy("para_index").collect()] == ["Introduction", "Methods", "Methods"]


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("It works. We saw it.", 2),
        ("It works (cf. Smith, J. A. 2020). We saw it.", 2),
        ("An open (paren. We saw it.", 2),
        ("Smith et al. found it. Yes.", 2),
        ("See Fig. 2. It grew by 2.5 mm.", 2),
        ("By A. B. Smith. Yes!", 3),
        ("In the U.S. It rained.", 1),
        ("It grew by approx. 2 mm? Yes.", 2),
        ("vitamin Y. The rest.", 2),
        ("it ended. and went on.", 1),
        ("no end", 1),
        ("", 1),
    ],
)
def test_sentence_rules(text, parts):
    assert len(seg.split_sentences(text)) == parts


def test_sentence_ids_run_through_the_document(spark):
    got = seg.numbered_sentences(paras(spark, "A is b. C is d.\nE is f.").where("doc_id = 1")).orderBy("para_index", "sent_index").collect()
    assert [r.sent_id for r in got] == ["S001", "S002", "S003"]


def test_first_occurrence_and_uncited(spark):
    events = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "b", 3), (1, None, 0), (1, "", 0)], "doc_id long, key string, pos int")
    numbered = nb.number_by_first_occurrence(events, ["pos"])
    assert {r.key: r.number for r in numbered.collect()} == {"a": 1, "b": 2}
    entries = spark.createDataFrame([(1, "z", 2), (1, "b", 1), (1, "y", 1), (1, "z", 5), (2, "q", 1)], "doc_id long, key string, original_number int")
    seeded = {(r.doc_id, r.key): (r.number, r.cited) for r in nb.seed_uncited(numbered, entries).collect()}
    assert seeded == {(1, "a"): (1, True), (1, "b"): (2, True), (1, "y"): (3, False), (1, "z"): (4, False), (2, "q"): (1, False)}


def test_alias_fold_depends_on_order_and_never_joins_known_classes(spark):
    events = spark.createDataFrame([(1, 1, 1, ["pmid:1"]), (1, 2, 2, ["doi:a"]), (1, 3, 3, ["pmid:1", "doi:a"]), (1, 4, 4, ["doi:a"]), (2, 5, 1, ["doi:a"]), (2, 6, 2, [])], "doc_id long, event_id long, pos int, aliases array<string>")
    got = {r.event_id: r.canonical for r in nb.fold_aliases(events, "pos").collect()}
    assert got == {1: "pmid:1", 2: "doi:a", 3: "pmid:1", 4: "doi:a", 5: "doi:a", 6: "event:6"}


def fold(spark, verdicts, level="MEDIUM", score=55.0, retracted=False):
    vs = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(q).alias("has_quote"), F.lit(f).alias("quote_found")) for v, q, f in verdicts])
    f = spark.range(1).select(evd.fold_verdicts(vs, F.lit(retracted), F.lit(level), F.lit(score)).alias("f")).first().f
    return f.level, f.score, f.status, f.warnings


@pytest.mark.parametrize(
    ("verdicts", "start", "want"),
    [
        ([("supports", True, True)] * 2, ("MEDIUM", 55.0), ("HIGH", 80.0, "verified", [])),
        ([("partial", False, False)], ("HIGH", 95.0), ("MEDIUM", 69.0, "partial", [])),
        ([("not_supported", False, False), ("partial", True, False)], ("HIGH", 90.0), ("LOW", 39.0, "mismatch", ["not_supported", "quote_not_found"])),
        ([("unverified", False, False)], ("HIGH", 90.0), ("HIGH", 90.0, "not_checked", ["unverified"])),
    ],
)
def test_verdicts(spark, verdicts, start, want):
    assert fold(spark, verdicts, *start) == want


@pytest.mark.parametrize(("n", "sizes", "slots", "want"), [(3, [], 1, [(0, 3)]), (3, [1, 2], 2, [(0, 1), (1, 3)]), (3, [1, 1], 2, [(0, 1), (1, 3)]), (1, [5], 2, [(0, 1), (1, 1)])])
def test_slots(spark, n, sizes, slots, want):
    s = F.array(*[F.lit(x) for x in sizes]).cast("array<int>")
    got = spark.range(1).select(evd.slot_ranges(F.lit(n), s, F.lit(slots)).alias("r")).first().r
    assert [(x.first, x.end) for x in got] == want


@pytest.mark.parametrize(("entries", "matched", "ratio", "blocked"), [(50, 3, 0.5, True), (10, 0, 0.5, True), (10, 5, 0.5, False), (4, 4, 0.5, False), (50, 3, 0.05, False)])
def test_guard(spark, entries, matched, ratio, blocked):
    no = F.lit(0)
    r = spark.range(1).select(evd.guard_reasons(F.lit(False), F.lit(False), no, no, no, F.lit(entries), F.lit(matched), ratio).alias("r")).first().r
    assert bool(r) == blocked


def quote(spark, q, t):
    return spark.range(1).select(ev.quote_occurs(F.lit(q), F.lit(t)).alias("o")).first().o


def test_quotes(spark):
    text = "The quick brown fox jumps over the lazy dog and then it runs away from the very old wolf in the wood."
    assert quote(spark, "Quick “brown” fox, jumps", text)
    assert quote(spark, text.replace("wood", "forest"), text)
    assert not quote(spark, "an invented quote that is nowhere in this text at all", text)
    assert not quote(spark, "", text)


def test_passages_skip_what_does_not_fit(spark):
    ps = [(2, 1, "Results", "a" * 900), (3, 2, "Results", "b" * 900), (1, 3, "", "c" * 50), (0, 4, "", "d")]
    df = spark.createDataFrame([(1, ps)], "id int, p array<struct<score:int,idx:int,section:string,text:string>>")
    got = df.select(F.inline(ev.select_passages(F.col("p"), 8, 1000))).collect()
    assert [r.idx for r in got] == [2, 3, 4]


def test_snippet_has_ellipses(spark):
    r = spark.range(1).select(doc.snippet(F.lit("abc " * 20), F.lit(40), F.lit(3), 20).alias("s")).first().s
    assert r.startswith("…") and r.endswith("…") and len(r) <= 22


def test_headings_by_style(spark):
    from citeloom.operators import documents as dc

    rows = [(1, 0, "Heading1", "A title of 12 words, which plain text could not tell from a line"), (1, 1, "", "Body one"), (1, 2, "Heading2", "Ends with a stop."), (1, 3, "Heading2", "x" * 80), (1, 4, None, "")]
    df = spark.createDataFrame(rows, "doc_id long, para_index int, style string, text string")
    got = [(r.para_index, r.section) for r in dc.fill_sections(df).orderBy("para_index").collect()]
    assert got == [(i, rows[0][3]) for i in (1, 2, 3)]


def test_chosen_passages_are_those_of_the_whole_arrays(spark):
    import random

    from pyspark.sql import functions as F

    from citeloom.functions import evidence_text as ev
    from citeloom.operators import evidence as evd

    rng = random.Random(6)
    rows = [(d, i, "S", "w" * rng.choice([10, 700, 1500, 5000]) + " ", rng.randrange(3) if d % 2 else 0) for d in range(6) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, para_index int, section string, text string, score int")
    whole = df.groupBy("doc_id").agg(F.collect_list(F.struct("score", F.col("para_index").alias("idx"), "section", "text")).alias("p")).select("doc_id", F.inline(ev.select_passages(F.col("p"))))
    got = evd.chosen_passages(df, "doc_id", "para_index")
    assert sorted(map(tuple, got.select(*whole.columns).collect())) == sorted(map(tuple, whole.collect()))


def test_quotes_of_any_length(spark):
    from citeloom.operators import evidence as evd

    long = "one two three four five six seven eight nine ten"
    quotes = spark.createDataFrame([(1, "Three, four FIVE."), (2, long), (3, ""), (4, None), (5, "five three")], "q long, text string")
    texts = spark.createDataFrame([(1, f"zero {long} eleven"), (2, "one two three four five six seven eight ten nine"), (3, None), (4, "")], "t long, text string")
    got = {(r.t, r.q): (r.share, r.occurs) for r in evd.quoted(quotes, "q", texts, "t").collect()}
    assert got == {(1, 1): (1.0, True), (1, 2): (1.0, True), (2, 1): (1.0, True), (2, 2): (0.333333, False)}
    assert evd.quoted(quotes.where("false"), "q", texts, "t").count() == 0
