"""Duplicates hidden by formatting (problem 4) and their best values (problem 2)."""

import random
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.llm import copies, queries, survivor


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(name, same_rows):
    same_rows(queries.QUERIES[name], queries.ORACLES[name])


def key(spark, doi, title, pmid):
    df = spark.createDataFrame([(doi, title, pmid)], "doi string, title string, pmid string")
    return df.select(copies.reference_key(F.col("doi"), F.col("title"), F.col("pmid")).alias("k")).first().k


def test_written_forms_of_one_record(spark):
    want = key(spark, "10.5555/ab-1", "A case-control study", "123")
    for form in [("https://doi.example/10.5555/AB-1.", " A  Case‐Control STUDY.", "PMID: 123"), ("123", "a case control study", "<10.5555/ab-1>"), ("doi: 10.5555 / ab-1", "[A case-control study]", "12 3")]:
        assert key(spark, *form) == want
    assert key(spark, "", "A case-control study", "123") != want
    assert key(spark, None, None, None) == key(spark, " ", "", "?")


@pytest.mark.parametrize(("parts", "reuse"), [(1, True), (3, True), (7, False)])
def test_groups_against_brute_force(spark, parts, reuse):
    rng = random.Random(parts)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}") for i in range(300)]
    rng.shuffle(rows)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 17)
    try:
        df = spark.createDataFrame(rows, "id long, key string")
        got = {r.id: r.first_id for r in copies.group_copies(df).collect()}
        counts = {r.first_id: r.copies for r in copies.collapse(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.unset("spark.sql.exchange.reuse")
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    least = {}
    for i, k in rows:
        least[k] = min(i, least.get(k, i))
    assert got == {i: least[k] for i, k in rows}
    assert counts == {least[k]: sum(x == k for _, x in rows) for k in least}


def test_counts_and_odd_rows(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, ""), (3, ""), (None, "a")], "id long, key string")
    assert {r.first_id: r.copies for r in copies.collapse(df).collect()} == {1: 2, 2: 2}
    assert copies.group_copies(df.where("false")).count() == 0


def test_hot_group_is_spread(spark):
    plan = copies._ranged(spark.createDataFrame([(1, "a")], "id long, key string"))._jdf.queryExecution().toString()
    assert "rangepartitioning(key" in plan and "id" in plan.split("rangepartitioning(key")[1][:40]


# ---------------------------------------------------------------- survivors


def usable(spark, text):
    return spark.range(1).select(survivor.usable_abstract(F.lit(text).cast("string")).alias("u")).first().u


@pytest.mark.parametrize("text", ["It fell by 2.5% (n.s.).", "Did it grow? Yes!", "We saw 14 mice."])
def test_usable(spark, text):
    assert usable(spark, text)


@pytest.mark.parametrize("text", [None, "", "  ", "-", "?", "n/a", "No abstract available.", "[Abstract not available]", "Error 503: try again later.", "Abstract withheld by the publisher. Sign in.", "It fell by…", "It fell [truncated]", "It fell (more)", "It fell by 2", "It fell (by 2.", "It fell by 9."])
def test_unusable(spark, text):
    assert not usable(spark, text)


def test_origins(spark):
    df = spark.createDataFrame([(s,) for s in (" PUBMED", "pub_med", "accepted_pubmed", "manual_add_pubmed", "Europe PMC", None)], "s string")
    assert [r.o for r in df.select(survivor.origin(F.col("s")).alias("o")).collect()] == ["pubmed"] * 4 + ["europepmc", ""]


def test_consensus_votes_per_column():
    values = [v.split() for v in ("the gut of old mice", "the gut of young mice", "a gut of old mice", "the gut of old rats")]
    assert survivor.consensus(values, [1.0] * 4) == "the gut of old mice".split()
    three = ["a b x", "a b c d", "a b c"]
    assert survivor.survivor(three, [1.0] * 3, survivor.vote_weights) == 2
    assert survivor.survivor(three, [9.0, 1.0, 1.0], survivor.vote_weights) == 0
    assert survivor.survivor(three, [1.0] * 3, survivor.trust_weights) == 0


def test_votes_of_equal_values_and_blocks_add_up(spark):
    rows = [(1, i, "the gut of old rats", 9, 2.0) for i in range(2)] + [(1, 10 + i, "The gut of old MICE", 1, 1.0) for i in range(5)] + [(1, 20, "the gut of young mice", 5, 1.0)]
    df = spark.createDataFrame([(g, "f", i, v, t, None, n) for g, i, v, t, n in rows], "g long, field_name string, row_id long, value string, trust int, added_at timestamp, vote double")
    for block in (1000, 2):
        assert survivor.surviving_values(df, ["g", "field_name"], survivor.vote_weights, block).first().row_id == 10
        assert survivor.surviving_values(df, ["g", "field_name"], block=block).first().row_id == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=6).map(" ".join), min_size=1, max_size=6))
def test_trust_always_follows_the_first(values):
    assert survivor.survivor(values, [1.0] * len(values), survivor.trust_weights) == 0


@settings(max_examples=50, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=7), st.lists(st.sampled_from("abc"), max_size=7))
def test_token_distance_against_brute_force(a, b):
    def slow(i, j):
        if i == len(a) or j == len(b):
            return len(a) - i + len(b) - j
        return slow(i + 1, j + 1) if a[i] == b[j] else 1 + min(slow(i + 1, j), slow(i, j + 1), slow(i + 1, j + 1))

    assert survivor.distance(a, b) == slow(0, 0)


LIBRARY = "row_id long, doi string, title string, pmid string, abstract string, journal_abbrev string, journal string, source string, added_at timestamp, extra string"


def test_survivors(spark):
    t = datetime(2020, 1, 1)
    rows = [
        (1, "10.5555/a", "T", "", "Good text.", "J T", "Journal of T", "embedded", t, "x"),
        (2, "10.5555/A", "T.", None, "Best text.", "Journal of T", "Journal of T", "PubMed", t, "x"),
        (3, "10.5555/a", "t", "", "Later text.", "J. T.", "Journal of T", "pub_med", datetime(2021, 1, 1), "x"),
        (4, "10.5555/a", "t", "", "Cut te…", None, "Journal of T", "pubmed", datetime(2022, 1, 1), "x"),
        (5, "10.5555/b", "alone", "", "Fine.", "J", "Journal", "pubmed", t, "x"),
        (6, "10.5555/c", "c", "", "-", "", "J", "pubmed", t, "x"),
        (7, "10.5555/c", "c", "", None, None, "J", None, None, "x"),
    ]
    trust = spark.createDataFrame([("pubmed", 6), ("embedded", 1)], "source string, trust int")
    library = spark.createDataFrame(rows, LIBRARY)
    got = survivor.library_survivors(library, copies.library_groups(library), trust).collect()
    assert {(r.first_row_id, r.field_name, r.row_id) for r in got} == {(1, "abstract", 3), (1, "journal_abbrev", 3)}


def test_large_groups_meet_in_blocks(spark):
    rows = [(1, "f", i, f"value {i} x.", i % 5, None) for i in range(200)]
    df = spark.createDataFrame(rows, "g long, field_name string, row_id long, value string, trust int, added_at timestamp")
    small = survivor.surviving_values(df, ["g", "field_name"], block=8).collect()
    whole = survivor.surviving_values(df, ["g", "field_name"], block=1000).collect()
    assert [tuple(r) for r in small] == [tuple(r) for r in whole] == [(1, "f", 4)]


def test_best_rows_need_no_alignment(spark):
    rng = random.Random(3)
    rows = [(g, "f", g * 100 + i, rng.choice(["a b", "a b c", "A, B.", "x"]), rng.choice([-1, 0, 6]), rng.choice([None, datetime(2020, 1, 1), datetime(2021, 1, 1)])) for g in range(40) for i in range(rng.randrange(1, 7))]
    df = spark.createDataFrame(rows, "g long, field_name string, row_id long, value string, trust int, added_at timestamp")
    best = survivor.best_rows(df, ["g", "field_name"])
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, survivor.surviving_values(df, ["g", "field_name"]).collect()))
    trust = spark.createDataFrame([("pubmed", 6)], "source string, trust int")
    library = spark.createDataFrame([], LIBRARY)
    plan = survivor.library_survivors(library, copies.library_groups(library).where("row_id > 0"), trust)._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" not in plan and "winner" not in plan and "max(" in plan
