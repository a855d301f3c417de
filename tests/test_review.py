"""Selection and review."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from citeloom.operators import review as rv


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("text", "want"), [('{"a": 1}', '{"a": 1}'), ('```json\n{"a": {"b": "}"}}\n```', '{"a": {"b": "}"}}'), ('so {not json} but {"c": 2} here', '{"c": 2}'), ("none", None), ("", None), (None, None)])
def test_lenient_json(text, want):
    assert rv.lenient_json(text) == want


def test_markers_take_no_work_twice(spark):
    picks = spark.createDataFrame([("s", 1, 1, 10), ("s", 1, 2, 11), ("s", 2, 1, 10), ("s", 2, 2, 12), ("s", 3, 1, 10)], "sent_id string, marker int, rank int, cand_id long")
    assert {(r.marker, r.cand_id) for r in rv.assign_without_repeats(picks).collect()} == {(1, 10), (2, 12)}


def test_adjacent_fields_are_one_cluster(spark):
    f = spark.createDataFrame([(1, 1, 0, 3), (1, 2, 3, 5), (1, 3, 7, 9), (2, 1, 9, 10)], "doc_id int, ord int, start int, end int")
    assert [r.cluster for r in rv.adjacent_clusters(f).orderBy("doc_id", "ord").collect()] == [1, 1, 2, 1]


def test_adoption_is_all_or_nothing(spark):
    groups = spark.createDataFrame([(1, "1-2"), (2, "1"), (2, "9"), (3, "1, x")], "doc_id int, text string")
    entries = spark.createDataFrame([(d, n) for d in (1, 2, 3) for n in (1, 2)], "doc_id int, number int")
    assert {r.doc_id: r.adopt for r in rv.adoptable(groups, entries).collect()} == {1: True, 2: False, 3: True}


def test_author_date_and_truncation(spark):
    labels = F.create_map(F.lit(1), F.lit("Doe, 2020"), F.lit(2), F.lit("Doe, 2020"))
    assert one(spark, rv.to_author_date(F.lit("1-3"), labels)) == "Doe, 2020; ref 3"
    authors = F.array(*[F.lit(str(i)) for i in range(40)])
    assert len(one(spark, rv.truncated_item(F.lit("x" * 20_000), authors)).authors) == 30
    assert not one(spark, rv.truncated_item(F.lit("x"), authors)).truncated


def test_fuzzy_titles(spark):
    left = spark.createDataFrame([(1, "Bone mass after silencing of Kluv: a change", 2020), (2, None, 2020), (3, "Other thing entirely", 2020)], "id int, title string, year int")
    right = spark.createDataFrame([(9, "Bone mass after silencing of Kluv - a change", 2021), (8, "Bone mass after silencing of Kluv: a change", 1990), (7, "Bone mass after silencing of Kluv: a change", 0)], "id int, title string, year int")
    assert {(r.left_id, r.right_id) for r in rv.fuzzy_title_matches(left, right).collect()} == {(1, 9), (1, 7)}


def test_fuzzy_titles_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    base = ["Colour of fibres in Klik-24 mice", "Bone", "On ageing", "Polymerisation and discriminatuon by colour " * 4, "", None, "?!"]
    base += [" ".join("".join(rng.choice("abcdeors") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(1, 9))) for _ in range(20)]

    def slips(t):
        t = list(t or "")
        for _ in range(rng.randrange(0, 1 + len(t) // 6)):
            t[rng.randrange(len(t))] = rng.choice(["", "x", "ab"])
        return "".join(t)

    rows = lambda: [(i, t if i % 3 == 0 else slips(t), rng.choice([0, None, -1, 1, 2000, 2001, 2003])) for i, t in enumerate(base * 4)]
    left, right = rows(), rows()
    right += [(900, "Color of fibers in Klik24 mice", 0), (901, "Polymerization and discrimination by color " * 4, 0)]
    bare = lambda t: re.sub("[^a-z0-9 ]+", "", (t or "").lower()).strip(" ")
    fits = lambda y, z: not y or not z or abs(y - z) <= 1
    want = {(i, j) for i, t, y in left for j, u, z in right if fits(y, z) and bare(t) and bare(u) and SequenceMatcher(None, bare(t), bare(u)).ratio() >= rv.TITLE_MATCH}
    schema = "id int, title string, year int"
    monkeypatch.setattr(rv, "TITLES_A_CELL", 30)
    got = [(r.left_id, r.right_id) for r in rv.fuzzy_title_matches(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema)).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {(0, 900), (3, 901)} <= want and (1, 1) in {(i % 27, j % 27) for i, j in want}


def test_pairs_without_enough_letters_are_left_out_before_their_order_is_compared(monkeypatch):
    rng = random.Random(5)
    words = ["bone", "colour", "silencing", "of", "mice", "after", "klik24", "a", "change", "in", "density", "aged", "rats", "secretion"]
    titles = [" ".join(rng.choices(words, k=rng.randrange(5, 9))) for _ in range(150)]
    want = {(i, j) for i, x in enumerate(titles) for j, y in enumerate(titles) if SequenceMatcher(None, x, y).ratio() >= 0.85}
    shared = lambda x, y: sum(min(x.count(c), y.count(c)) for c in set(x))
    taken, true = [], rv.common_lengths

    def spy(xs, ys, left, right):
        taken.extend((xs[i], ys[j]) for i, j in zip(left, right))
        return true(xs, ys, left, right)

    monkeypatch.setattr(rv, "common_lengths", spy)
    assert {(i, j) for i, j, _ in rv.like_titles(titles, titles, 0.85)} == want
    assert taken and all(len(x) + len(y) - 2 * shared(x, y) <= 0.15 * (len(x) + len(y)) + 1e-6 for x, y in taken)


def test_selection_and_message(spark):
    slots = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c")))
    assert one(spark, rv.rebuilt_selection(slots, F.array(F.lit("b"), F.lit("c")))) == ["b", "c"]
    text = one(spark, rv.claim_message(F.lit("C."), F.lit(""), F.lit("Results"), F.array(F.lit("A."), F.lit("B.")), F.array().cast("array<string>"), F.lit(2)))
    assert text == 'CLAIM: 2 references\n"C."\nSection: Results\nPreceding: "A." "B."'


def test_recent_rows_are_cut_before_ranking(spark):
    rows = spark.createDataFrame([(1, "2024-01-03", "x"), (2, "2024-01-02", "gut bone"), (3, "2024-01-01", "gut bone")], "row_id int, day string, t string")
    assert [r.row_id for r in rv.recent_then_ranked(rows, "day", F.lit("2024-01-01"), 2, ["gut", "bone"], F.col("t")).collect()] == [2]
