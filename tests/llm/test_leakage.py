"""Leaking evaluation texts (problem 9)."""

import random

import numpy as np
import pytest

from citeloom.llm import leakage as lk

ITEM = "By midsummer, letters from the harbour blamed tanned hides for a stone's throw of rust-red blindness among ferrets, says one merry net mender. What next?"


def found(spark, docs, items=((1, ITEM),), **kw):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame(list(items), "item_id long, text string")
    return {(r.doc_id, r.item_id): r.edits for r in lk.leaks(d, e, **kw).collect()}


def words(n, start=0):
    return " ".join(ITEM.split()[start : start + n])


@pytest.mark.parametrize(
    "text",
    [
        ITEM,
        f"Before. {words(14)}, and after.",
        words(16).upper(),
        words(16).replace(" ", "  \n"),
        words(16).replace("letters", "let-\nters"),
        words(16).replace("letters", "letters (Smith et al. 2020)").replace("hides", "hides [12, 3]").replace("tanned", "tanned (PMID: 123)"),
        words(20).replace("rust-red", "rust red").replace("'", ""),
        words(20).replace("rust-red", "rust-\nred"),
    ],
)
def test_disguises_are_found(spark, text):
    for edits in (0, 1):
        assert found(spark, [(7, text)], edits=edits) == {(7, 1): 0}


def test_short_passages_are_not(spark):
    assert found(spark, [(1, words(9)), (2, None), (3, ""), (4, "word " * 50)]) == {}


def test_both_paths_agree(spark):
    rng = random.Random(3)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(40))) for i in range(12)]
    docs = []
    for i in range(40):
        ws = items[i % 12][1].split()[5:30]
        if i % 3:
            ws[rng.randrange(25)] = "changed"
        docs.append((i, "pre text " + " ".join(ws) + " post"))
    for edits in (0, 1):
        assert found(spark, docs, items, edits=edits) == found(spark, docs, items, edits=edits, map_side_bytes=0)


def test_both_paths_agree_on_broken_words_and_near_copies(spark):
    docs = [(1, words(20).replace("rust-red", "rust-\nred")), (2, words(20).replace("letters", "let-\nters").replace("rust-red", "rust-\nred"))]
    for edits in (0, 1):
        assert found(spark, docs, edits=edits, map_side_bytes=0) == {(1, 1): 0, (2, 1): 0}
    # a near copy before the exact one agrees with it in every sampled symbol
    cgk, exact = lk.Cgk(edits=0), ITEM.split()[:12]
    item = [(1, " ".join(w.strip(",") for w in exact))]
    plain = lk.readings(item[0][1])[0][0]
    codes = lambda ws: np.array([[lk.word_code(w) for w in ws]], np.int64)
    near = next(c for k in range(lk.WINDOW) if (cgk.buckets(codes(c := [*plain[:k], "zzz", *plain[k + 1 :]])) == cgk.buckets(codes(plain))).all())
    doc = [(7, " ".join([*near, "between", *plain]))]
    assert found(spark, doc, item) == found(spark, doc, item, map_side_bytes=0) == {(7, 1): 0}


def test_recall_of_near_windows_against_brute_force():
    rng = np.random.default_rng(5)
    a = rng.integers(1, 2**40, (600, lk.WINDOW))
    b = a.copy()
    for row in b[:300]:
        row[rng.integers(lk.WINDOW)] = 1  # a changed word
    for k in range(300, 600):
        at = rng.integers(lk.WINDOW)
        b[k] = np.concatenate([np.delete(b[k], at), [1]])  # a lost word
    for edits, least in ((1, 0.9), (2, 0.9)):
        cgk = lk.Cgk(edits=edits, recall=0.95)
        hit = (cgk.buckets(a) == cgk.buckets(b)).any(axis=1)
        near = lk.edit_distances(a, b) <= edits
        assert hit[near].mean() >= least


@pytest.mark.parametrize(("edits", "map_side_bytes"), [(1, lk.MAP_SIDE_BYTES), (2, lk.MAP_SIDE_BYTES), (1, 0)])
def test_recall_with_words_that_no_item_has(spark, edits, map_side_bytes):
    """Substitutions, insertions and losses with unknown words, each item being a single window."""
    rng = random.Random(11)
    items = [(i, " ".join(f"w{rng.randrange(5000)}" for _ in range(lk.WINDOW))) for i in range(300)]
    docs, kinds = [], {}
    for i, (_, text) in enumerate(items):
        ws = text.split()
        kind = "changed" if edits == 1 else ("changed twice", "inserted", "lost")[i % 3]
        at = rng.randrange(1, lk.WINDOW - 1)
        if kind == "inserted":
            ws.insert(at, f"new{i}")
        elif kind == "lost":
            del ws[at]
        else:
            ws[at] = f"new{i}"
            if kind == "changed twice":
                ws[(at + 5) % lk.WINDOW] = f"other{i}"
        docs.append((i, f"some{i} text before " + " ".join(ws) + f" and{i} text behind"))
        kinds[i] = kind
    got = found(spark, docs, items, edits=edits, map_side_bytes=map_side_bytes)
    for kind in set(kinds.values()):
        of = [i for i in kinds if kinds[i] == kind]
        assert sum((i, i) in got for i in of) / len(of) >= 0.95, kind


def test_both_paths_agree_with_unknown_words_and_many_windows(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(30))) for i in range(20)]
    docs = []
    for i in range(60):
        ws = items[i % 20][1].split()
        ws[rng.randrange(30)] = f"strange{i}"
        docs.append((i, " ".join(ws) + " (2001) " + " ".join(ws[::-1]) + " " + " ".join(ws)))
    for most in (lk.VOCABULARY_BYTES, 0):
        monkeypatch.setattr(lk, "VOCABULARY_BYTES", most)
        for edits in (0, 1):
            assert found(spark, docs, items, edits=edits) == found(spark, docs, items, edits=edits, map_side_bytes=0)


def test_brackets_of_a_passage_stay(spark):
    item = [(1, "the long walk (in the summer of 1998) ended where it began")]
    doc = [(1, "We read that the long walk (in the summer of 1998) ended where it began."), (2, "the long walk ended where it began")]
    for size in (lk.MAP_SIDE_BYTES, 0):
        assert found(spark, doc, item, map_side_bytes=size) == {(1, 1): 0}
    both = [(1, "the long walk (in the summer of 1998) ended [3] where (Smith et al. 1999) it began")]
    assert found(spark, both, item) == {(1, 1): 0}


def test_edit_distance_against_brute_force():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (50, 6)), rng.integers(0, 3, (50, 6))

    def slow(x, y):
        d = np.zeros((7, 7), int)
        d[:, 0] = d[0] = range(7)
        for i in range(6):
            for j in range(6):
                d[i + 1, j + 1] = min(d[i, j + 1] + 1, d[i + 1, j] + 1, d[i, j] + (x[i] != y[j]))
        return d[6, 6]

    assert list(lk.edit_distances(a, b)) == [slow(x, y) for x, y in zip(a, b)]


def test_empty_tables(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    e = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert lk.leaks(d, e).count() == 0
    assert lk.leaks(spark.createDataFrame([(1, ITEM)], "doc_id long, text string"), e.where("false")).count() == 0
