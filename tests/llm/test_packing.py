"""Packing (problem 8)."""

import random
from pathlib import Path

import pytest

from citeloom.llm import packing as pk
from citeloom.llm.queries import TOKENIZER


def check(items, tiers, rows):
    size = dict(items)
    seen, used = {}, {}
    for i, k, n, t, c, off, g in rows:
        assert n <= t and k not in seen.setdefault(i, set())
        seen[i].add(k)
        used.setdefault((t, c), []).append((off, n))
    assert {i: sum(n for j, _, n, *_ in rows if j == i) for i in seen} == size
    for (t, _), spans in used.items():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and spans[-1][0] + spans[-1][1] <= t
    return used


@pytest.mark.parametrize("seed", range(4))
def test_nothing_is_lost_or_split_needlessly(seed):
    rng = random.Random(seed)
    items = [(i, rng.choice([rng.randrange(1, 60), rng.randrange(1, 400), rng.randrange(1, 2000)])) for i in range(400)]
    used = check(items, (64, 256, 1024), pk.pack(items, (64, 256, 1024)))
    waste = 1 - sum(n for s in used.values() for _, n in s) / sum(t for t, _ in used)
    assert waste < 0.03


def test_long_windows_are_filled_from_shorter_tiers():
    rows = pk.pack([(1, 700), (2, 300), (3, 24), (4, 60)], (64, 256, 1024))
    assert {(i, t) for i, _, _, t, *_ in rows} == {(1, 1024), (2, 1024), (3, 1024), (4, 64)}


def test_step_groups_are_balanced():
    work = [random.Random(2).randrange(1, 100) for _ in range(80)]
    groups = pk.step_groups(work, 8)
    load = {g: sum(w for w, x in zip(work, groups) if x == g) for g in set(groups)}
    assert max(groups.count(g) for g in load) <= 8 and max(load.values()) < 1.1 * min(load.values())


def test_best_fit_prefers_the_fullest():
    b = pk.BestFit(10)
    first, second = b.open(4), b.open(7)
    assert b.place(3) == second and b.place(6) == first and b.place(1) is None


@pytest.mark.skipif(not Path(TOKENIZER[1]).exists(), reason="no tokenizer files")
def test_table(spark):
    df = spark.createDataFrame([(1, "gut " * 30), (2, None), (3, ""), (4, "gut " * 30), (5, "x " * 1000), (6, "<|endoftext|>")], "doc_id long, text string")
    got = pk.containers(pk.token_counts(df, "doc_id", "text", TOKENIZER[1]), (16, 64), shard=2).collect()
    assert {r.doc_id for r in got} == {1, 4, 5, 6} and all(r.n_tokens <= r.tier for r in got)
    assert pk.containers(pk.token_counts(df.where("false"), "doc_id", "text", TOKENIZER[1])).count() == 0
