"""Record linkage (problem 6)."""

import numpy as np
from pyspark.sql import functions as F

from citeloom.llm import linkage as lk

ENTRY = "entry_id long, doc_id long, raw_text string, title string, authors_str string, year int, journal string, cand_id string"
CAND = "cand_id long, title string, authors array<struct<last_name:string,first_name:string,initials:string>>, year int, journal string, volume string, pages string"
NAMES = ["Haugen", "Lindqvist", "Morales", "Petrov", "Okafor", "Tanaka", "Dubois", "Weber", "Rossi", "Novak"]
GENES = ["Abc1", "Def22", "Ghi3", "Jkl14", "Mno5", "Pqr36", "Stu7", "Vwx28", "Yza9", "Bcd10"]


def tables(spark, extra_entries=(), extra_cands=()):
    cands, entries = [], []
    for i in range(60):
        a, g = NAMES[i % 10], GENES[(i * 3 + i // 10) % 10]
        title = f"{g} modulates pathway number {chr(97 + i % 26) * 4} in cultured cells"
        cands.append((1000 + i, title, [(a, "", "A"), (NAMES[(i + 3) % 10], "", "B")], 1980 + i % 40, "Journal of Cells", str(10 + i), f"{100 + 7 * i}-{105 + 7 * i}"))
        if i % 2 == 0:
            entries.append((i, 1, f"{i}. {a} A, {NAMES[(i + 3) % 10]} B. {title}. J Cells. {1980 + i % 40};{10 + i}(2):{100 + 7 * i}-{105 + 7 * i}.", None, None, None, None, "x"))
    return spark.createDataFrame(entries + list(extra_entries), ENTRY), spark.createDataFrame(cands + list(extra_cands), CAND)


def pairs(df):
    return {(r.entry_id, r.cand_id) for r in df.collect()}


def test_links_and_confidence(spark):
    entries, cands = tables(spark)
    got = lk.linked(entries, cands)
    assert pairs(got) == {(i, 1000 + i) for i in range(0, 60, 2)}
    assert got.where("confidence < 0.5 or confidence > 1").count() == 0


def test_parts_of_a_work_and_copies(spark):
    a, title = NAMES[0], "Abc1 modulates pathway number aaaa in cultured cells"
    extra_c = [(2000, title + ": a reply", [(a, "", "A")], 1980, "Journal of Cells", "10", "106-108"), (2001, title.upper() + ".", [(a, "", "A")], 1980, "Journal of Cells", "10", "100-105")]
    extra_e = [(500, 1, f"9. {a} A. {title}: a reply. J Cells. 1980;10(2):106-108.", None, None, None, None, "x"), (501, 2, f"9. {a} A. {title}: a reply. J Cells. 1980;10(2):106-108.", None, None, None, None, "x"), (502, 1, None, None, None, None, None, None), (503, 1, " ", "", "", 0, "", None)]
    got = pairs(lk.linked(*tables(spark, extra_e, extra_c)))
    assert {(500, 2000), (501, 2000), (0, 1000), (0, 2001)} <= got
    assert not {(500, 1000), (0, 2000)} & got and not any(e in (502, 503) for e, _ in got)


def test_parsed_fields_stand_in_for_a_missing_text(spark):
    a, title = NAMES[1], "Jkl14 modulates pathway number bbbb in cultured cells"
    entries, cands = tables(spark, [(600, 1, "", title, f"{a} A", 1981, "Journal of Cells", None)])
    assert (600, 1001) in pairs(lk.linked(entries, cands))


def test_empty_tables(spark):
    entries, cands = tables(spark)
    assert lk.linked(entries.where("false"), cands).count() == 0
    assert lk.linked(entries, cands.where("false")).count() == 0


def test_estimation_finds_the_planted_rates():
    rng = np.random.default_rng(1)
    sizes = list(lk.LEVELS.values())
    rows = []
    for i in range(4000):
        match = i < 1000
        rows.append(tuple(int(rng.choice(s, p=np.linspace(1, 9, s)[:: 1 if match else -1] / np.linspace(1, 9, s).sum())) for s in sizes))
    counts = {}
    for r in rows:
        counts[r] = counts.get(r, 0) + 1
    rate, m, u = lk.estimate(list(counts.items()))
    assert abs(rate - 0.25) < 0.08 and all(mk[-1] > uk[-1] for mk, uk in zip(m, u))


def test_folding_and_parts(spark):
    df = spark.range(1).select(lk.folded(F.lit("Ærø Straße Gårdş")).alias("f"), lk.part_of_work(F.lit("x, part ii")).alias("p"), lk.part_of_work(F.lit("a reply to all")).alias("r"), lk.joined_symbols(F.lit("abc 12 and def-3")).alias("s"))
    assert tuple(df.first()) == ("aero strasse gards", "part2", "reply", ["abc12", "def3"])


def test_accent_table_is_aligned():
    assert len(lk._ACCENTS) == len(lk._PLAIN)


def test_first_author(spark):
    cases = {
        "46. Tupel QL, Zabra F: title": "tupel ql",
        "[4] t. k. nisi, j. grid, title": "t. k. nisi",
        "12 van der Berg KO 1999 title": "van der berg ko ",
        "St. John AB, Lee C": "st. john ab",
        "Li X, Wu Y. Title": "li x",
        "O'Neil P (2001) title": "o'neil p ",
        "张 伟, 李 娜": "张 伟",
        "123": "",
        "": "",
    }
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    got = df.select("want", lk.first_author(lk.folded(F.col("t"))).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_short_names_and_swapped_authors(spark):
    title = "Abc1 modulates pathway number qqqq in cultured cells"
    cand = [(3000, title, [("Li", "", "X"), ("Wu", "", "Y")], 1995, None, None, None)]
    entry = [(600, 1, f"7. Li X, Wu Y. {title}. J Cells. 1995.", None, None, None, None, "x"), (601, 1, f"8. Wu Y, Li X. {title}. J Cells. 1995.", None, None, None, None, "x")]
    assert {(600, 3000), (601, 3000)} <= pairs(lk.linked(*tables(spark, entry, cand)))


def test_crowded_blocks_lose_nothing(spark, monkeypatch):
    want = pairs(lk.linked(*tables(spark)))
    monkeypatch.setattr(lk, "CROWDED", 1)
    assert pairs(lk.linked(*tables(spark))) == want
