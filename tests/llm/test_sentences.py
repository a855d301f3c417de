"""Sentence boundaries (problem 7)."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.llm import sentences as sn


def cut(text):
    ends = sn.boundaries(text)
    return [text[a:b].strip() for a, b in zip([0, *ends], ends)]


@pytest.mark.parametrize(
    "parts",
    [
        ["Dr. Lee came at 9 a.m. and left.", "It rained."],
        ["It stopped at 5 p.m.", "The rest slept."],
        ["It lay in the U.S.", "The U.S. cohort was small, cf. Tab. 4."],
        ["We used tubes, etc.", "Then E. coli grew by 2.5 (x 10.3)."],
        ['He wrote: "Why now? Nobody asked." and left.', "Yes!"],
        ["Cells were kept (medium changed. No antibiotics.) for days.", "Fine."],
        ["What a surprise... the cells recovered.", "It works (REF)."],
        ["According to Lee et al.\nthe value fell.", "Next [1, 2]."],
        ["Im 19. Jahrhundert war es u. a. neu.", "Am 3. Mai fand Dr. Lee z. B. nichts."],
        ["„Es ging nicht. Wir brachen ab“, steht im Bericht.", "Der Wert lag bei ca. 2,8 mg, d. h. unter der Norm."],
        ["« C'est fini. On arrête », dit J.-P. Roy.", "Quelle surprise !", "M. Roy et le Dr Lee ont relu, p. ex., la fig. 2."],
        ["¡Nada cambió!", "¿Depende de ello?", "El Dr. Lee y la Sra. Roy, p. ej., en EE. UU. y aquí."],
        ["Проф. Ли и др. проверили рис. 2 и табл. 3.", "Значение (ок. 5 мг) росло, т. е. было выше.", "Неужели это так?!"],
        ["قال د. Lee إن القيمة 4.8 مرتفعة.", "هل يؤثر ذلك؟"],
        ['"रुको। अब नहीं।" ऐसा लिखा था।', "डॉ. Lee ने चित्र 2 देखा।"],
        ["ናሙናዎቹ ተቀመጡ።", "104 ተመረመሩ።"],
    ],
)
def test_languages(parts):
    assert cut(" ".join(parts)) == parts
    assert cut("\n " + "\n".join(parts) + " \n") == parts


@pytest.mark.parametrize("parts", [["他说：“停。不要再做了。”然后离开了。", "真的吗？！", "温度升到5度……样品稳定。"], ["記録には「止めた。もう続けない。」とある。", "本当だろうか？"]])
def test_scripts_without_spaces(parts):
    assert cut("".join(parts)) == parts


def test_thai_spaces_and_markers():
    assert cut("ไม่พบความแตกต่าง มวลกระดูกเพิ่มขึ้น (REF) ระยะเวลานอน") == ["ไม่พบความแตกต่าง", "มวลกระดูกเพิ่มขึ้น (REF)", "ระยะเวลานอน"]


def test_missing_space_and_unclosed_marks():
    assert cut("It works.Then it rained.") == ["It works.", "Then it rained."]
    assert cut('It "works. Then it (rained. End.') == ['It "works.', "Then it (rained.", "End."]


@pytest.mark.parametrize("text", [None, "", "  \n "])
def test_no_sentences(text):
    assert sn.boundaries(text) == []


def test_no_terminator_and_long_text():
    assert sn.boundaries(" no end ") == [7]
    assert len(sn.boundaries("It works. " * 20_000)) == 20_000


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab A.!?()\"'。 \n1“”", max_size=60))
def test_ends_are_ordered_and_cover_the_text(text):
    ends = sn.boundaries(text)
    assert ends == sorted(set(ends))
    assert (ends[-1] if ends else 0) == len(text.rstrip()) if text.strip() else ends == []
    assert all(not text[e - 1].isspace() for e in ends)


def test_rows(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 9), (2, None, 9), (3, "x", 9)], "id long, t string, sent_no int")
    assert [tuple(r) for r in sn.sentence_rows(df, "id", F.col("t")).orderBy("id", "sent_no").collect()] == [(1, 1, 4), (1, 2, 9), (3, 1, 1)]


def cut(text):
    out, at = [], 0
    for end in sn.boundaries(text):
        out.append(text[at:end].strip())
        at = end
    return out


def test_list_items_are_units():
    assert cut("1. First item is here\n2. Second item is here") == ["1. First item is here", "2. Second item is here"]
    nested = ["Three steps:", "1. Wash. ", "a) with water", "b) with salt, e.g. brine.", "2. Dry", "- in air", "- in a box", "3. Weigh"]
    assert cut("\n".join(nested)) == ["Three steps:", "1. Wash.", *nested[2:]]
    assert cut("i. one\nii. two\niii. three") == ["i. one", "ii. two", "iii. three"]


def test_numbers_at_the_beginning_of_a_line_are_no_items():
    text = "We tested mice aged\n12. The rest were\nolder."
    assert cut(text) == ["We tested mice aged\n12.", "The rest were\nolder."]
    assert cut("It holds for n =\n3 and more.") == ["It holds for n =\n3 and more."]


def test_long_markers_belong_to_their_sentence():
    marker = "(" + "; ".join(f"Smith {1990 + i}" for i in range(30)) + ")"
    assert cut(f"It rose. {marker} It fell.") == [f"It rose. {marker}", "It fell."]
