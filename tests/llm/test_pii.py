"""Personal data (problem 10)."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from citeloom.llm import pii


GIVEN = (*pii.GIVEN_NAMES, "jonas", "milo", "wanda")


def kinds(text, given=GIVEN):
    return [(text[b:e], k) for b, e, k in pii.find(text, given)]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Write to jane.doe+refs@post.uni.example or ring.", [("jane.doe+refs@post.uni.example", "email")]),
        ("Write to JDOE@UNI.EXAMPLE.", [("JDOE@UNI.EXAMPLE", "email")]),
        ("Write to jdoe (at) uni (dot) example", [("jdoe (at) uni (dot) example", "email")]),
        ("Write to jdoe(at)uni(dot)example only", [("jdoe(at)uni(dot)example", "email")]),
        ("Write to jdoe at post dot uni dot example only", [("jdoe at post dot uni dot example", "email")]),
        ("Write to jdoe @ uni.example today", [("jdoe @ uni.example", "email")]),
        ("Write to jdoe [at] uni-x.example today", [("jdoe [at] uni-x.example", "email")]),
        ("The batch was rerun @ 37 °C. Mail the kit @ room temperature. Next.", []),
        ("Ring +44 7700 900 745 42 times", [("+44 7700 900 745", "phone")]),
        ("Ring +1-415-555-0132, (212) 555-0182, 212.555.0165, 555-0144 or 020 7946 0080", [("+1-415-555-0132", "phone"), ("(212) 555-0182", "phone"), ("212.555.0165", "phone"), ("555-0144", "phone"), ("020 7946 0080", "phone")]),
        ("tél. 07700 900248; 030/23125-519", [("07700 900248", "phone"), ("030/23125-519", "phone")]),
        ("Ref. 555-307 of the catalogue, grant 12-3456-307, scores (9398-45-104), ratio 030:23335, at 162450-1286733, 2020;32:148-153", []),
        ("IDs 000-13-1568, 909 82 8239, QQ 46 79 21 D, QQ302733C, ZZ7035437, X1695080Q, 00.10.34-867.35", [(x, "id_number") for x in ("000-13-1568", "909 82 8239", "QQ 46 79 21 D", "QQ302733C", "ZZ7035437", "X1695080Q", "00.10.34-867.35")]),
        ("lives at Flat 3, 20B Tollgate Ave., Galdren and", [("Flat 3, 20B Tollgate Ave., Galdren", "address")]),
        ("at 36 Old Mill Ave.. Power", [("36 Old Mill Ave.", "address")]),
        ("at 42 Larkspur Rd.\nIn", [("42 Larkspur Rd", "address")]),
        ("at 29B St. Brannoc Road, Ostrelle-Nord.", [("29B St. Brannoc Road, Ostrelle-Nord", "address")]),
        ("wohnt Am Mühlbach 142, 00118 Ruddock.", [("Am Mühlbach 142, 00118 Ruddock", "address")]),
        ("wohnt Lindenstr. 72a, 00965 Hexwater.", [("Lindenstr. 72a, 00965 Hexwater", "address")]),
        ("au 178 bis bd. du Lavoir, 00865 Vindell, tél.", [("178 bis bd. du Lavoir, 00865 Vindell", "address")]),
        ("en Calle del Olmo, 25, 2.º B, 00584 Morvale.", [("Calle del Olmo, 25, 2.º B, 00584 Morvale", "address")]),
        ("Close to 23 animals at the close of day on the road", []),
        ("We thank Dr. Jonas van der Berg and Berg, Wanda for help.", [("Jonas van der Berg", "person"), ("Berg, Wanda", "person")]),
        ("We thank WANDA H. O'BERG and jonas bergström-lee.", [("WANDA H. O'BERG", "person"), ("jonas bergström-lee", "person")]),
        ("The Jonas Berg Institute and the Berg-Lee test, Berg et al. 2020, Jonas alone", []),
        ("联系人：尉迟砚秋，电话", [("尉迟砚秋", "person")]),
        ("The spines of lines and Milo", []),
        ("code 555-0199 part, version 555-0199", []),
        ("Ring 555-0199", [("555-0199", "phone")]),
        ("His passport no. is 523 886 914, her NHS number: 943 476 5919, SSN 000131568", [("523 886 914", "id_number"), ("943 476 5919", "id_number"), ("000131568", "id_number")]),
        ("See mailto:jane.doe@uni.example or sip:jane@uni.example or tel:+1-415-555-0132", [("jane.doe@uni.example", "email"), ("jane@uni.example", "email"), ("+1-415-555-0132", "phone")]),
        ("A passport number is needed, the social security of all, PMID 12345678", []),
        (None, []),
        ("", []),
    ],
)
def test_finds(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize("name", ["Priya Raghunathan", "Ahmed Khan", "Mei-Ling Chen", "Khan, Ahmed", "FATIMA EL-AMRANI", "Kwame N. Boateng"])
def test_names_outside_the_data(name):
    assert kinds(f"We thank {name} for help.", tuple(pii.GIVEN_NAMES)) == [(name, "person")]


@pytest.mark.parametrize("name", ["Xiulan Zhao", "Torvik Gunderhaug", "Gunderhaug, Torvik", "Ngozi A. Eze"])
@pytest.mark.parametrize("cue", ["Dr. {}", "for the attention {} of unit 3", "One participant, {}, left", "Contact: {}"])
def test_unlisted_names_behind_cues(cue, name):
    assert kinds(cue.format(name)) == [(name, "person")]


def test_cues_without_a_full_name():
    assert kinds("Dr. Smith left. Contact: The Institute. Prof. Berg Institute. Mr. Power was. Attention deficit disorder. Pay attention Now.") == []


def test_learned_names(spark):
    rows = spark.createDataFrame([("Torvik",), (" torvik ",), ("J.",), (None,), ("",), ("Anna Lena",)], "v string")
    assert set(pii.learned_names(rows)) == {*pii.GIVEN_NAMES, "torvik"}
    df = spark.createDataFrame([(1, "We thank Torvik Gunderhaug for help")], "id long, t string")
    assert pii.found_places(df, "id", F.col("t")).count() == 0
    assert pii.found_places(df, "id", F.col("t"), pii.learned_names(rows)).count() == 1
    with pytest.raises(ValueError, match="bytes"):
        pii.learned_names(rows, most_bytes=2)


def test_many_finds_in_one_text():
    assert len(kinds("Ring 555-0144. " * 30_000)) == 30_000


def test_name_and_mail_do_not_overlap():
    assert kinds("Jonas Berg (jonas.berg@uni.example)") == [("Jonas Berg", "person"), ("jonas.berg@uni.example", "email")]


def test_offsets_count_code_points_even_where_lower_case_is_longer():
    text = "İ😀 Ring 555-0144"
    assert kinds(text) == [("555-0144", "phone")]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab @.+-0123456789()/İstWanda Jonas,", max_size=80))
def test_spans_are_ordered_and_apart(text):
    spans = pii.find(text)
    assert all(0 <= b < e <= len(text) for b, e, _ in spans)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "Ask Maria Berg, tel. 555-0144."), (2, None), (3, "nothing")], "id long, t string")
    assert [r.t for r in df.select(pii.redacted(F.col("t")).alias("t")).collect()] == ["Ask [PERSON], tel. [PHONE].", None, "nothing"]
    assert pii.found_places(df, "id", F.col("t")).count() == 2
    assert pii.found_places(df.where("false"), "id", F.col("t")).count() == 0


def test_long_texts_are_read_whole():
    text = "filler words here. " * 20_000 + "Ring 555-0144"
    assert kinds(text) == [("555-0144", "phone")]
