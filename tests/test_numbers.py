"""Golden cases of citation numbers."""

import pytest
from pyspark.sql import functions as F

from citeloom.functions import numbers as num


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("text", "strict", "lenient"),
    [("1, 2", [1, 2], [1, 2]), ("1-3", [1, 2, 3], [1, 2, 3]), ("1–3; 7", [1, 2, 3, 7], [1, 2, 3, 7]), ("5-3", [5, 4, 3], [5, 4, 3]), ("1, 3-", [1], [1, 3]), ("", [], []), ("x", [], [])],
)
def test_expand(spark, text, strict, lenient):
    assert value(spark, num.expand_numbers(F.lit(text))) == strict
    assert value(spark, num.expand_numbers(F.lit(text), True)) == lenient
    assert value(spark, num.strictly_numeric(F.lit(text))) == (strict == lenient)


def test_null_text_has_no_numbers(spark):
    assert value(spark, num.expand_numbers(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize(("ns", "text"), [([1, 2], "1, 2"), ([1, 2, 3], "1-3"), ([3, 4, 5, 9], "3-5, 9"), ([5], "5"), ([], ""), ([9, 3, 4], "9, 3, 4")])
def test_format(spark, ns, text):
    assert value(spark, num.format_numbers(F.array(*[F.lit(n) for n in ns]).cast("array<int>"))) == text


def test_format_and_expand_are_inverse_on_sorted_numbers(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=15, deadline=None)
    @given(st.sets(st.integers(1, 60), min_size=1, max_size=20))
    def check(ns):
        ordered = sorted(ns)
        formatted = num.format_numbers(F.array(*[F.lit(n) for n in ordered]).cast("array<int>"))
        assert value(spark, num.expand_numbers(formatted)) == ordered

    check()


def test_renumber_keeps_unmapped_and_first_places(spark):
    mapping = F.create_map(F.lit(1), F.lit(3), F.lit(2), F.lit(3))
    assert value(spark, num.renumber(F.lit("1, 2, 7"), mapping)) == "3, 7"


def style(name):
    row = next(s for s in num.STYLES if s[0] == name)
    return F.struct(*[F.lit(v).alias(k.split()[0]) for k, v in zip(num.STYLE_SCHEMA.split(", "), row)])


@pytest.mark.parametrize(
    ("name", "ns", "text"), [("nature", [5, 3, 4, 3, 9], "3-5,9"), ("nsf_grant", [1, 2], "[1, 2]"), ("ieee", [3, 4, 5], "[3], [4], [5]"), ("vancouver", [1, 2, 3], "(1-3)"), ("nature", [], "[?]")]
)
def test_render(spark, name, ns, text):
    assert value(spark, num.render_numbers(F.array(*[F.lit(n) for n in ns]).cast("array<int>"), style(name))) == text


def test_render_labels_and_shape(spark):
    labels = F.array(F.lit("Smith, 2020"), F.lit("Doe, 2019"), F.lit("Smith, 2020"))
    assert value(spark, num.render_labels(labels, style("apa"))) == "(Smith, 2020; Doe, 2019)"
    followed = num.follow_document_shape(style("ieee"), F.lit(False))
    assert value(spark, num.render_numbers(F.array(F.lit(1), F.lit(2)), followed)) == "[1, 2]"


def test_digit_core(spark):
    assert tuple(value(spark, num.digit_core(F.lit("^1, 2-3.")))) == ("^", "1, 2-3", ".")


def test_styles_dimension(spark):
    assert num.styles(spark).count() == 19
