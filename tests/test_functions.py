import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyforge.functions import choice, confidence, latex, numbers


def apply(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    return [r[0] for r in df.select(column.alias("x"), "i").orderBy("i").select("x").collect()]


def test_last_number(spark):
    cases = {"so #### 1,200": "1,200", "#### 5 then #### 7.": "7.", "#### -3": "-3", "#### $18": None, "#### 1.2.3": "1.2.3", "none": None, "": None}
    assert apply(spark, [(k,) for k in cases] + [(None,)], "t string", numbers.last_match(F.col("t"))) == [*cases.values(), None]
    assert apply(spark, [("#### $18",), ("#### \\boxed{1,250}",)], "t string", numbers.last_match(F.col("t"), numbers.FINAL_NUMBER_LENIENT)) == ["18", "1,250"]


def test_parse_number(spark):
    cases = {"1,200": 1200.0, "7.": 7.0, "-3": -3.0, "1.2.3": None, "50%": 0.5, "1d": None, "3F": None, "0x1p3": None, "1_000": 1000.0, "1__0": None, " 4 2 ": 42.0, "1e3": 1000.0, "": None, "%": None, "inf": math.inf, "-Infinity": -math.inf}
    assert apply(spark, [(k,) for k in cases] + [(None,)], "t string", numbers.parse_number(F.col("t"))) == [*cases.values(), None]


def test_close(spark):
    cases = [(1.0, 1.00009, True), (1.0, 1.0002, False), (1e-7, 0.0, True), (1e-5, 0.0, False), (None, 1.0, False), (1.0, None, False), (math.nan, math.nan, False), (math.inf, math.inf, True), (math.inf, 1.0, False), (math.inf, -math.inf, False)]
    assert apply(spark, [c[:2] for c in cases], "a double, b double", numbers.close(F.col("a"), F.col("b"))) == [c[2] for c in cases]


@settings(max_examples=25, deadline=None)
@given(values=st.lists(st.tuples(st.floats(-1e6, 1e6), st.floats(-1e6, 1e6)), min_size=1, max_size=30))
def test_close_is_as_isclose(spark, values):
    own = apply(spark, values, "a double, b double", numbers.close(F.col("a"), F.col("b")))
    assert own == [abs(a) < 1e-6 if b == 0 else math.isclose(a, b, rel_tol=1e-4) for a, b in values]


@pytest.mark.parametrize("text, box", [("\\boxed{5}", "5"), ("\\boxed{1} \\boxed{\\frac{1}{2}}", "\\frac{1}{2}"), ("\\boxed{a{b{c}}}", "a{b{c}}"), ("\\boxed{1} \\boxed{2", "1"), ("\\boxed{}", ""), ("none", None), (None, None), ("\\boxed{2 \\boxed{3}", None), ("\\boxed{ x }", "x")])
def test_boxed(spark, text, box):
    assert latex.last_box(text) == box
    assert apply(spark, [(text,)], "t string", latex.boxed_answer(F.col("t"))) == [box]


def test_normal_form(spark):
    cases = {"\\frac{1}{2}": "(1)/(2)", "\\text{cm}": "cm", "\\sqrt[3]{x}": "(x)**(1/(3))", "x^{10}": "x**(10)", "x^2": "x**2", "3\\pi": "3pi", "2\\cdot 3": "2* 3", "$5$": "5", "\\rightarrow": "arrow", "a\\,b": "ab"}
    assert apply(spark, [(k,) for k in cases], "t string", latex.normal_form(F.col("t"))) == list(cases.values())


def test_math_match(spark):
    cases = [("1,000", "1000", True), ("\\frac{1}{2}", "0.5", True), ("\\text{red}", "red", True), ("x+x", "2x", True), ("(x+1)^2", "x^2+2x+1", True), ("\\sqrt{8}", "2\\sqrt{2}", True), ("x", "y", False), ("2", "3", False), (None, "1", False), ("1/0", "5", False), ("__import__('os')", "0", False)]
    assert apply(spark, [c[:2] for c in cases], "a string, b string", latex.math_match(F.col("a"), F.col("b"))) == [c[2] for c in cases]


def test_choice(spark):
    cases = {
        "The answer is B": ("B", "B"), "answer is A. No, answer is C": ("A", "C"), "I choose a dog": ("A", "A"), "answer is definitely B": ("D", "D"), "answer depends": (None, "D"), "E": (None, "E"), "": (None, None), "B) it is so": ("B", "B"), "so\nC\n": ("C", "C"),
    }
    rows = [(k,) for k in cases]
    assert apply(spark, rows, "t string", choice.first_choice(F.col("t"))) == [v[0] for v in cases.values()]
    assert apply(spark, rows, "t string", choice.last_choice(F.col("t"))) == [v[1] for v in cases.values()]
    strict = apply(spark, [("I choose a dog",), ("answer is definitely B",), ("answer depends",), ("E",)], "t string", choice.last_choice(F.col("t"), strict=True))
    assert strict == [None, "B", None, "E"]
    assert apply(spark, [("b",), ("A\n",), ("AB",), ("7",)], "t string", choice.answer_type(F.col("t"))) == ["multiple_choice", "free_text", "free_text", "free_text"]
    assert apply(spark, [("1",), ("4",), ("E",), ("x",), (None,)], "t string", choice.normal_label(F.col("t"))) == ["A", "D", "E", "x", None]


def test_wording(spark):
    cases = {"": 0.0, "yes": 0.55, "it is clearly four": 0.85, "maybe it is four": 0.725, "maybe, it is four": 0.85, "   ": 0.55}
    found = apply(spark, [(k,) for k in cases] + [(None,)], "t string", confidence.from_wording(F.col("t")))
    assert found == pytest.approx([*cases.values(), 0.0])


def test_logprobs(spark):
    half = math.log(0.5)
    rows = [([],), ([{"a": 0.0}],), ([{"a": half, "b": half}],), ([{}, {"a": 0.0}],), (None,)]
    assert apply(spark, rows, "p array<map<string,double>>", confidence.from_logprobs(F.col("p"))) == pytest.approx([0.0, 1.0, 0.5, 1.0, 0.0])
    assert apply(spark, rows, "p array<map<string,double>>", confidence.from_logprobs(F.col("p"), "entropy")) == pytest.approx([0.0, 1.0, 0.0, 1.0, 0.0], abs=1e-6)
    with pytest.raises(ValueError):
        confidence.from_logprobs(F.col("p"), "other")
