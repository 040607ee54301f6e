"""Column functions on hand-made cases."""

import pytest
from pyspark.sql import functions as F

from corvid.functions import judge as J
from corvid.functions import messages as M
from corvid.functions import names as N
from corvid.functions import text as X


def each(spark, values, *columns, ddl="i int, x string"):
    df = spark.createDataFrame(list(enumerate(values)), ddl).repartition(2)
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


def test_think_reason(spark):
    cases = {"plain": None, "<think>a</think>b": None, "<think>a": "unclosed_think_tag", "a</think>": "orphaned_close_tags", "<think>a</think>b</think>": "extra_close_tags", "<think><think>a</think>": "multiple_open_tags_2", "</think><think>": "think_tags_wrong_order", "": None}
    assert [r[0] for r in each(spark, cases, X.think_reason(F.col("x")))] == list(cases.values())


def test_sample_reason(spark):
    cases = {
        " <think>a</think>b ": None, "b": "missing_think_tag", "<think>a<think></think>b": "multiple_open_tags_2", "<think>a": "unclosed_think_tag",
        "<think>a</think>b</think>": "multiple_close_tags_2", "<think> \u00a0</think>b": "empty_thinking", "<think>a</think>\n": "empty_response",
    }
    assert [r[0] for r in each(spark, cases, X.sample_reason(F.col("x")))] == list(cases.values())


def test_strip_and_extract(spark):
    cases = {
        "<think>a\nb</think>\n c ": ("c", "a\nb", "c"), "no tags ": ("no tags", "", "no tags"), "a</think> b": ("b", "", "a</think> b"),
        "<think>open": ("open", "", "<think>open"), "x<think>1</think>y<think>2</think>z": ("xyz", "1", "y<think>2</think>z"),
    }
    x = F.col("x")
    assert each(spark, cases, X.strip_thinking(x), X.thinking(x), X.response(x)) == list(cases.values())
    twice = each(spark, cases, X.strip_thinking(X.strip_thinking(x)))
    assert [r[0] for r in twice] == [v[0] for v in cases.values()]


def test_py_strip(spark):
    values = ["\x1c\x85 a\n", "\u2003b\u00a0", "", " \t ", "a b"]
    assert [r[0] for r in each(spark, values, X.py_strip(F.col("x")))] == [v.strip() for v in values]


def test_normalize_content(spark):
    cases = {
        '"hello"': "hello", '[{"type":"thinking","thinking":"t"},{"type":"text","text":"r"}]': "<think>t</think>r", '[{"text":"only"}]': "only",
        "[]": "", "null": "", '[{"type":"image","url":"u"}]': '{"type":"image","url":"u"}', "12": "12",
    }
    assert [r[0] for r in each(spark, cases, X.normalize_content(F.col("x")))] == list(cases.values())


def test_mc_answer(spark):
    cases = {
        " B ": "B", "Answer: A then Answer: c": "C", "**Answer:** D": "D", r"so \boxed{ B }": "B", "the answer is d": "D", "the answer is (a)": "A", "x\nC) because": "C",
        "b is the correct answer": "B", "I pick C": "C", "It is D . sure": "D", "nothing": None, "Answer: E": None, "": None,
    }
    got = [r[0] for r in each(spark, cases, X.mc_answer(F.col("x")))]
    assert got == list(cases.values())


def test_provider_reasoning(spark):
    cases = {
        '{"reasoning":" a "}': " a ", '{"reasoning":" ","reasoning_content":"b"}': "b", '{"choices":[{"message":{"reasoning":"c"}}]}': "c",
        '{"reasoning":7}': None, '{"choices":[]}': None, "not json": None,
    }
    assert [r[0] for r in each(spark, cases, X.provider_reasoning(F.col("x")))] == list(cases.values())


def test_think_html_round_trip(spark):
    values = ["a<think>x < y & z</think>b", "none", "<think>1</think><think>2</think>"]
    x = F.col("x")
    got = each(spark, values, X.strip_think_formatting(X.format_think_tags(x)), X.format_think_tags(x))
    assert [r[0] for r in got] == values and "x &lt; y &amp; z" in got[0][1]


def test_xml_and_scores(spark):
    cases = {
        "<score>7</score>": (7, None), "<a><score>3</score></a>": (3, None), "<score>2-4</score>": (2, None), "<score>high</score>": (None, "Non-numeric score: high"),
        "none": (None, "No score found"), "<score>1</score><score>0</score>": (0, None), "<aria-shapedness>5</aria-shapedness>": (5, None), "<score>true</score>": (None, "Non-numeric score: true"),
    }
    e = J.xml_entries(F.col("x"))
    assert each(spark, cases, J.score_of(e), J.score_error(e)) == list(cases.values())


def test_assessment_fields(spark):
    text = "<analysis></analysis><impression>fine</impression><needs-review>TRUE</needs-review><score>4</score><own-field> z </own-field>"
    a = each(spark, [text], J.assessment(J.xml_entries(F.col("x"))))[0][0]
    assert (a.score, a.analysis, a.needs_review, a.errors, a.extra) == (4, "fine", True, "", {"own_field": "z"})
    v = each(spark, ["<score>5</score>", "<score>0</score>", "x"], J.judge_verdict(J.assessment(J.xml_entries(F.col("x"))), 5))
    assert [(r[0].score, r[0].correct) for r in v] == [(5.0, True), (0.0, None), (None, None)]


def test_xml_any_depth(spark):
    deep = "<a>" * 3 + "<b><c><d><e>1</e></d></c></b>" + "</a>" * 3
    assert each(spark, [deep, None], J.xml_fields(F.col("x"))) == [({"e": "1"},), (None,)]


def test_message_functions(spark):
    ddl = "i int, x array<struct<role:string,content:string>>"
    rows = [[("user", "u")], [("system", "s"), ("user", "u"), ("assistant", "a"), ("assistant", "b")], [], None]
    x = F.col("x")
    got = each(spark, rows, M.inject_system(x, F.lit("p")), M.is_multi_turn(x), M.last_assistant(x), M.or_prompt(x, F.lit("q")), ddl=ddl)
    assert [m.role for m in got[0][0]] == ["system", "user"] and len(got[1][0]) == 4
    assert [r[1] for r in got] == [False, True, False, False]
    assert [r[2] for r in got] == [None, 3, None, None]
    assert got[3][3][0].content == "q" and got[2][3][0].role == "user"


def test_chat_row_error(spark):
    ddl = "i int, x array<struct<role:string,content:string>>"
    rows = [[("user", "u"), ("assistant", "a")], [], [("judge", "x")], [("user", None)], [("user", "u")], None]
    got = [r[0] for r in each(spark, rows, M.chat_row_error(F.col("x")), ddl=ddl)]
    assert got[0] is None and "non-empty" in got[1] and "invalid role judge" in got[2] and "string content" in got[3] and "assistant" in got[4] and "non-empty" in got[5]


def test_sample_validity_first_reason(spark):
    ddl = "i int, x array<struct<role:string,content:string>>"
    rows = [[("user", "u")], [("assistant", "<think>a</think>b"), ("assistant", "no"), ("assistant", "<think>")], [("assistant", None)]]
    assert [r[0] for r in each(spark, rows, M.sample_validity(F.col("x")), ddl=ddl)] == [None, "missing_think_tag", None]


def test_names(spark):
    ids = ["batch-20260105-152748-6e65", "manual-id-of-a-run", "x"]
    assert [r[0] for r in each(spark, ids, N.short_id(F.col("x")))] == ["0105-6e65", "manual-id-of", "x"]
    assert [r[0] for r in each(spark, ["0105-6e65", "0105-6E6g", "105-6e65"], N.is_short_id(F.col("x")))] == [True, False, False]
    specs = each(spark, ["b", "b::r", "b::r::tinker://p"], N.checkpoint_spec(F.col("x")))
    assert [tuple(s[0]) for s in specs] == [("b", "qwen3", None), ("b", "r", None), ("b", "r", "tinker://p")]
    with pytest.raises(Exception, match="Invalid checkpoint spec"):
        each(spark, ["a::b::c::d"], N.checkpoint_spec(F.col("x")))
    assert [r[0] for r in each(spark, ["usnloth", " Prime-Intellect", "", "zzz", None], N.backend(F.col("x")))] == ["unsloth", "prime", "tinker", None, "tinker"]
    assert [r[0] for r in each(spark, ["id-v0.9-full", "x"], N.version_of_alias(F.col("x")))] == ["v0.9", None]
    assert [r[0] for r in each(spark, ["a/B", "c"], N.organization(F.col("x")))] == ["a", "unknown"]
    assert [r[0] for r in each(spark, ["E001-final", "gpt"], N.output_name(F.col("x"), F.lit("ev")))] == ["E001", "ev"]


def test_numbers(spark):
    got = each(spark, ["0"], N.progress(F.lit(4), F.lit(0)), N.progress(F.lit(4), F.lit(10)), N.normalized_grad(F.lit(6.0), F.lit(9)), N.normalized_grad(F.lit(6.0), F.lit(0)), N.validation_loss(F.lit(0.0), F.lit(2.0)), N.correct_estimate(F.lit(0.5), F.lit(3)))
    assert got == [(0.0, 0.5, 2.0, 6.0, 2.0, 2)]
