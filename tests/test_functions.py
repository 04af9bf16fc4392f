import pytest
from pyspark.sql import functions as F

from millrace.functions import answers, ids, records, text
from millrace.functions.json_repair import extract_json_object, json_fields


def column(spark, values, make, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(make(F.col("x"))).collect()]


def test_strip_all_white_space(spark):
    assert column(spark, ["\t a b \n", " x　", None], text.strip) == ["a b", "x", None]


def test_normalize_text(spark):
    values = ["Find \\left(x\\right) at http://a.b/c?d now", "\\leftarrow x", None, "", "é 见 A_B"]
    assert column(spark, values, text.normalize_text) == ["find x at now", "arrow x", "", "", "见 a b"]


def test_shingles(spark):
    got = column(spark, ["a b c d e f", "a b", "", None, "a a a a a a a"], lambda c: F.array_join(text.shingles(c), "|"))
    assert got == ["a b c d e|b c d e f", "a b", "", "", "a a a a a"]


def test_text_only(spark):
    assert column(spark, ["see figure 1", "见figure 1", "figures", "a ![p](q)", "http://x/y.JPG", None], text.is_text_only) == [False, True, True, False, False, True]


def test_extract_boxed(spark):
    values = [r"so \boxed{\frac{1}{2}}.", r"\boxed{1} then \boxed{2", r"\boxed{ a } \boxed{b{c}d} e", "none", None, r"\boxed{}", r"\boxed{\{24t\mid t\in\mathbb{Z}\}}"]
    assert column(spark, values, answers.extract_boxed) == [r"\frac{1}{2}", None, "b{c}d", None, None, "", r"\{24t\mid t\in\mathbb{Z}\}"]


def test_answers(spark):
    df = spark.createDataFrame([(r"\dfrac{1}{2}", r"\frac{1}{2}"), (" $3$. ", "3"), ("", ""), (None, "1"), ("4", "3")], "a string, b string")
    assert [r[0] for r in df.select(answers.answer_matches("a", "b")).collect()] == [True, True, False, False, False]
    assert column(spark, ["false", "TRUE", "maybe", None, " 1 "], answers.parse_bool) == [False, True, None, None, True]
    assert column(spark, ["proof", " ", "-", "7", None, "\\pi"], answers.is_parseable) == [False, False, False, True, False, True]
    assert column(spark, [r"\boxed{137/2}", r"\boxed{3}", "no", None], lambda c: answers.compute_score(c, F.lit("137/2"))) == [1.0, 0.0, 0.0, 0.0]
    gated = spark.createDataFrame([(True,), (False,), (None,)], "v boolean").select(answers.gated_score(F.lit(r"\boxed{1}"), F.lit("1"), "v"))
    assert [r[0] for r in gated.collect()] == [1.0, 0.0, 1.0]
    assert column(spark, ["valid", "odd", None], answers.verdict_kind) == ["valid", "other_invalid", "other_invalid"]
    assert column(spark, [" invalid ", "x", None], answers.declared_invalid) == [True, False, False]


def test_ids(spark):
    import hashlib

    df = spark.createDataFrame([("a", 1), (None, 2)], "x string, n int")
    got = df.select(ids.stable_id("p", "x", "n"), ids.seed31("x", "n")).collect()
    for (made, seed), raw in zip(got, ["a\x1f1", "None\x1f2"]):
        digest = hashlib.sha256(raw.encode()).digest()
        assert made == "p_" + digest.hex()[:16] and seed == int.from_bytes(digest[:4], "big") & 0x7FFFFFFF


@pytest.mark.parametrize(
    "reply, key, value",
    [
        ('```json\n{"ok": true}\n```', "ok", True),
        ('{"p": "Find \\frac{1}{2} and \\(x+1\\)."}', "p", "Find \\frac{1}{2} and \\(x+1\\)."),
        ('text {"p": "a\\nb", "q": "\\qquad"} more', "q", "\\qquad"),
        ('{"p": "\\nabla"}', "p", "\nabla"),
        ('{"p": "\\\\frac"}', "p", "\\frac"),
    ],
)
def test_json_repair(reply, key, value):
    assert extract_json_object(reply)[key] == value


@pytest.mark.parametrize("reply", ["", "no object", "[1]", '{"a": ', '{"a": b}'])
def test_json_failures(reply):
    with pytest.raises(ValueError):
        extract_json_object(reply)


def test_json_fields(spark):
    got = spark.createDataFrame([('{"a": 1, "b": null}',), (None,), ("x",)], "r string").select(json_fields(F.col("r"), ["a", "b"]).alias("v")).select("v.ok", "v.a", "v.b").collect()
    assert [tuple(r) for r in got] == [(True, "1", None), (False, None, None), (False, None, None)]


def test_fill_and_prompt(spark):
    assert column(spark, ["P", None], lambda c: records.fill("a {x} {{b}}", x=c)) == ["a P {b}", "a None {b}"]
    wrapped = [([(f"{records.POOL_PREFIX}\n\nQ?\n\n{records.POOL_SUFFIX}",)],), ([],), (None,)]
    df = spark.createDataFrame(wrapped, "prompt array<struct<content: string>>")
    assert [r[0] for r in df.select(records.unwrapped_prompt("prompt")).collect()] == ["Q?", "", ""]


def test_last_step_of_json_repair():
    tolerant = lambda t: {"a": "b"} if "b}" in t else None
    assert extract_json_object('{"a": b}', tolerant) == {"a": "b"}
    with pytest.raises(ValueError):
        extract_json_object('{"a": }', tolerant)
    with pytest.raises(ValueError):
        extract_json_object('{"a": c}', lambda t: 1 / 0)


def test_word_boundary_after_a_command():
    assert extract_json_object('{"a": "\\frac1"}')["a"] == "\x0crac1" and extract_json_object('{"a": "\\fracé"}')["a"] == "\x0cracé"


def test_fields_read_by_the_engine_and_by_python(spark):
    replies = ['{"a": "x", "b": 12, "c": true}', ' {"a":"x","b":null}\n', '{"a": 1.50}', '{"a": [1, 2]}', '{"a": "x", "a": "y"}', '{"a": "x"} {"a": "y"}', '{"a": 01}', '{"a": "\\frac{1}{2}"}', '```json\n{"a": "z"}\n```', '{"a": "tab\there"}', "{'a': 'x'}", "{}", ""]
    got = [tuple(r) for r in spark.createDataFrame([(r,) for r in replies], "r string").select(json_fields(F.col("r"), ["a", "b", "c"]).alias("v")).select("v.ok", "v.a", "v.b", "v.c").collect()]
    for reply, row in zip(replies, got):
        try:
            v = extract_json_object(reply)
            text = lambda x: None if x is None else x if isinstance(x, str) else __import__("json").dumps(x)
            assert row == (True, *(text(v.get(k)) for k in "abc")), reply
        except ValueError:
            assert row == (False, None, None, None), reply


def test_a_zero_says_nothing(spark):
    assert column(spark, [0, 1, 7, None], answers.normalize_answer, "int") == ["", "1", "7", ""]
    assert column(spark, [0, 1, 2], answers.parse_bool, "bigint") == [None, True, None]
    assert column(spark, [0.0, 1.5], answers.normalize_answer, "double") == ["", "1.5"]
    assert column(spark, [True, False, None], answers.parse_bool, "boolean") == [True, False, None]
    assert column(spark, ["0", "0.0"], answers.normalize_answer) == ["0", "0.0"]


def test_other_equalities(spark):
    def symbolic(a, b):
        value = lambda x: __import__("fractions").Fraction(x)
        return a.map(value) == b.map(value)

    df = spark.createDataFrame([("1/2", "2/4"), ("1/2", "1/2"), ("1/3", "2/4"), (None, "1"), ("1", None)], "a string, b string")
    assert [r[0] for r in df.select(answers.answer_matches("a", "b", symbolic)).collect()] == [True, True, False, False, False]
    scored = df.select(answers.compute_score(F.concat(F.lit("\\boxed{"), "a", F.lit("}")), "b", symbolic))
    assert [r[0] for r in scored.collect()] == [1.0, 1.0, 0.0, 0.0, 0.0]
