from __future__ import annotations

import pytest

from framelake.functions.fraction import Fraction
from framelake.script.columns import compile_expression
from framelake.script.language import Interpreter, ScriptError


@pytest.fixture
def script():
    i = Interpreter()
    i.run("declare tn = Script.TypeName, ts = Script.ToString, to = Script.TestOverloading;")
    return i


@pytest.mark.parametrize(
    ("text", "kind"),
    [("7", "int"), ("0x90000000", "long"), ("2.5", "double"), ("7 + 0x90000000", "long"), ("7 * 2.5", "double"), ("~0x90000000", "long"), ("!0x90000000", "int"), ("-2.5", "double"), ('"a" + 1', "string"), ("(int)2.5", "int"), ("(long)2", "long"), ("(double)3 / 2", "double"), ("2.5 < 3", "int")],
)
def test_types(script, text, kind):
    assert script.run(f"tn({text});") == kind


@pytest.mark.parametrize(
    ("text", "value"),
    [("1 + 2 * 3 - 4 / 3", 6), ("-7 / 2", -3), ("-7 % 3", -1), ("7 & 3 | 8 ^ 1", 11), ("1 < 2 == 1", 1), ("0 || 3 && 2", 1), ("ts(0.1 + 0.2)", "0.3"), ("ts((int)1.9)", "1"), ("ts((int)0x80000000)", "-2147483648"), ('"a" + 1.5 + 7', "a1.57"), ("010 + 0x10", 24), ('Script.Atoi("0x1F") + Script.Atoi("-012")', 21), ("2147483647 + 1", -2147483648), ('u"a\\n"', "a\\n"), ('"\\x41\\n"', "A\n")],
)
def test_values(script, text, value):
    assert script.run(f"{text};") == value


def test_overloads(script):
    calls = ["", "1", "0x90000000", "1.0", "1, 1", "1, 0x90000000", "1, 1.0", "0x90000000, 1", "0x90000000, 0x90000000", "0x90000000, 1.0", "1.0, 1", "1.0, 0x90000000", "1.0, 1.0", "1, 2, 3"]
    assert [script.run(f"to({c});") for c in calls] == list(range(1, 15))


def test_statements(script):
    assert script.run("declare a = 3, b; // a comment\nb = a = a + 1; a + b;") == 8


@pytest.mark.parametrize("text", ["1 / 0;", "1 +;", "nothing;", "1", "to(;", 'Script.Assert("x");', "Script.Assert(0);", '"a" - 1;', "1 = 2;", "ts.x;", "declare 1;", "x" * 65 + ";", 'Script.Atoi("1x");'])
def test_errors(script, text):
    with pytest.raises(ScriptError):
        script.run(text)


def test_columns_agree_with_the_interpreter(spark):
    texts = ["a * 3 + b / 4 - a % 5", "a ^ b & 7 | 1", "a > b && b != 3 || !a", "~a + -b", "(a + 1) / 2 == b"]
    rows = [(a, b) for a in range(-6, 7, 3) for b in range(-5, 6, 2)]
    found = spark.createDataFrame(rows, "a long, b long").select("a", "b", *(compile_expression(t).alias(f"c{i}") for i, t in enumerate(texts))).collect()
    for r in found:
        i = Interpreter()
        for k, t in enumerate(texts):
            assert r[f"c{k}"] == i.run(f"declare a = {r['a']}, b = {r['b']}; {t};")


def test_fractions():
    assert Fraction(1, 1) * Fraction(2, 3) == Fraction(2, 3) and Fraction(3, 1) * Fraction(2, 3) == Fraction(2)
    assert Fraction(0xF0000000, 0x08000000) == Fraction(30)
    f, g = Fraction(1, 30), Fraction(30)
    for v, modes in ((10**13, (333333333333, 333333333333, 333333333334)), (2 * 10**13, (666666666667, 666666666666, 666666666667)), (3 * 10**13, (10**12,) * 3)):
        assert tuple(f.scale(v, m) for m in ("round", "trunc", "up")) == modes
        assert tuple(g.inverse().scale(v, m) for m in ("round", "trunc", "up")) == modes
    assert [Fraction(1, 2).scale(-3, m) for m in ("round", "trunc", "up")] == [-2, -1, -1]
