from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from framelake.llm.chat import CONTROLS, TEMPLATE, escape, format_conversations, read_back, read_formatted, unescape
from framelake.llm.template import Const, Emit, TemplateError, compile_template, fold, parse

PIECES = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "/", "INST]", "s>", " ", "é", "\n", "ok"]), max_size=8).map("".join)


@given(PIECES)
def test_escape_is_reversible_and_hides_marks(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROLS)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "[ROLE]"]), PIECES), max_size=6))
def test_round_trip(turns):
    out = compile_template(TEMPLATE, {"escape": escape})({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert read_back(out.text) == turns
    assert [unescape(out.text[a:b]) for a, b in out.spans] == [t for r, t in turns if r == "assistant"]


def test_table(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, 1, "user", "</s>"), (None, None, "assistant", "x"), (3, 0, "user", "same"), (3, 0, "user", "same")]
    rows += [(7, i, "assistant", f"t{i}") for i in range(50, 0, -1)]  # one conversation holds most rows
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn int, role string, text string, formatted int")
    found = {r["conv_id"]: r for r in read_formatted(format_conversations(table)).collect()}
    assert {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in found.items()} == {
        1: [("user", "a"), ("assistant", "b")],
        2: [("", ""), ("user", "</s>")],
        3: [("user", "same")] * 2,
        7: [("assistant", f"t{i}") for i in range(1, 51)],
        None: [("assistant", "x")],
    }
    assert found[7]["loss_text"] == "".join(f"t{i}" for i in range(1, 51))
    assert format_conversations(table.limit(0)).count() == 0


def test_language():
    show = lambda source, **v: compile_template(source)(v).text
    assert show("{% for x in xs %}{{ loop.index }}{{ x.a ~ '!' }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=[{"a": 1}, {"a": 2}]) == "11!, 22!"
    assert show("{% set n = 2 * 3 + xs | length %}{% if n == 8 and 'a' in xs %}{{ n }}{% elif n %}x{% else %}y{% endif %}", xs=["a", "b"]) == "8"
    assert show("a {{- ' b ' | trim -}} c{{ none }}{{ true }}{{ xs[-1] }}{{ missing | default('d') }}", xs=[1, 2]) == "abctrue2d"
    assert show('{{ "q\\"\\n" }}{{ [1, 2][1] - -1 }}{{ 7 // 2 % 2 }}') == 'q"\n31'


def test_folding():
    assert fold(parse("a{{ 'b' ~ 1 + 2 }}{% if 1 > 2 %}c{% else %}d{% endif %}"), {}) == (Emit(Const("ab3d")),) or fold(parse("a{{ 'b' ~ 'c' }}{% if 1 > 2 %}c{% else %}d{% endif %}"), {}) == (Emit(Const("abcd")),)
    assert fold(parse("{% if true or x %}a{% endif %}"), {}) == (Emit(Const("a")),)


@pytest.mark.parametrize("source", ["{% if x %}", "{{ x", "{{ 1 + }}", "{% for x %}{% endfor %}", "{{ x() }}", "{% import os %}", "{{ x.__class__.y }}", "{{ x | nothing }}"])
def test_refused(source):
    with pytest.raises((TemplateError, AssertionError)):
        out = compile_template(source)({"x": "text"})
        assert out.text != source
