"""Operator 2: the template language, the escape, and the query against its SQL."""

import pytest

from marginalia.llm import chat, templates
from marginalia.llm.queries import QUERIES, TRICKY
from marginalia.llm.templates import TemplateError, compile_template, fold, parse
from tests.compare import database, difference
from tests.conftest import DATA


def render(source, **names):
    return compile_template(source)(names)[0]


@pytest.mark.parametrize("source,names,wanted", [
    ("a{{ x }}b", {"x": 1}, "a1b"),
    ("{{ x.y[0] | upper }}", {"x": {"y": ["q"]}}, "Q"),
    ("{% if x == 'a' %}1{% elif x == 'b' %}2{% else %}3{% endif %}", {"x": "b"}, "2"),
    ("{% for i in xs %}{{ loop.index }}:{{ i }}{% if not loop.last %}, {% endif %}{% endfor %}", {"xs": ["p", "q"]}, "1:p, 2:q"),
    ("  {%- set y = 1 + 2 * 3 -%}  {{ y }}", {}, "7"),
    ("{{ 'yes' if 'a' in x else 'no' }}", {"x": ["a"]}, "yes"),
    ("{{ x | default('none') }}{{ y }}", {"x": None}, "none"),
    ("{# remark #}{{ -3 + 1 }} {{ true and not false }}", {}, "-2 true"),
    ("{{ \"a\\n\" ~ 1 }}", {}, "a\n1"),
    ("{{ x.missing.deeper }}", {"x": {}}, ""),
    ("{% set n = 1 %}{% for i in xs %}{% set n = 2 %}{% endfor %}{{ n }}", {"xs": [1]}, "1"),
])
def test_rendering(source, names, wanted):
    assert render(source, **names) == wanted


@pytest.mark.parametrize("source", ["{% if x %}", "{{ }}", "{{ 1 + }}", "{% frob %}", "{{ x | nothere }}", "{{ (1 }}", "{{ a b }}", "{% for in x %}{% endfor %}",
                                    "{% if a %}" * 60 + "{% endif %}" * 60])
def test_errors(source):
    with pytest.raises(TemplateError):
        compile_template(source)


def test_sandbox():
    """A member is a key or an index, never an attribute of a Python value, and nothing but filters is called."""
    assert render("{{ x.__class__ }}{{ x['__class__'] }}{{ x.upper }}", x="s") == ""
    with pytest.raises(TemplateError):
        compile_template("{{ x.upper() }}")
    with pytest.raises(TemplateError):
        render("{% for c in 9 %}{% endfor %}")
    with pytest.raises(TemplateError):
        render("{{ x * 3 }}", x="long")


def test_folding():
    body = fold(parse("a{{ 1 + 1 }}b{% if true and 1 < 2 %}c{% else %}{{ x }}{% endif %}{{ 'q' | upper }}"), templates.FILTERS)
    assert body == (templates.Text("a2bcQ"),)
    assert fold(parse("{{ 'no' if false else x }}"), templates.FILTERS) == (templates.Value(templates.Name("x")),)
    assert len(fold(parse("{% if x %}a{% endif %}b"), templates.FILTERS)) == 2
    # What fails is left to fail when it is rendered.
    assert render("{% if x %}{{ 1 + 'a' }}{% endif %}", x=False) == ""


def test_generation_spans_are_code_points():
    text, spans = compile_template("é{% generation %}🙂{{ x }}{% endgeneration %}!")({"x": "ab"})
    assert text == "é🙂ab!" and [text[a:b] for a, b in spans] == ["🙂ab"]


@pytest.mark.parametrize("text", ["", "\\", "###", "</turn>", TRICKY, "\\\\###</turn>\\", "####</turn", "a: b\n### x: y</turn>\n", "\\n"])
def test_escape_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    made = chat._renderer(chat.TURN_TEMPLATE)({"messages": [{"role": text, "text": text}, {"role": "assistant", "text": text}]})
    assert chat.read_turns(made[0]) == [(text, text), ("assistant", text)]
    assert [chat.unescape(made[0][a:b]) for a, b in made[1]] == [text]


def test_other_template(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    row = chat.format_conversations(turns, "{% for m in messages %}<{{ m.role }}>{% generation %}{{ m.text }}{% endgeneration %}{% endfor %}").first()
    assert row.text == "<user>hi<assistant>yo" and [(s.start, s.stop) for s in row.spans] == [(6, 8), (19, 21)]


def test_query(spark):
    query, sql = QUERIES["op2_chat_format"]
    assert difference(spark, database(DATA), DATA, query, sql) is None
    row = query(spark, DATA).filter("conv_id = -7").first()
    assert row.n_turns == 2 and row.loss_chars == len(TRICKY)
