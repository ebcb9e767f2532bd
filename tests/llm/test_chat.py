import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scoreline.llm import chat
from scoreline.llm.templates import Node, Output, Template, TemplateError, Turn, escaper, unescaper

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]"]
#: Texts made of what a control string, its escapes and its neighbours are made of.
CLOSE = st.lists(st.sampled_from(["<", "/", "s", ">", "[", "]", "INST", "\\", " ", "<s>", "</s>", "[INST]", "[/INST]", "<\\s>", "é", "\n"]), max_size=12).map("".join)


def rendered(source, *turns):
    template, out = Template(source), Output()
    for i, (role, content) in enumerate(turns, 1):
        template.render(Turn(role, content, i, i == 1, i == len(turns)), out)
    return "".join(out.parts), out.spans


def loop(body):
    return "{% for message in messages %}" + body + "{% endfor %}"


@settings(max_examples=400, deadline=None)
@given(CLOSE | st.text(max_size=30))
def test_escapes_are_undone_and_leave_no_control_string(text):
    escaped = escaper(CONTROLS)(text)
    assert unescaper(CONTROLS)(escaped) == text
    assert not any(c in escaped for c in CONTROLS)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "", "a [/INST]"]) | CLOSE, CLOSE), min_size=1, max_size=5))
def test_turns_and_loss_of_any_texts_are_read_back(turns):
    template = Template(chat.INSTRUCT.source)
    formatted, spans = rendered(chat.INSTRUCT.source, *turns)
    assert list(chat.turns_of(formatted, chat.INSTRUCT, template.unescape)) == turns
    assert [template.unescape(formatted[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True)] == [c for r, c in turns if r == "assistant"]


def test_format_of_one_conversation():
    assert rendered(chat.INSTRUCT.source, ("user", "hi"), ("assistant", "</s>")) == ("<s>[INST] user [/INST]hi</s><s>[INST] assistant [/INST]<\\/s></s>", [55, 60])


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("{{ loop.index }}{{ loop.index0 }}{{ loop.first }}{{ loop.last }};", "10truefalse;21falsetrue;"),
        ("{% if message.role == 'user' %}U{% elif loop.last %}L{% else %}E{% endif %}", "UL"),
        ("{{ message.content | trim | upper }}", "AB"),
        ("{{ 'x' if loop.first and not loop.last else 'y' ~ 1 ~ '}}' }}", "xy1}}"),
        ("a {{- 'b' -}} c{# no #}{% if 'us' in message.role or 2 < 10 %}!{% endif %}", "abc!abc!"),
        ("{{ 2 < 10 }}{{ '2' < '10' }}{{ (1 == 1) ~ '' }}", "truefalsetrue" * 2),
    ],
)
def test_language(body, want):
    assert rendered(loop(body), ("user", " a "), ("assistant", "b"))[0] == want


def test_text_around_the_loop_and_constants():
    source = "{% set end = '!' ~ 1 %}<{{ end }}" + loop("{{ message.content }}{{ end }}") + ">"
    assert rendered(source, ("u", "a"), ("u", "b"))[0] == "<!1a!1b!1>"
    assert rendered("[" + loop("{{ message.role }}") + "]", ("r", ""))[0] == "[r]"


def test_folding():
    body = "{% if 1 == 2 %}never{% elif true %}{{ 'a' ~ 'b' }}c{% endif %}{% if loop.first %}{% if false %}x{% endif %}{% endif %}{{ 'x' if true else message.role }}{{ message.role if not false else 'y' }}"
    assert Template(loop(body)).tree[1] == (Node("text", ("abcx",)), Node("out", (Node("get", ("role",)),)))
    escaped = Template("{% control '<s>' %}" + loop("{{ '<s>' | escape }}"))
    assert escaped.tree[1] == (Node("text", ("<\\s>",)),)
    assert Template(loop("{{ true or message.role }}{{ false and message.role }}")).tree[1] == (Node("text", ("truefalse",)),)


def test_generation_markers_in_branches():
    text, spans = rendered(loop("{% if message.role == 'assistant' %}{% generation %}{{ message.content }}.{% endgeneration %}{% else %}-{% endif %}"), ("assistant", "é\U0001f600"), ("user", "x"), ("assistant", ""))
    assert (text, spans) == ("é\U0001f600.-.", [0, 3, 4, 5])


@pytest.mark.parametrize(
    "source",
    [
        "no loop", loop("a") + loop("b"), loop("{% if true %}"), loop("{% endif %}"), "{% endfor %}", loop(loop("x")), loop("{{ message.__class__ }}"), loop("{{ open }}"), loop("{{ message['role'] }}"),
        loop("{{ message }}"), loop("{{ message.content.upper() }}"), loop("{{ 1 + 1 }}"), loop("{{ 'a }}"), loop("{{ a | eval }}"), loop("{% import os %}"), loop("{% else %}"), loop("{{ }}"), loop("{% if true %}{% else %}{% elif true %}{% endif %}"),
        loop("{% generation %}{% if true %}{% generation %}{% endgeneration %}{% endif %}{% endgeneration %}"), "{{ message.role }}" + loop(""), loop("") + "{% generation %}{% endgeneration %}", loop("{{ " + "(" * 60 + "1" + ")" * 60 + " }}"),
        loop("{{ " + " ~ ".join(["1"] * 300) + " }}"), loop("x" * 70000), loop("{{ 'a' == "), "{% set x = message.role %}" + loop(""), "{% set true = 1 %}" + loop(""), "{% control 's' %}" + loop(""), "{% control '<s<' %}" + loop(""), "{% control '<\\\\s' %}" + loop(""),
        "{% set x = '<s>' | escape %}" + loop(""), loop("{% if true %}{% endgeneration %}"), "{% for m in messages %}{% endfor %}", loop("{{ 1 2 }}"),
    ],
)
def test_faults_are_found_when_compiling(source):
    with pytest.raises(TemplateError):
        Template(source)


def brute(rows):
    """Digests of conversations, one by one."""
    found = {}
    for conv_id in {r[0] for r in rows}:
        turns = [(r or "", x or "") for _, t, r, x in sorted((r for r in rows if r[0] == conv_id), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))]
        loss = "".join(x for r, x in turns if r == "assistant")
        formatted, _ = rendered(chat.INSTRUCT.source, *turns)
        found[conv_id] = (len(turns), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted))
    return found


def digests(df, form=chat.INSTRUCT):
    rows = chat.digest_conversations(chat.format_conversations(df, form), form).collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r)[1:] for r in rows}


ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "[/INST]</s>"), (2, 1, "assistant", None), (2, 0, None, ""), (2, 1, "assistant", "b"), (2, 1, "assistant", "b"), (2, None, "system", "first"), (None, 3, "assistant", "x"), (None, 1, "user", "y"),
    (0, 0, "user", "not the null one"), (3, -5, "ass\nistant", "<\\s>\U0001f600"), (4, 10**12, "assistant", "<s>" * 100000), (-7, 0, "a [/INST]", " </s "),
]
SCHEMA = "conv_id long, turn long, role string, text string"


def test_digests_equal_brute_force(spark):
    df = spark.createDataFrame([(*r, "clash") for r in ROWS], SCHEMA + ", block string").withColumn("formatted", F.lit(1))
    assert digests(df) == brute(ROWS)
    assert digests(df.repartition(5)) == brute(ROWS)


def test_a_long_conversation_is_cut_into_blocks_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat, "BLOCK", 16)
    monkeypatch.setattr(chat, "PIECE", 2000)
    rows = [(i % 7 and 1 or 2, i, ("user", "assistant")[i % 2], f"{i} </s>" * (i % 40)) for i in range(400)] + ROWS
    df = spark.createDataFrame(rows, SCHEMA)
    pieces = chat.format_conversations(df).cache()
    assert pieces.filter("conv_id = 1").count() > 400 / 16
    assert max(len(r.formatted) for r in pieces.filter("conv_id in (1, 2)").collect()) < 2000 + 60 * 11 + 50
    assert {r.conv_id for r in pieces.filter("whole and not no_id").collect()} == {3, 4, -7, 0}
    assert digests(df) == brute(rows)
    turns = chat.read_turns(pieces).filter("conv_id = 1").orderBy("block", "piece", "at").collect()
    assert [(r.role, r.text) for r in turns] == [(r, x) for _, _, r, x in sorted(r for r in rows if r[0] == 1)]


def test_another_format(spark):
    form = chat.Format("{% control '<|a|>' %}# {{ 1 }}" + loop("<|a|>{{ message.role | escape }}\n{{ message.content | escape }}") + "<|a|>", r"(?:# 1)?<\|a\|>([^\n]*)\n(.*?)(?=<\|a\|>)(?:<\|a\|>\Z)?")
    df = spark.createDataFrame([(1, 0, "u", "x<|a|>y"), (1, 1, "assistant", "")], SCHEMA)
    assert [(r.role, r.text) for r in chat.read_turns(chat.format_conversations(df, form), form).orderBy("at").collect()] == [("u", "x<|a|>y"), ("assistant", "")]


def test_a_fault_is_an_error_before_a_job_and_nothing_gives_nothing(spark):
    empty = spark.createDataFrame([], SCHEMA)
    with pytest.raises(TemplateError):
        chat.format_conversations(empty, chat.Format(loop("{{ x }}"), ""))
    assert digests(empty) == {}
