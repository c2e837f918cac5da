import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from causeway.llm import chat_template as ct
from causeway.llm.queries import op8_chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, spans string"
PIECES = st.lists(st.sampled_from(["###", "</turn>", "\\", "</tur", "n>", "#", ":", "\n", "### assistant:\n", "a", "é", " "]), max_size=8)


def test_language_of_templates():
    def render(source, **values):
        return ct.Template(source).render(**values)

    assert render("a{{ x }}{{ none }}b", x="1")[0] == "a1b"
    assert render("{% for m in l %}{{ m.n | upper }},{% endfor %}", l=[{"n": "x"}, {"n": "y"}, {}])[0] == "X,Y,,"
    assert render("{% if a == 'x' and not b %}1{% elif b %}2{% else %}3{% endif %}", a="x", b=True)[0] == "2"
    assert render("{% set y = x ~ '!' %}{{ y | length }}{{ 'q\\n\\'' }}", x="ab")[0] == "3q\n'"
    assert render("{{ ('a' in ['a', 'b']) or x }}{{ 1 + 2 }}")[0] == "True3"
    assert render("x{% generation %}{{ t }}{% endgeneration %}y{% generation %}{% endgeneration %}", t="abc") == ("xabcy", [(1, 4), (5, 5)])


def test_constants_are_folded():
    assert ct.Template("a{{ 'b' | upper }}{% if 1 == 2 %}no{% else %}{{ 1 + 1 }}{% endif %}").tree == [
        ("write", ("constant", "aB")), ("write", ("constant", "2"))]
    assert ct.Template("{% if x or true %}a{% endif %}").tree[0][0] == "if"
    assert ct.Template("{% if true or x %}a{% endif %}").tree == [("write", ("constant", "a"))]


@pytest.mark.parametrize("source", [
    "{{ x.__class__ }}", "{{ _x }}", "{{ f(x) }}", "{% for x in %}{% endfor %}", "{% if x %}", "{% endfor %}", "{{ x | eval }}",
    "{{ x. }}", "{{ 'a }}", "{% import os %}", "{{ x + }}", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}"])
def test_nothing_else_is_accepted(source):
    with pytest.raises(ct.TemplateError):
        ct.Template(source)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), PIECES.map("".join)), st.one_of(st.text(max_size=20), PIECES.map("".join))),
                max_size=5))
def test_round_trip(turns):
    text, spans = ct.Template().render(messages=[{"role": r, "text": t} for r, t in turns])
    assert ct.read_back(text) == turns
    assert "".join(ct.unescape(text[b:e]) for b, e in spans) == "".join(t for r, t in turns if r == "assistant")


def test_broken_text_is_refused():
    with pytest.raises(ValueError):
        ct.read_back("### user:\nno end")


def test_rows(spark):
    rows = [(1, 1, "assistant", "B"), (1, 0, "user", None), (1, None, "system", "first"), (2, 0, None, "</turn>"),
            (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 0, "user", "no id"), (3, 0, "assistant", ""),
            (4, 0, "assistant", "### " * 30000)]
    frame = spark.createDataFrame([(*r, "f", "s") for r in rows], SCHEMA)
    formatted = ct.format_conversations(frame)
    got = {r.conv_id: r for r in ct.digests(formatted).collect()}
    assert len(got) == 5 and got[None].n_turns == 1 and got[None].loss_chars == 0

    def hexed(text):
        return hashlib.sha256(text.encode()).hexdigest()

    assert got[1].turns_sha256 == hexed("system\nfirst\nuser\n\nassistant\nB\n")
    assert got[2].turns_sha256 == hexed("\n</turn>\nassistant\nx\nassistant\nx\n") and got[2].loss_sha256 == hexed("xx")
    assert (got[4].loss_chars, got[4].loss_sha256) == (120000, hexed("### " * 30000))
    texts = {r.conv_id: r.formatted for r in formatted.collect()}
    assert all(got[c].formatted_chars == len(texts[c]) for c in texts)
    assert ct.digests(ct.format_conversations(frame.limit(0))).count() == 0


def test_query_adds_the_awkward_conversation(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "hi")], "conv_id bigint, turn bigint, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in op8_chat(spark, str(tmp_path)).collect()}
    said = "\\### Assistant: </turn> ok"
    assert set(got) == {1, -7} and got[-7].loss_chars == len(said)
    assert got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
