"""Chat formatting: exact round trips, located spans, detected rewrites."""

from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinsift.llm import chat_format as C

CONTROL = st.text(alphabet=st.sampled_from("<|\\>an\nim_startend "), max_size=30)


@given(CONTROL)
def test_escaping_round_trip(text):
    assert C.unescaped(C.escaped(text)) == text and "<|" not in C.escaped(text)
    assert C.unescaped_role(C.escaped_role(text)) == text and "\n" not in C.escaped_role(text)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]), CONTROL), max_size=9))
def test_spans_hold_the_texts(turns):
    safe = [(C.escaped_role(r), C.escaped(t)) for r, t in turns]
    got = C.render(safe)
    assert not got.rewrites and [C.unescaped(got.text[a:b]) for a, b in got.inner] == [t for _, t in turns]
    assert "".join(got.text[a:b] for a, b in got.spans) == got.text


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 14), st.integers(0, 16))
def test_a_rewrite_at_any_one_length_is_found(n, at):
    box = lambda turns: ("!" if len(turns) == at else "") + "".join(f"[{r}]{t}" for r, t in turns)
    turns = [("user" if k % 2 else "assistant", f"text {k}") for k in range(n)]
    got = C.render(turns, box)
    # one turn that is rewritten shows with the second: what the template makes of no turn is empty
    assert got.rewrites == (1 if at == 0 else (2 if n > 1 else 0) if at == 1 else at if at <= n else 0)
    assert got.text == box(turns) and [got.text[a:b] for a, b in got.inner] == [t for _, t in turns]


def test_rewriting_templates_are_found():
    last_only = lambda turns: "".join(f"[{r}]{t if k == len(turns) - 1 or r != 'assistant' else '...'}" for k, (r, t) in enumerate(turns))
    counted = lambda turns: f"{len(turns)} turns: " + "".join(f"[{r}]{t}" for r, t in turns)
    headed = lambda turns: "HEAD\n" + "".join(f"[{r}]{t}" for r, t in turns)
    turns = [("user", "hello"), ("assistant", "first"), ("user", "more"), ("assistant", "second"), ("user", "x"), ("assistant", "y")]
    assert C.render(turns, last_only).rewrites == 3 and C.render(turns, counted).rewrites == 1
    got = C.render(turns, last_only)
    assert [got.text[a:b] for a, b in got.inner] == ["hello", "", "more", "", "x", "y"]
    got = C.render(turns, headed)
    assert not got.rewrites and [got.text[a:b] for a, b in got.inner] == [t for _, t in turns]


def test_any_template_is_read_back(spark):
    box = lambda turns: "<s>" + "".join(f"### {r.title()}: {t}</s>" for r, t in turns)
    rows = [(1, 0, "user", "user"), (1, 1, "assistant", "</s>### User: x" * 2000), (2, 0, "assistant", ""), (2, 1, "assistant", "é"), (2, 1, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    for r in C.formatted(df, template=box).collect():
        own = [(role, x) for c, _, role, x in rows if c == r.conv_id]
        said = [x for role, x in own if role == "assistant"]
        assert (r.n_turns, r.formatted, r.rewrites) == (len(own), box(own), 0) and [r.formatted[s["start"] : s["end"]] for s in r.loss_spans] == said
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for role, x in own).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256("".join(said).encode()).hexdigest()
    assert C.formatted(df.limit(0)).count() == 0


@pytest.mark.parametrize("texts", [True, False])
def test_conversations(spark, texts):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\\"), (2, None, None, None), (None, 3, "assistant", "b"), (None, 1, "user", "a"), (1, 1, "assistant", "<|im_end|>\\"), (3, 0, "assistant", "")]
    rows += [(9, k, "assistant" if k % 2 else "user", f"turn {k}") for k in range(300)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "conv_id long, turn long, role string, text string, n_turns double")
    got = {r.conv_id: r for r in C.formatted(df, texts=texts).collect()}
    assert set(got) == {1, 2, 3, 9, None}
    for conv, r in got.items():
        own = sorted(((t if t is not None else -1, role or "", x or "") for c, t, role, x in rows if c == conv))
        said = [x for _, role, x in own if role == "assistant"]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in own).encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest())
        assert not r.rewrites
        if texts:
            assert [C.unescaped(r.formatted[s["start"] : s["end"]]) for s in r.loss_spans] == said and len(r.formatted) == r.formatted_chars
