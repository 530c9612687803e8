"""Operator 11: templates as black boxes, spans, history that is rewritten, long conversations, reading back."""

import hashlib
import re
import sys

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark import cloudpickle

from rallyframe.llm import chat
from rallyframe.llm.chat import MARKED, Escaper, Template, chat_formatting, format_chats, render_segment

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # the workers cannot import the tests' templates
SCHEMA = "conv_id long, turn long, role string, text string"


def closing_moves(messages):
    """The closing mark stands only behind the last turn."""
    return "".join(f"[{r}]{t};" for r, t in messages) + "<eos>"


def drops_thoughts(messages):
    """Of earlier turns the thoughts go: history is rewritten."""
    said = [(r, t if k == len(messages) - 1 else re.sub("<think>.*?</think>", "", t)) for k, (r, t) in enumerate(messages)]
    return "".join(f"[{r}]{t};" for r, t in said)


def counts_turns(messages):
    """Each turn bears its number: looks back at all turns."""
    return "".join(f"[{k} {r}]{t};" for k, (r, t) in enumerate(messages))


def expected(rows):
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or 0, x[2] or "")):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        said = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(MARKED.render(turns)), True)
    return out


def results(df):
    rows = df.collect()
    got = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def test_long_conversations_lie_over_tasks(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 7)
    rows = [(5, k, "user" if k % 2 == 0 else "assistant", f"</s>[INST] {k} <\\s> <|end|> é{'x' * (k % 50)}") for k in range(900)]
    rows += [(c, k, r, f"{c} {k}") for c in range(60) for k, r in enumerate(("system", "user", "assistant", "tool")) if c != 5]
    rows += [(70, 0, "assistant", ""), (71, 3, None, None), (71, 9, "assistant", None), (None, 1, "user", "null"), (None, None, "assistant", "first")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "text as formatted", "1 as part", "role as before").repartition(6)
    assert results(chat_formatting(df)) == expected(rows)
    parts = format_chats(df).where("conv_id = 5").collect()
    assert len(parts) >= 900 / 7 and not any(r["alone"] for r in parts)
    assert "".join(r["formatted"] for r in sorted(parts, key=lambda r: r["part"])) == MARKED.render([(r, t) for c, _, r, t in rows if c == 5])


def test_ties_and_repeated_rows_are_all_kept(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, "assistant", "b")]
    assert results(chat_formatting(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_very_long_text_and_empty_table(spark):
    rows = [(1, 0, "user", "<s>" * 200_000), (1, 1, "assistant", "ß<|end|>" * 100_000), (1, 2, "user", "ok")]
    assert results(chat_formatting(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
    assert results(chat_formatting(spark.createDataFrame([], SCHEMA))) == {}


@given(st.text(alphabet="<>[]/\\s|INSTend_imr", max_size=60))
def test_escape_is_reversible(text):
    e = Escaper()
    out = e.escape(text)
    assert e.unescape(out) == text
    assert not any(c in out for c in chat.CONTROL)


def test_escape_needs_distinct_first_characters():
    with pytest.raises(ValueError):
        Escaper(("<s>", "<<SYS>>"))


def test_spans_of_a_plain_template():
    turns = [("user", "hello"), ("assistant", "hi; [assistant]"), ("assistant", "")]
    r = render_segment(Template(lambda m: "".join(f"[{a}]{b};" for a, b in m)), [], turns)
    assert [r.formatted[s:e] for s, e in r.texts] == ["hello", "hi; [assistant]", ""] and r.rewritten is None
    assert r.ends == [len("[user]hello;"), len("[user]hello;[assistant]hi; [assistant];"), len(r.formatted)]


def test_a_moving_end_mark_is_not_a_rewrite():
    turns = [("user", "one"), ("assistant", "two"), ("user", "three")]
    r = render_segment(Template(closing_moves), [], turns)
    assert r.rewritten is None and r.formatted == "[user]one;[assistant]two;[user]three;<eos>"
    assert r.ends[:2] == [len("[user]one;"), len("[user]one;[assistant]two;")] and r.formatted[slice(*r.texts[1])] == "two"


def test_rewritten_history_is_found_and_not_trained_on(spark):
    turns = [("user", "q"), ("assistant", "<think>long</think>a"), ("user", "r"), ("assistant", "b")]
    assert render_segment(Template(drops_thoughts), [], turns).rewritten == 2
    rows = [(1, k, r, t) for k, (r, t) in enumerate(turns)] + [(2, 0, "user", "q"), (2, 1, "assistant", "plain")]
    segments = format_chats(spark.createDataFrame(rows, SCHEMA), Template(drops_thoughts)).collect()
    trained = {c: [r["formatted"][s:e] for r in segments if r["conv_id"] == c for s, e in zip(r["loss_starts"], r["loss_ends"])] for c in (1, 2)}
    # a conversation keeps its history where all its segments do; a rewritten segment trains on nothing
    assert not all(r["history_kept"] for r in segments if r["conv_id"] == 1) and all(r["loss_starts"] == [] for r in segments if not r["history_kept"])
    assert all(r["history_kept"] for r in segments if r["conv_id"] == 2) and trained[2] == ["plain"]


def test_a_template_that_looks_further_back_is_reported(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT", 4)
    rows = [(1, k, "user", str(k)) for k in range(20)] + [(2, k, "user", str(k)) for k in range(3)]
    got = format_chats(spark.createDataFrame(rows, SCHEMA).coalesce(1), Template(counts_turns)).collect()
    assert not all(r["history_kept"] for r in got if r["conv_id"] == 1) and all(r["history_kept"] for r in got if r["conv_id"] == 2)
