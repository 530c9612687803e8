"""Operator 11: chat formatting by incremental rendering of a black box.

A template is a black box: messages in, one string out.  Successive prefixes of a conversation are
rendered and consecutive outputs compared; what the output of the longer prefix has beyond their common
start is the new turn's span, and where an output departs from the one before inside an earlier turn, the
template rewrites history.  The text's own place in a turn is found by rendering the turn once more with
probes in its place.  Assistant texts so located are the loss mask.

Long conversations
------------------
Turns are range-sorted by (conversation, turn), so a conversation of a third of all rows lies over many
tasks, and are rendered in segments of at most ``SEGMENT`` turns or about ``SEGMENT_CHARS`` characters.
A segment is rendered behind the ``context`` turns before it, which a template declares as what it looks
back at; the first turn of a segment is rendered behind the whole segment before it as well, and a
template whose output differs is reported (``history_kept`` is false), as it looks further back than it says.

Output: a table, one row per segment: ``conv_id``, ``part`` (ascending within a conversation), ``alone``
(surely the conversation's only segment), ``formatted``, ``turn_ends`` (of each turn in ``formatted``),
``loss_starts``, ``loss_ends``, ``history_kept``.

Defined cases: null text or role: empty.  Null conv_id: a conversation of its own, null turns first.
Rows of one turn (repeated rows too) are all kept, ordered by role, then by the text's hash.  Roles other
than ``assistant``, known or not, are marked but not trained on.  A segment whose history is rewritten has no loss
mask, as its spans are no longer where they were; a conversation keeps its history where all its segments do.
Empty table: no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rallyframe.llm.common import materialise, parts

SEGMENT = 256
SEGMENT_CHARS = 1 << 18
Message = tuple[str, str]

#: Strings that chat models read as control, beside the template's own; each begins with < or [ and has neither elsewhere.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|turn|>", "<|body|>", "<|end|>")


class Escaper:
    r"""Reversible escape of control strings: ``<s>`` becomes ``<\s>``, ``<\s>`` becomes ``<\\s>``, and so on."""

    def __init__(self, control: tuple[str, ...] = CONTROL):
        by_first: dict[str, list[str]] = {}
        for c in control:
            by_first.setdefault(c[0], []).append(re.escape(c[1:]))
        if any(first in c[1:] for first in by_first for c in control):
            raise ValueError("the first character of a control string may not stand further on in one")
        # the first character, and behind it any backslashes and the rest: escaping adds a backslash, unescaping takes one
        self._more = re.compile("|".join(rf"{re.escape(f)}(?=\\*(?:{'|'.join(rest)}))" for f, rest in by_first.items()))
        self._less = re.compile("|".join(rf"{re.escape(f)}\\(?=\\*(?:{'|'.join(rest)}))" for f, rest in by_first.items()))

    def escape(self, text: str) -> str:
        return self._more.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._less.sub(lambda m: m[0][0], text)


@dataclass(frozen=True)
class Template:
    """A black box and what is known of it.

    render: messages to one string.  context: the turns before a turn that its output may depend on.
    parse: a rendered string back to messages, where the template can be read back.  unescape: of a text
    as it stands in the output.
    """

    render: Callable[[list[Message]], str]
    context: int = 1
    parse: Callable[[str], list[Message]] | None = None
    unescape: Callable[[str], str] = str


_ESCAPE = Escaper()
_TURN = re.compile(r"<\|turn\|>(.*?)<\|body\|>(.*?)<\|end\|>", re.DOTALL)


def _marked(message: Message) -> str:
    e = _ESCAPE.escape
    return f"<|turn|>{e(message[0])}<|body|>{e(message[1])}<|end|>"


_remembered = lru_cache(maxsize=2 * SEGMENT)(_marked)


def _render_marked(messages: list[Message]) -> str:
    return "".join([_remembered(m) if len(m[1]) < 4096 else _marked(m) for m in messages])


def _parse_marked(text: str) -> list[Message]:
    found, at = [], 0
    for m in _TURN.finditer(text):
        if m.start() != at:
            raise ValueError("text between turns")
        found.append((_ESCAPE.unescape(m[1]), _ESCAPE.unescape(m[2])))
        at = m.end()
    if at != len(text):
        raise ValueError("text behind the last turn")
    return found


#: Turns between marks, with every control string in roles and texts escaped; can be read back.
MARKED = Template(_render_marked, context=1, parse=_parse_marked, unescape=_ESCAPE.unescape)


def _common(a: str, b: str) -> int:
    """Length of the common start, by halving: comparisons of whole stretches, not of characters one by one."""
    if b.startswith(a):
        return len(a)
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


@dataclass
class Rendered:
    """A segment's output behind its context: ``formatted``, each turn's end in it, (start, end) of each turn's
    text in it, and the first turn behind which history was rewritten (None: never)."""

    formatted: str
    ends: list[int]
    texts: list[tuple[int, int]]
    rewritten: int | None


def text_span(template: Template, before: list[Message], message: Message, full: str) -> tuple[int, int]:
    """Where the message's text stands in ``full``, the output of ``before`` and the message: the output with an empty
    text is head and tail, and one with a probe departs from it exactly where the head ends."""
    role, text = message
    empty = template.render([*before, (role, "")])
    # two probes of different first characters: one at least departs at the head's end, whatever stands behind the text
    head = min(_common(empty, template.render([*before, (role, probe)])) for probe in "\ue000\ue001")
    tail = len(empty) - head
    if len(full) < head + tail or full[:head] != empty[:head] or (tail and full[-tail:] != empty[-tail:]):
        return 0, 0  # the box moves or drops this text: no place of its own
    return head, len(full) - tail


def render_segment(template: Template, context: list[Message], messages: list[Message]) -> Rendered:
    """Render successive prefixes behind ``context`` and compare consecutive outputs.

    A common start that ends before the last turn's text does means that history was rewritten; one that
    ends in what closes that turn only moves the border (a closing mark that the next turn replaces).
    """
    last = template.render(context) if context else ""
    base, ends, texts, rewritten = len(last), [], [], None
    reach = base  # the end of the last turn's text
    for k, message in enumerate(messages):
        before = [*context, *messages[:k]]
        now = template.render([*before, message])
        same = _common(last, now)
        if same < len(last):
            if k == 0:
                base = min(base, same)
                if context and same < text_span(template, context[:-1], context[-1], last)[1]:
                    rewritten = 0
            elif same < reach:
                rewritten = k if rewritten is None else rewritten
            else:
                ends[-1] = same
        start, end = text_span(template, before, message, now)
        texts.append((start, end))
        reach = end or same
        ends.append(len(now))
        last = now
    return Rendered(last[base:], [max(0, e - base) for e in ends], [(max(0, s - base), max(0, e - base)) for s, e in texts], rewritten)


def looks_further_back(template: Template, earlier: list[Message], message: Message) -> bool:
    """Whether the message comes out otherwise behind all of ``earlier`` than behind its last ``context`` turns."""
    near = earlier[len(earlier) - template.context :] if template.context else []
    outputs = []
    for before in (earlier, near):
        a, b = template.render(before) if before else "", template.render([*before, message])
        outputs.append(b[len(a) :] if b.startswith(a) else None)
    return outputs[0] != outputs[1]


GATHERED = "conv_id long, part long, first boolean, last boolean, alone boolean, turns array<struct<role:string,text:string>>, before array<struct<role:string,text:string>>"
_PAIRS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def gather(chats: DataFrame, context: int) -> DataFrame:
    """Segments of range-sorted turns, a row each, with the turns before (``before``; the whole segment before where the
    same task holds it); ``first`` and ``last`` of a task's segments may have neighbours in other tasks."""
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "hash"]

    def run(batches: Iterator[pa.RecordBatch]):
        none = object()
        conv, turns, chars, before, place, held = none, [], 0, [], None, None

        def row(segment, last, goes_on=True):
            conv, place, first, turns, before = segment
            alone = not (first or last or before or goes_on)
            dicts = [[{"role": r, "text": t} for r, t in x] for x in (turns, before)]
            return pa.RecordBatch.from_arrays(
                [pa.array([conv], pa.int64()), pa.array([place], pa.int64()), pa.array([first]), pa.array([last]), pa.array([alone]), pa.array([dicts[0]], _PAIRS), pa.array([dicts[1]], _PAIRS)],
                ["conv_id", "part", "first", "last", "alone", "turns", "before"],
            )

        n = 0
        for b in batches:
            for c, task, role, text in zip(*(b.column(k).to_pylist() for k in range(4))):
                place = task << 32
                if conv is none or c != conv or len(turns) >= SEGMENT or chars >= SEGMENT_CHARS:
                    if conv is not none:
                        if held is not None:
                            yield row(held, False, held[0] == conv)
                        held = (conv, place + n, n == 0, turns, before)
                        n += 1
                        before = turns if c == conv else []
                    conv, turns, chars = c, [], 0
                turns.append((role, text))
                chars += len(text)
        if conv is not none:
            if held is not None:
                yield row(held, False, held[0] == conv)
            yield row((conv, place + n, n == 0, turns, before), True)

    rows = chats.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    ).withColumn("hash", F.xxhash64("text"))
    ranged = rows.repartitionByRange(parts(chats.sparkSession), *order).sortWithinPartitions(*order)
    return ranged.select("conv_id", F.spark_partition_id().cast("long").alias("task"), "role", "text").mapInArrow(run, GATHERED)


def _last(turns, n: int):
    """The last n elements of an array."""
    return F.when(F.size(turns) > n, F.slice(turns, -n, n) if n else F.slice(turns, 1, 0)).otherwise(turns)


def _carried(segments: DataFrame, context: int) -> DataFrame:
    """(part, carried): for the first segment of each task, the last turns that the tasks before hold of its conversation;
    one row a task, in one window.  A task always holds a turn, so ``context`` tasks back are enough."""
    task = F.shiftright("part", 32).alias("task")
    heads = segments.where("first").select(task, "part", "conv_id")
    tails = segments.where("last").select(task, F.struct("conv_id", _last(F.concat("before", "turns"), context).alias("turns")).alias("tail"))
    back = F.collect_list("tail").over(Window.orderBy("task").rowsBetween(-max(context, 1), -1))
    same = F.filter("back", lambda x: x["conv_id"].eqNullSafe(F.col("conv_id")))
    together = F.flatten(F.transform(same, lambda x: x["turns"]))
    return heads.join(tails, "task").withColumn("back", back).select("part", _last(together, context).alias("carried"))


FORMATTED = "conv_id long, part long, alone boolean, formatted string, turn_ends array<int>, loss_starts array<int>, loss_ends array<int>, history_kept boolean"


def format_chats(chats: DataFrame, template: Template = MARKED) -> DataFrame:
    """Format (conv_id, turn, role, text) into the output table, written to the shared folder."""
    segments = materialise(gather(chats, template.context), "chat-turns")
    firsts = segments.where("first").drop("before").join(_carried(segments, template.context), "part").withColumnRenamed("carried", "before")
    rows = firsts.unionByName(segments.where("not first")).select("conv_id", "part", "alone", "turns", "before")
    context = template.context

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            out: list[list] = [[] for _ in range(8)]
            for conv, part, alone, turns, before in zip(*(b.column(k).to_pylist() for k in range(5))):
                turns, before = ([(x["role"], x["text"]) for x in y or ()] for y in (turns, before))
                near = before[len(before) - context :] if context and before else []
                r = render_segment(template, near, turns)
                kept = r.rewritten is None
                if kept and len(before) > len(near):
                    kept = not looks_further_back(template, before, turns[0])
                spans = [x for (role, _), x in zip(turns, r.texts) if role == "assistant"] if kept else []
                for column, value in zip(out, (conv, part, alone, r.formatted, r.ends, [s for s, _ in spans], [e for _, e in spans], kept)):
                    column.append(value)
            ints = pa.list_(pa.int32())
            kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string(), ints, ints, ints, pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds)], [c.split()[0] for c in FORMATTED.split(", ")])

    return materialise(rows.mapInArrow(run, FORMATTED), "chat-formatted")


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, history_kept boolean"


def _read_back(template: Template, formatted: str, starts: list[int], ends: list[int]) -> tuple[int, bytes, int, bytes]:
    """Turns, their digest's bytes, the masked characters and their bytes, of one segment's output."""
    turns = template.parse(formatted)
    loss = "".join(template.unescape(formatted[s:e]) for s, e in zip(starts, ends))
    return len(turns), "".join(f"{role}\n{text}\n" for role, text in turns).encode(), len(loss), loss.encode()


def read_digests(formatted: DataFrame, template: Template = MARKED) -> DataFrame:
    """One row per conversation, read back from the output table alone.

    A digest is one pass over a conversation by its nature; a segment that is alone has it where it is read,
    the others' bytes pass by in order, one segment in memory at a time.
    """
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names)

    def single(batches):
        for b in batches:
            rows = []
            for conv, text, starts, ends, kept in zip(*(b.column(k).to_pylist() for k in range(5))):
                n, said, chars, loss = _read_back(template, text, starts, ends)
                rows.append((conv, n, hashlib.sha256(said).hexdigest(), chars, hashlib.sha256(loss).hexdigest(), len(text), kept))
            if rows:
                yield batch(rows)

    def ordered(batches):
        none = object()
        current, state = none, None

        def done():
            n, said, chars, loss, length, kept = state
            return batch([(current, n, said.hexdigest(), chars, loss.hexdigest(), length, kept)])

        for b in batches:
            for conv, text, starts, ends, kept in zip(*(b.column(k).to_pylist() for k in range(5))):
                if current is none or conv != current:
                    if current is not none:
                        yield done()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                n, said, chars, loss = _read_back(template, text, starts, ends)
                state[1].update(said)
                state[3].update(loss)
                state[0], state[2], state[4], state[5] = state[0] + n, state[2] + chars, state[4] + len(text), state[5] and kept
        if current is not none:
            yield done()

    columns = ("conv_id", "formatted", "loss_starts", "loss_ends", "history_kept")
    alone = formatted.where("alone").select(*columns).mapInArrow(single, DIGESTS)
    several = formatted.where("not alone").repartition(parts(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return alone.unionByName(several.select(*columns).mapInArrow(ordered, DIGESTS))


def chat_formatting(chats: DataFrame, template: Template = MARKED) -> DataFrame:
    """Format, write, read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, history_kept."""
    return read_digests(format_chats(chats, template), template)
