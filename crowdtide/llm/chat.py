"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to one string.  It is rendered on successive
prefixes of a conversation; where the new output goes on from the one before, the addition is the
new turn's span.  A template that changes what it had written before rewrites history: then no
span can be told, which is reported and not repaired.

Conversations stream through a task turn by turn, sorted by turn.  Every prefix is rendered whole,
as no rendering of some turns tells what a template does with later ones; work then grows with the
square of a conversation's length.  Only for a template that the caller declares ``local`` (each
turn is rendered by itself, as ``instruct_template`` does) is a long conversation rendered from a
later turn on, so that memory and work stay in proportion to its length.

Defined results: a null text or role counts as empty; a null conversation id is a conversation of
its own; turns with the same number, or none, stand in order of (turn, role, text), nulls first, and
are all kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turns = list[tuple[str, str]]
WINDOW = 32       # turns of a local template that are rendered together before the start is moved on

# The marks of the template.
OPEN, CLOSE, BREAK = "<s>", "</s>", "[INST]"
_ESCAPED = re.compile(r"[\\<\[]")
_UNESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No mark can stand in the result, whatever the text; ``unescape`` undoes it."""
    return _ESCAPED.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _UNESCAPED.sub(lambda m: m[1], text)


def instruct_template(turns: Turns) -> str:
    """``<s>role[INST]text</s>`` for each turn, texts and roles escaped."""
    return "".join(f"{OPEN}{escape(role)}{BREAK}{escape(text)}{CLOSE}" for role, text in turns)


def read_turn(span: str) -> tuple[str, str, int, int]:
    """Role and text of a span, and where the escaped text starts and ends in it."""
    if not (span.startswith(OPEN) and span.endswith(CLOSE)):
        raise ValueError("the span is not one turn of this template")
    # escaped parts hold no bare bracket, so the first mark that is not escaped ends the role
    cut = re.compile(r"(?:[^\\\[]|\\.)*", re.DOTALL).match(span, len(OPEN)).end()
    start, stop = cut + len(BREAK), len(span) - len(CLOSE)
    return unescape(span[len(OPEN):cut]), unescape(span[start:stop]), start, stop


@dataclass
class Rendering:
    """Renders a conversation turn by turn; ``rewritten`` once the template has changed its past."""

    template: Callable[[Turns], str]
    window: int = WINDOW
    turns: Turns = field(default_factory=list)
    before: str = ""
    rewritten: bool = False
    local: bool = False

    def add(self, role: str, text: str) -> str | None:
        """The span of the next turn; None if history was rewritten."""
        last = self.before
        self.turns.append((role, text))
        now = self.template(self.turns)
        if not now.startswith(last):
            self.rewritten = True
        span = None if self.rewritten else now[len(last):]
        self.before = now
        if self.local and span is not None and len(self.turns) > self.window:
            # the rest is rendered from this turn on, which must read the same without its past
            if self.template(self.turns[-1:]) != span:
                raise ValueError("a template declared local renders a turn by those before it")
            self.turns, self.before = self.turns[-1:], span
        return span


def _text(value) -> str:
    value = value.as_py()
    return "" if value is None else value


def _rendered(template, window, local):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, number, rendering, total, blank = None, 0, None, 0, True
        for batch in batches:
            out = []
            for conv, role, text in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                conv = conv.as_py()
                if blank or conv != current:
                    current, number, total, blank = conv, 0, 0, False
                    rendering = Rendering(template, window, local=local)
                span = rendering.add(_text(role), _text(text))
                # a span that cannot be told is null; the output so far then is the whole rendering
                out.append((conv, number, role.as_py(), total, span, rendering.rewritten))
                number += 1
                total += len(span or "")
            columns = zip(*out, strict=True) if out else [[]] * 6
            kinds = [batch.schema.field(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", "n", "role", "start", "span", "rewritten"])

    return run


def _ordered(turns: DataFrame) -> DataFrame:
    order = [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    return turns.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *order)


def render(turns: DataFrame, template: Callable[[Turns], str] = instruct_template, window: int = WINDOW, local: bool | None = None) -> DataFrame:
    """conv_id, n (place of the turn), role, start and text of its span, and whether history was rewritten.

    ``local``: the template renders each turn by itself, whatever stands before or after it; only
    ``instruct_template`` is taken for local without being declared so.
    """
    local = template is instruct_template if local is None else local
    kind = turns.schema["conv_id"].dataType.simpleString()
    ordered = _ordered(turns.select("conv_id", "turn", "role", "text")).select("conv_id", "role", "text")
    return ordered.mapInArrow(_rendered(template, window, local), f"conv_id {kind}, n long, role string, start long, span string, rewritten boolean")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads spans of ``instruct_template`` back; a conversation's spans arrive one after another."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    current, state, kind = None, None, None

    def row():
        return (current, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"])

    def batch_of(rows):
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()], strict=True)], names=names)

    for batch in batches:
        kind, done = batch.schema.field(0).type, []
        for conv, span in zip(batch.column("conv_id"), batch.column("span"), strict=True):
            conv, span = conv.as_py(), span.as_py()
            if state is None or conv != current:
                if state is not None:
                    done.append(row())
                current, state = conv, {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
            role, text, start, stop = read_turn(span)
            state["n"] += 1
            state["turns"].update(f"{role}\n{text}\n".encode())
            state["chars"] += len(span)
            if role == "assistant":
                learnt = unescape(span[start:stop])    # the loss mask covers these characters of the span
                state["loss_chars"] += len(learnt)
                state["loss"].update(learnt.encode())
        yield batch_of(done)
    if state is not None:
        yield batch_of([row()])


def format_digests(turns: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per conversation: what can be read back from its formatted string, and the string's length."""
    spans = render(turns, instruct_template, window)
    kind = turns.schema["conv_id"].dataType.simpleString()
    # the spans leave render() grouped and in order, and stay so: nothing is shuffled in between
    return spans.select("conv_id", "span").mapInArrow(_digested, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def loss_spans(turns: DataFrame, window: int = WINDOW) -> DataFrame:
    """render() of ``instruct_template`` with ``loss_start`` and ``loss_end``: the assistant's characters in the formatted string."""
    spans = render(turns, instruct_template, window)
    is_loss = F.coalesce(F.col("role") == "assistant", F.lit(False))
    head = len(OPEN) + len("assistant") + len(BREAK)
    start = F.when(is_loss, F.col("start") + head)
    return spans.withColumn("loss_start", start).withColumn("loss_end", F.when(is_loss, F.col("start") + F.length("span") - len(CLOSE)))
