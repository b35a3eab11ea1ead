"""Chat formatting by incremental black-box rendering.

A template is any function from turns to a string; nothing about it is assumed. The conversation is
rendered for each prefix of its turns. Where an output continues the one before it (up to a closing
tail that stays at the end), the new part is the turn's span; where it doesn't, the template rewrites
history, which is reported. A turn's text is located in its output by rendering the turn with two
one-letter texts: they differ at exactly the place where texts go. With a template that rewrites
history, spans and texts are located in the output of the whole conversation by the same probes, and
a turn that the template leaves out has none.

Only two outputs are held at a time. Rendering every prefix costs the square of the number of turns in
string copying, which a template that is a black box does not allow to avoid; a conversation's output
is one string, so it must fit in a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import ship

Turn = tuple[str, str]
Template = Callable[[Sequence[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"
_OPEN, _HELD = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(r"<\|im_start\|>(.*?)\n(.*?)<\|im_end\|>\n", re.S)
_ROLE = {"\\": "\\\\", "\n": "\\n"}


def escape(text: str) -> str:
    """One more backslash in each ``<``, backslashes, ``|``: no control string is left, and it can be undone."""
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _HELD.sub(r"<\1|", text)


def chatml(turns: Sequence[Turn]) -> str:
    """Each turn between control strings, role on the first line, control strings in texts escaped."""
    return "".join(f"{START}{escape(''.join(_ROLE.get(c, c) for c in role))}\n{escape(text)}{END}\n" for role, text in turns)


def read_chatml(formatted: str) -> list[Turn]:
    """The turns that ``chatml`` was given."""
    return [(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role)), unescape(text)) for role, text in _TURN.findall(formatted)]


def shared_prefix(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while lo + 1 < hi:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo + 1 if a[lo : lo + 1] == b[lo : lo + 1] else lo


class Rendered:
    """A conversation's output with the span of each turn and of its text (None where there is none)."""

    def __init__(self, turns: Sequence[Turn], template: Template = chatml):
        turns = list(turns)
        before = template([])
        self.rewrites = False
        self.spans: list[tuple[int, int] | None] = []
        self.texts: list[tuple[int, int] | None] = []
        for k in range(len(turns)):
            after = template(turns[: k + 1])
            head = shared_prefix(before, after)
            tail = len(before) - head
            if tail and not after[head:].endswith(before[head:]):
                self.rewrites = True
                break
            self.spans.append((head, len(after) - tail))
            self.texts.append(self._text(turns[: k + 1], k, after, template))
            before = after
        self.formatted = before if not self.rewrites else template(turns)
        if self.rewrites:
            self.texts = [self._text(turns, k, self.formatted, template) for k in range(len(turns))]
            self.spans = list(self.texts)

    @staticmethod
    def _text(turns: list[Turn], k: int, output: str, template: Template) -> tuple[int, int] | None:
        a, b = (template([*turns[:k], (turns[k][0], probe), *turns[k + 1 :]]) for probe in "AB")
        if a == b:
            return None
        start = shared_prefix(a, b)
        end = len(output) - (len(a) - start - 1)
        return (start, end) if end >= start and output[:start] == a[:start] else None


TYPE = "conv_id {0}, formatted string, roles array<string>, spans array<struct<start:long,end:long>>, texts array<struct<start:long,end:long>>, rewrites boolean"


def format_conversations(rows: DataFrame, template: Template = chatml) -> DataFrame:
    """One row a conversation: conv_id, formatted, and for each turn its role, span and text span, in code points.

    Turns are ordered by turn (null first), then role and text, so repeated turns have a fixed order.
    Null roles and texts are empty; rows with a null conv_id form one conversation. Extra columns are
    not read; an empty table gives none.
    """
    ship(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType.simpleString()
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                turns = [[(t["role"], t["text"]) for t in c] for c in part.column("turns").to_pylist()]
                got = [Rendered(t, template) for t in turns]
                pairs = lambda spans: [{"start": s[0], "end": s[1]} if s else None for s in spans]
                cols = [part.column("conv_id"), pa.array([g.formatted for g in got], pa.string()), pa.array([[r for r, _ in t] for t in turns], pa.list_(pa.string())), pa.array([pairs(g.spans) for g in got], span), pa.array([pairs(g.texts) for g in got], span), pa.array([g.rewrites for g in got], pa.bool_())]
                yield pa.record_batch(cols, names=["conv_id", "formatted", "roles", "spans", "texts", "rewrites"])

    return whole.mapInArrow(run, TYPE.format(kind))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader finds in ``chatml`` outputs: turns, loss mask (assistant texts) and their digests.

    Roles and texts are read back from the output, the mask from it and the text spans; an output
    without turns has digests of nothing.
    """
    ship(formatted.sparkSession)
    kind = formatted.schema["conv_id"].dataType.simpleString()
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, spans in zip(*(batch.column(c).to_pylist() for c in ("formatted", "texts")), strict=True):
                turns = read_chatml(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for (r, _), s in zip(turns, spans, strict=True) if r == "assistant" and s)
                out.append((len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
            cols = [pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
            yield pa.record_batch([batch.column("conv_id"), *cols, batch.column("rewrites")], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"])

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
