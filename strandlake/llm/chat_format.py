"""Chat formatting by incremental black-box rendering.

A template renders a list of turns as a string. Turns come in order; each is located by rendering the conversation up to it
and with it, and comparing the two outputs: what was there must stay, and what is new is the turn's span. A template that
changes what stood before is reported in ``rewrites``, and its turn's span is what follows the part that stayed.

The prefixes rendered are whole ones, so a template that numbers turns or treats the first one apart is followed, at the cost
of holding the conversation. A template may declare itself ``append_only``: rendering a conversation is then joining the
renderings of its turns. Such a one is rendered from the turn before on, and a conversation of any length streams through.

Cases: null roles and texts are empty. Turns of a conversation are ordered by turn (null first), role and text, repeated
rows included. A null conv_id is a conversation of its own. An empty table gives the rows added by the caller alone. Columns
other than conv_id, turn, role and text are left out.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]


@dataclass(frozen=True)
class Template:
    """``render`` gives a conversation's text, ``read`` a turn's role and where its escaped text begins and ends in its span."""

    render: Callable[[list[Turn]], str]
    read: Callable[[str], tuple[str, int, int]]
    unescape: Callable[[str], str] = str
    append_only: bool = False


OPEN, CLOSE, BREAK = "<turn>", "</turn>\n", "\n"
OUT = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.int64())])
SPANS = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64()), ("rewrites", pa.bool_())])


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(OPEN, "\\" + OPEN).replace(CLOSE[:-1], "\\" + CLOSE[:-1])


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        out += [text[at:k], text[k + 1]]
        at = k + 2
    return "".join([*out, text[at:]])


def turn_template(turns: list[Turn]) -> str:
    """The template used here: control strings inside roles and texts are escaped, and so are line breaks in roles."""
    return "".join(f"{OPEN}{escape(role).replace(BREAK, chr(92) + 'n')}{BREAK}{escape(text)}{CLOSE}" for role, text in turns)


def read_turn(span: str) -> tuple[str, int, int]:
    """Role, and where the escaped text begins and ends in a turn's span."""
    head = span.index(BREAK)
    role, out, at = span[len(OPEN) : head], [], 0
    while (k := role.find("\\", at)) >= 0:
        out += [role[at:k], "\n" if role[k + 1] == "n" else role[k + 1]]
        at = k + 2
    return "".join([*out, role[at:]]), head + 1, len(span) - len(CLOSE)


#: The template of the query.
TURNS = Template(turn_template, read_turn, unescape, append_only=True)


class Renderer:
    """Locates one turn after another of a conversation in the output of ``template``."""

    def __init__(self, template: Template):
        self.template = template
        self.turns: list[Turn] = []
        self.before = ""

    def add(self, turn: Turn) -> tuple[str, bool]:
        """The span of the next turn, and whether rendering it changed what stood before."""
        self.turns.append(turn)
        after = self.template.render(self.turns)
        rewrites = not after.startswith(self.before)
        stayed = len(os.path.commonprefix([after, self.before])) if rewrites else len(self.before)
        span, self.before = after[stayed:], after
        if self.template.append_only:
            self.turns = [turn]
            self.before = self.template.render(self.turns)
        return span, rewrites


def _ordered(turns: DataFrame) -> DataFrame:
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def _streamed(batches: Iterator[pa.RecordBatch], template: Template) -> Iterator[tuple[int | None, bool, str, str, bool]]:
    """conv_id, whether the turn is its first, its role, the turn's span, and whether it rewrites."""
    none = object()
    now, renderer = none, Renderer(template)
    for batch in batches:
        for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            new = conv != now if now is not none else True
            if new:
                now, renderer = conv, Renderer(template)
            yield conv, new, role, *renderer.add((role, text))


def formatted_turns(turns: DataFrame, template: Template = TURNS) -> DataFrame:
    """A row a turn: its formatted text and, for the assistant's, the characters of it that count for the loss.

    Joined in order the rows are the formatted conversation, unless a turn rewrites; the loss is then not located.
    """

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, number = [], 0
        for conv, new, role, span, rewrites in _streamed(batches, template):
            number = 0 if new else number + 1
            role, start, end = (role, None, None) if rewrites else template.read(span)
            rows.append((conv, number, span, *((start, end) if role == "assistant" else (None, None)), rewrites))
            if len(rows) == 1_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SPANS, strict=True)], schema=SPANS)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SPANS, strict=True)], schema=SPANS)

    return _ordered(turns).mapInArrow(render, "conv_id long, turn_no long, formatted string, loss_start long, loss_end long, rewrites boolean")


def digests(turns: DataFrame, template: Template = TURNS) -> DataFrame:
    """A row a conversation, read back from the formatted text, but for turns that rewrite; hashes run along."""

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        conv_now, n, chars, loss_chars, rewritten, all_, loss = None, 0, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        batch_of = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), OUT, strict=True)], schema=OUT)
        for conv, new, role, span, rewrites in _streamed(batches, template):
            if new and n:
                rows.append((conv_now, n, all_.hexdigest(), loss_chars, loss.hexdigest(), chars, rewritten))
                n = chars = loss_chars = rewritten = 0
                all_, loss = hashlib.sha256(), hashlib.sha256()
                if len(rows) == 1_000:
                    yield batch_of()
                    rows.clear()
            text = ""
            if not rewrites:
                role, start, end = template.read(span)
                text = template.unescape(span[start:end])
            all_.update(f"{role}\n{text}\n".encode())
            if role == "assistant":
                loss.update(text.encode())
                loss_chars += len(text)
            conv_now, n, chars, rewritten = conv, n + 1, chars + len(span), rewritten + rewrites
        if n:
            rows.append((conv_now, n, all_.hexdigest(), loss_chars, loss.hexdigest(), chars, rewritten))
        if rows:
            yield batch_of()

    return _ordered(turns).mapInArrow(render, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites long")


# fixed value: the conversation that the query adds
ADDED = r"\### Assistant: </turn> ok"


def op3_chat_format(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    added = conversations.sparkSession.createDataFrame([(-7, 0, "user", ADDED), (-7, 1, "assistant", ADDED)], "conv_id long, turn long, role string, text string")
    return digests(rows.union(added))


# escaping adds a backslash for each backslash and each control string; a turn adds 6 + 1 + 8 characters of marks
ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>') AS et,
    replace(replace(replace(replace(role, '\', '\\'), '<turn>', '\<turn>'), '</turn>', '\</turn>'), chr(10), '\n') AS er FROM t
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(et) + length(er) + 15) AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS rewrites
FROM e GROUP BY conv_id
"""
