"""Conversations as text for training, rendered by a compiled template (see templates), and read back from it.

A conversation is a stream of turns, dealt by its id and blocks of BLOCK turns, so that one of very many turns is
the work of many tasks; a small row ahead of each block tells how many turns the conversation has and how many stand before, which is all that
a template needs to know of the others. A task sorts its rows outside Python and holds one piece of text at a time.
Reading back finds turns by the format's pattern and undoes its escapes; the loss mask is read on its own, by its spans alone. A
conversation of one piece is digested where it is rendered; pieces of longer ones are sent on by conversation, in order,
since a digest of a whole text has to be taken from its start to its end.

Nulls and the like: a null text or role is the empty one. Turns go by number, nulls first, and turns of one number by role and text, so repeated rows
stand side by side and each counts. Rows without an id are one conversation, whose id is null. Texts are read whole.
A table without rows gives none. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices
from .templates import Output, Template, Turn

#: Turns a block, and characters after which a piece of text ends with its turn.
BLOCK, PIECE = 512, 1 << 20


class Format(NamedTuple):
    """A template and the pattern whose groups are a turn's role and content in what it renders."""

    source: str
    turn: str


INSTRUCT = Format(
    """
    {%- control '<s>' '</s>' '[INST]' '[/INST]' -%}
    {%- for message in messages -%}
      <s>[INST] {{ message.role | escape }} [/INST]
      {%- if message.role == 'assistant' -%}
        {%- generation -%}{{ message.content | escape }}{%- endgeneration -%}
      {%- else -%}
        {{ message.content | escape }}
      {%- endif -%}
      </s>
    {%- endfor -%}
    """,
    r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>",
)
KEYS = ["conv_id", "no_id", "block"]
PIECES = "conv_id long, no_id boolean, block long, piece int, whole boolean, formatted string, loss array<int>"
DIGESTS = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def with_keys(df: DataFrame, *more: str) -> DataFrame:
    """Keys without nulls, which hash well and compare plainly."""
    block = F.coalesce(F.floor(F.col("turn") / BLOCK).cast("long"), F.lit(-(1 << 62)))
    return df.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(0)).alias("conv_id"), F.col("conv_id").isNull().alias("no_id"), block.alias("block"), *more)


def format_conversations(df: DataFrame, form: Format = INSTRUCT) -> DataFrame:
    """Pieces of formatted conversations: ``formatted`` in the order of block and piece is a conversation's text.

    ``loss`` holds start and end of each span under the loss mask, in code points of the piece; whole is true where a
    conversation is one piece. no_id tells conversations of null id, whose conv_id is given as 0.
    """
    Template(form.source)  # a fault is found before anything runs
    counted = with_keys(df).groupBy(KEYS).agg(F.count("*").alias("n"))
    conversation = Window.partitionBy("conv_id", "no_id")
    before = F.sum("n").over(conversation.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    head = counted.select(*KEYS, F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(conversation).alias("of"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("text"), F.col("n"))
    none = F.lit(None).cast("long")
    turns = with_keys(df, none.alias("before"), none.alias("of"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), none.alias("n"))
    dealt = head.unionAll(turns).repartition(*KEYS).sortWithinPartitions(*KEYS, F.col("of").desc_nulls_last(), F.col("turn").asc_nulls_first(), "role", "text")

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, out, rows, size = Template(form.source), Output(), [], 0
        at = of = left = first = piece = 0
        for turn in in_slices(batches, "text"):
            conv_id, no_id, block, before, total, _, role, text, n = turn
            if total is not None:
                at, of, left, first, piece = before, total, n, before + 1, 0
                continue
            at, left = at + 1, left - 1
            template.render(Turn(role, text, at, at == 1, at == of), out)
            if left and out.length < PIECE:
                continue
            rows.append((conv_id, no_id, block, piece, first == 1 and at == of, "".join(out.parts), out.spans))
            size += out.length
            out, first, piece = Output(), at + 1, piece + 1
            if size >= PIECE:
                yield as_batch(rows, PIECES)
                rows, size = [], 0
        yield as_batch(rows, PIECES)

    return dealt.mapInArrow(render, PIECES)


def in_slices(batches: Iterable[pa.RecordBatch], text: str) -> Iterator[tuple]:
    """Rows, of which few long ones are Python objects at a time."""
    for batch in batches:
        for part in slices(batch, text):
            yield from zip(*(c.to_pylist() for c in part.columns), strict=True)


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = []
    for column in schema.split(", "):
        name, kind = column.split(" ")
        fields.append(pa.field(name, {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[kind]))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(fields), fields, strict=True)], schema=pa.schema(fields))


def turns_of(formatted: str, form: Format, unescape) -> Iterator[tuple[str, str]]:
    """Roles and contents of a piece of formatted text, as they were."""
    end = 0
    for found in re.compile(form.turn, re.S).finditer(formatted):
        if found.start() != end:
            raise ValueError(f"no turn where one should start: {formatted[end : end + 40]!r}")
        end = found.end()
        yield unescape(found[1]), unescape(found[2])
    if end != len(formatted):
        raise ValueError(f"no turn where one should start: {formatted[end : end + 40]!r}")


def read_turns(pieces: DataFrame, form: Format = INSTRUCT) -> DataFrame:
    """conv_id, at, role, text: the turns of formatted conversations, ``at`` counting within block and piece."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unescape = Template(form.source).unescape
        for conv_id, no_id, block, piece, _, formatted, _ in in_slices(batches, "formatted"):
            found = list(turns_of(formatted, form, unescape))
            yield as_batch([(None if no_id else conv_id, block, piece, at, role, text) for at, (role, text) in enumerate(found)], schema)

    schema = "conv_id long, block long, piece int, at int, role string, text string"
    return pieces.mapInArrow(read, schema)


class Digest:
    """What is read back of one conversation, piece by piece."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.formatted_chars = 0

    def add(self, formatted: str, spans: list[int], form: Format, unescape) -> None:
        for role, text in turns_of(formatted, form, unescape):
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            self.n_turns += 1
        for start, end in zip(spans[::2], spans[1::2], strict=True):
            text = unescape(formatted[start:end])
            self.loss.update(text.encode("utf-8", "surrogatepass"))
            self.loss_chars += len(text)
        self.formatted_chars += len(formatted)

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


def digest_conversations(pieces: DataFrame, form: Format = INSTRUCT) -> DataFrame:
    """One row a conversation, read back from its pieces: the digests of its turns and of what is under its loss mask."""
    both, none = f"{PIECES}, {DIGESTS}", (None,) * 5

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unescape = Template(form.source).unescape
        rows: list[tuple] = []
        size = 0
        for *keys, whole, formatted, spans in in_slices(batches, "formatted"):
            if whole:
                digest = Digest()
                digest.add(formatted, spans, form, unescape)
                rows.append((*keys, whole, None, None, *digest.row()))
            else:
                rows.append((*keys, whole, formatted, spans, *none))
                size += len(formatted)
            if size >= PIECE or len(rows) >= 10000:
                yield as_batch(rows, both)
                rows, size = [], 0
        yield as_batch(rows, both)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unescape = Template(form.source).unescape
        rows, current, digest = [], None, Digest()
        for conv_id, no_id, _, _, whole, formatted, spans, *found in in_slices(batches, "formatted"):
            if current not in (None, (conv_id, no_id)):
                rows.append((current[0], current[1], *digest.row()))
                digest = Digest()
            current = None if whole else (conv_id, no_id)
            if whole:
                digest = Digest()
                rows.append((conv_id, no_id, *found))
            else:
                digest.add(formatted, spans, form, unescape)
            if len(rows) >= 10000:
                yield as_batch(rows, schema)
                rows = []
        if current:
            rows.append((*current, *digest.row()))
        yield as_batch(rows, schema)

    schema = f"conv_id long, no_id boolean, {DIGESTS}"
    found = pieces.mapInArrow(here, both).repartition("conv_id", "no_id").sortWithinPartitions("conv_id", "no_id", "block", "piece").mapInArrow(joined, schema)
    return found.select(F.when(~F.col("no_id"), F.col("conv_id")).alias("conv_id"), *(c.split(" ")[0] for c in DIGESTS.split(", ")))


#: DuckDB SQL for the rows of op13: a turn renders as 22 characters, its role and its text, and a backslash for each escape.
OP13_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]'))
), sized AS (
  SELECT *, length('<s>[INST]  [/INST]</s>') + length(role) + length(text)
    + len(regexp_extract_all(role || '|' || text, '<\\*/?s>|\[\\*/?INST\]')) AS chars,
    CASE WHEN role = 'assistant' THEN text ELSE '' END AS loss
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(length(loss)) AS BIGINT) AS loss_chars, sha256(string_agg(loss, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
