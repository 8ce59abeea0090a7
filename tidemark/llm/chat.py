r"""Chat formatting checked by a grammar round trip.

A formatted turn is ``<|turn|>`` role newline text ``<|end|>`` newline. The text is put in as it is, and the result is
read by the same parser that reads whole conversations; where it does not give back exactly that one turn, control
strings inside are escaped (``<|`` becomes ``<\|``, ``<\|`` becomes ``<\\|`` and so on, and in roles a newline becomes
``\n``) and it is read again. The parser takes one backslash from each, so escaping is reversible. Every turn starts and
ends with a marker, hence a conversation reads back as its turns do.

Conversations are written turn by turn from sorted partitions, in parts of about ``part_chars`` code points that hold
whole turns, so no conversation has to fit into memory or one cell. Null roles and texts count as empty; null
conv_ids form one conversation; turns of equal number follow by role and text, repeated rows each count; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import text_or_empty

TURN, END = "<|turn|>", "<|end|>\n"
PART_CHARS = 1 << 20
PARTS = "conv_id bigint, part bigint, formatted string, loss array<struct<start: bigint, stop: bigint>>"
_OPEN = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_ROLE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return _OPEN.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def _escape_role(role: str) -> str:
    return escape(role).replace("\\", "\\\\").replace("\n", "\\n")


def _unescape_role(role: str) -> str:
    return unescape(_ROLE.sub(lambda m: "\n" if m[1] == "n" else m[1], role))


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """The turns of a formatted text, or None where it doesn't follow the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(TURN, at):
            return None
        line = formatted.find("\n", at)
        stop = formatted.find(END, line + 1)
        role = formatted[at + len(TURN) : line]
        if line < 0 or stop < 0 or TURN in role or "<|" in formatted[line + 1 : stop]:
            return None
        turns.append((_unescape_role(role), unescape(formatted[line + 1 : stop])))
        at = stop + len(END)
    return turns


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn as formatted, and where its text begins and ends."""
    for name, body in ((role, text), (_escape_role(role), escape(text))):
        out = f"{TURN}{name}\n{body}{END}"
        if parse(out) == [(role, text)]:
            begin = len(TURN) + len(name) + 1
            return out, begin, begin + len(body)
    raise ValueError("a turn does not survive the round trip")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


_SPAN = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
_PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(_SPAN))])
_READ = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_READ_ARROW = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in _READ.split(", "))])


def format_conversations(conversations: DataFrame, loss_role: str = "assistant", part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, formatted, loss) of ``conversations(conv_id, turn, role, text)``; ``loss`` has the spans of
    the texts of ``loss_role`` within the part, in code points."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, part, pieces, spans, size, open_ = None, 0, [], [], 0, False
        for conv_id, role, text in _runs(batches):
            new = open_ and conv_id != conv
            if open_ and (new or size >= part_chars):
                yield _emit([(conv, part, "".join(pieces), spans)], _PARTS)
                part, pieces, spans, size = part + 1, [], [], 0
            if new or not open_:
                conv, part, open_ = conv_id, 0, True
            out, begin, stop = format_turn(role, text)
            if role == loss_role:
                spans.append({"start": size + begin, "stop": size + stop})
            pieces.append(out)
            size += len(out)
        if open_:
            yield _emit([(conv, part, "".join(pieces), spans)], _PARTS)

    rows = conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint").alias("turn"), text_or_empty("role").alias("role"), text_or_empty("text").alias("text")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(write, PARTS)


def read_back(parts: DataFrame) -> DataFrame:
    """One row per conversation, from the formatted parts alone: the number and digest of the turns parsed, of the
    text under the loss mask, and the length."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, conv, open_ = [], None, False
        for conv_id, formatted, loss in _runs(batches):
            if not open_ or conv_id != conv:
                if open_:
                    done.append((conv, n, turns.hexdigest(), chars, masked.hexdigest(), size))
                conv, open_, n, chars, size = conv_id, True, 0, 0, 0
                turns, masked = hashlib.sha256(), hashlib.sha256()
            parsed = parse(formatted)
            if parsed is None:
                raise ValueError(f"conversation {conv_id} does not parse")
            for role, text in parsed:
                turns.update(f"{role}\n{text}\n".encode())
            for span in loss:
                text = unescape(formatted[span["start"] : span["stop"]])
                chars += len(text)
                masked.update(text.encode())
            n += len(parsed)
            size += len(formatted)
            if len(done) >= 1000:
                yield _emit(done, _READ_ARROW)
                done = []
        if open_:
            done.append((conv, n, turns.hexdigest(), chars, masked.hexdigest(), size))
            yield _emit(done, _READ_ARROW)

    dealt = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.select("conv_id", "formatted", "loss").mapInArrow(read, _READ)


def op4_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_conversations(rows.unionByName(more)))


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(17 + length(role) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
