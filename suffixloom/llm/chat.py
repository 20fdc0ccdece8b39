"""Chat formatting: typed content parts flattened by a visitor, turns marked, control strings escaped.

A message is text or a list of typed parts.  The visitor writes text parts (escaped) and, for image,
audio and document parts, an ordered placeholder; it records each attachment's reference, its place
and the number of tokens that the placeholder expands to.

A conversation is written as ``<s>``, then for each turn ``[INST]role[/INST]text</s>``.  Where a
role or text holds a control string, a backslash goes in after its first character (and one more
if there are some already), so control strings in the output are always the template's own and
the original comes back exactly.  Text parts that stand side by side are escaped as one text, so a
control string dealt over several parts is found too.  No control string has the first character of
another inside, so none can arise where a text meets a placeholder or the template.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import named

OPEN, ROLE, ROLE_END, TURN_END = "<s>", "[INST]", "[/INST]", "</s>"
#: Placeholders of the part types other than text.
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
CONTROL = (OPEN, ROLE, ROLE_END, TURN_END, *PLACEHOLDER.values())
#: What a placeholder expands to: tokens of an image tile of ``TILE`` pixels square, of a second of sound, of a page.
TILE, TOKENS_PER_TILE, TOKENS_PER_SECOND, TOKENS_PER_PAGE = 448, 256, 25, 512
#: Greatest width, height, length in seconds or number of pages that a part may state.
MOST = 10_000_000

_FIND = re.compile("|".join(rf"{re.escape(c[0])}(\\*){re.escape(c[1:])}" for c in CONTROL))
_ESCAPED = re.compile("|".join(rf"{re.escape(c[0])}\\(\\*){re.escape(c[1:])}" for c in CONTROL))


def escape(text: str) -> str:
    """``text`` with a backslash more in each control string."""
    return _FIND.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    return _ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


@dataclass
class Attachment:
    """A part that is no text: its type, reference, place among the conversation's attachments, offset and tokens."""

    kind: str
    ref: str
    number: int
    offset: int
    tokens: int


class Malformed(Exception):
    """A part of a known type whose fields make no sense."""


def number(part: dict, name: str, default: float) -> float:
    """A field that counts something; missing, null and zero are the default."""
    value = part.get(name)
    if value is None:
        return default
    if isinstance(value, bool) or not isinstance(value, (int, float)) or not 0 <= value <= MOST:  # NaN is neither
        raise Malformed(name)
    return value or default


def string(part: dict, *names: str) -> str:
    """The first of the fields that is there and not empty."""
    values = [part.get(n) for n in names]
    if any(v is not None and not isinstance(v, str) for v in values):
        raise Malformed(names)
    return next(filter(None, values), "")


@dataclass
class Flattener:
    """Visits a message's parts in order; ``out`` is the flat text so far, ``pending`` text that is yet to be escaped."""

    out: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[Attachment] = field(default_factory=list)
    pending: list[str] = field(default_factory=list)

    def put(self, text: str) -> None:
        """Text of the template; what was pending goes before it."""
        if self.pending:
            before, self.pending = escape("".join(self.pending)), []
            self.put(before)
        self.out.append(text)
        self.length += len(text)

    def end(self) -> int:
        """Where the flat text ends, with all that was pending."""
        self.put("")
        return self.length

    def visit(self, content: Any) -> None:
        """Null is nothing, a string is a text part, a list is its parts, a dict is a part by its ``type``.

        A part of an unknown type, or with a field that makes no sense (a width that is no number, not
        finite, negative or over ``MOST``; a text or reference that is no string), is text: its JSON.
        """
        if content is None:
            return
        if isinstance(content, str):
            self.pending.append(content)
            return
        if isinstance(content, list):
            for part in content:
                self.visit(part)
            return
        try:
            getattr(self, f"visit_{content.get('type')}", self.visit_unknown)(content)
        except Malformed:
            self.visit_unknown(content)

    def visit_text(self, part: dict) -> None:
        self.pending.append(string(part, "text"))

    def visit_image(self, part: dict) -> None:
        across, down = (math.ceil(number(part, k, TILE) / TILE) for k in ("width", "height"))
        self.attach("image", part, across * down * TOKENS_PER_TILE)

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, max(1, round(number(part, "seconds", 0) * TOKENS_PER_SECOND)))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, math.ceil(number(part, "pages", 1)) * TOKENS_PER_PAGE)

    def visit_unknown(self, part: dict) -> None:
        self.pending.append(json.dumps(part, sort_keys=True, ensure_ascii=False))

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        ref = string(part, "ref", "url")
        self.attachments.append(Attachment(kind, ref, len(self.attachments), self.end(), tokens))
        self.put(PLACEHOLDER[kind])


@dataclass
class Formatted:
    """A conversation's text, the code points under the loss mask, and its attachments."""

    text: str
    loss: list[tuple[int, int]]
    attachments: list[Attachment]


def format_turns(turns: list[tuple[str | None, Any]], trained: tuple[str, ...] = ("assistant",)) -> Formatted:
    """Write (role, content) turns; the loss mask covers the content of the roles in ``trained``."""
    flat, loss = Flattener(), []
    flat.put(OPEN)
    for role, content in turns:
        flat.put(ROLE + escape(role or "") + ROLE_END)
        begin = flat.length
        flat.visit(content)
        end = flat.end()
        if role in trained:
            loss.append((begin, end))
        flat.put(TURN_END)
    return Formatted("".join(flat.out), loss, flat.attachments)


_TURN = re.compile(r"\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
_HOLDER = re.compile("(" + "|".join(map(re.escape, PLACEHOLDER.values())) + ")")
_KIND = {v: k for k, v in PLACEHOLDER.items()}


def read_content(text: str) -> str | list:
    """A turn's content, unescaped: text, or where placeholders are in it a list of texts and parts ``{"type": ...}``.

    A placeholder that was written in a text is escaped, so it comes back as text.
    """
    if not _HOLDER.search(text):
        return unescape(text)
    return [{"type": _KIND[p]} if p in _KIND else unescape(p) for p in _HOLDER.split(text) if p]


def read_turns(text: str, attachments: list | None = None) -> list[tuple[str, str | list]]:
    """(role, content) of each turn of a formatted conversation, as ``read_content`` gives it.

    With the conversation's ``attachments`` (``Attachment``s or rows of them) parts have their references too.
    """
    if not text.startswith(OPEN):
        raise ValueError("not a formatted conversation")
    turns, at, refs = [], len(OPEN), iter(attachments or ())
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"broken turn at {at}")
        content = read_content(m[2])
        if attachments is not None and isinstance(content, list):
            content = [p | {"ref": next(refs).ref} if isinstance(p, dict) else p for p in content]
        turns.append((unescape(m[1]), content))
        at = m.end()
    return turns


def content_text(content: str | list) -> str:
    """A turn's content as one text, placeholders for its parts."""
    return content if isinstance(content, str) else "".join(PLACEHOLDER[p["type"]] if isinstance(p, dict) else p for p in content)


ATTACHMENT = StructType([StructField("kind", StringType()), StructField("ref", StringType()), StructField("number", LongType()), StructField("offset", LongType()), StructField("tokens", LongType())])
SPAN = StructType([StructField("begin", LongType()), StructField("end", LongType())])
FORMATTED = StructType([StructField("formatted", StringType()), StructField("loss", ArrayType(SPAN)), StructField("attachments", ArrayType(ATTACHMENT)), StructField("attachment_tokens", LongType())])


def format_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "text", parts_json: bool = False) -> DataFrame:
    """``conv, formatted, loss, attachments, attachment_tokens``: a row for each conversation.

    ``content`` is text, or with ``parts_json`` a JSON list of typed parts (anything else counts as text, also
    a list that UTF-8 cannot hold or that is nested too deeply to read).  Turns go by ``turn``; nulls come first and ties go by role and content, so repeated rows stand
    side by side.  Null content is empty, a null role has no name, and rows with a null conversation key make
    one conversation.  Offsets count code points.  An empty table gives no rows.  A conversation becomes one
    value of a row and must fit in one; nothing else is gathered.
    """
    one = F.struct(named(turn).alias("turn"), named(role).alias("role"), named(content).cast("string").alias("content"))
    grouped = turns.groupBy(named(conv).alias("conv")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    schema = StructType([grouped.schema["conv"], *FORMATTED.fields])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                done = [format_turns([(t["role"], _parts(t["content"]) if parts_json else t["content"]) for t in ts]) for ts in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([f.text for f in done], pa.string()),
                        pa.array([[{"begin": a, "end": z} for a, z in f.loss] for f in done], pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                        pa.array([[vars(a) for a in f.attachments] for f in done], pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("number", pa.int64()), ("offset", pa.int64()), ("tokens", pa.int64())]))),
                        pa.array([sum(a.tokens for a in f.attachments) for f in done], pa.int64()),
                    ],
                    names=schema.names,
                )

    return grouped.mapInArrow(each, schema)


def _parts(content: str | None) -> Any:
    try:
        parts = json.loads(content) if content else content
        if not isinstance(parts, list) or not all(isinstance(p, (dict, str)) for p in parts):
            return content
        json.dumps(parts, ensure_ascii=False).encode()  # a lone surrogate raises
    except (ValueError, RecursionError):
        return content
    return parts


DIGESTS = "conv_id {}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digests(formatted: DataFrame) -> DataFrame:
    """Digests of formatted conversations, read back from ``formatted`` and ``loss`` alone."""
    part = formatted.select("conv", "formatted", "loss")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, loss in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                turns = [(r, content_text(c)) for r, c in read_turns(text)]
                under = [unescape(text[x["begin"] : x["end"]]) for x in loss]
                sha = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
                out.append((len(turns), sha(f"{r}\n{t}\n" for r, t in turns), sum(map(len, under)), sha(under), len(text)))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return part.mapInArrow(each, DIGESTS.format(part.schema["conv"].dataType.simpleString()))


#: The conversation that op10 adds to the table.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's turns and loss text, as digests read back from the formatted output."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id bigint, turn bigint, role string, text string")
    return digests(format_conversations(rows.unionByName(added)))


def _sql_escaped(text: str) -> str:
    for c in CONTROL:
        pattern = "".join(rf"\{x}" if not x.isalnum() else x for x in c[1:])
        text = f"regexp_replace({text}, '(\\{c[0]})(\\\\*{pattern})', '\\1\\\\\\2', 'g')"
    return text


OP10_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS r, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, {_sql_escaped("text")} AS et, {_sql_escaped("r")} AS er FROM t)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(6 + length(er) + 7 + length(et) + 4) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
