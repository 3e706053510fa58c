"""Chat formatting: event-sourced reconstruction, then a reversible template with a loss mask.

A log holds events (conv_id, turn, seq, kind, role, text): `message` starts a message of its turn, `delta` appends to it,
`edit` replaces its text, `regenerate` empties it for the deltas that follow. An edit or a regeneration also
voids what later turns had said before it (events with a smaller seq). The log is partitioned by conversation,
sorted by turn and sequence, and folded as a stream: a task holds one message at a time, however long a conversation is.

Each final message becomes a segment; a conversation's document is its segments joined. A user's turn is
`<s>[INST] text [/INST]`, an assistant's ` text </s>`, a system's `<s><<SYS>> text <</SYS>>`, any other role's
`<s>[ROLE:name] text [/ROLE]` with the name percent-encoded. Control strings inside texts get a backslash after their
first character, and those with backslashes there one more, which reading takes away again. The loss mask is a
range of code points of the segment: the whole text of an assistant.

Defined results: null text counts as empty and null role as ''; rows with equal turns are messages of their own,
ordered by role and then by a hash of the text; a null conv_id is a conversation, a null turn comes first; an empty log gives no rows;
other columns are ignored; a conversation -1 of the table is one with the control conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<s><<SYS>> ", " <</SYS>>")}
DELTA_CHARS = 1024
FLUSH_CHARS = 4 << 20
SEGMENT = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("segment", T.StringType()), T.StructField("mask_start", T.LongType()), T.StructField("mask_end", T.LongType())])


#: A control string with any number of backslashes after its first character.
ESCAPE = re.compile(r"(<)(\\*(?:/?s>|</?SYS>>))|(\[)(\\*(?:/?INST\]|/?ROLE[:\]]))")


def _one_more(m: re.Match) -> str:
    return f"{m[1] or m[3]}\\{m[2] or m[4]}"


def _one_less(m: re.Match) -> str:
    return f"{m[1] or m[3]}{(m[2] or m[4])[1:]}"


UNESCAPE = re.compile(r"(<)(\\+(?:/?s>|</?SYS>>))|(\[)(\\+(?:/?INST\]|/?ROLE[:\]]))")


def escape(text: str) -> str:
    return ESCAPE.sub(_one_more, text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(_one_less, text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """(segment, mask start, mask end) of one message; an empty range where there is no loss."""
    body = escape(text)
    if role in FORMS:
        before, after = FORMS[role]
    else:
        before, after = f"<s>[ROLE:{quote(role, safe='')}] ", " [/ROLE]"
    start = len(before)
    return before + body + after, start, start + len(body) if role == "assistant" else start


TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<s><<SYS>> (?P<system>.*?) <</SYS>>|<s>\[ROLE:(?P<name>[^\] ]*)\] (?P<other>.*?) \[/ROLE\]| (?P<assistant>.*?) </s>", re.S)


def read(document: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in a rendered document or segment."""
    place = 0
    while place < len(document):
        m = TURN.match(document, place)
        if m is None:
            raise ValueError(f"no turn at {place}")
        kind = "other" if m["name"] is not None else next(k for k in FORMS if m[k] is not None)
        yield (unquote(m["name"]) if kind == "other" else kind), unescape(m[kind])
        place = m.end()


def fold(events: Iterable[tuple]) -> Iterator[tuple]:
    """(conv_id, turn, role, text) of the final messages; events are sorted by conversation, turn and sequence."""
    key, void, void_next, message = None, None, None, None
    for conv, turn, seq, kind, role, text in events:
        if message is not None and (message[0], message[1]) != (conv, turn):
            yield (*message[:3], "".join(message[3]))
            message = None
        if key is None or key[0] != conv:
            void = void_next = None
        elif key[1] != turn:
            void = void_next if void is None or (void_next is not None and void_next > void) else void
        key = (conv, turn)
        if void is not None and seq is not None and seq < void:
            continue
        if kind == "message":
            if message is not None:
                yield (*message[:3], "".join(message[3]))
            message = [conv, turn, role or "", [text or ""]]
            continue
        if message is None:
            message = [conv, turn, role or "", []]
        if kind == "delta":
            message[3].append(text or "")
        else:
            message[3] = [text or ""] if kind == "edit" else []
            if seq is not None and (void_next is None or seq > void_next):
                void_next = seq
    if message is not None:
        yield (*message[:3], "".join(message[3]))


def _rows(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(n).to_pylist() for n in names], strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema, size) -> Iterator[pa.RecordBatch]:
    """Batches of rows of some FLUSH_CHARS code points each."""
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += size(row)
        if chars >= FLUSH_CHARS or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


SEGMENT_ARROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("segment", pa.string()), ("mask_start", pa.int64()), ("mask_end", pa.int64())])
READ_ARROW = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
READ = T.StructType([T.StructField(f.name, T.LongType() if f.type == pa.int64() else T.StringType()) for f in READ_ARROW])


def format_logs(events: DataFrame, *tie: str) -> DataFrame:
    """Segments (SEGMENT) of all conversations, in order inside each partition; a conversation is in one partition. tie: columns that part messages of one turn."""
    names = ["conv_id", "turn", "seq", "kind", "role", "text"]
    ordered = events.repartition("conv_id").sortWithinPartitions("conv_id", "turn", *tie, "seq").select(*names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((conv, turn, *render(role, text)) for conv, turn, role, text in fold(_rows(batches, names)))
        yield from _batches(rows, SEGMENT_ARROW, lambda r: len(r[2]))

    return ordered.mapInArrow(run, SEGMENT)


def digest_segments(segments: DataFrame) -> DataFrame:
    """Reads rendered conversations back; the segments lie in order, each conversation in one partition, as format_logs leaves them."""

    def read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        conv, state = None, None
        for own, segment, start, end in _rows(batches, ["conv_id", "segment", "mask_start", "mask_end"]):
            if state is None or own != conv:
                if state is not None:
                    yield _digest(conv, state)
                conv, state = own, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in read(segment):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            lost = unescape(segment[start:end])
            state[2] += len(lost)
            state[3].update(lost.encode())
            state[4] += len(segment)
        if state is not None:
            yield _digest(conv, state)

    return segments.mapInArrow(lambda batches: _batches(read_back(batches), READ_ARROW, lambda r: 100), READ)


def _digest(conv, state) -> tuple:
    n, turns, loss, loss_sha, chars = state
    return conv, n, turns.hexdigest(), loss, loss_sha.hexdigest(), chars


def events_of(conversations: DataFrame, delta_chars: int = DELTA_CHARS) -> DataFrame:
    """A log from a table of finished turns: an assistant's text arrives as deltas, any other in one message. The columns tie1.. part messages of one turn."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"),
        F.xxhash64(text).alias("tie1"), F.monotonically_increasing_id().alias("tie2"),
    )
    streamed = F.col("role") == "assistant"
    first = F.struct(F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), F.when(streamed, "").otherwise(F.col("text")).alias("text"))
    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.length("text") - 1) / delta_chars).cast("int")),
        lambda i: F.struct((i + 1).cast("long").alias("seq"), F.lit("delta").alias("kind"), F.substring(F.col("text"), i * delta_chars + 1, F.lit(delta_chars)).alias("text")),
    )
    log = F.when(streamed & (F.length("text") > 0), F.concat(F.array(first), parts)).otherwise(F.array(first))
    return base.select("conv_id", "turn", "role", "tie1", "tie2", F.explode(log).alias("e")).select("conv_id", "turn", "role", "tie1", "tie2", "e.seq", "e.kind", "e.text")


def control_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts are made of control strings."""
    said = "</s>[INST] ok [/INST]"
    return spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")


def format_digest(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(control_conversation(conversations.sparkSession))
    return digest_segments(format_logs(events_of(turns), "role", "tie1", "tie2"))
