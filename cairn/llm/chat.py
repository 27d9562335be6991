r"""Chat formatting by event-sourced reconstruction (operator 9).

A log holds events of conversations.  It is partitioned by conversation, sorted by sequence number and folded in one pass:

* `message` begins a message with a role and a text,
* `delta` appends its text to the message that it names (null: the last one),
* `edit` replaces the text of the message that it names,
* `regenerate` drops the messages from the one that it names on and begins that message anew with its role and text.

`target` counts the messages of the conversation from 0, and below 0 from the last one (-1).  `as_events` writes the log that a chat leaves behind: each turn begins as a draft
that an edit, or for an assistant a regeneration, replaces by the first piece of its text; the others are streamed as deltas.  `fold` returns a row for each final message, `render` turns those rows into
segments of the formatted conversation with a loss mask, and `read_back` restores messages from segments alone.

The template of a message is `<s>[INST]role\ntext[/INST]</s>`.  Inside a role or text, a backslash is put before each backslash and
into each control string after its first character, and in a role before each line feed; reading drops the backslash of each pair.
So no text can hold a control string, and every text comes back as it was.

Defined results: null roles and texts count as empty; a null kind counts as `message`; null sequence numbers come first; equal sequence
numbers are put in order by kind, role and text, and repeated events count each; events that name a message that does not exist begin
none and change none (a delta without any message begins one with an empty role); unknown kinds are passed over; null conversations make
up one conversation; an empty log gives an empty table; other columns are not read.  A fold holds the texts of one conversation at a
time, beyond SPOOLED bytes in a scratch file of the task, where Spark itself spills to; no other task reads it, and a task that runs again
writes its own.
"""

from __future__ import annotations

import hashlib
import os
import re
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean, table

#: The template's control strings.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
SPOOLED = 16 << 20
#: What a turn says before it is edited or regenerated, and the pieces in which its text comes.
DRAFT, PIECES = "...", 4
OUT_ROWS, OUT_CHARS = 2000, 2 << 20

_hide = re.compile(r"\\|<(?=/?s>)|\[(?=/?INST\])").sub
_show = re.compile(r"\\(.)", re.DOTALL).sub
_segment = re.compile(r"<s>\[INST\]((?:[^\\\n]|\\.)*)\n(.*)\[/INST\]</s>", re.DOTALL).fullmatch

MESSAGES = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), T.StructField("last", T.BooleanType())])
SEGMENTS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("segment", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_chars", T.LongType()), T.StructField("last", T.BooleanType())])
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _hide(lambda m: "\\\\" if m.group() == "\\" else m.group() + "\\", text)


def unescape(text: str) -> str:
    return _show(r"\1", text)


def render_message(role: str, text: str, trained=("assistant",)) -> tuple[str, int, int]:
    """The segment of a message, and where its part under the loss mask begins and how long it is, in code points."""
    head = f"<s>[INST]{escape(role)}".replace("\n", "\\\n") + "\n"
    body = escape(text)
    return f"{head}{body}[/INST]</s>", len(head), len(body) if role in trained else 0


def read_message(segment: str) -> tuple[str, str]:
    if not (m := _segment(segment)):
        raise ValueError("not a segment of this template")
    return unescape(m[1]), unescape(m[2])


class Conversation:
    """The fold's state: roles and texts so far, the texts in a file that leaves memory when it grows."""

    def __init__(self):
        self.file = tempfile.SpooledTemporaryFile(max_size=SPOOLED, dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
        self.messages: list[tuple[str, list[tuple[int, int]]]] = []

    def store(self, text: str) -> tuple[int, int]:
        at = self.file.seek(0, 2)
        return at, self.file.write(text.encode("utf-8", "surrogatepass"))

    def apply(self, kind: str | None, target: int | None, role: str | None, text: str | None) -> None:
        role, text, n = role or "", text or "", len(self.messages)
        if target is not None and target < 0:
            target += n
        if kind in (None, "message"):
            self.messages.append((role, [self.store(text)]))
        elif kind == "delta":
            at = n - 1 if target is None else target
            if not n and target is None:
                self.messages.append((role, [self.store(text)]))
            elif 0 <= at < n:
                self.messages[at][1].append(self.store(text))
        elif kind == "edit" and target is not None and 0 <= target < n:
            self.messages[target][1][:] = [self.store(text)]
        elif kind == "regenerate" and target is not None and 0 <= target < n:
            del self.messages[target:]
            self.messages.append((role, [self.store(text)]))

    def __iter__(self):
        for role, parts in self.messages:
            got = []
            for at, n in parts:
                self.file.seek(at)
                got.append(self.file.read(n))
            yield role, b"".join(got).decode("utf-8", "surrogatepass")


def _batched(rows, schema: T.StructType, text: int):
    """Arrow batches of rows, of bounded rows and characters."""
    names, kinds = schema.names, [pa.int64() if f.dataType == T.LongType() else pa.bool_() if f.dataType == T.BooleanType() else pa.string() for f in schema.fields]
    out, chars = [], 0
    for row in rows:
        out.append(row)
        chars += len(row[text])
        if len(out) >= OUT_ROWS or chars >= OUT_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out, chars = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def fold(events: DataFrame) -> DataFrame:
    """A row for each final message of events(conv_id, seq, kind, target, role, text), conversations together and in order."""
    sorted_log = events.select("conv_id", "seq", "kind", "target", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "seq", "kind", "role", "text")

    def run(batches):
        def rows():
            conv, state = None, None

            def final():
                n = len(state.messages)
                for i, (role, text) in enumerate(state):
                    yield conv, i, role, text, i == n - 1

            for b in batches:
                for c, kind, target, role, text in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in ("conv_id", "kind", "target", "role", "text"))):
                    if state is None or c != conv:
                        if state is not None:
                            yield from final()
                        conv, state = c, Conversation()
                    state.apply(kind, target, role, text)
            if state is not None:
                yield from final()

        return _batched(rows(), MESSAGES, 3)

    return sorted_log.mapInArrow(lean(run), MESSAGES)


def render(messages: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """A row for each message with its segment of the formatted conversation and the segment's part under the loss mask."""

    def run(batches):
        def rows():
            for b in batches:
                for c, pos, role, text, last in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in MESSAGES.names)):
                    segment, start, n = render_message(role or "", text or "", trained)
                    yield c, pos, segment, start, n, last

        return _batched(rows(), SEGMENTS, 2)

    return messages.mapInArrow(lean(run), SEGMENTS)


def read_back(segments: DataFrame) -> DataFrame:
    """A row of digests for each conversation, of what its segments say; segments of a conversation stand together and in order."""

    def run(batches):
        fresh = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
        out, state = [], fresh()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(zip(*out))], [x.split()[0] for x in DIGESTS.split(", ")])
        for b in batches:
            for c, _, segment, start, n, last in zip(*(b.column(b.schema.get_field_index(x)).to_pylist() for x in SEGMENTS.names)):
                role, text = read_message(segment)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                learnt = unescape(segment[start : start + n])
                state[2] += len(learnt)
                state[3].update(learnt.encode("utf-8", "surrogatepass"))
                state[4] += len(segment)
                if last:
                    out.append((c, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))
                    state = fresh()
                    if len(out) >= OUT_ROWS:
                        yield flush()
                        out = []
        if out:
            yield flush()

    return segments.mapInArrow(lean(run), DIGESTS)


def as_events(conversations: DataFrame) -> DataFrame:
    """The log of a table with a row for each turn: a draft, what replaces it, and the rest of the text in PIECES.  Turns of equal number
    are put in order by a hash of role and text; no two rows mix their events."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("row", F.struct("turn", F.xxhash64("role", "text").alias("tie"), F.monotonically_increasing_id().alias("id")))
    piece = F.greatest(F.lit(1), F.ceil(F.length("text") / PIECES)).cast("int")
    steps = F.ceil(F.length("text") / piece)
    events = rows.select("conv_id", "row", "role", "text", piece.alias("piece"), F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(1), steps))).alias("step"))
    first = F.when(F.col("role") == "assistant", "regenerate").otherwise("edit")
    kind = F.when(F.col("step") == 0, "message").when(F.col("step") == 1, first).otherwise("delta")
    text = F.when(F.col("step") == 0, F.lit(DRAFT)).otherwise(F.substring("text", ((F.col("step") - 1) * F.col("piece") + 1).cast("int"), F.col("piece")))
    return events.select("conv_id", F.struct("row", "step").alias("seq"), kind.alias("kind"), F.when(F.col("step") > 0, F.lit(-1).cast("long")).alias("target"), F.when(F.col("step") <= 1, F.col("role")).alias("role"), text.alias("text"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted; digests of what the formatted segments give back."""
    said = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.sql(f"select -7L as conv_id, turn, role, '{said}' as text from values (0L, 'user'), (1L, 'assistant') as t(turn, role)")
    return read_back(render(fold(as_events(turns.unionByName(extra)))))
