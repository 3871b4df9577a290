"""Chat formatting by event-sourced reconstruction.

A log of events is dealt by conversation and sorted by the message an event
concerns, then by sequence; one pass folds each message's events (streamed
deltas, edits, regenerations) into its final text and renders it.  The pass
holds one message at a time, so a conversation of any length needs no more
memory than its longest message.

Rendering of a turn::

    ### <role>: <text></turn>\\n

Inside roles and texts a backslash stands before each ``\\``, ``#``, ``<`` and
``:`` (``:`` in roles only), so an unescaped ``#`` or ``<`` is always a control
string and unescaping gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import small_batches

OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
_TURN = re.compile(r"### ((?:\\.|[^\\:#<])*): ((?:\\.|[^\\#<])*)</turn>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

TURNS = "conv_id long, position long, role string, rendered string, start long, loss_start long, loss_end long"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str, chars: str = "\\#<") -> str:
    return "".join("\\" + c if c in chars else c for c in text) if any(c in text for c in chars) else text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def fold(events: Iterable[tuple]) -> Iterator[tuple]:
    """(conv, target, kind, role, text) in log order by conversation and target -> (conv, role, final text)."""
    at, role, parts = None, None, None
    for conv, target, kind, who, text in events:
        if kind == "message" or parts is None or (conv, target) != at:
            if parts is not None:
                yield at[0], role, "".join(parts)
            at, role, parts = (conv, target), who, [text or ""]
        elif kind == "delta":
            parts.append(text or "")
        else:  # an edit replaces the text; a regeneration starts it anew
            parts = [text or ""]
    if parts is not None:
        yield at[0], role, "".join(parts)


def _render(batches: Iterator[pa.RecordBatch], loss_roles: frozenset) -> Iterator[pa.RecordBatch]:
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "target", "kind", "role", "text")), strict=True)

    def packed(out):
        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("rendered", pa.string()), ("start", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    out, held, conv, position, start = [], 0, object(), 0, 0
    for c, role, text in fold(rows()):
        if c != conv:
            conv, position, start = c, 0, 0
        head = OPEN + escape(role or "", "\\#<:") + MIDDLE
        body = escape(text)
        rendered = head + body + CLOSE
        loss = role in loss_roles
        out.append((c, position, role, rendered, start, start + len(head) if loss else None, start + len(head) + len(body) if loss else None))
        position, start, held = position + 1, start + len(rendered), held + len(rendered)
        if len(out) >= 2000 or held > 4_000_000:
            yield packed(out)
            out, held = [], 0
    if out:
        yield packed(out)


def format_events(events: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Render an event log of conversations.

    ``events``: conv_id, seq, kind (message, delta, edit or regenerate; null:
    message), target (the seq of the message concerned; null: its own seq), role, text.
    A message event opens a message; events of one target apply to the last
    message opened there, in order of seq; an event that concerns no open message
    opens one.  Ties of seq are ordered by kind (messages first), role and text,
    nulls first; a repeated message is a turn of its own, and a repeated delta
    is appended again (edits and regenerations repeat without effect).  Null
    texts and roles are empty.  Rows without conv_id are one conversation.
    Texts of any length are held one message at a time.  Further columns are
    ignored; no events give no rows.

    Returns the turns in order, dealt by conversation: conv_id, position, role,
    rendered (the conversation's text is their concatenation), start, and the
    loss span loss_start, loss_end in code points of the conversation's text
    (null outside ``loss_roles``).
    """
    small_batches(events.sparkSession)
    kind = F.coalesce(F.col("kind"), F.lit("message"))
    log = events.select(F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("target", "seq").cast("long").alias("target"), F.col("seq").cast("long").alias("seq"), kind.alias("kind"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "target", "seq", F.col("kind") != "message", "role", "text")
    return log.mapInArrow(partial(_render, loss_roles=frozenset(loss_roles)), TURNS)


def streamed(rows: DataFrame) -> DataFrame:
    """An event log whose fold gives the turns ``rows`` (conv_id, turn, role, text) back.

    By the hash of a turn its text comes as one message, as a message continued
    by two deltas, as a draft that an edit replaces, or as a draft that is
    regenerated and streamed anew, with events of other turns between them in
    seq.  Turns that share conv_id and turn, or have none, come as plain messages.
    """
    turns = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    turns = turns.repartition("conv_id").withColumn("ties", F.count("*").over(Window.partitionBy("conv_id", "turn")))
    # the later events of a turn have numbers far behind it
    first, late = F.col("turn"), F.col("turn") + F.lit(1 << 20)
    third = F.floor(F.length("text") / 3).cast("int")
    parts = [F.substring("text", F.lit(1), third), F.substring("text", third + 1, third), F.substring("text", 2 * third + 1, F.length("text"))]
    draft = F.concat(F.lit("draft "), F.reverse("text"))
    none = F.lit(None).cast("string")

    def event(seq: Column, kind: str, target: Column, role: Column, text: Column) -> Column:
        return F.struct(seq.alias("seq"), F.lit(kind).alias("kind"), target.cast("long").alias("target"), role.cast("string").alias("role"), text.alias("text"))

    opens = lambda text: event(first, "message", F.lit(None), F.col("role"), text)
    delta = lambda k, text: event(late * 4 + k, "delta", first, none, text)
    kinds = F.when((F.col("ties") > 1) | F.col("turn").isNull(), 0).otherwise(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4)))
    events = (
        F.when(kinds == 0, F.array(opens(F.col("text"))))
        .when(kinds == 1, F.array(delta(2, parts[2]), opens(parts[0]), delta(1, parts[1])))
        .when(kinds == 2, F.array(event(late * 4, "edit", first, none, F.col("text")), opens(draft)))
        .otherwise(F.array(opens(draft), delta(0, F.lit(" and more")), event(late * 4 + 1, "regenerate", first, none, none), delta(3, F.concat(parts[1], parts[2])), delta(2, parts[0])))
    )
    return turns.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.*")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def closed(s):
        return (s["conv"], s["n"], s["turns"].hexdigest(), s["loss_n"], s["loss"].hexdigest(), s["chars"])

    out, now = [], None
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    for batch in batches:
        for conv, rendered, start, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "start", "loss_start", "loss_end")), strict=True):
            if now is None or conv != now["conv"] or start == 0:
                if now is not None:
                    out.append(closed(now))
                now = {"conv": conv, "n": 0, "turns": hashlib.sha256(), "loss_n": 0, "loss": hashlib.sha256(), "chars": 0}
            turn = _TURN.fullmatch(rendered)
            role, text = unescape(turn[1]), unescape(turn[2])
            now["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if a is not None:
                masked = unescape(rendered[a - start : b - start])
                now["loss"].update(masked.encode("utf-8", "surrogatepass"))
                now["loss_n"] += len(masked)
            now["n"] += 1
            now["chars"] += len(rendered)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
            out = []
    if now is not None:
        out.append(closed(now))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def read_back(turns: DataFrame) -> DataFrame:
    """Parse rendered turns, as ``format_events`` deals them, and digest each conversation."""
    return turns.mapInArrow(_digest, DIGEST)
