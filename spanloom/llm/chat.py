"""Chat formatting from an event log.

Events: conv_id, seq, msg_id, op, role, text. message, edit and regenerate set a message's text, delta adds to
it, delete takes it away (a later setting event or delta brings it back). First each message is folded for itself, keyed by
conversation and message, so a long conversation isn't one task's work: only what follows the last setting event counts. Then the
final messages are dealt by conversation, sorted, and rendered as they stream by, with digests kept up; a conversation is
held as its output alone, which is one row (digests only: nothing is held).

Order of a message's events: by seq, nulls first; of equal seq setting events before deltas; then by op, role, text, nulls first. An
event delivered again, equal in all six columns, counts once. Other ops, and a null one, aren't events. A message stands at its least seq (null
if it has one), has the role of its first event with a role, and messages at one place go by role, text, msg_id. A null
msg_id is one message, a null conv_id one conversation.

A turn is rendered ``### role: text</turn>\\n``. In texts ``\\`` is doubled, ``</turn>`` becomes ``<\\/turn>`` and
``### `` becomes ``#\\## ``; in roles ``% : < # newline`` are written as % and two hex digits. So the marks stand
nowhere else and reading back gives what went in.

Null text, role: empty. Rows of the same turn: by role, then text; repeated rows are turns each. Very long texts: as they are. Other
columns aren't read. Empty log: empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>"
END = CLOSE + "\n"
ESCAPED = re.compile(r"\\(.)", re.S)
ROLE_CODES = (("%", "%25"), (":", "%3A"), ("<", "%3C"), ("#", "%23"), ("\n", "%0A"))


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace(CLOSE, "<\\/turn>").replace(OPEN, "#\\## ")


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


def escape_role(role: str) -> str:
    for plain, code in ROLE_CODES:
        role = role.replace(plain, code)
    return role


def unescape_role(role: str) -> str:
    for plain, code in reversed(ROLE_CODES):
        role = role.replace(code, plain)
    return role


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text begins and ends there."""
    head = f"{OPEN}{escape_role(role)}: "
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(turn: str) -> tuple[str, str]:
    """Role and text of one rendered turn."""
    role, _, text = turn[len(OPEN) : -len(END)].partition(": ")
    return unescape_role(role), unescape(text)


def turns(formatted: str) -> list[tuple[str, str]]:
    return [parse(x + END) for x in formatted.split(END)[:-1]]


SETS = ("message", "edit", "regenerate", "delete")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, at: the message's first seq, role, text, msg_id) of the messages that are left."""
    sets = F.col("op").isin(*SETS)
    log = events.where(sets | (F.col("op") == "delta")).select("conv_id", "msg_id", "seq", sets.cast("int").alias("sets"), "op", "role", "text").distinct()
    # a struct orders like an event: nulls are least in it
    log = log.withColumn("at", F.struct("seq", (-F.col("sets")).alias("adds"), "op", "role", "text"))
    message = Window.partitionBy("conv_id", "msg_id")
    log = log.withColumn("last_set", F.max(F.when(F.col("sets") == 1, F.col("at"))).over(message))
    named = F.min(F.when(F.col("role").isNotNull(), F.col("at"))).over(message)
    log = log.withColumn("first", F.min("at").over(message)).withColumn("named", named)
    kept = log.where(F.col("last_set").isNull() | (F.col("at") >= F.col("last_set")))
    parts = F.sort_array(F.collect_list("at"))
    folded = kept.groupBy("conv_id", "msg_id").agg(F.min("first")["seq"].alias("at"), F.min("named")["role"].alias("role"), parts.alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: F.when(x["op"] == "delete", "").otherwise(F.coalesce(x["text"], F.lit("")))), "")
    gone = (F.size("parts") == 1) & (F.get("parts", F.lit(0))["op"] == "delete")
    return folded.where(~gone).select("conv_id", "at", "role", text.alias("text"), "msg_id")


SCHEMA = "conv_id long, formatted string, spans array<struct<start:long,stop:long>>, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _render(loss_role: str, whole: bool):
    """Messages in order to conversations; the digests are of what is read back from each rendered turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def fresh(conv):
            return {"conv": conv, "parts": [], "spans": [], "n": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0}

        def row(s):
            return (s["conv"], "".join(s["parts"]), s["spans"], s["n"], s["all"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"])

        def out(rows):
            types = (pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["conv_id", "formatted", "spans", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            rows = []
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if state is None or state["conv"] != conv:
                    if state is not None:
                        rows.append(row(state))
                    state = fresh(conv)
                turn, a, b = render(role or "", text or "")
                read_role, read_text = parse(turn)
                state["all"].update(f"{read_role}\n{read_text}\n".encode())
                if read_role == loss_role:
                    loss = unescape(turn[a:b])
                    if whole:
                        state["spans"].append({"start": state["chars"] + a, "stop": state["chars"] + b})
                    state["loss"].update(loss.encode())
                    state["loss_chars"] += len(loss)
                if whole:
                    state["parts"].append(turn)
                state["n"] += 1
                state["chars"] += len(turn)
            if rows:
                yield out(rows)
        if state is not None:
            yield out([row(state)])

    return run


def format_conversations(messages: DataFrame, loss_role: str = "assistant", whole: bool = True) -> DataFrame:
    """messages: (conv_id, at, role, text, msg_id). One row a conversation: the text, the loss mask's spans in it (both empty unless whole), digests."""
    ordered = messages.select("conv_id", "role", "text", "at", "msg_id").repartition("conv_id").sortWithinPartitions("conv_id", "at", "role", "text", "msg_id")
    return ordered.mapInArrow(_render(loss_role, whole), SCHEMA)


def as_events(conversations: DataFrame) -> DataFrame:
    """A log whose fold has each row of (conv_id, turn, role, text) as a message. In turn a message comes as deltas, one of them delivered
    twice; as a draft that is edited; as a draft that is generated anew, in two parts; or deleted and sent again."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "role", "text", F.row_number().over(order).cast("long").alias("msg_id"))
    half = F.floor(F.length("text") / 2).cast("int")
    start, rest = F.substring("text", F.lit(1), half), F.substring("text", half + 1, F.length("text"))

    def event(k: int, op: str, text: Column | None, role: bool = False) -> Column:
        return F.struct((4 * F.col("msg_id") + k).alias("seq"), F.lit(op).alias("op"), (F.col("role") if role else F.lit(None).cast("string")).alias("role"), (F.lit(None).cast("string") if text is None else text).alias("text"))

    streamed = F.array(event(0, "delta", start, True), event(1, "delta", rest), event(1, "delta", rest))
    edited = F.array(event(0, "message", F.lit("draft"), True), event(1, "delta", F.lit(" text")), event(2, "edit", F.col("text")))
    again = F.array(event(0, "message", F.lit("draft"), True), event(1, "regenerate", start), event(2, "delta", rest))
    resent = F.array(event(0, "message", F.lit("draft"), True), event(1, "delete", None), event(2, "message", F.col("text")))
    kind = F.col("msg_id") % 4
    return rows.select("conv_id", "msg_id", F.inline(F.when(kind == 0, streamed).when(kind == 1, edited).when(kind == 2, again).otherwise(resent)))


PROBE = "\\### Assistant: </turn> ok"


def op3(conversations: DataFrame) -> DataFrame:
    probe = conversations.sparkSession.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").union(probe)
    return format_conversations(fold(as_events(rows)), whole=False).drop("formatted", "spans")
