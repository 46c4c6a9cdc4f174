"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the formatted turns before
it are context, and only its text lies under the loss mask.  A conversation is
``<s>`` and its turns; a user turn is ``[INST] text [/INST]``, an assistant turn
`` text </s>``, any other role ``[ROLE hex] text [/ROLE]`` with the role's UTF-8
bytes in hex (none for a null role).

A control string inside a text gets a backslash after its first character, and
one more where backslashes stand there already; reading takes one away.  So no
text can hold a control string, and every text can be read back.

Edge cases: a null text is empty; turns are ordered by turn, role and text
(null first), so ties and repeated rows each count, in a stable order; a null
conversation id is one conversation; an empty table gives no rows; other columns
are not read.  A conversation's turns meet in one task and its examples grow
with the square of its turns, as the method says; nothing else is gathered.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BEGIN = "<s>"
_CONTROL = re.compile(r"([\[<])(\\*)(/?INST\]|/?s>|/ROLE\]|ROLE)")
_ESCAPED = re.compile(r"([\[<])\\(\\*)(/?INST\]|/?s>|/ROLE\]|ROLE)")
_TURN = re.compile(r"\[INST\] (.*?) \[/INST\]| (.*?) </s>|\[ROLE ?([0-9a-f]*)\] (.*?) \[/ROLE\]", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The formatted turn, and where in it the text starts and ends."""
    inner = escape(text or "")
    if role == "user":
        before, after = "[INST] ", " [/INST]"
    elif role == "assistant":
        before, after = " ", " </s>"
    else:
        before, after = f"[ROLE {role.encode().hex()}] " if role is not None else "[ROLE] ", " [/ROLE]"
    return before + inner + after, len(before), len(before) + len(inner)


def parse(formatted: str) -> list[tuple[str | None, str]]:
    """Role and text of each turn."""
    turns: list[tuple[str | None, str]] = []
    at = len(BEGIN) if formatted.startswith(BEGIN) else 0
    while at < len(formatted):
        if not (m := _TURN.match(formatted, at)):
            raise ValueError(f"no turn at {at}")
        at = m.end()
        user, reply, role, other = m.groups()
        if user is not None:
            turns.append(("user", unescape(user)))
        elif reply is not None:
            turns.append(("assistant", unescape(reply)))
        else:
            turns.append((bytes.fromhex(role).decode() if m.group(0).startswith("[ROLE ") else None, unescape(other)))
    return turns


_OUT = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("example", T.LongType()), T.StructField("text", T.StringType()), T.StructField("loss_start", T.LongType()), T.StructField("loss_end", T.LongType())])


def expand_targets(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", keep_rest: bool = False) -> DataFrame:
    """``conv_id, example, text, loss_start, loss_end``: one row for each assistant
    turn, with the range of characters under the loss mask.  ``keep_rest`` adds,
    for conversations that do not end with an assistant turn, a last row with all
    turns and an empty mask."""
    rows = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.struct(F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).alias("turn"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))

    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=_OUT.names)

    def run(parts):
        out, size = [], 0
        for conv, turns in ((c, t) for p in parts for c, t in zip(p.column(0).to_pylist(), p.column(1).to_pylist(), strict=True)):
            so_far, example = BEGIN, 0
            for i, turn in enumerate(turns):
                text, start, end = format_turn(turn["role"], turn["text"])
                start, end = start + len(so_far), end + len(so_far)
                so_far += text
                reply = turn["role"] == "assistant"
                if reply or keep_rest and i == len(turns) - 1:
                    out.append((conv, example, so_far, start if reply else end, end))
                    example += 1
                    size += len(so_far)
                if size > 1 << 22:
                    yield made(out)
                    out, size = [], 0
        if out:
            yield made(out)

    return grouped.mapInArrow(run, _OUT)


def read_examples(examples: DataFrame) -> DataFrame:
    """From each example's own text: ``conv_id, example, n_turns, turns_sha256``
    (role, newline, text, newline of each turn), ``loss_text`` and ``formatted_chars``."""
    import hashlib

    def run(parts):
        for part in (p.slice(at, 64) for p in parts for at in range(0, p.num_rows, 64)):
            turns, marks, losses, sizes = [], [], [], []
            for text, start, end in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                read = parse(text)
                turns.append(len(read))
                marks.append(hashlib.sha256("".join(f"{r or ''}\n{t}\n" for r, t in read).encode()).hexdigest())
                losses.append(unescape(text[start:end]))
                sizes.append(len(text))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(turns, pa.int64()), pa.array(marks, pa.string()), pa.array(losses, pa.string()), pa.array(sizes, pa.int64())], names=["conv_id", "example", "n_turns", "turns_sha256", "loss_text", "formatted_chars"])

    return examples.mapInArrow(run, "conv_id long, example long, n_turns long, turns_sha256 string, loss_text string, formatted_chars long")
