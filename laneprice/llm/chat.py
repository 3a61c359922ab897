"""Chat formatting in budgeted windows.

Running sums of turn tokens cut a conversation into turn-aligned spans. Every window begins with the
system turn, if there is one, and repeats a few turns of history, all within one budget of tokens; only
turns that are new there are targets, so each assistant text is under the loss mask once.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops
from .packing import _Encoder
from .shared import bounded_batches

#: Tokens of a window with all that it repeats, and of history that it repeats; turns of history at most.
BUDGET, HISTORY_TOKENS, HISTORY_TURNS = 1024, 256, 2
#: Opening and closing strings of assistant turns and of other turns. A backslash inside keeps texts apart from them.
TARGET, OTHER = ("<s>", "</s>"), ("[INST]", "[/INST]")
_TURN = re.compile(r"(?:<s>|\[INST\])(.*?)(?:</s>|\[/INST\])", re.S)
_ROLE = re.compile(r"((?:[^\\\n]|\\.)*)\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
#: Characters of finished windows that a task holds before it hands them on.
FLUSH_CHARS = 4_000_000


def turn_tokens(marked: Column) -> Column:
    """An estimate for a turn as it stands in a window: one token for four bytes, and four for the marks."""
    return F.ceil(F.octet_length(marked) / 4) + 4


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), r"([<\[])(/?(?:s>|INST\]))", r"$1\\$2")


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _count(tokenizer_path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder.of(tokenizer_path)
        for batch in batches:
            data, offsets = textops.utf8_column(batch["marked"])
            counts = [np.zeros(0, np.int64)]
            for i, j in textops.chunks(offsets):
                counts.append(np.diff(encoder.ids(textops.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))[1]))
            columns = [c for c in batch.schema.names if c != "marked"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(np.concatenate(counts), pa.int64())], names=[*columns, "tokens"])

    return count


def _cut(budget: int):
    """Cuts ordered turns into windows; holds one window, the system turn and the turns that may be history."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, window, rows, size, conv_type = None, None, [], 0, None

        def close() -> int:
            if window is None:
                return 0
            text = "".join(h + t + e for h, t, e in window["turns"])
            rows.append((now["conv"], now["n"], text, window["repeated"], window["spans"], window["tokens"]))
            now["n"] += 1
            return len(text)

        def flushed() -> pa.RecordBatch:
            types = [conv_type, pa.int64(), pa.string(), pa.int32(), _SPANS, pa.int64()]
            names = ["conv_id", "window", "formatted", "n_repeated", "loss_spans", "n_tokens"]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv, system, answers, head, text, tail, tokens in zip(*(batch[c].to_pylist() for c in batch.schema.names), strict=True):
                if now is None or now["conv"] != conv:
                    size += close()
                    now, window = {"conv": conv, "n": 0, "system": None, "recent": deque(maxlen=HISTORY_TURNS), "first": True}, None
                if window is None or window["tokens"] + tokens > budget:
                    size += close()
                    again = [now["system"]] if now["system"] else []
                    used, spare, history = tokens + sum(n for _, n in again), HISTORY_TOKENS, []
                    for turn in reversed(now["recent"]):
                        if turn[1] > min(spare, budget - used):
                            break
                        history.insert(0, turn)
                        used, spare = used + turn[1], spare - turn[1]
                    again = [turn for turn, _ in again + history]
                    window = {"turns": again, "repeated": len(again), "spans": [], "tokens": used, "at": sum(len(x) for turn in again for x in turn)}
                else:
                    window["tokens"] += tokens
                start = window["at"] + len(head)
                if answers:
                    window["spans"].append({"start": start, "end": start + len(text)})
                window["at"] = start + len(text) + len(tail)
                window["turns"].append((head, text, tail))
                if now["first"] and system:
                    now["system"] = ((head, text, tail), tokens)
                else:
                    now["recent"].append(((head, text, tail), tokens))
                now["first"] = False
                if size >= FLUSH_CHARS:
                    yield flushed()
                    rows.clear()
                    size = 0
        if now is not None:
            close()
            yield flushed()

    return cut


def format_windows(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", budget: int = BUDGET, tokenizer_path: str | None = None) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_repeated (turns at its start that aren't new), loss_spans and n_tokens.

    A window takes as many whole new turns as fit the budget together with the system turn and the history
    that it repeats; history that leaves no room for the first new turn is left out. Only a new turn that
    is too long by itself, or with the system turn, goes beyond the budget, and has no other turns then but
    the system turn. Tokens are those of each turn as it stands in the window, escaped and with its role
    and marks, counted by the tokenizer turn by turn, or turn_tokens() without one; n_tokens is their sum.
    loss_spans are code points (start, end) of the new assistant texts in formatted. Turns are ordered
    by turn (nulls first), then role, then text; turns that repeat stay apart. Null texts and roles are
    empty; a null conversation is one of its own. Other columns are ignored. A conversation's turns stream
    through one task.
    """
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    answers = F.col("role") == "assistant"
    body = F.concat(F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    head, tail = F.concat(F.when(answers, TARGET[0]).otherwise(OTHER[0]), body), F.when(answers, TARGET[1]).otherwise(OTHER[1])
    marked = F.concat(head, escaped(F.col("text")), tail)
    if tokenizer_path is None:
        sized = rows.withColumn("tokens", turn_tokens(marked))
    else:
        kind = T.StructType([*rows.schema, T.StructField("tokens", T.LongType())])
        sized = bounded_batches(rows).withColumn("marked", marked).mapInArrow(_count(tokenizer_path), kind)
    ordered = sized.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    ready = ordered.select("conv_id", (F.col("role") == "system").alias("system"), answers.alias("answers"), head.alias("head"), escaped(F.col("text")).alias("text"), tail.alias("tail"), "tokens")
    kind = T.StructType([rows.schema["conv_id"], *T._parse_datatype_string("window long, formatted string, n_repeated int, loss_spans array<struct<start:int,end:int>>, n_tokens long").fields])
    return bounded_batches(ready).mapInArrow(_cut(budget), kind)


def parse_window(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a window."""
    out = []
    for found in _TURN.finditer(formatted):
        role = _ROLE.match(found[1])
        out.append((unescaped(role[1]), unescaped(found[1][role.end() :])))
    return out


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from the formatted windows alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    Windows of a conversation stream through one task in order; no conversation is held in memory.
    """
    kind = T.StructType([windows.schema["conv_id"], *T._parse_datatype_string("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def close():
            if now is not None:
                rows.append((now["conv"], now["turns"], now["all"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["size"]))

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = [conv_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=kind.names)

        conv_type = None
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if now is None or now["conv"] != r["conv_id"]:
                    close()
                    now = {"conv": r["conv_id"], "turns": 0, "chars": 0, "size": 0, "all": hashlib.sha256(), "loss": hashlib.sha256()}
                text = r["formatted"]
                now["size"] += len(text)
                for role, own in parse_window(text)[r["n_repeated"] :]:
                    now["turns"] += 1
                    now["all"].update(f"{role}\n{own}\n".encode())
                for span in r["loss_spans"]:
                    own = unescaped(text[span["start"] : span["end"]])
                    now["chars"] += len(own)
                    now["loss"].update(own.encode())
            if len(rows) >= 1000:
                yield flushed()
                rows = []
        if conv_type is not None:
            close()
            yield flushed()

    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInArrow(read, kind)
