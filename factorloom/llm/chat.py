"""Chat formatting with offset-aligned loss masks.

A conversation is rendered as one text, every turn as

    <s>[INST]role[/INST]text</s>

and encoded once, with the character offsets of its tokens.  The control strings
are tokens of their own, so no token reaches across the edge of a turn.  A token
is under the loss mask if its span meets the text of an assistant turn; sorted
turn spans and token spans are intersected by binary search.

Control strings inside roles and texts are escaped: a backslash is doubled, and a
backslash is put behind the first character of a control string.  Dropping the
escaping backslashes gives the text back.

Defined results: a NULL text or role is an empty one; turns are ordered by
number, then role, then text (NULL numbers first); rows with a NULL conversation
id form one conversation; repeated rows are separate turns; a conversation
without assistant text has an empty mask; an empty table gives no rows.  A
conversation is one row of the output, so it must fit in a task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template's control strings; the last is the vocabulary's own.
OPEN, ROLE, TEXT, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
CONTROL = (OPEN, ROLE, TEXT, CLOSE, "<|endoftext|>")
LEARNT = "assistant"

_CONTROL = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(
    f"{re.escape(OPEN + ROLE)}(.*?){re.escape(TEXT)}(.*?){re.escape(CLOSE)}", re.S
)
_TOKENIZERS: dict[str, object] = {}


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The conversation as text, and the spans (start, end) of its assistant texts."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = OPEN + ROLE + escape(role) + TEXT, escape(text)
        parts += [head, body, CLOSE]
        if role == LEARNT:
            spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), np.array(spans, "int64").reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns back from a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def mask_of(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens whose span meets one of the sorted ``spans``."""
    spans = spans[spans[:, 1] > spans[:, 0]]
    if not len(spans):
        return np.zeros(len(starts), bool)
    at = np.searchsorted(spans[:, 1], starts, side="right")  # first span that ends behind the token's start
    inside = at < len(spans)
    return inside & (ends > spans[np.minimum(at, len(spans) - 1), 0])


def masked_text(formatted: str, mask: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """All text under the mask; characters that several tokens share count once."""
    starts, ends = starts[mask], ends[mask]
    if not len(starts):
        return ""
    before = np.maximum.accumulate(np.r_[0, ends[:-1]])
    return "".join(formatted[a:b] for a, b in zip(np.maximum(starts, before).tolist(), ends.tolist()) if a < b)


def tokenizer(path: str):
    """One per Python worker: the vocabulary with the control strings as further tokens."""
    if path not in _TOKENIZERS:
        from tokenizers import AddedToken, Tokenizer, processors

        made = Tokenizer.from_file(path)
        made.add_special_tokens([AddedToken(c, normalized=False, special=True) for c in CONTROL])
        made.post_processor = processors.ByteLevel(trim_offsets=False)
        _TOKENIZERS[path] = made
    return _TOKENIZERS[path]


def format_conversations(
    rows: DataFrame, vocabulary: str, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conversation, formatted, ids, starts, ends, loss_mask``, one row per conversation."""

    def plain(name: str):
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))

    turns = rows.select(
        F.col(f"`{conversation}`").alias("conv"),
        F.struct(F.col(f"`{turn}`").alias("turn"), plain(role).alias("role"), plain(text).alias("text")).alias("row"),
    )
    whole = turns.groupBy("conv").agg(F.sort_array(F.collect_list("row")).alias("turns"))
    whole = whole.select("conv", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))
    numbers = T.ArrayType(T.IntegerType())
    out = T.StructType(
        [
            whole.schema["conv"],
            T.StructField("formatted", T.StringType()),
            T.StructField("ids", numbers),
            T.StructField("starts", numbers),
            T.StructField("ends", numbers),
            T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
        ]
    )

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = tokenizer(vocabulary)
        for batch in batches:
            for first in range(0, len(batch), 500):
                part = batch.iloc[first : first + 500]
                made = []
                for roles, texts in zip(part["roles"], part["texts"]):
                    formatted, spans = render(list(zip(roles, texts)))
                    got = encoder.encode(formatted, add_special_tokens=False)
                    at = np.array(got.offsets, "int32").reshape(-1, 2)
                    made.append((formatted, got.ids, at[:, 0], at[:, 1], mask_of(spans, at[:, 0], at[:, 1])))
                frame = pd.DataFrame(made, columns=["formatted", "ids", "starts", "ends", "loss_mask"])
                frame.insert(0, "conv", part["conv"].reset_index(drop=True))
                yield frame

    return whole.mapInPandas(encode, out).withColumnRenamed("conv", conversation)


def digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """What an output of :func:`format_conversations` says, read back from it."""
    kind = T.StructType(
        [
            formatted.schema[conversation],
            T.StructField("n_turns", T.LongType()),
            T.StructField("turns_sha256", T.StringType()),
            T.StructField("loss_chars", T.LongType()),
            T.StructField("loss_sha256", T.StringType()),
            T.StructField("formatted_chars", T.LongType()),
        ]
    )

    def sha(text: str) -> str:
        return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for conv, text, starts, ends, mask in zip(b[conversation], b["formatted"], b["starts"], b["ends"], b["loss_mask"]):
                turns = parse(text)
                loss = unescape(masked_text(text, np.asarray(mask, bool), np.asarray(starts), np.asarray(ends)))
                spoken = "".join(f"{role}\n{said}\n" for role, said in turns)
                made.append((len(turns), sha(spoken), len(loss), sha(loss), len(text)))
            frame = pd.DataFrame(made, columns=kind.names[1:])
            frame.insert(0, conversation, b[conversation].reset_index(drop=True))
            yield frame

    return formatted.select(conversation, "formatted", "starts", "ends", "loss_mask").mapInPandas(digest, kind)
