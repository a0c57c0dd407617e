"""Chat formatting: exact round trips and masks."""

import hashlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from factorloom.llm import chat

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
TEXT = st.text(max_size=40) | st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", " ", "é", "ok", "s>", "/"]), max_size=12).map("".join)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "</s>", ""]), TEXT), max_size=5))
def test_round_trip(turns):
    turns = [(r, t.encode("utf-8", "ignore").decode()) for r, t in turns]
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    got = chat.tokenizer(VOCABULARY).encode(formatted, add_special_tokens=False)
    at = np.array(got.offsets, "int64").reshape(-1, 2)
    mask = chat.mask_of(spans, at[:, 0], at[:, 1])
    assert chat.unescape(chat.masked_text(formatted, mask, at[:, 0], at[:, 1])) == "".join(t for r, t in turns if r == "assistant")
    brute = [any(a < e and b > s for s, e in spans if e > s) for a, b in at]
    assert mask.tolist() == brute


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_whole_conversations(spark):
    rows = [
        (1, 1, "assistant", "two [INST]", "x"), (1, 0, "user", "one", "x"), (1, 2, "assistant", None, "x"),
        (2, None, None, None, "x"), (None, 0, "assistant", "long " * 20000, None), (1, 1, "assistant", "two [INST]", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, ids string")
    made = chat.format_conversations(df, VOCABULARY)
    got = {r["conv_id"]: r for r in chat.digests(made).collect()}
    assert got[1]["n_turns"] == 4
    assert got[1]["turns_sha256"] == sha("user\none\n" + "assistant\ntwo [INST]\n" * 2 + "assistant\n\n")
    assert got[1]["loss_sha256"] == sha("two [INST]" * 2) and got[1]["loss_chars"] == 20
    assert got[2]["n_turns"] == 1 and got[2]["loss_chars"] == 0 and got[2]["turns_sha256"] == sha("\n\n")
    assert got[None]["loss_chars"] == 100000
    assert chat.digests(chat.format_conversations(df.where("false"), VOCABULARY)).collect() == []
