import hashlib

import pytest
from hypothesis import given, strategies as st

from chronoframe.llm import chat

HOSTILE = st.text(alphabet="<|\\\n>aim_startendé", max_size=40)


@given(HOSTILE, HOSTILE)
def test_escapes_are_reversible_and_hide_control_strings(role, text):
    assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.unescape_role(chat.escape_role(role)) == role and "\n" not in chat.escape_role(role)


@given(st.lists(st.tuples(HOSTILE, HOSTILE), max_size=4))
def test_pieces_are_read_back(turns):
    reader, want = chat.Reader(1), hashlib.sha256()
    for role, text in turns:
        head = f"{chat.START}{chat.escape_role(role)}\n"
        reader.feed(f"{head}{chat.escape(text)}{chat.END}\n", [len(head), len(chat.escape(text))])
        want.update(f"{role}\n{text}\n".encode())
    loss = "".join(t for _, t in turns)
    assert reader.row()[1:5] == (len(turns), want.hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_attachments_become_ordered_placeholders(spark):
    parts = [("text", "see <|", None, None, None, None, None), ("image", None, "i.png", 57, 28, None, None), None, ("audio", None, "a.wav", None, None, 1.5, None), ("document", None, "d.pdf", None, None, None, 3)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, content array<{chat.PART}>")
    one, two = chat.format_turns(rows, "content").orderBy("turn").collect()
    assert one["piece"] == "<|im_start|>user\nsee <\\|<|image:0|><|audio:1|><|document:2|><|im_end|>\n"
    assert [(a["kind"], a["uri"], a["tokens"]) for a in one["attachments"]] == [("image", "i.png", 3), ("audio", "a.wav", 38), ("document", "d.pdf", 768)]
    assert one["n_tokens"] == 2 + 3 + 38 + 768 and two["loss"] == []
    said = chat.format_turns(rows.selectExpr("conv_id", "turn", "'assistant' as role", "content"), "content")
    assert [said.orderBy("turn").first()["piece"][a : a + n] for a, n in [said.orderBy("turn").first()["loss"]]] == ["see <\\|"]
    found = chat.read_back(said).first()
    assert found["loss_chars"] == len("see <|") and found["loss_sha256"] == hashlib.sha256(b"see <|").hexdigest()
    with pytest.raises(ValueError):
        chat.Flatten().visit({"kind": "smell"})


def test_odd_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, None, None), (1, 1, "assistant", "b"), (None, 0, "user", "x"), (2, None, "assistant", "y" * 300_000), (2, 0, "user", "")]
    turns = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    assert {k: (r["n_turns"], r["loss_chars"]) for k, r in found.items()} == {1: (3, 2), None: (1, 0), 2: (2, 300_000)}
    assert found[1]["turns_sha256"] == hashlib.sha256(b"\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert chat.read_back(chat.format_turns(turns.where("false"))).count() == 0
