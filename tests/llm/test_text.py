import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from chronoframe.llm import textkernel as tk

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aB9 é\n\t-\x0b\x85ñ", max_size=30)), max_size=6)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@settings(deadline=None, max_examples=150)
@given(TEXTS)
def test_tokens_are_those_of_the_patterns(texts):
    for member, pattern in ((tk.WORDS, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (tk.SOLID, r"[^\x20\x09-\x0D]+")):
        data, offsets = tk.text_bytes(pa.array(texts, pa.string()))
        found = tk.tokenize(data, offsets, member, tk.FOLDED)
        wanted = [re.findall(pattern, lower(t)) for t in texts]
        assert np.diff(found.bounds).tolist() == [len(w) for w in wanted]
        flat = [w for words in wanted for w in words]
        if flat:
            assert (tk.word_hash(flat) == found.hash).all()


def test_chunks_hold_all_rows_and_split_long_texts():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 50, None, "y" * 500, "", "z"])], ["text"])
    parts = list(tk.chunks(batch, "text", 100))
    assert [r for p in parts for r in p.column(0).to_pylist()] == batch.column(0).to_pylist() and len(parts) > 1


def test_slices_of_a_column_start_anywhere():
    whole = pa.array(["ab cd", "ef", None, "gh ij"])
    data, offsets = tk.text_bytes(whole.slice(1, 3))
    assert bytes(data) == b"efgh ij" and offsets.tolist() == [0, 2, 2, 7]
