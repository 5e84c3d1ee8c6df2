import numpy as np
import pyarrow as pa
from aerolytics.llm.words import shingle_sets, split_bytes, words
from hypothesis import given, settings
from hypothesis import strategies as st


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é漢\t\n\x0b \x1c\xa0", max_size=30)), max_size=8))
def test_words_are_those_of_a_plain_split(texts):
    h, first, starts, ends = words(pa.array(texts, pa.string()), True)
    body = "".join(t or "" for t in texts).encode()
    names = {}
    for t, a, b in zip(texts, first[:-1], first[1:], strict=True):
        want = (t or "").encode().lower().split()
        assert [body[x:y].lower() for x, y in zip(starts[a:b], ends[a:b], strict=True)] == want
        for w, x in zip(want, h[a:b].tolist(), strict=True):
            assert names.setdefault(w, x) == x
    assert len(set(names.values())) == len(names)


def test_shingles_and_batches():
    a, b, c, d = shingle_sets(pa.array(["A b c d", "a  B\nc d", "a b", None]), 3)
    assert (a == b).all() and len(a) == 2 and len(c) == 1 and len(d) == 0
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * 50, None, "y" * 5, "z" * 200])], ["text"])
    parts = list(split_bytes(iter([batch, batch.slice(0, 0)]), limit=60))
    assert [p.num_rows for p in parts] == [3, 1] and sum(p.num_rows for p in parts) == 4
    assert np.array_equal(words(pa.array(["A" * 3000]))[0], words(pa.array(["a" * 3000]))[0])
