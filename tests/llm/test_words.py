import sys

import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st

from polyview.llm import words as W
from polyview.llm.common import process_state
from tests.llm import cases

texts = st.lists(st.text(alphabet=" \n\tabé.", max_size=30), max_size=6)


def found(rows):
    data = [t.encode() for t in rows]
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in data])]).astype(np.int64)
    return W.find_words(np.frombuffer(b"".join(data), np.uint8), offsets)


@settings(max_examples=200, deadline=None)
@given(texts)
def test_words_and_hashes(rows):
    got = found(rows)
    data = "".join(rows).encode()
    spelled = [[data[a:b].decode() for a, b in zip(got.starts[x:y], got.ends[x:y])] for x, y in zip(got.first[:-1], got.first[1:])]
    assert spelled == [cases.words(t) for t in rows]
    flat = [w for row in spelled for w in row]
    hashes = got.hashes(5).tolist()
    assert len(set(zip(flat, hashes))) == len(set(flat)) == len(set(hashes))


def test_a_word_longer_than_a_segment_has_one_hash(monkeypatch):
    rows = ["a bcdefghijklmnop bcdefghijklmnop c"]
    whole = found(rows).hashes(9)
    assert whole[1] == whole[2]
    monkeypatch.setattr(W, "SEGMENT", 4)
    monkeypatch.setattr(W, "process_state", lambda name, make: make())
    assert found(rows).hashes(9).tolist() == whole.tolist()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 20))
def test_grams_and_sliding_min(values, size):
    hashes = W.mix(np.array(values, np.uint64))
    got = W.grams(hashes, size).tolist()
    want = [tuple(values[i:i + size]) for i in range(len(values) - size + 1)]
    assert len(got) == len(want) and len(set(zip(got, want))) == len(set(want)) == len(set(got))
    assert W.sliding_min(hashes, size).tolist() == [min(hashes[i:i + size].tolist()) for i in range(len(values) - size + 1)]


def test_process_state_is_made_once():
    assert process_state("test_state", lambda: []) is process_state("test_state", lambda: [1])


def test_what_a_worker_keeps_ends_with_its_stage(spark):
    def kept(name):
        def run(batches):
            for _ in batches:
                made = [process_state(name, dict), process_state(name, dict)]
                home = sys.modules["polyview_process_state"]
                yield pa.RecordBatch.from_pydict({"names": [" ".join(sorted(home.kept))], "same": [made[0] is made[1]]})

        return [tuple(r) for r in spark.range(1).coalesce(1).mapInArrow(run, "names string, same boolean").collect()]

    assert kept("a") == [("a", True)]
    assert kept("b") == [("b", True)]
