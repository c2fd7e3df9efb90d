import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from twinsift.llm.shared_keys import filed, flags_of, packed_keys, _answer, _spread, _squeezed
from twinsift.llm.words import hashed_words, ngrams

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbé \t\n\x1c.", max_size=30)), max_size=8)


@settings(max_examples=60, deadline=None)
@given(TEXTS)
def test_words_are_those_of_the_pattern(texts):
    buffer, starts, ends, hashes, index = hashed_words(pa.array(texts, pa.string()), lower=True)
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert [buffer[a:b].tobytes().decode() for a, b in zip(starts, ends)] == [w for ws in words for w in ws]
    assert np.diff(index).tolist() == [len(w) for w in words]
    lowered = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for ws in words for w in ws]
    assert len(set(hashes.tolist())) == len(set(lowered))


def test_ngrams_depend_on_order_and_salt():
    _, _, _, hashes, _ = hashed_words(pa.array(["a b c a b", "b a"]), lower=False)
    grams = ngrams(hashes, 2)
    assert grams[0] == grams[3]
    assert grams[0] != grams[5]
    assert ngrams(hashes, 2, salt=1)[0] != grams[0]
    assert len(ngrams(hashes, 8)) == 0


def test_a_very_long_word_and_text():
    long = "x" * (3 << 20)
    _, _, _, hashes, index = hashed_words(pa.array([long + " y", "y " + long]), lower=False)
    assert index.tolist() == [0, 2, 4]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] != hashes[0]


def test_packed_numbers_come_back():
    for low in ([5], [0, 1, 65_535, 70_000], [3, 1 << 23]):
        low = np.array(low, np.uint32)
        assert _spread(_squeezed(low)).tolist() == low.tolist()


def test_keys_seen_in_other_chunks():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    chunks = [np.unique(filed(np.concatenate((common, rng.integers(0, 1 << 63, 300, dtype=np.uint64))), 4)) for _ in range(3)]
    packed = pa.concat_tables([packed_keys(i, c) for i, c in enumerate(chunks)])
    buckets = sorted(set(packed["bucket"].to_pylist()))
    answers = pa.concat_tables([_answer(packed.filter(pa.array([b == x for x in packed["bucket"].to_pylist()]))) for b in buckets])
    for i, chunk in enumerate(chunks):
        mine = answers.filter(pa.array([c == i for c in answers["chunk"].to_pylist()]))
        others = set(np.concatenate([c for k, c in enumerate(chunks) if k != i]).tolist())
        assert flags_of(chunk, mine).tolist() == [int(k) in others for k in chunk.tolist()]
