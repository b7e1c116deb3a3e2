"""What Python workers hold between batches and tasks."""

import tracemalloc

import numpy as np
import pytest
import xxhash

from millrace.llm import jaccard, packing
from millrace.llm.common import thrifty


def test_shingler_holds_no_words():
    """However many distinct words have passed, and the shingles are those of hashed words."""
    shingle = jaccard.Shingler(5)
    tracemalloc.start()
    try:
        for part in range(20):
            shingle.many([b" ".join(b"w%d" % i for i in range(part * 5000, part * 5000 + 5000))])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 1 << 20
    h = np.array([xxhash.xxh64_intdigest(w) for w in (b"one", b"two", b"one")], np.uint64)
    run = np.full(1, 3, np.uint64)
    for x in h:
        run = jaccard.mix(run * np.uint64(0x9E3779B97F4A7C15) + x)
    assert shingle(b"One two\tone").tolist() == run.tolist()
    assert [s.tolist() for s in shingle.many([None, b"", b" \n", b"one  two one"])] == [[], [], [], run.tolist()]


@pytest.mark.parametrize("batches", [True, False])
def test_other_stages_let_the_tokenizer_go(batches):
    def some(rows):
        seen.append(packing.word_tokenizer(packing.default_tokenizer()))
        yield from rows

    def other(rows):
        yield packing.word_tokenizer.cache_info().currsize

    def group(rows):
        return [packing.word_tokenizer.cache_info().currsize]

    seen = []
    for _ in range(2):
        list(thrifty(some, packing.word_tokenizer)([]))
    assert seen[0] is seen[1]
    assert list(thrifty(other if batches else group)([])) == [0]
    list(thrifty(some, packing.word_tokenizer)([]))
    assert seen[2] is not seen[1] and packing.word_tokenizer.cache_info().currsize == 1
