"""Recompression: what a task holds of a batch."""

import tracemalloc

import pyarrow as pa

from sitemarks.llm import repeats


def test_of_a_batch_only_some_words_are_held_at_a_time():
    texts = ["".join(f"w{i % 97}x{j} " for j in range(1500)) for i in range(1200)]  # about 10 MB
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(1200)), "text": [None, "", *texts[2:]]})
    del texts
    tracemalloc.start()
    n = words = 0
    for rows, own in repeats._chunks(iter([batch]), "text", repeats.words_of):
        assert len(rows) == len(own) and rows["doc_id"][0].as_py() == n
        n, words = n + len(rows), words + sum(map(len, own))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (n, words) == (1200, 1198 * 1500)
    assert peak < 25e6  # two lists of 100,000 words of some 40 bytes, and a pointer to each; all words would be 80 MB


def test_words_are_read_from_bytes():
    values = pa.array([" a\tb\x0bc \n", "", None, "é x \U0001f600"])
    assert [repeats.words_of(v.as_buffer()) for v in values] == [[b"a", b"b", b"c"], [], [], ["é x".encode(), "\U0001f600".encode()]]
