"""What op1 does for a text must not grow faster than the text: rows sent, false positives of its filter, suffixes sorted."""

import numpy as np
import pyarrow as pa
import pytest

from sitefold.llm import keyfilter, suffixes


def _batch(texts):
    n = pa.array(range(len(texts)), pa.int64())
    return pa.RecordBatch.from_arrays([n, n, pa.array(texts, pa.string())], names=["id", "th", "text"])


def _all_known():
    return keyfilter.Filter(np.full(1 << 24, 255, np.uint8), np.zeros(1 << 24, np.uint8))


def test_rows_sent_do_not_grow_with_the_square_of_the_input():
    rng = np.random.default_rng(5)
    batch = _batch(["".join(chr(97 + c) for c in rng.integers(0, 26, 20_000)) for _ in range(40)])
    rows = {}
    for bits in (8, 14):     # buckets of keys for half a GB of text, and for 64 times as much
        sent = list(suffixes._contexts([batch], suffixes._context_bits(bits), _all_known()))
        rows[bits] = sum(b.num_rows for b in sent)
        assert rows[bits] > 500 and len(sent) <= rows[bits] // 100 + 1     # many rows in a batch
    assert rows[14] <= 4 * rows[8]


def test_the_same_contexts_are_sent_whatever_the_number_of_buckets():
    rng = np.random.default_rng(6)
    batch = _batch(["".join(chr(97 + c) for c in rng.integers(0, 3, 700)) for _ in range(30)])
    want = None
    for bits in (4, 9, 13):
        sent = [b for b in suffixes._contexts([batch], bits, _all_known())]
        t = suffixes._unpacked(*(x.as_buffer() for b in sent for x in b.column("contexts") if x.is_valid))
        got = sorted(map(str, t.to_pylist()))
        want = want or got
        assert got == want


@pytest.mark.parametrize("twice", [False, True])
def test_a_larger_filter_lets_less_through_and_loses_nothing(twice):
    rng = np.random.default_rng(7)
    keys = rng.integers(0, 1 << keyfilter.KEY_BITS, 260_000).astype(np.uint64)
    again, size, bits = keys[:60_000], 20, 4
    rows = pa.Table.from_batches(list(keyfilter.dealt(iter([keys, again]), bits)))
    found = keyfilter.Filter(np.zeros(1 << (size - 3), np.uint8), np.zeros(1 << 24, np.uint8), bits if twice else None)
    for i in range(rows.num_rows):
        t = keyfilter._segment(rows.slice(i, 1), bits, size, twice)
        part = np.frombuffer(t["bits"][0].as_py(), np.uint8)
        found.bits[t["bucket"][0].as_py() * len(part):][:len(part)] = part
    assert found.repeated(again).all()
    assert found.repeated(keys[60_000:]).mean() < (0.02 if twice else 0.07)


def test_the_filter_grows_with_the_text():
    assert [suffixes._filter_bits(b) for b in (4, 7, 8, 10, 14)] == [27, 27, 28, 30, 30]


def test_strings_equal_to_one_of_a_smaller_document_are_found_by_their_bytes(monkeypatch):
    rng = np.random.default_rng(8)
    data = rng.integers(0, 2, 3_000).astype(np.uint8)
    for a, z in ((0, 900), (2_000, 333), (40, 1_500)):
        data[z:z + 120] = data[a:a + 120]
    data[2_500:2_650] = 0
    at = np.arange(len(data) - suffixes.WINDOW + 1)
    ids = rng.integers(0, 4, len(at))
    least: dict = {}
    strings = [data[i:i + suffixes.WINDOW].tobytes() for i in at.tolist()]
    for s, i in zip(strings, ids.tolist()):
        least[s] = min(i, least.get(s, i))
    want = [i > least[s] for s, i in zip(strings, ids.tolist())]
    assert any(want)
    words = suffixes._words(data)
    assert suffixes._equal_before(words, at, ids).tolist() == want
    monkeypatch.setattr(suffixes, "_hashed", lambda words, at, offsets: words[at] & np.uint64(3))     # hashes that tell little
    assert suffixes._equal_before(words, at, ids).tolist() == want


def test_hashes_of_contexts_cover_all_their_bytes():
    rng = np.random.default_rng(9)
    data = rng.integers(97, 123, 200).astype(np.uint8)
    for size in range(suffixes.WINDOW, suffixes.WINDOW + 31):
        one = lambda d: suffixes._span_hashes(suffixes._words(d), np.array([60]), np.array([size]))[0]
        h = one(data)
        for i in range(60, 60 + size):
            other = data.copy()
            other[i] += 1
            assert one(other) != h
        other = data.copy()
        other[:60], other[60 + size:] = 1, 2
        assert one(other) == h
