"""What op1 sends: keys, contexts and runs in few bytes, whatever the number of buckets, and the same when read again."""

import numpy as np
import pyarrow as pa

from sitefold.llm import keyfilter, suffixes


def test_keys_are_sent_in_steps_and_none_is_lost():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << keyfilter.KEY_BITS, 50_000).astype(np.uint64)
    sent = np.concatenate([keys, keys[:5_000]])
    rows = pa.Table.from_batches(list(keyfilter.dealt(iter([sent]), 6)))
    assert sum(len(k.as_py()) for k in rows.column("keys")) < 5 * len(sent)
    found = np.zeros(1 << keyfilter.FILTER_BITS, bool)
    for i in range(rows.num_rows):
        seg = keyfilter._segment(rows.slice(i, 1), 6)
        b, size = seg.column("bucket")[0].as_py(), 1 << (keyfilter.FILTER_BITS - 6)
        found[b * size:(b + 1) * size] = np.unpackbits(np.frombuffer(seg.column("bits")[0].as_py(), np.uint8), bitorder="little").astype(bool)
    hit = found[(keys >> np.uint64(keyfilter.KEY_BITS - keyfilter.FILTER_BITS)).astype(np.int64)]
    assert hit[:5_000].all() and hit[5_000:].mean() < 0.05


def test_few_contexts_take_few_bytes():
    text = np.random.default_rng(2).integers(97, 123, 200).astype(np.uint8)
    n = np.array([1, 31, 4], np.uint8)
    cut = suffixes._cut(text, np.array([0, 20, 100]), n.astype(np.int64) + suffixes.WINDOW - 1)
    t = pa.table({"id": pa.array([-5, 7, 2**40]), "th": pa.array([1, -2, 3]), "start": pa.array([0, 20, 10**9]), "n": pa.array(n), "offset": pa.array([3, 30, suffixes.BY_ITSELF], pa.uint8()), "bytes": cut})
    sent = suffixes._packed(t)
    assert len(sent) < 350 and suffixes._unpacked(sent).equals(t)
    assert suffixes._unpacked(suffixes._packed(t.slice(1, 2))).equals(t.slice(1, 2).combine_chunks())


def test_runs_of_many_documents_are_merged_and_read_again():
    rng = np.random.default_rng(3)
    ids, ths = rng.integers(-3, 4, 400), rng.integers(0, 2, 400)
    start, size = rng.integers(0, 5_000, 400), rng.integers(1, 90, 400)
    halves = [next(suffixes._runs(*(x[k::2] for x in (ids, ths, start, size)))) for k in (0, 1)]
    want: dict = {}
    for i, h, s, z in zip(ids.tolist(), ths.tolist(), start.tolist(), size.tolist()):
        want.setdefault((i, h), set()).update(range(s, s + z))
    keys = sorted(want)
    lists = pa.array([None, *[[r for b in halves for i, h, r in zip(b["id"].to_pylist(), b["th"].to_pylist(), b["runs"].to_pylist()) if (i, h) == k] for k in keys], []], pa.list_(pa.binary()))
    row, begin, end = suffixes._covered(lists)
    got: dict = {}
    for r, b, e in zip(row.tolist(), begin.tolist(), end.tolist()):
        got.setdefault(keys[r - 1], []).append((b, e))
    assert {k: set().union(*(range(*r) for r in v)) for k, v in got.items()} == want
    assert all(x[1] < y[0] for v in got.values() for x, y in zip(v, v[1:]))
    assert [len(x) for x in suffixes._covered(pa.array([None, []], pa.list_(pa.binary())))] == [0, 0, 0]


def _sent(texts):
    """How many contexts are sent for texts whose longer grams are the only ones known."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["id", "th", "text"])
    keys = pa.Table.from_batches(keyfilter.dealt(suffixes._anchor_keys([batch]), 4)).to_pylist()
    found = keyfilter.Filter(np.zeros(1 << 24, np.uint8), np.zeros(1 << 24, np.uint8))
    for r in keys:
        t = keyfilter._segment(pa.table({"bucket": [r["bucket"]], "keys": pa.array([r["keys"]], pa.binary())}), 4)
        found.bits[r["bucket"] << 20:(r["bucket"] + 1) << 20] = np.frombuffer(t["bits"][0].as_py(), np.uint8)
    rows = [r["contexts"] for b in suffixes._contexts([batch], 6, found) for r in b.to_pylist() if r["contexts"]]
    return sum(suffixes._unpacked(r).num_rows for r in rows)


def test_strings_around_a_short_common_phrase_are_not_sent():
    rng = np.random.default_rng(4)
    other = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    phrase = "in the course of the last years "
    assert _sent([other(100) + phrase + other(100) for _ in range(50)]) == 0
    assert _sent([other(100) + phrase + phrase.upper() + other(100) for _ in range(50)]) > 0
