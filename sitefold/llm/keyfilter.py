"""Which 48-bit keys occur more than once in a corpus, as a filter of fixed size.

Every task sends the leading bits of its sorted keys as steps, dealt by their first bits, and each at most KEEP times; where they meet the
repeated ones set a bit, or two where the caller says that there may be many. The filter has false positives, which only cost work, and no false negatives. A second filter
has the keys that occur very often.

A caller whose keys grow in number with the input names a larger size: a filter that fills up lets everything through."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sitefold.llm import keycounts
from sitefold.llm.common import MIX1, written

KEY_BITS, FILTER_BITS = 48, 27   # a filter is 2**27 bits, 16 MB, if the caller names no other size
MOST_BITS = 30                   # what a caller may name: 128 MB
KEEP, OFTEN = 64, 4_096          # copies of a key that a task sends at most; what counts as very often
AT_ONCE = 4 << 20
READ_BITS = 25                   # bits of a filter that the driver reads at once
SENT_BITS = 40                   # leading bits of a key that are sent, as steps from the key before


def _second(keys: np.ndarray, inner: int) -> np.ndarray:
    """Another place of keys of SENT_BITS bits, within the 2**inner places of their bucket."""
    return ((keys * MIX1) >> np.uint64(64 - inner)).astype(np.int64)


@dataclass
class Filter:
    bits: np.ndarray
    often: np.ndarray
    bucket_bits: int | None = None   # leading bits that name a bucket, if a key has two places in `bits`

    @staticmethod
    def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    @staticmethod
    def _first(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(KEY_BITS + 1 - (len(bits) * 8).bit_length())).astype(np.int64)

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(self.bits, keys)
        out = self._has(self.bits, at)
        if self.bucket_bits is not None:
            some = np.flatnonzero(out)
            inner = (len(self.bits) * 8).bit_length() - 1 - self.bucket_bits
            out[some] = self._has(self.bits, at[some] >> inner << inner | _second(keys[some] >> np.uint64(KEY_BITS - SENT_BITS), inner))
        return out

    def very_often(self, keys: np.ndarray) -> np.ndarray:
        return self._has(self.often, self._first(self.often, keys))


def bucket_bits(spark) -> int:
    return max(4, (int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def dealt(parts: Iterator[np.ndarray], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, keys) of a task's key arrays."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        keys = np.sort(np.concatenate(held) >> np.uint64(KEY_BITS - SENT_BITS))
        keys = keys[np.concatenate([np.ones(min(KEEP, len(keys)), bool), keys[KEEP:] != keys[:-KEEP]])]
        begin = np.arange(1 << bits, dtype=np.uint64) << np.uint64(SENT_BITS - bits)
        edges = np.append(np.searchsorted(keys, begin), len(keys))
        some = np.flatnonzero(np.diff(edges))
        steps = np.diff(keys, prepend=np.uint64(0))
        steps[edges[some]] = keys[edges[some]] - begin[some]
        coded = keycounts._coded(steps)
        ends = np.concatenate([[0], np.flatnonzero(coded < 128) + 1])[np.append(edges[some], len(keys))]  # the last byte of a number is below 128
        packed = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(coded)])
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), packed], names=["bucket", "keys"])

    for keys in parts:
        held.append(keys)
        size += len(keys)
        if size >= AT_ONCE:
            yield batch()
            held, size = [], 0
    if size:
        yield batch()


def _segment(group: pa.Table, bits: int, size: int = FILTER_BITS, twice: bool = False) -> pa.Table:
    """The part of one bucket in a filter of 2**size bits; `twice`: with two places for each key."""
    bucket = group.column("bucket")[0].as_py()
    keys = [np.cumsum(keycounts._decoded(np.frombuffer(k.as_buffer(), np.uint8)), dtype=np.uint64) for k in group.column("keys")]
    keys = np.sort(np.concatenate(keys))     # places within the bucket
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    times = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    out = []
    for least, n, both in ((2, size, twice), (OFTEN, FILTER_BITS, False)):
        seg, mine = np.zeros(1 << (n - bits), np.uint8), keys[times >= least]
        seg[(mine >> np.uint64(SENT_BITS - n)).astype(np.int64)] = 1
        if both:
            seg[_second(mine + (np.uint64(bucket) << np.uint64(SENT_BITS - bits)), n - bits)] = 1
        out.append(np.packbits(seg, bitorder="little").tobytes())
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "bits": pa.array([out[0]], pa.binary()), "often": pa.array([out[1]], pa.binary())})


def repeated_keys(keys: DataFrame, bits: int, size: int = FILTER_BITS, twice: bool = False) -> Filter:
    """The filter of rows (bucket, keys) made by `dealt` with the same bits."""
    out = Filter(np.zeros(1 << (size - 3), np.uint8), np.zeros(1 << (FILTER_BITS - 3), np.uint8), bits if twice else None)
    # written where all tasks run at once: what is read one partition after the other is no more than the filters
    found = written(keys.groupBy("bucket").applyInArrow(lambda t: _segment(t, bits, size, twice), "bucket int, bits binary, often binary"), "repeated")
    for r in found.coalesce(max(1, 1 << (size - READ_BITS))).toLocalIterator():
        for whole, part in ((out.bits, r["bits"]), (out.often, r["often"])):
            whole[r["bucket"] * len(part):(r["bucket"] + 1) * len(part)] = np.frombuffer(part, np.uint8)
    return out
