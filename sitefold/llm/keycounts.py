"""Which 44-bit keys occur how often in a corpus, as filters whose size follows from the number of keys.

Tasks send their distinct keys with counts, sorted and coded by differences, in buckets of leading bits. Where a bucket's keys meet, counts are
added up and compared with thresholds. For every threshold a filter says which keys reach it: it has no false negatives, and false
positives, the rarer the larger the filter, must only cost the caller work."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitefold.llm.common import written

KEY_BITS = 44
MOST = 255                     # a task's count of one key is sent up to this
BUCKET_BYTES = 2 << 20         # text whose keys meet in one bucket, about
MOST_BUCKETS = 1 << 14
FILTER_BITS = (20, 30)         # a filter has 2**20 to 2**30 bits: 128 MB at the very most


def keys_of(hashes: np.ndarray) -> np.ndarray:
    return hashes >> np.uint64(64 - KEY_BITS)


def bucket_bits(spark: SparkSession, texts: DataFrame, text_col: str) -> int:
    """Leading bits that name a bucket, from the number of bytes."""
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return min(MOST_BUCKETS, max(16, size // BUCKET_BYTES + 1)).bit_length() - 1


def _coded(numbers: np.ndarray) -> np.ndarray:
    """Unsigned numbers below 2**49 in bytes of seven bits, the lowest first; all but the last have the top bit."""
    size = np.ones(len(numbers), np.int64)
    for k in range(1, 7):
        size += numbers >= np.uint64(1 << 7 * k)
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    for k in range(7):
        mine = np.flatnonzero(size > k)
        if not len(mine):
            break
        out[at[mine] + k] = ((numbers[mine] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | np.where(size[mine] > k + 1, 128, 0).astype(np.uint8)
    return out


def _decoded(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128)
    begin = np.concatenate([[0], last[:-1] + 1])
    out = np.zeros(len(last), np.uint64)
    for k in range(7):
        mine = np.flatnonzero(begin + k <= last)
        if not len(mine):
            break
        out[mine] |= (data[begin[mine] + k] & np.uint8(127)).astype(np.uint64) << np.uint64(7 * k)
    return out


def dealt(keys: np.ndarray, counts: np.ndarray, bits: int) -> tuple[np.ndarray, list[bytes]]:
    """Buckets, and their packed content, of sorted distinct keys."""
    edges = np.searchsorted(keys, np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(KEY_BITS - bits))
    counts = np.minimum(counts, MOST).astype(np.uint8)
    some, z = np.flatnonzero(np.diff(edges)), zstandard.ZstdCompressor(level=1)
    out = []
    for b in some:
        k, c = keys[edges[b]:edges[b + 1]], counts[edges[b]:edges[b + 1]]
        out.append(len(k).to_bytes(4, "little") + z.compress(c.tobytes() + _coded(np.diff(k, prepend=np.uint64(int(b) << (KEY_BITS - bits)))).tobytes()))
    return some.astype(np.int32), out


def _opened(bucket: int, data: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    n, raw = int.from_bytes(data[:4], "little"), np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:]), np.uint8)
    return np.cumsum(_decoded(raw[n:]), dtype=np.uint64) + np.uint64(bucket << (KEY_BITS - bits)), raw[:n]


@dataclass
class Filters:
    """One bit array per threshold, indexed by the leading bits of a key."""
    thresholds: tuple[int, ...]
    bits: list[np.ndarray]

    def reach(self, keys: np.ndarray, which: int = 0) -> np.ndarray:
        bits = self.bits[which]
        at = (keys >> np.uint64(KEY_BITS - (len(bits) * 8).bit_length() + 1)).astype(np.int64)
        return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1

    def level(self, keys: np.ndarray) -> np.ndarray:
        """How many thresholds a key reaches, about."""
        return sum((self.reach(keys, i).astype(np.int8) for i in range(len(self.bits))), np.zeros(len(keys), np.int8))


def filters(rows: DataFrame, thresholds: tuple[int, ...], bits: int) -> Filters:
    """The filters of rows (bucket, keys) made by `dealt`."""
    def reaching(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        parts = [_opened(bucket, x.as_py(), bits) for x in group.column("keys")]
        keys, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        total = np.add.reduceat(counts.astype(np.int64), first)
        kept = [keys[first][total >= t] for t in thresholds]
        some = [i for i in range(len(thresholds)) if len(kept[i])]
        return pa.table({"bucket": pa.array([bucket] * len(some), pa.int32()), "which": pa.array(some, pa.int32()), "n": pa.array([len(kept[i]) for i in some], pa.int64()),
                         "keys": pa.array([dealt(kept[i], np.ones(len(kept[i])), bits)[1][0] for i in some], pa.binary())})

    # buckets are few and as good as equal in size
    found = written(rows.groupBy("bucket").applyInArrow(reaching, "bucket int, which int, n long, keys binary"), "frequent")
    many = {r["which"]: r["n"] for r in found.groupBy("which").agg(F.sum("n").alias("n")).collect()}
    sizes = [min(FILTER_BITS[1], max(FILTER_BITS[0], bits + 3, (16 * many.get(i, 0)).bit_length())) for i in range(len(thresholds))]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for bucket, which, data in zip(*(b.column(c).to_pylist() for c in ("bucket", "which", "keys"))):
                keys, _ = _opened(bucket, data, bits)
                seg = np.zeros(1 << (sizes[which] - bits), np.uint8)
                seg[((keys >> np.uint64(KEY_BITS - sizes[which])) - np.uint64(bucket << (sizes[which] - bits))).astype(np.int64)] = 1
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([which], pa.int32()), pa.array([np.packbits(seg, bitorder="little").tobytes()], pa.binary())], names=["bucket", "which", "bits"])

    out = Filters(thresholds, [np.zeros(1 << (s - 3), np.uint8) for s in sizes])
    for r in found.mapInArrow(segments, "bucket int, which int, bits binary").toLocalIterator():  # 2**30 bits a threshold at most, whatever the input
        size = len(out.bits[r["which"]]) >> bits
        out.bits[r["which"]][r["bucket"] * size:(r["bucket"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out
