"""Blocks: runs of rows of about the same number of text bytes, packed into one row each.

A block is the unit in which operators deduplicate locally before anything is shuffled. Blocks are written once to the shared
checkpoint folder, so every later stage sees the same ones whatever tasks are run again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

def packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return zstandard.ZstdCompressor(level=3).compress(sink.getvalue())


def unpacked(data: bytes) -> pa.Table:
    with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)) as r:
        return r.read_all()


def whole(column) -> pa.Array:
    """A column of a table as one array."""
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


AT_ONCE = 1 << 19  # numbers coded at once, to bound what a block needs beside itself


def small_bytes(numbers: np.ndarray) -> np.ndarray:
    """Unsigned numbers below 2**28 in one to four bytes of seven bits, the lowest first; all but the last have the top bit."""
    out = [np.zeros(0, np.uint8)]
    for begin in range(0, len(numbers), AT_ONCE):
        x = numbers[begin:begin + AT_ONCE].astype(np.int64)
        size = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21)
        at = np.cumsum(size) - size
        part = np.empty(int(size.sum()), np.uint8)
        for k in range(4):
            mine = size > k
            part[at[mine] + k] = ((x[mine] >> (7 * k)) & 127) | np.where(size[mine] > k + 1, 128, 0)
        out.append(part)
    return np.concatenate(out)


def from_small_bytes(data: np.ndarray) -> np.ndarray:
    last = np.flatnonzero(data < 128).astype(np.int32)
    out = np.zeros(len(last), np.int32)
    for begin in range(0, len(last), AT_ONCE):
        end = last[begin:begin + AT_ONCE]
        at = np.concatenate([[last[begin - 1] + 1 if begin else 0], end[:-1] + 1])
        part = out[begin:begin + AT_ONCE]
        for k in range(4):
            mine = at + k <= end
            part[mine] |= (data[at[mine] + k].astype(np.int32) & 127) << (7 * k)
    return out


def packed_lists(sizes: np.ndarray, content: bytes) -> bytes:
    """Lists laid end to end in `content`, with their sizes."""
    head = small_bytes(sizes).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(head).to_bytes(4, "little") + head + content)


def unpacked_lists(data: bytes) -> tuple[np.ndarray, bytes]:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = 4 + int.from_bytes(data[:4], "little")
    return from_small_bytes(np.frombuffer(data, np.uint8, n - 4, 4)), data[n:]


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])


def in_blocks(batches: Iterator[pa.RecordBatch], text_col: str, target: int) -> Iterator[pa.Table]:
    """Consecutive rows with about `target` bytes of text; a longer single text is a block of its own."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
        at = 0
        while at < b.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + target - size, side="right")))
            if held and to == at + 1 and size + int(ends[at]) - before > target:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            held.append(b.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at = to
            if size >= target:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def block_id(seq: int) -> int:
    """Unique in one run of a stage; the stage's output is written, so the number stays what it is."""
    from pyspark import TaskContext

    return (TaskContext.get().partitionId() << 32) | seq
