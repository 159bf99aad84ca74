"""Exact substring deduplication with longest-previous-factor arrays over suffixes.

A byte goes if a string of `WINDOW` bytes over it also starts in a document with a smaller id. To bring equal strings together without
moving every suffix, each string is assigned the k-gram inside it whose first eight bytes have the least hash (its anchor; content alone decides,
so equal strings have equal anchors). A string lies far to the left or to the right of its anchor, so it holds `HALF` bytes that begin or end
with the anchor: strings whose longer gram occurs once in the corpus are dropped by a filter. From the others of an anchor a context is cut. Where the contexts of an anchor meet, their suffixes are sorted and the previous and
next suffix of a smaller document give the longest previous factor: at WINDOW and more, the string is a later copy. Suffixes
that no other one equals for WINDOW bytes, as their hashes tell, are not sorted.

Contexts that repeat within a task are sent once, for the smallest document. Anchors that occur very often are dealt by their strings
instead, one by one, so that no group grows with a frequent line.

Defined results: a null text is an empty one; a null id takes no part and loses nothing; strings within documents of the same id do
not count against each other; repeated rows are treated alike. Other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm import keycounts, keyfilter
from sitefold.llm.blocks import from_small_bytes, small_bytes, whole
from sitefold.llm.common import lean, mix64
from sitefold.runtime import ship_package

WINDOW, GRAM = 50, 20
HALF = GRAM + (WINDOW - GRAM) // 2    # bytes of the gram that the filter is asked for: an anchor with what its strings share on one side
BY_ITSELF = 255         # in place of an anchor's offset: the string is dealt by its own hash
AT_ONCE = 1 << 17        # bytes of text anchored together
PIECE = 1 << 19          # a longer text is anchored in pieces that overlap by a window
SENT_AT_ONCE = 300_000   # contexts that a task holds before it sends them
SORTED_AT_ONCE = 100_000  # strings
HASHED_AT_ONCE = 20_000  # contexts
FINER = 1                # more bits of a bucket for contexts than for keys: they are larger
ROW_BITS = 9             # that many bits of a bucket for contexts before only one more in three is added
FILTER_FOR_BUCKET = 20   # more bits for the size of the filter than for buckets of keys
ROWS_AT_ONCE = 256       # of what is sent, in one batch
ROW = ["bucket", "contexts", "id", "th", "runs"]
_PLACE = np.uint64((1 << 24) - 1)
_START, _SPREAD = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """(bytes, begin of each piece, (id, text hash, offset) of each piece), about AT_ONCE bytes at a time."""
    held, about, size = [], [], 0

    def out():
        sizes = np.array([len(x) for x in held], np.int64)
        return np.frombuffer(b"".join(held), np.uint8), np.concatenate([[0], np.cumsum(sizes)]), about

    for b in batches:
        for i, th, text in zip(b.column("id").to_pylist(), b.column("th").to_pylist(), b.column("text")):
            data = text.as_buffer()
            if i is None or data is None or len(data) < WINDOW:
                continue
            data = data.to_pybytes()
            for at in range(0, len(data) - WINDOW + 1, PIECE):
                held.append(data[at:at + PIECE + WINDOW - 1])
                about.append((i, th, at))
                size += len(held[-1])
                if size >= AT_ONCE:     # within a text too: places must fit in _PLACE
                    yield out()
                    held, about, size = [], [], 0
    if held:
        yield out()


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as a number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data, strides=(1,)).astype(np.uint64)


def _hashed(words: np.ndarray, at: np.ndarray, offsets: tuple[int, ...]) -> np.ndarray:
    """A hash of the words at each place and these offsets from it."""
    out = np.full(len(at), _START)
    for o in offsets:
        out = mix64(out ^ words[at + o])
    return out


def _span_hashes(words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each context: its first 48 bytes, its last 32 and its size, as it has 50 to 80."""
    out = _hashed(words, begin, (0, 8, 16, 24, 32, 40)) ^ size.astype(np.uint64)
    for o in (32, 24, 16, 8):
        out = mix64(out ^ words[begin + size - o])
    return out


def _anchor_runs(words: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings (windows that lie within a piece) that begin next to each other and have the same anchor: the first one's begin, their
    number, their piece and the anchor's place. An anchor is told by its first eight bytes."""
    value = words * _SPREAD
    value &= ~_PLACE
    value |= np.arange(len(words), dtype=np.uint64)     # the least hash, and the first place among equal ones
    width, least, grams = 1, value, WINDOW - GRAM + 1
    while 2 * width <= grams:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    strings = edges[-1] - WINDOW + 1
    least = np.minimum(least[:strings], least[grams - width:][:strings])
    new = np.ones(strings + 1, bool)
    np.not_equal(least[1:], least[:-1], out=new[1:-1])
    new[edges[:-1]] = new[edges[1:] - WINDOW + 1] = True    # windows over the edge of a piece are runs of their own, and left out
    start = np.flatnonzero(new)
    piece = np.repeat(np.arange(len(edges) - 1), np.diff(np.searchsorted(start, edges)))
    n = np.diff(start, append=start[-1:])
    inside = start + WINDOW <= edges[piece + 1]
    start, n, piece = start[inside], n[inside], piece[inside]
    return start, n, piece, (least[start] & _PLACE).astype(np.int64)


def _keys(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """48-bit keys of the grams of `size` bytes at these places, mixed less than hashes that stand for the bytes themselves."""
    out = np.full(len(at), _START)
    for o in (*range(0, size - 8, 8), size - 8):
        out ^= words[at + o]
        out *= _SPREAD
        out ^= out >> np.uint64(32)
    return mix64(out) >> np.uint64(16)


def _anchors(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each string: its begin, its piece, the place and the 48-bit key of its anchor."""
    words = _words(data)
    begin, n, piece, place = _anchor_runs(words, edges)
    return _each(begin, n), *(np.repeat(x, n) for x in (piece, place, _keys(words, place, GRAM)))


def _each(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1 and so on, n of them, one after the other."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - ends + n, n)


def _longer(words: np.ndarray, begin: np.ndarray, n: np.ndarray, piece: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs cut where the longer gram that their strings share changes: first begin, number, piece, place, and the longer gram's 48-bit key."""
    left = np.clip(place - (HALF - GRAM) - begin + 1, 0, n)    # strings that reach farther to the left of the anchor
    begin, n = np.stack([begin, begin + left], 1).ravel(), np.stack([left, n - left], 1).ravel()
    half = np.stack([place - (HALF - GRAM), place], 1).ravel()
    some = np.flatnonzero(n)
    return begin[some], n[some], piece[some >> 1], place[some >> 1], _keys(words, half[some], HALF)


def _once_a_piece(key: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """Sorted keys, each as often as there are pieces that have it. A piece's number has 16 bits, as AT_ONCE bytes hold fewer."""
    both = np.sort(key << np.uint64(16) | piece.astype(np.uint64))
    return both[np.concatenate([[True], both[1:] != both[:-1]])] >> np.uint64(16) if len(both) else both


@lean
def _anchor_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Keys of longer grams, and of anchors that occur again near by: those only tell which anchors occur very often."""
    for data, edges, _ in _pieces(batches):
        words = _words(data)
        begin, n, piece, place = _anchor_runs(words, edges)
        _, _, of, _, longer = _longer(words, begin, n, piece, place)
        yield _once_a_piece(longer, of)
        k = _once_a_piece(_keys(words, place, GRAM), piece)
        same = k[1:] == k[:-1]
        yield k[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(k) else k


def _cut(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum(size)])
    take = np.arange(ends[-1]) + np.repeat(begin - ends[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data[take])])


COLUMNS = [("id", np.int64), ("th", np.int64), ("start", np.int64), ("n", np.uint8), ("offset", np.uint8)]


def _packed_rows(t: pa.Table, edges: np.ndarray) -> list[bytes]:
    """Contexts edges[i] to edges[i + 1] as bytes: a count, the columns byte by byte (those of numbers alike are zeros in a row) and the strings,
    whose sizes follow from n."""
    columns = [whole(t.column(name)).to_numpy().astype(kind).view(np.uint8).reshape(len(t), -1) for name, kind in COLUMNS]
    strings, z = whole(t.column("bytes")), zstandard.ZstdCompressor(level=3)
    ends = np.frombuffer(strings.buffers()[1], np.int32)[strings.offset:strings.offset + len(t) + 1][edges].tolist()
    data, edges = memoryview(strings.buffers()[2]), edges.tolist()
    return [z.compress(b"".join([(to - at).to_bytes(4, "little"), *(c[at:to].T.tobytes() for c in columns), data[a:e]]))
            for at, to, a, e in zip(edges, edges[1:], ends, ends[1:])]


def _packed(t: pa.Table) -> bytes:
    return _packed_rows(t, np.array([0, len(t)]))[0]


def _unpacked(*rows: bytes) -> pa.Table:
    """The contexts of all these rows."""
    columns, strings, z = {name: [] for name, _ in COLUMNS}, [], zstandard.ZstdDecompressor()
    for data in rows:
        data = z.decompress(data)
        n, at = int.from_bytes(data[:4], "little"), 4
        for name, kind in COLUMNS:
            size = np.dtype(kind).itemsize
            columns[name].append(np.frombuffer(data, np.uint8, n * size, at).reshape(size, n))
            at += n * size
        strings.append(memoryview(data)[at:])
    columns = {name: np.ascontiguousarray(np.concatenate(columns[name], 1).T).view(kind).ravel() for name, kind in COLUMNS}
    ends = np.concatenate([[0], np.cumsum(columns["n"].astype(np.int64) + WINDOW - 1)]).astype(np.int32)
    data = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(b"".join(strings))])
    return pa.table({**{name: pa.array(c) for name, c in columns.items()}, "bytes": data})


def _copies(same: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of these contexts a smaller document has as well."""
    order = np.lexsort((ids, same))
    first = np.flatnonzero(np.concatenate([[True], same[order][1:] != same[order][:-1]]))
    least = np.empty(len(ids), np.int64)
    least[order] = np.repeat(ids[order][first], np.diff(np.append(first, len(order))))
    return ids > least


@lean
def _contexts(batches: Iterator[pa.RecordBatch], bits: int, found: keyfilter.Filter) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, contexts, id, th, runs): contexts dealt by their anchor, or runs that a smaller document of this task has as well."""
    held: list[pa.Table] = []

    def sent() -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held).combine_chunks()
        held.clear()
        col = lambda c: whole(t.column(c)).to_numpy(zero_copy_only=False)
        copy = _copies(col("same"), col("id"))
        yield from _runs(col("id")[copy], col("th")[copy], col("start")[copy], col("n")[copy] + WINDOW - 1)
        bucket = (col("key").astype(np.uint64) >> np.uint64(keyfilter.KEY_BITS - bits)).astype(np.int32)
        order = np.flatnonzero(~copy)
        order = order[np.argsort(bucket[order], kind="stable")]
        bucket = bucket[order]
        # the hashes are formed again where the contexts meet: they would be most of what is sent
        t = t.drop_columns(["same", "key"])
        edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        for at in range(0, len(edges) - 1, ROWS_AT_ONCE):
            part = edges[at:at + ROWS_AT_ONCE + 1]
            contexts = t.take(pa.array(order[part[0]:part[-1]])).combine_chunks()
            none = [pa.nulls(len(part) - 1, kind) for kind in (pa.int64(), pa.int64(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[part[:-1]]), pa.array(_packed_rows(contexts, part - part[0]), pa.binary()), *none], names=ROW)

    for data, edges, about in _pieces(batches):
        words = _words(data)
        begin, n, piece, place, longer = _longer(words, *_anchor_runs(words, edges))
        hit = found.repeated(longer)
        begin, n, piece, place, longer = begin[hit], n[hit], piece[hit], place[hit], longer[hit]
        if not len(begin):
            continue
        key = _keys(words, place, GRAM)
        often = found.very_often(longer) | found.very_often(key)
        # one context for the strings that follow each other and have the same anchor; alone and dealt by itself under a frequent anchor
        times = np.where(often, n, 1)
        begin, n = _each(begin, times), np.repeat(np.where(often, 1, n), times)
        piece, place, key, often = (np.repeat(x, times) for x in (piece, place, key, often))
        new = np.flatnonzero((np.diff(place, prepend=-1) != 0) | (begin != np.concatenate([[-1], begin[:-1] + n[:-1]])) | often | np.concatenate([[False], often[:-1]]))
        n = np.add.reduceat(n, new)
        begin, piece, place, key, often = begin[new], piece[new], place[new], key[new], often[new]
        same = _span_hashes(words, begin, n + WINDOW - 1)
        key = np.where(often, same >> np.uint64(16), key)
        ids, ths, offs = (np.array(x, np.int64) for x in zip(*about))
        held.append(pa.table({"key": pa.array(key.astype(np.int64)), "id": pa.array(ids[piece]), "th": pa.array(ths[piece]), "start": pa.array(begin - edges[piece] + offs[piece]),
                              "n": pa.array(n.astype(np.uint8)), "offset": pa.array(np.where(often, BY_ITSELF, place - begin).astype(np.uint8)), "same": pa.array(same), "bytes": _cut(data, begin, n + WINDOW - 1)}))
        if sum(t.num_rows for t in held) >= SENT_AT_ONCE:
            yield from sent()
            pa.default_memory_pool().release_unused()
    if held:
        yield from sent()


def _merged(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, begin and end of the maximal runs that pieces cover, of all documents at once, in order."""
    if not len(doc):
        return doc, start, end
    order = np.lexsort((start, doc))
    doc, apart = doc[order], int(end.max()) + 1
    start, end = start[order] + doc * apart, np.maximum.accumulate(end[order] + doc * apart)  # a document's places lie behind those of the one before
    first = np.flatnonzero(np.concatenate([[True], start[1:] > end[:-1]]))
    last = np.append(first[1:], len(end)) - 1
    return doc[first], start[first] - doc[first] * apart, end[last] - doc[first] * apart


def _runs(ids: np.ndarray, ths: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
    """One row per document with its merged runs: gaps and lengths in turn."""
    if not len(ids):
        return
    order = np.lexsort((ths, ids))
    ids, ths, start, size = ids[order], ths[order], start[order].astype(np.int64), size[order].astype(np.int64)
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (ths[1:] != ths[:-1])])
    doc, s, e = _merged(np.cumsum(new) - 1, start, start + size)
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    both = np.empty(2 * len(s), np.int64)
    both[::2] = s - np.concatenate([[0], e[:-1]])
    both[2 * first] = s[first]
    both[1::2] = e - s
    coded = small_bytes(both)
    ends = np.concatenate([[0], np.flatnonzero(coded < 128) + 1])[np.append(2 * first, len(both))]  # the last byte of a number is below 128
    n = len(first)
    out = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(coded)])
    yield pa.RecordBatch.from_arrays([pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.array(ids[new]), pa.array(ths[new]), out], names=ROW)


def previous_factors(rank: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """Longest previous factors in suffix order: `rank` is what makes a suffix earlier, lcp[i] its common prefix with suffix i - 1.

    Each suffix points to its neighbour and, while that is not earlier, on to where the neighbour points; all steps are taken at once."""

    def towards_smaller(rank: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        to, common = np.arange(len(rank)) - 1, lcp.copy()
        common[:1] = 0
        todo = np.flatnonzero((to >= 0) & (common > 0))
        while len(todo := todo[(rank[np.maximum(to[todo], 0)] >= rank[todo]) & (to[todo] >= 0) & (common[todo] > 0)]):
            on = to[todo]
            to_new, common_new = to[on], np.minimum(common[todo], common[on])
            to[todo], common[todo] = to_new, common_new
        return np.where(to >= 0, common, 0)

    after = towards_smaller(rank[::-1], np.concatenate([[0], lcp[:0:-1]]))[::-1] if len(rank) else lcp
    return np.maximum(towards_smaller(rank, lcp), after)


def _equal_before(words: np.ndarray, at: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the strings that begin at these places also begin in a document with a smaller id, by longest previous factors."""
    out, offsets = np.zeros(len(at), bool), (*range(0, WINDOW - 8, 8), WINDOW - 8)
    # strings whose hash no other one has cannot be copies, and need no sorting
    same = _hashed(words, at, offsets)
    by = np.argsort(same, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], same[by[1:]] != same[by[:-1]]]))
    times = np.diff(np.append(first, len(by)))
    by = by[np.repeat(times > 1, times)]
    if not len(by):
        return out
    times = times[times > 1]
    # suffix order: one string of each hash is sorted by its bytes, and those with the same hash stand beside it
    string = np.stack([words[at[by] + o] for o in offsets], 1)
    begin = np.cumsum(times) - times
    if (string == string[np.repeat(begin, times)]).all():
        order = np.lexsort(string[begin].byteswap().T[::-1])
        take = _each(begin[order], times[order])
    else:
        take = np.lexsort(string.byteswap().T[::-1])
    by, string = by[take], string[take]
    # shorter common prefixes cannot make a copy
    lcp = np.concatenate([[0], np.where((string[1:] == string[:-1]).all(1), WINDOW, 0)])
    out[by] = previous_factors(ids[by], lcp) >= WINDOW
    return out


def _later_copies(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """Runs that the longest previous factors of one bucket's contexts find."""
    t = _unpacked(*(x.as_buffer() for x in group.column("contexts")))
    ids, ths, start, n, offset = (whole(t.column(c)).to_numpy() for c, _ in COLUMNS)
    n, strings = n.astype(np.int64), whole(t.column("bytes"))
    ends, data = np.frombuffer(strings.buffers()[1], np.int32)[:-1].astype(np.int64), np.frombuffer(strings.buffers()[2], np.uint8)
    same, key = np.empty(len(n), np.uint64), np.empty(len(n), np.uint64)
    for at in range(0, len(n), HASHED_AT_ONCE):
        mine = slice(at, at + HASHED_AT_ONCE)
        begin, size = ends[mine] - ends[at], n[mine] + WINDOW - 1
        words = _words(data[ends[at]:ends[at] + begin[-1] + size[-1]])
        same[mine] = _span_hashes(words, begin, size)
        alone = offset[mine] == BY_ITSELF
        key[mine] = np.where(alone, same[mine] >> np.uint64(16), _keys(words, begin + np.where(alone, 0, offset[mine]), GRAM))
    # equal contexts first: all but the smallest document's are later copies whole, and need no sorting
    copy = _copies(same, ids)
    found = [(np.flatnonzero(copy), np.zeros(int(copy.sum()), np.int64), n[copy])]     # contexts, the first of their strings that goes, and how many do
    order = np.flatnonzero(~copy)
    order = order[np.argsort(key[order], kind="stable")]
    key = key[order]
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(new, len(key)))
    order, key = order[np.repeat(times > 1, times)], key[np.repeat(times > 1, times)]     # an anchor with one context has nothing to compare
    done = np.cumsum(n[order])
    at = 0
    while at < len(order):
        to = int(np.searchsorted(done, (done[at - 1] if at else 0) + SORTED_AT_ONCE, side="right"))
        to = min(len(order), max(at + 1, to))
        to = int(np.searchsorted(key, key[to - 1], side="right"))     # contexts of an anchor stay together
        part = order[at:to]
        at = to
        size = n[part] + WINDOW - 1
        begin = np.cumsum(size) - size
        which, first = np.repeat(np.arange(len(part)), n[part]), np.cumsum(n[part]) - n[part]
        copy = _equal_before(_words(data[_each(ends[part], size)]), _each(begin, n[part]), ids[part][which])
        # strings that follow each other in a context go as one
        edge = np.zeros(len(copy) + 1, bool)
        edge[first] = edge[-1] = True
        begun = np.flatnonzero(copy & (edge[:-1] | ~np.concatenate([[False], copy[:-1]])))
        ended = np.flatnonzero(copy & (edge[1:] | ~np.concatenate([copy[1:], [False]])))
        found.append((part[which[begun]], begun - first[which[begun]], ended - begun + 1))
    of, shift, many = (np.concatenate(x) for x in zip(*found))
    yield from _runs(ids[of], ths[of], start[of] + shift, many + WINDOW - 1)


@lean
def _shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    small = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("th"), pa.array([small.compress(t.as_buffer() or b"") for t in b.column("text")], pa.binary())], names=["id", "th", "text"])


def _covered(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the maximal runs of every row of lists of coded runs."""
    coded, row = lists.flatten(), pc.list_parent_indices(lists).to_numpy()
    ends = np.frombuffer(coded.buffers()[1], np.int32)[coded.offset:coded.offset + len(coded) + 1].astype(np.int64) if len(coded) else np.zeros(1, np.int64)
    if ends[-1] == ends[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    data = np.frombuffer(coded.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    begun = np.searchsorted(np.flatnonzero(data < 128), ends - ends[0])  # numbers before each value
    place = np.concatenate([[0], np.cumsum(from_small_bytes(data), dtype=np.int64)])
    edges = place[1:] - np.repeat(place[begun[:-1]], np.diff(begun))
    return _merged(np.repeat(row, np.diff(begun) // 2).astype(np.int64), edges[::2], edges[1::2])


@lean
def _emptied(batches: Iterator[pa.RecordBatch], keep_text: bool) -> Iterator[pa.RecordBatch]:
    small = zstandard.ZstdDecompressor()
    for b in batches:
        sizes, removed, spans, digests, texts = [], [], [], [], []
        row, start, end = _covered(b.column("runs"))
        edges = np.searchsorted(row, np.arange(b.num_rows + 1)).tolist()
        start, end = start.tolist(), end.tolist()
        for i, text in enumerate(b.column("text")):
            data = memoryview(small.decompress(text.as_buffer()))
            mine = slice(edges[i], edges[i + 1])
            kept = b"".join([data[a:z] for a, z in zip([0, *end[mine]], [*start[mine], len(data)])])
            sizes.append(len(data))
            removed.append(len(data) - len(kept))
            spans.append(edges[i + 1] - edges[i])
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept if keep_text else None)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.binary())],
                                         names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _filter_bits(bits: int) -> int:
    """The filter of the longer grams has 2 ** this bits, from the bits of a bucket of keys: a filter of one size fills up as the input grows, and lets more and more through."""
    return min(keyfilter.MOST_BITS, max(keyfilter.FILTER_BITS, bits + FILTER_FOR_BUCKET))


def _context_bits(bits: int) -> int:
    """Leading bits that name a bucket of contexts, from those for keys. A task sends a row to every bucket again and again, so past ROW_BITS most of the growth
    of the input goes into what meets in a bucket: with buckets of one size, the rows would grow with the square of the input."""
    fine = bits + FINER
    return min(fine, ROW_BITS + max(0, fine - ROW_BITS) // 3)


def remove_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with `keep_text`, the bytes left (`kept`): one row per document."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    bits = keycounts.bucket_bits(spark, rows, "text")  # from the bytes, so that what meets in a bucket does not grow with the input
    met_bits, size = _context_bits(bits), _filter_bits(bits)
    keys = rows.mapInArrow(lambda it: keyfilter.dealt(_anchor_keys(it), bits), "bucket int, keys binary")
    held = spark.sparkContext.broadcast(keyfilter.repeated_keys(keys, bits, size, twice=True))
    row = "bucket int, contexts binary, id long, th long, runs binary"
    sent = rows.mapInArrow(lambda it: _contexts(it, met_bits, held.value), row)

    def met(t: pa.Table) -> pa.Table:
        """A bucket's contexts become runs. Runs of a task pass through under a bucket of their document's own."""
        own = t.filter(t.column("runs").is_valid())
        contexts = t.filter(t.column("contexts").is_valid())
        out = list(_later_copies(contexts)) if contexts.num_rows else []
        return pa.concat_tables([x.select(["id", "th", "runs"]) for x in (own, *(pa.Table.from_batches([b]) for b in out))])

    spread = F.coalesce("bucket", F.pmod(F.xxhash64("id"), F.lit(1 << met_bits)).cast("int"))
    # many partitions, since little packed data is much work
    runs = sent.withColumn("b", spread).repartition(1 << met_bits - 2, "b").groupBy("b").applyInArrow(met, "id long, th long, runs binary")
    by_document = runs.groupBy("id", "th").agg(F.collect_list("runs").alias("runs"))  # bounded by the document
    texts = rows.mapInArrow(_shrunk, "id long, th long, text binary")
    done = texts.join(by_document, ["id", "th"], "left").select("id", "text", "runs")
    out = done.mapInArrow(lambda it: _emptied(it, keep_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out if keep_text else out.drop("kept")
