"""Benchmark decontamination by latent semantic retrieval.

Each text is written once as the terms of its words: places in the benchmark's vocabulary, or -1. The TF-IDF matrix of passages over these
terms (document frequencies count all passages of all documents) is factorised by a distributed randomised SVD: every task sends its share of
A'(A W) for one random W, the shares are summed per term, and the small eigenproblem that is left is solved on the driver. Coordinates are scaled
to equal variance, so that what all passages of a language share does not count; a term's direction there, times its IDF, is its vector.

A window's cosine with an item decides alone whether it is a candidate. Windows are one and a half to somewhat over two times as long as the item,
at every third of their length, so that one of them holds each run of the item's length; words that the benchmark does not have count in a window's
length. A candidate is a leak if the longest common subsequence with its surroundings covers enough of the item's words and, where the item
has an answer mark, of what follows it; where the cosine is as high as that of the item itself, fewer words of both its halves are enough (a paraphrase).

The benchmark is taken in blocks of at most ITEMS items and about TERMS words, each against all documents; what is broadcast is bounded by a block.

Defined results: null or empty texts and items without words match nothing; items of fewer than SHORT words must occur word for word;
repeated rows are found repeatedly; a null id stays null. Other columns play no part.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm.common import lean, written
from sitefold.llm.shingles import span_hashes
from sitefold.llm.shingles import words as runs
from sitefold.runtime import ship_package

ITEMS, TERMS = 20_000, 1 << 16
PASSAGE = 16               # words of a passage of the TF-IDF matrix
BLOCK = 4                  # windows are whole blocks of so many words
RANK, SPARE = 128, 16
MAX_SHARE = 0.05           # a term in more than this share of all passages weighs nothing, unless its item has fewer than FEW others
FEW = 3
COMMON, ANSWER_COMMON = 0.75, 0.6
BAR = 0.5                  # of the cosine that a window with the share COMMON of an item's words has if all words weigh the same
CLOSE, LOOSE = 0.95, 0.6   # a cosine of so much of the item's own makes the share LOOSE of both its halves enough
SHORT = 8
AT_ONCE = 1 << 20          # bytes of text, or of terms, at once
TOGETHER = 1 << 18         # the same where words are hashed: a byte takes some thirty there
WINDOWED = 1 << 16         # the same where windows are summed: a byte takes over a hundred there
CELLS = 1 << 22            # cosines at once
_ANSWER = re.compile(r"(?:^|\s)(?:answer|antwort|réponse|respuesta)\s*[:=]", re.I)
# Bytes that are no part of a word: ASCII other than letters and digits.
_BLANK = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def clean(text: str | None) -> bytes:
    return text.lower().encode().translate(_BLANK) if text else b""


def words(text: str | None) -> list[bytes]:
    return clean(text).split()


def _places(a: list) -> dict:
    """The places of each word of `a` as the bits of one integer."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    return at


def _common(at: dict, n: int, b: list) -> int:
    full = (1 << n) - 1
    row = full
    for w in b:
        if m := at.get(w):
            u = row & m
            row = ((row + u) | (row - u)) & full
    return n - row.bit_count()


def common(a: list, b: list) -> int:
    """Length of the longest common subsequence, a row of the table being the bits of one integer."""
    return _common(_places(a), len(a), b)


@dataclass
class Items:
    ids: list[int]
    terms: list[list[int]]     # of each item's words
    answers: list[list[int]]   # of what follows its answer mark
    hashes: np.ndarray         # of the vocabulary's words, sorted
    by_hash: np.ndarray        # their terms

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Items:
        split = [(i, words(t), words(t[m.end():]) if (m := _ANSWER.search(t)) else []) for i, t in rows]
        split = [(i, w, a) for i, w, a in split if w]
        vocabulary = sorted({w for _, ws, _ in split for w in ws})
        number = {w: n for n, w in enumerate(vocabulary)}
        data = np.frombuffer(b" ".join(vocabulary), np.uint8)
        h = span_hashes(data, *runs(data)) if vocabulary else np.zeros(0, np.uint64)
        return cls([i for i, _, _ in split], [[number[w] for w in ws] for _, ws, _ in split], [[number[w] for w in a] for _, _, a in split],
                   np.sort(h), np.argsort(h).astype(np.int32))

    @cached_property
    def bags(self) -> list[frozenset[int]]:
        return [frozenset(ts) for ts in self.terms]

    @cached_property
    def places(self) -> list[dict[int, int]]:
        return [_places(ts) for ts in self.terms]

    def found_in(self, item: int, passage: list[int], close: bool = False) -> float:
        """The share of the item's words in common order, or 0 if that or, where it has one, its answer's is too small."""
        mine = self.terms[item]
        if len(mine) < SHORT:
            return float(any(passage[k:k + len(mine)] == mine for k, t in enumerate(passage) if t == mine[0]))
        share = _common(self.places[item], len(mine), passage) / len(mine)
        if share < COMMON and not (close and all(common(half, passage) >= LOOSE * len(half) for half in (mine[:len(mine) // 2], mine[len(mine) // 2:]))):
            return 0.0
        answer = self.answers[item]
        return share if common(answer, passage) >= ANSWER_COMMON * len(answer) else 0.0


def _groups(sizes: list[int], most: int) -> Iterator[slice]:
    """Neighbours whose sizes add up to at most `most`, or one by itself."""
    at = 0
    while at < len(sizes):
        end, size = at + 1, sizes[at]
        while end < len(sizes) and size + sizes[end] <= most:
            size += sizes[end]
            end += 1
        yield slice(at, end)
        at = end


def _sizes(column: pa.Array) -> list[int]:
    """Bytes of each value."""
    return pc.fill_null(pc.binary_length(column), 0).to_pylist()


def _term_of(items: Items, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and term of each word of cleaned text, in pieces that end at blanks."""
    begins, terms, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], 0
    while at < len(data):
        end = data.find(b" ", at + min(AT_ONCE, TOGETHER))
        end = len(data) if end < 0 else end
        piece = np.frombuffer(data, np.uint8, end - at, at)
        begin, stop = runs(piece)
        if len(begin):
            h = span_hashes(piece, begin, stop)
            place = np.minimum(np.searchsorted(items.hashes, h), len(items.hashes) - 1)
            begins.append(begin + at)
            terms.append(np.where(items.hashes[place] == h, items.by_hash[place], np.int32(-1)))
        at = end
    return np.concatenate(begins), np.concatenate(terms)


@lean
def _coded(batches, items: Items) -> Iterator[pa.RecordBatch]:
    """(id, terms): the terms of each text's words as little-endian 32-bit integers."""
    for b in batches:
        for part in _groups(_sizes(b.column("text")), min(AT_ONCE, TOGETHER)):
            cleaned = [clean(t) for t in b.column("text")[part].to_pylist()]
            begin, term = _term_of(items, b" ".join(cleaned))
            edges = np.searchsorted(begin, np.cumsum([0] + [len(c) + 1 for c in cleaned]))
            raw = [term[i:j].astype("<i4").tobytes() for i, j in zip(edges[:-1].tolist(), edges[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("id").slice(part.start, len(raw)), pa.array(raw, pa.binary())], names=["id", "terms"])


def _passages(batch: pa.RecordBatch, width: int, overlap: int = 0, together: int = AT_ONCE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows and terms of neighbouring texts, and the first block of `width` words of each text, which has at least one.

    Texts are padded to whole blocks by a term after the last, -2; long ones come in pieces of which each begins with the last `overlap` words before it.
    Neighbours have at most `together` bytes of terms; a text's pieces do not depend on that."""
    most = AT_ONCE // 4 // width * width + overlap
    sizes = [n // 4 for n in _sizes(batch.column("terms"))]
    for part in _groups(sizes, min(most, together // 4)):
        texts = [(part.start + k, np.frombuffer(r, "<i4")) for k, r in enumerate(batch.column("terms")[part].to_pylist())]
        if len(texts) > 1 or sizes[part.start] <= most:
            pieces = [texts]
        else:
            row, t = texts[0]
            pieces = [[(row, t[at:at + most])] for at in range(0, len(t) - overlap, most - overlap)]
        for piece in pieces:
            size = np.array([len(t) for _, t in piece])
            blocks = np.maximum(1, -(-size // width))
            first = np.concatenate([[0], np.cumsum(blocks)])
            term = np.full(int(first[-1]) * width, -2, np.int32)
            to = np.repeat(first[:-1] * width - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
            term[to] = np.concatenate([t for _, t in piece])
            yield np.array([r for r, _ in piece]), term, first


def _sums(vectors: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """The sum of the vectors at each row's places."""
    out = vectors[slots[:, 0]]
    for k in range(1, slots.shape[1]):
        out += vectors[slots[:, k]]
    return out


def _merged(sums: np.ndarray, first: np.ndarray, times: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of `times` neighbouring rows of a text, the last perhaps of fewer; and where each text begins. A row of zeros ends both tables."""
    count = -(-np.diff(first) // times)
    begin = np.concatenate([[0], np.cumsum(count)])
    at = np.append(np.repeat(first[:-1] - begin[:-1] * times, count) + np.arange(int(begin[-1])) * times, first[-1])
    return _runs(sums, at, np.append(np.repeat(first[1:], count), first[-1]), times), begin


def _runs(sums: np.ndarray, at: np.ndarray, last: np.ndarray, times: int) -> np.ndarray:
    """The sums of `times` rows from each of `at`, or of those before `last`; the last row is zero."""
    out = sums[at]
    for k in range(1, times):
        out += sums[np.where(at + k < last, at + k, len(sums) - 1)]
    return out


@lean
def _frequencies(batches, v: int) -> Iterator[pa.RecordBatch]:
    """Passages that hold each term; term -1 counts all passages."""
    df, n = np.zeros(v, np.int64), 0
    for b in batches:
        for _, term, first in _passages(b, PASSAGE):
            at = np.flatnonzero(term >= 0)
            held = np.sort(at // PASSAGE * v + term[at])
            df += np.bincount(held[np.diff(held, prepend=-1) > 0] % v, minlength=v)
            n += int(first[-1])
    some = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([[-1], some]).astype(np.int32)), pa.array(np.concatenate([[n], df[some]]))], names=["term", "n"])


@lean
def _sketch(batches, idf: np.ndarray, omega: np.ndarray) -> Iterator[pa.RecordBatch]:
    """This task's share of A'(A W), one row per term."""
    y = np.zeros(omega.shape)
    weighted, heard = np.append(omega * idf[:, None], np.zeros((2, omega.shape[1])), axis=0).astype(np.float32), np.append(idf > 0, [False, False])
    for b in batches:
        for _, term, _ in _passages(b, PASSAGE):
            at = np.flatnonzero(heard[term])
            if not len(at):
                continue
            aw = _sums(weighted, term.reshape(-1, PASSAGE))
            at = at[np.argsort(term[at], kind="stable")]
            edges, passage = np.flatnonzero(np.diff(term[at], prepend=-1, append=-1)), at // PASSAGE
            for i, j, t in zip(edges[:-1].tolist(), edges[1:].tolist(), term[at[edges[:-1]]].tolist()):
                y[t] += np.add.reduce(aw[passage[i:j]], axis=0)
    y *= idf[:, None]
    some = np.flatnonzero(np.abs(y).sum(1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(y[some, j].astype(np.float32)) for j in range(y.shape[1]))], names=["term", *(f"y{j}" for j in range(y.shape[1]))])


def _scales(lengths: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(blocks of a third of a window, items): two thirds hold each of the items. Thirds are 1, 2, 3, 4, 6, 8, 12, 16 and so on blocks."""
    out, below, third, then = [], 0, 1, 2
    while below < lengths.max():
        reach = 2 * third * BLOCK
        out.append((third, np.flatnonzero((lengths > below) & (lengths <= reach))))
        below, third, then = reach, then, 3 if third == 1 else 2 * third
    return out


@lean
def _matches(batches, items: Items, latent: np.ndarray, unknown: float) -> Iterator[pa.RecordBatch]:
    """(id, item, cosine, share) of each document's leaks: per item the passage with the largest share. `unknown` is the square of an unknown word's weight."""
    lengths = np.array([len(ts) for ts in items.terms])
    q = np.array([latent[ts].sum(0) for ts in items.terms], np.float32)
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)
    # the last but one row is padding, the last an unknown word, which counts in one more column
    vectors = np.zeros((len(latent) + 2, latent.shape[1] + 1), np.float32)
    vectors[:-2, :-1] = latent
    vectors[-1, -1] = unknown
    share = np.where(lengths < SHORT, 1.0, COMMON)
    # an order of most of n words leaves out at most so many different ones; halves are rounded by themselves
    need = [len(bag) - int((1 - LOOSE) * len(ts)) - 1 for bag, ts in zip(items.bags, items.terms)]
    scales = _scales(lengths)
    for b in batches:
        best: dict[tuple[int, int], tuple[float, float]] = {}
        for row, term, first in _passages(b, BLOCK, overlap=5 * scales[-1][0] * BLOCK, together=WINDOWED):
            thirds = {1: (_sums(vectors, np.append(term, np.full(BLOCK, -2, np.int32)).reshape(-1, BLOCK)), first)}
            for third, mine in scales:
                if third > 1:
                    times = 3 if third == 3 else 2
                    thirds[third] = _merged(*thirds[third // times], times)
                if not len(mine):
                    continue
                part, begin = thirds[third]
                owner = np.repeat(np.arange(len(row)), np.diff(begin))
                nth = np.arange(len(owner)) - begin[owner]
                last = begin[owner + 1]
                # a window that ends with the text holds those which begin later
                at = np.flatnonzero((nth == 0) | (np.arange(len(owner)) + 3 <= last))
                alike = np.sqrt(np.minimum(1.0, lengths[mine] / (3 * third * BLOCK))).astype(np.float32)
                bar, high, seen = np.maximum(BAR * share[mine] * alike, 1e-6).astype(np.float32), CLOSE * alike, -1
                turned, rows = np.ascontiguousarray(q[mine].T), max(1, CELLS // len(mine))
                for lo in range(0, len(at), rows):
                    window = _runs(part, at[lo:lo + rows], last[at[lo:lo + rows]], 3)
                    alien, window = window[:, -1], window[:, :-1]
                    cosine = window @ turned
                    cosine /= np.maximum(np.sqrt(np.einsum("ij,ij->i", window, window) + alien)[:, None], 1e-12)
                    for i, j in zip(*(x.tolist() for x in np.nonzero(cosine >= bar))):
                        if lo + i != seen:
                            seen = lo + i
                            doc, a = int(owner[at[seen]]), int(nth[at[seen]])
                            origin, step = int(first[doc]) * BLOCK, third * BLOCK
                            passage = term[origin + max(0, a - 1) * step:min(int(first[doc + 1]) * BLOCK, origin + (a + 4) * step)].tolist()
                            bag, key = frozenset(passage), int(row[doc])
                        item = int(mine[j])
                        # most different words of an item must occur before an order of them is looked for
                        if len(items.bags[item] & bag) < need[item] or best.get((key, item), (0.0, 0.0))[1] >= 1.0:
                            continue
                        found = items.found_in(item, passage, bool(cosine[i, j] >= high[j]))
                        if found:
                            best[key, item] = max(best.get((key, item), (0.0, 0.0)), (float(cosine[i, j]), found), key=lambda x: x[1])
        if best:
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array([d for d, _ in best])), pa.array([items.ids[i] for _, i in best], pa.int64()),
                                              pa.array([c for c, _ in best.values()], pa.float64()), pa.array([s for _, s in best.values()], pa.float64())], names=["id", "item", "cosine", "share"])


def latent_terms(coded: DataFrame, items: Items, seed: int = 5) -> tuple[np.ndarray, float]:
    """Each term's direction in the latent space times its weight, and the mean square of the weights."""
    sc = coded.sparkSession.sparkContext
    v, r = len(items.hashes), RANK + SPARE
    counted = coded.mapInArrow(lambda it: _frequencies(it, v), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(v + 1)
    counts[counted.column("term").to_numpy() + 1] = counted.column("n").to_numpy()
    idf = np.log((counts[0] + 1) / (counts[1:] + 1)) + 1
    usual = counts[1:] > MAX_SHARE * counts[0]
    needed = {t for bag in items.bags if sum(not usual[t] for t in bag) < FEW for t in bag}
    usual[list(needed)] = False
    idf[usual] = 0.0
    r = min(r, v)
    omega = np.random.default_rng(seed).standard_normal((v, r)) * (idf > 0)[:, None]
    given = sc.broadcast((idf, omega))
    schema = "term int, " + ", ".join(f"y{j} float" for j in range(r))
    shares = coded.mapInArrow(lambda it: _sketch(it, *given.value), schema).groupBy("term").agg(*[F.sum(f"y{j}").alias(f"y{j}") for j in range(r)]).toArrow()
    y = np.zeros((v, r))
    if shares.num_rows:
        y[shares.column("term").to_numpy()] = np.stack([shares.column(f"y{j}").to_numpy() for j in range(r)], 1)
    # A'A is about Y (W'Y)^+ Y'; its leading eigenvectors are A's right singular vectors
    basis, _ = np.linalg.qr(y)
    inner = basis.T @ y
    values, turn = np.linalg.eigh(inner @ np.linalg.pinv((omega.T @ y + y.T @ omega) / 2, rcond=1e-10, hermitian=True) @ inner.T)
    leading = np.argsort(-values)[:RANK]
    leading = leading[values[leading] > 1e-9 * max(values.max(), 1e-300)]
    at = basis @ turn[:, leading] / np.sqrt(values[leading])
    size = np.linalg.norm(at, axis=1, keepdims=True)
    vectors = np.where(size > 1e-9 * max(size.max(), 1e-300), at / np.maximum(size, 1e-300), 0.0) * idf[:, None]
    return vectors.astype(np.float32), float(np.mean(idf[idf > 0] ** 2)) if (idf > 0).any() else 1.0


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, cosine, common_share for each benchmark item that a document leaks."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    read = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).cast("string").alias("t")).where("t is not null")
    found = spark.createDataFrame([], "doc_id long, item_id long, cosine double, common_share double")
    held: list[tuple[int, str]] = []
    vocabulary: set[bytes] = set()

    def search(block: list[tuple[int, str]]) -> None:
        nonlocal found
        items = Items.of(block)
        if items.ids:
            given = spark.sparkContext.broadcast(items)
            coded = written(rows.mapInArrow(lambda it: _coded(it, given.value), "id long, terms binary"), "benchmark-terms")
            space = spark.sparkContext.broadcast(latent_terms(coded, items))
            hits = coded.mapInArrow(lambda it: _matches(it, given.value, *space.value), "id long, item long, cosine double, share double")
            found = found.unionByName(hits.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "cosine", F.col("share").alias("common_share")))

    for r in read.orderBy("i", "t").toLocalIterator():
        held.append((r["i"], r["t"]))
        vocabulary.update(words(r["t"]))
        if len(held) == ITEMS or len(vocabulary) >= TERMS:
            search(held)
            held, vocabulary = [], set()
    search(held)
    return found
