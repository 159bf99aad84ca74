"""Language identification by prediction with partial matching.

Each language has a tree of byte contexts up to a fixed order with the counts of what followed. A byte's probability is its share in the
longest known context, or else the escape probability (method C, with exclusion of what the longer context would have
coded) times its probability one order lower, down to a uniform order of -1. Statistics are frozen after training, so the code length of a
text is a sum of table entries, and the language that codes it in the fewest bits is predicted.

Training reads a bounded sample: about `rows_per_language` whole documents of each of at most `max_languages` languages, chosen by a
hash of their id; at most `max_contexts` contexts are kept, the most frequent. Prediction reads every whole text.

Defined results: a null text, and one without a letter, is `und` with score 0; so is everything if nothing could be learned. A null id
is not held out and not learned from. Equal code lengths go to the language that sorts first. Rows are independent, so repeated rows
change nothing; other columns pass through, except those named like an output.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitefold.llm.common import lean, map_columns, texts
from sitefold.runtime import ship_package

ORDER = 3
ROWS_PER_LANGUAGE, MAX_LANGUAGES, MAX_CONTEXTS, MIN_COUNT = 600, 200, 20_000, 3
CODED_AT_ONCE, TEXTS_AT_ONCE = 1 << 17, 1 << 20  # bytes whose code lengths are looked up together, and of the texts prepared for that
_LETTER = re.compile(r"[^\W\d_]")


def held_out(id_col: str = "doc_id"):
    """True where crc32 of the id's decimal text is divisible by 5."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _bytes(text: str) -> bytes:
    return text.lower().encode("utf-8")


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray    # byte -> symbol; all bytes never seen share the last
    child: np.ndarray     # node x symbol of the next older byte -> node, or the last (dead) node
    bits: np.ndarray      # (node * symbols + symbol) x language: code length
    order: int

    def code_lengths(self, data: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Bits of each text under each language. `data`: bytes of all texts, `begin`: where each starts."""
        a, out = self.child.shape[1], np.zeros((len(begin), len(self.languages)))
        if not len(data):
            return out
        owner_edge = np.append(begin, len(data))
        sizes = np.diff(owner_edge)
        s = self.symbol[data]
        for at in range(0, len(data), CODED_AT_ONCE):
            part = slice(at, min(len(data), at + CODED_AT_ONCE))
            first = np.searchsorted(owner_edge, at, side="right") - 1
            inside = np.searchsorted(owner_edge, part.stop, side="left")
            owner = np.repeat(np.arange(first, inside), np.minimum(owner_edge[first + 1:inside + 1], part.stop) - np.maximum(owner_edge[first:inside], at))
            pos = np.arange(at, part.stop)
            depth = pos - begin[owner]
            node = best = np.zeros(len(pos), np.int32)
            for k in range(1, self.order + 1):
                older = np.where(depth >= k, s[np.maximum(pos - k, 0)], a - 1)
                node = self.child[node, older]
                best = np.where(node < len(self.child) - 1, node, best)
            cost = self.bits[best.astype(np.int64) * a + s[part]]
            filled = np.flatnonzero(np.bincount(owner - first, minlength=inside - first)) + first
            starts = np.maximum(owner_edge[filled], at) - at
            out[filled] += np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        assert sizes.sum() == len(data)
        return out


@lean
def _gram_counts(batches: Iterator[pa.RecordBatch], languages: list[str], order: int) -> Iterator[pa.RecordBatch]:
    """(language, order, gram, n): gram holds the context's bytes, oldest first, and then the byte that followed."""
    for b in batches:
        by: dict[int, list[bytes]] = {}
        for lang, text in zip(b.column("lang").to_pylist(), texts(b, "text")):
            by.setdefault(languages.index(lang), []).append(_bytes(text))
        for lang, parts in by.items():
            data = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
            depth = np.concatenate([np.arange(len(p)) for p in parts]) if parts else np.zeros(0, np.int64)
            gram = np.zeros(len(data), np.int64)
            for k in range(order + 1):
                if k:
                    gram[k:] += data[:-k] << (8 * k)
                else:
                    gram = data.copy()
                key, n = np.unique(gram[depth >= k], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), lang, np.int32)), pa.array(np.full(len(key), k, np.int32)), pa.array(key), pa.array(n.astype(np.int64))], names=["lang", "k", "gram", "n"])


def _build(languages: list[str], k: np.ndarray, lang: np.ndarray, gram: np.ndarray, n: np.ndarray, order: int, max_contexts: int, min_count: int) -> Model:
    seen = np.unique(gram[k == 0]) & 255
    symbol = np.full(256, len(seen), np.int32)
    symbol[seen] = np.arange(len(seen))
    a, L = len(seen) + 1, len(languages)
    # nodes: the root, then contexts by order; a context's suffix occurs at least as often, so it is kept with it
    nodes: list[np.ndarray] = [np.zeros(1, np.int64)]
    room, totals = max_contexts, []
    for d in range(1, order + 1):
        ctx, at = np.unique(gram[k == d] >> 8, return_inverse=True)
        totals.append((ctx, np.bincount(at, n[k == d], len(ctx))))
    bar = min_count
    every = np.sort(np.concatenate([t for _, t in totals]))[::-1] if totals else np.zeros(0)
    if len(every) > room:
        bar = max(bar, every[room])
    kept = np.zeros(1, np.int64)
    for d, (ctx, total) in enumerate(totals, 1):
        ctx = ctx[total > bar] if bar > min_count else ctx[total >= bar]
        if d > 1:
            ctx = ctx[np.isin(ctx & ((1 << (8 * (d - 1))) - 1), kept)]
        nodes.append(ctx)
        kept = ctx
    base = np.concatenate([[0], np.cumsum([len(x) for x in nodes])])
    m = int(base[-1])
    child = np.full((m + 1, a), m, np.int32)
    parent = np.zeros(m, np.int64)
    for d in range(1, order + 1):
        ctx = nodes[d]
        shorter = ctx & ((1 << (8 * (d - 1))) - 1)
        parent[base[d]:base[d + 1]] = base[d - 1] + np.searchsorted(nodes[d - 1], shorter)
        child[parent[base[d]:base[d + 1]], symbol[ctx >> (8 * (d - 1))]] = base[d] + np.arange(len(ctx))
    bits = np.zeros((m * a, L), np.float32)
    for l in range(L):
        count = np.zeros((m, a))
        for d in range(order + 1):
            mine = (k == d) & (lang == l)
            ctx = gram[mine] >> 8
            if not len(nodes[d]):
                continue
            where = np.minimum(np.searchsorted(nodes[d], ctx), len(nodes[d]) - 1)
            ok = nodes[d][where] == ctx
            count[base[d] + where[ok], symbol[gram[mine][ok] & 255]] += n[mine][ok]
        has = count > 0
        kinds, total = has.sum(1), count.sum(1)
        unseen = 256 - len(seen)  # bytes behind the last symbol; each costs the same
        lower = np.empty((m, a))  # what a byte costs after an escape from the node
        lower[0] = 1.0 / max(1, 256 - kinds[0])
        for v in range(1, order + 1):
            mine = np.arange(base[v], base[v + 1])
            u = parent[mine]
            left = ~has[mine]
            t = (has[u] & left).sum(1)
            total_left = (count[u] * left).sum(1) + t
            escape = np.where(t > 0, t / np.maximum(total_left, 1), 1.0)
            lower[mine] = np.where(has[u], count[u] / np.maximum(total_left, 1)[:, None], escape[:, None] * lower[u])
        both = np.maximum(total + kinds, 1)[:, None]
        p = np.where(has, count / both, np.where((kinds > 0)[:, None], kinds[:, None] / both, 1.0) * lower)
        bits[:, l] = -np.log2(p).ravel()
        assert unseen >= 0
    return Model(languages, symbol, child, bits, order)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE, max_languages: int = MAX_LANGUAGES,
          order: int = ORDER, max_contexts: int = MAX_CONTEXTS, min_count: int = MIN_COUNT) -> Model | None:
    """Learn from documents that have a language, a text and an id that is not held out; None if there are none."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out("id"))
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()
    if not sizes:
        return None
    languages = sorted(r["lang"] for r in sizes)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, rows_per_language / r["count"]))])
    place = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where(F.col("lang").isin(languages) & (place < share[F.col("lang")])).select("text", "lang")
    grams = sample.mapInArrow(lambda it: _gram_counts(it, languages, order), "lang int, k int, gram long, n long")
    g = grams.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toArrow()
    col = lambda c: g.column(c).to_numpy()
    return _build(languages, col("k"), col("lang"), col("gram"), col("n"), order, max_contexts, min_count) if g.num_rows else None


def predict(docs: DataFrame, model: Model | None, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score", bits_col: str = "bits_per_byte") -> DataFrame:
    """`docs` with the language, its probability against the other learned languages, and the bits its code spends on a byte."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        model, column = held.value, texts(batch, text_col)
        pred, score, rate = ["und"] * len(column), np.zeros(len(column)), [None] * len(column)
        at = 0
        while model is not None and at < len(column):
            mine, parts, size = [], [], 0
            while at < len(column) and size < TEXTS_AT_ONCE:
                if column[at] and _LETTER.search(column[at]):
                    mine.append(at)
                    parts.append(_bytes(column[at]))
                    size += len(parts[-1])
                at += 1
            if not mine:
                continue
            sizes = np.array([len(p) for p in parts])
            bits = model.code_lengths(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            best = bits.argmin(1)
            score[mine] = 1.0 / np.exp2(np.maximum(bits.min(1)[:, None] - bits, -1000.0)).sum(1)
            for i, b, r in zip(mine, best, bits.min(1) / sizes):
                pred[i], rate[i] = model.languages[b], float(r)
        return {pred_col: pa.array(pred, pa.string()), score_col: pa.array(score), bits_col: pa.array(rate, pa.float64())}

    return map_columns(docs, run, [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType()), T.StructField(bits_col, T.DoubleType())])
