"""Nearest neighbours by inner product: inverted lists scanned dimension by dimension with early abandonment.

Inner products become distances by one more coordinate (the root of what a vector lacks to the largest squared norm; 0 for queries).
Vectors are turned by a random rotation, so any first t of D coordinates hold about t/D of a squared distance, and a
hypothesis test on the partial distance tells, with a small error, that a candidate cannot be among the k nearest: it is abandoned there.
Lists come from k-means on a bounded sample; blocks of a list hold the rotated vectors as blocks of columns. Survivors of all
columns are scored exactly, in double precision on the original vectors. How many lists a query probes is tuned on the
sample against brute force, for a target recall.

Equal vectors are indexed once, with the k + 1 smallest ids that have them, which are all that ties to smaller ids can let through.

Defined results: vectors null, zero, with a null or non-finite component, or of another length than the most frequent (ties: longer)
take no part, nor does a null id. Repeated rows count once; an id with several vectors is a query and a candidate with each. With at most
`SMALL` distinct vectors, one list holds all. Fewer than k others: all of them. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitefold.llm.common import written
from sitefold.runtime import ship_package

SMALL = 2_000
SAMPLE, MAX_LISTS, TUNING_QUERIES = 20_000, 4_096, 200
BLOCK, QUERY_BLOCK = 4_096, 256  # vectors of a list in a row, queries of a list in a row
FIRST_COLUMNS, COLUMNS = 16, 8  # coordinates before the first test, and between two tests
EPSILON = 2.1      # of the test: a candidate goes if its partial distance is beyond (1 + EPSILON / sqrt(t)) times what it should be
RECALL = 0.97


@dataclass
class Index:
    dim: int
    top: float              # largest squared norm
    rotation: np.ndarray    # (dim + 1) x (dim + 1)
    centres: np.ndarray     # rotated
    sizes: np.ndarray       # share of the sample in each list
    probes: int

    def turned(self, v: np.ndarray, query: bool) -> np.ndarray:
        lack = np.zeros(len(v)) if query else np.sqrt(np.maximum(0.0, self.top - np.einsum("ij,ij->i", v, v)))
        return (np.concatenate([v, lack[:, None]], 1) @ self.rotation).astype(np.float32)

    def order(self, turned: np.ndarray) -> np.ndarray:
        """Lists by distance, for each row."""
        return np.argsort((self.centres ** 2).sum(1)[None, :] - 2.0 * turned @ self.centres.T, axis=1, kind="stable")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    flat = column.flatten() if pa.types.is_list(column.type) else column
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def fit(sample: np.ndarray, top: float, n: int, k: int, recall: float = RECALL, seed: int = 7) -> Index:
    """Rotation, centres and the number of probes from a bounded sample of the n distinct vectors."""
    rng, dim = np.random.default_rng(seed), sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dim + 1, dim + 1)))[0]
    lists = 1 if n <= SMALL else int(min(MAX_LISTS, max(8, np.sqrt(n) / 2), len(sample) // 8))
    index = Index(dim, top, rotation, np.zeros((lists, dim + 1), np.float32), np.ones(lists), 1)
    x = index.turned(sample, False)
    index.centres = x[rng.choice(len(x), lists, replace=False)].copy()
    for _ in range(8 if lists > 1 else 1):
        mine = np.concatenate([index.order(x[i:i + 2048])[:, 0] for i in range(0, len(x), 2048)])
        for j in np.unique(mine):
            index.centres[j] = x[mine == j].mean(0)
    index.sizes = np.bincount(mine, minlength=lists) / len(x)
    # the fewest probes with which the tuning queries find enough of their true neighbours in the sample
    at = rng.choice(len(x), min(TUNING_QUERIES, len(x)), replace=False)
    scores = sample[at] @ sample.T
    scores[np.arange(len(at)), at] = -np.inf
    near = np.argsort(-scores, axis=1)[:, :min(k, len(x) - 1)]
    order = index.order(index.turned(sample[at], True))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(lists), order.shape), axis=1)
    needed = np.sort(np.take_along_axis(place, mine[near], axis=1).ravel())
    index.probes = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) + 1 if len(needed) else 1
    return index


def _scan(q: np.ndarray, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (query, candidate) of the pairs that no test on turned vectors abandons; `reach`: squared distance to beat per query."""
    D = x.shape[1]
    bar = lambda t: reach * (t / D) * (1.0 + EPSILON / np.sqrt(t)) ** 2 if t < D else reach * 1.0001 + 1e-6
    t = min(D, FIRST_COLUMNS)
    partial = (q[:, :t] ** 2).sum(1)[:, None] + (x[:, :t] ** 2).sum(1)[None, :] - 2.0 * q[:, :t] @ x[:, :t].T
    i, j = np.nonzero(partial <= bar(t)[:, None])
    partial = partial[i, j]
    while t < D and len(i):
        to = min(D, t + COLUMNS)
        partial = partial + ((q[i, t:to] - x[j, t:to]) ** 2).sum(1)
        t = to
        keep = partial <= bar(t)[i]
        i, j, partial = i[keep], j[keep], partial[keep]
    return i, j


def _search(batches: Iterator[pa.RecordBatch], index: Index, k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for row in range(b.num_rows):
            ids = b.column("ids")[row].values
            xo = _matrix(b.column("vectors")[row].values, index.dim)
            qo = _matrix(b.column("queries")[row].values, index.dim)
            heads, floors = b.column("heads")[row].values.to_numpy(), b.column("floors")[row].values.to_numpy()
            reach = np.maximum(0.0, index.top + np.einsum("ij,ij->i", qo, qo) - 2.0 * floors)
            i, j = _scan(index.turned(qo, True), index.turned(xo, False), reach)
            s = np.einsum("ij,ij->i", xo[j], qo[i])
            smallest = ids.flatten().to_numpy()[ids.offsets.to_numpy()[:-1] - ids.offsets[0].as_py()]
            order = np.lexsort((smallest[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            best = np.arange(len(i)) - np.searchsorted(i, i) < k
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(heads[i[best]]), ids.take(pa.array(j[best])), pa.array(s[best])], names=["head", "ids", "score"])


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """query_id, rank, the id found, score: for each id divisible by `every`, the k largest inner products among all others."""
    spark = vectors.sparkSession
    ship_package(spark)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    usable = v.isNotNull() & F.col("id").isNotNull() & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists(v, lambda e: e != 0)
    rows = rows.where(usable)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    out = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], out)
    dim = lengths[0]["d"]
    rows = rows.where(F.size("v") == dim).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit("second"), "v"))
    rows = rows.groupBy("h1", "h2", "id").agg(F.first("v").alias("v"))
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("r") <= k + 1)
    classes = written(ranked.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("v").alias("v"))
                      .withColumn("head", F.col("ids")[0]), "vector-classes")
    n, top = classes.agg(F.count(F.lit(1)), F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))).first()
    some = classes.where(F.pmod("h2", F.lit(1 << 20)) < int(min(1.0, SAMPLE / n) * (1 << 20)) + 1).select("v").limit(2 * SAMPLE).toArrow()
    sample = _matrix(pa.concat_arrays(some.column("v").chunks), dim) if some.num_rows else np.zeros((0, dim))
    if len(sample) < 2:
        sample = _matrix(pa.concat_arrays(classes.select("v").limit(SMALL).toArrow().column("v").chunks), dim)
    held = spark.sparkContext.broadcast(fit(sample, top, n, k, recall))

    def listed(batches: Iterator[pa.RecordBatch], query: bool) -> Iterator[pa.RecordBatch]:
        index = held.value
        for b in batches:
            order = index.order(index.turned(_matrix(b.column("v"), dim), query))
            if query:  # the tuned number of lists, and more while they are small for k
                enough = np.cumsum(index.sizes[order] * n, axis=1) - index.sizes[order] * n >= 8 * k
                width = np.maximum(index.probes, np.where(enough.any(1), enough.argmax(1), order.shape[1]))
            else:
                width = np.ones(len(order), int)
            chosen = np.arange(order.shape[1])[None, :] < width[:, None]
            at = np.nonzero(chosen)[0]
            out = [pa.array(order[chosen].astype(np.int32)), *b.take(pa.array(at)).columns]
            if query:
                out.append(pa.array(np.nonzero(chosen)[1].astype(np.int32)))
            yield pa.RecordBatch.from_arrays(out, names=["list", *b.schema.names, "place"][:len(out)])

    members = classes.select("head", "ids", "v").mapInArrow(lambda it: listed(it, False), "list int, head long, ids array<long>, v array<double>")
    asked = rows.where(F.col("id") % every == 0).select("h1", "h2", F.col("id").alias("query_id"))
    askers = asked.join(classes.select("h1", "h2", "head"), ["h1", "h2"]).select("query_id", "head")
    query_classes = asked.select("h1", "h2").distinct().join(classes, ["h1", "h2"]).select("head", "v")
    probing = query_classes.mapInArrow(lambda it: listed(it, True), "list int, head long, v array<double>, place int")

    def parts(df: DataFrame, size: int):
        """A hash part of a list with about `size` rows; at most MAX_LISTS counts come to the driver."""
        counts = {r["list"]: -(-r["count"] // size) for r in df.groupBy("list").count().collect()} or {0: 1}
        number = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[F.col("list")]
        return F.pmod(F.xxhash64("head"), number)

    blocks = members.groupBy("list", parts(members, BLOCK).alias("part")).agg(F.collect_list(F.struct("ids", "v")).alias("rows"))
    blocks = blocks.select("list", F.col("rows.ids").alias("ids"), F.flatten("rows.v").alias("vectors"))

    def searched(asking: DataFrame) -> DataFrame:
        """The k + 1 best classes of each query among the lists it asks for."""
        asks = asking.groupBy("list", parts(asking, QUERY_BLOCK).alias("part")).agg(F.collect_list(F.struct("head", "v", "floor")).alias("rows"))
        asks = asks.select("list", F.col("rows.head").alias("heads"), F.col("rows.floor").alias("floors"), F.flatten("rows.v").alias("queries"))
        hits = asks.join(blocks, "list").select("heads", "floors", "queries", "ids", "vectors").mapInArrow(lambda it: _search(it, held.value, k + 1), "head long, ids array<long>, score double")
        return top_classes(hits)

    def top_classes(hits: DataFrame) -> DataFrame:
        by = Window.partitionBy("head").orderBy(F.desc("score"), F.col("ids")[0])
        return hits.withColumn("r", F.row_number().over(by)).where(F.col("r") <= k + 1)

    # the nearest list of each query sets what candidates of its other lists have to reach
    nearest_hits = written(searched(probing.where("place = 0").withColumn("floor", F.lit(float("-inf")))), "nearest-lists")
    floors = nearest_hits.where(F.col("r") == k + 1).select("head", F.col("score").alias("floor"))
    others = probing.where("place > 0").join(floors, "head", "left").fillna(float("-inf"), "floor")
    best = top_classes(nearest_hits.drop("r").unionByName(searched(others).drop("r")))
    found = best.select("head", "score", F.explode("ids").alias("vec_id"))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("head").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k + 1).drop("r")
    each = askers.join(found, "head").where(F.col("query_id") != F.col("vec_id"))
    rank = F.row_number().over(Window.partitionBy("query_id", "head").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
