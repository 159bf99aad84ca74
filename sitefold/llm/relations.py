"""Exact n-gram Jaccard join by set-relation skipping.

A set's shingles are put in one global order, those of few sets first. Two linked sets share a shingle in their first parts, at positions that
leave enough room for the overlap they need, so an index lists for each shingle the sets that hold it there, with size and position.
Shingles of a single set are never listed: they only push the others back, and with them what a set could be linked with out of reach.

Relations between sets spare most of the comparisons:
* Index level: the entries of a list are blocks of like size and position, and a pair of blocks is skipped when no entry of one can reach one of the other.
* Answer level: a leader of each list is compared first, and all that it links is one answer. Sets of one answer are connected, whatever else
  they share, so lists within one answer are done; a few rounds with other leaders leave little.
* Inside the blocks that remain, a set close to one already compared gets its answers from that one's: with x and z at distances dx and dz
  (elements in one set only) from a pivot, their own distance lies between |dx - dz| and dx + dz, which mostly decides; where it does not, their overlap
  follows from the few elements by which they differ from the pivot.
Between rounds one pass of contraction over the new links labels the answers. Every link between different labels is verified on full sets,
and the components of all links are formed once, at the end, so they are exact.

Defined results: documents with equal sets are one class, whose smallest id joins; a document without words has an empty set and no
links; a null id has its size and a null component; rows that share an id share a component, if their sets are not empty. Other columns
play no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm import keycounts, shingles
from sitefold.llm.common import MIX1, mix64, written
from sitefold.llm.graph import components, contracted
from sitefold.runtime import ship_package

WIDTH, PERCENT = 5, 80          # words of a shingle; 100 * intersection >= PERCENT * union
FREQUENT = (2, 8, 64, 1024)     # sets that hold a shingle, in steps of the global order
UNIT = 1 << 20                  # shingles of a task counted together
ROWS = 1000                     # documents whose sets a task holds at once
CELL, BLOCK = 200, 256          # sets compared with one leader in a task; sets of a block
ROUNDS = 3                      # leaders tried before blocks are compared

CANDIDATE = "node long, n long, h1 long, h2 long, tokens array<long>, places array<int>, packed binary"


def _sides(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each whole set."""
    return tuple(np.array([int(mix64(s ^ salt).sum(dtype=np.uint64).view(np.int64)) for s in sets], np.int64) for salt in (np.uint64(0), MIX1))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Few rows at a time, with their texts."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            part = b.slice(at, ROWS)
            yield part, [t.encode() if t else b"" for t in part.column("text").to_pylist()]


def _counting(bits: int):
    names = ["id", "n", "h1", "h2", "bucket", "keys"]
    types = [pa.int64()] * 4 + [pa.int32(), pa.binary()]

    def rows(**columns) -> pa.RecordBatch:
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in zip(names, types)], names=names)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        buckets, packs = keycounts.dealt(*np.unique(keycounts.keys_of(np.concatenate(held)), return_counts=True), bits)
        return rows(bucket=buckets, keys=packs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for b, texts in _parts(batches):
            sets = shingles.sets(texts, WIDTH)
            h1, h2 = _sides(sets)
            yield rows(id=b.column("id"), n=[len(s) for s in sets], h1=h1, h2=h2)
            for s, key in zip(sets, zip(h1.tolist(), h2.tolist())):
                if key not in seen:  # copies count once
                    seen.add(key)
                    held.append(s)
                    size += len(s)
                    if size >= UNIT:
                        yield counted(held)
                        held, size, seen = [], 0, set()
        if size:
            yield counted(held)

    return run


def first_places(s: np.ndarray, frequent: keycounts.Filters) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of a set's first part, in the global order, that other sets hold too, and their positions."""
    level = frequent.level(keycounts.keys_of(s))
    order = np.argsort(level, kind="stable")[:len(s) - (PERCENT * len(s) + 99) // 100 + 1]  # sets are sorted by hash already
    places = np.flatnonzero(level[order])
    return s[order[places]], places


def _candidates(frequent: keycounts.Filters):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b, texts in _parts(batches):
            sets = shingles.sets(texts, WIDTH)
            found = [first_places(s, frequent) if len(s) else (s, s) for s in sets]
            some = [i for i, (t, _) in enumerate(found) if len(t)]
            h1, h2 = _sides([sets[i] for i in some])
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(some, pa.int64())), pa.array([len(sets[i]) for i in some], pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()),
                                              pa.array([found[i][0].view(np.int64) for i in some], pa.list_(pa.int64())), pa.array([found[i][1].astype(np.int32) for i in some], pa.list_(pa.int32())),
                                              pa.array([z.compress(texts[i]) for i in some], pa.binary())], names=["node", "n", "h1", "h2", "tokens", "places", "packed"])

    return run


def _unpacked(given: list[dict]) -> dict[int, list[np.ndarray]]:
    """The sets of each node: rows that share an id have one each."""
    z, of = zstandard.ZstdDecompressor(), {}
    for x, s in zip(given, shingles.sets([z.decompress(x["packed"]) for x in given], WIDTH)):
        of.setdefault(x["node"], []).append(s)
    return of


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Elements in both of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    return int((y[np.minimum(at, len(y) - 1)] == x).sum())


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = overlap(x, y)
    return 100 * both >= PERCENT * (len(x) + len(y) - both)


class Family:
    """Sets near a pivot, kept as what they lack of it and what they have beside it."""

    def __init__(self, pivot: np.ndarray):
        self.pivot = pivot

    def differences(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.setdiff1d(self.pivot, s, assume_unique=True), np.setdiff1d(s, self.pivot, assume_unique=True)

    def linked(self, x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> bool:
        """Whether two sets are linked, from their differences: a link is a distance of at most (100 - PERCENT) / (100 + PERCENT) of both sizes."""
        (lack_x, more_x), (lack_y, more_y) = x, y
        nx, ny = (len(self.pivot) - len(lack) + len(more) for lack, more in (x, y))
        most, dx, dy = (100 - PERCENT) * (nx + ny), len(lack_x) + len(more_x), len(lack_y) + len(more_y)
        if (100 + PERCENT) * (dx + dy) <= most:
            return nx > 0 and ny > 0
        if (100 + PERCENT) * abs(dx - dy) > most:
            return False
        both = len(self.pivot) - len(lack_x) - len(lack_y) + overlap(lack_x, lack_y) + overlap(more_x, more_y)
        return 100 * both >= PERCENT * (nx + ny - both)


def connecting(sets: list[np.ndarray], labels: list[int], possible: Iterator[tuple[int, np.ndarray]]) -> list[tuple[int, int]]:
    """Links among `sets` that connect different labels. `possible` gives positions with those each may be linked with. A set is compared
    in full with the pivots of the families so far, and with those of its family by differences; sets that a link has connected are not compared."""
    up = {k: k for k in labels}

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    families: list[Family] = []
    member: dict[int, tuple[int, tuple[np.ndarray, np.ndarray]]] = {}

    def placed(i: int) -> tuple[int, tuple[np.ndarray, np.ndarray]]:
        if i not in member:
            for f, family in enumerate(families):
                if 2 * abs(len(family.pivot) - len(sets[i])) <= len(sets[i]):
                    lack, more = family.differences(sets[i])
                    if 2 * (len(lack) + len(more)) <= len(sets[i]):
                        member[i] = f, (lack, more)
                        break
            else:
                families.append(Family(sets[i]))
                member[i] = len(families) - 1, (sets[i][:0], sets[i][:0])
        return member[i]

    out = []
    for i, others in possible:
        for j in others.tolist():
            a, b = top(labels[i]), top(labels[j])
            if a != b:
                (f, x), (g, y) = placed(i), placed(j)
                if families[f].linked(x, y) if f == g else _linked(sets[i], sets[j]):
                    up[max(a, b)] = min(a, b)
                    out.append((i, j))
    return out


def _pairs_checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for asked, given in zip(b.column("asked"), b.column("given")):
            of = _unpacked(given.as_py())
            ok = list({(p["la"], p["lb"]) for p in asked.as_py() if any(_linked(x, y) for x in of.get(p["a"], ()) for y in of.get(p["b"], ()))})
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in ok], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _blocks_checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for asked, given in zip(b.column("asked"), b.column("given")):
            of, entries = _unpacked(given.as_py()), asked.as_py()
            # an entry for each set of a node; rows that share an id share their label
            entries = [(e, s) for e in entries for s in of.get(e["node"], ()) if len(s) == e["n"]]
            n, reach, label, side = (np.array([e[c] for e, _ in entries], np.int64) for c in ("n", "reach", "label", "side"))

            def possible() -> Iterator[tuple[int, np.ndarray]]:
                for i in range(len(entries)):
                    rest = slice(i + 1, None)
                    fits = ((100 + PERCENT) * np.minimum(reach[i], reach[rest]) >= PERCENT * (n[i] + n[rest])) & (100 * np.minimum(n[i], n[rest]) >= PERCENT * np.maximum(n[i], n[rest]))
                    fits &= (label[i] != label[rest]) & ((side[i] | side[rest]) == 3)
                    if fits.any():
                        yield i, np.flatnonzero(fits) + i + 1

            found = connecting([s for _, s in entries], label.tolist(), possible())
            yield pa.RecordBatch.from_arrays([pa.array([entries[p[i]][0]["label"] for p in found], pa.int64()) for i in (0, 1)], names=["a", "b"])


def _given(needed: DataFrame, candidates: DataFrame) -> DataFrame:
    """(cell, given): the texts of the nodes of each cell."""
    return needed.join(candidates.select("node", "packed"), "node").groupBy("cell").agg(F.collect_list(F.struct("node", "packed")).alias("given"))


def _labelled(entries: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The entries with the labels that their labels have now."""
    if labels is None:
        return entries
    return entries.join(labels.withColumnRenamed("node", "label"), "label", "left").withColumn("label", F.coalesce("to", "label")).drop("to")


def _reachable(a: str, b: str) -> str:
    """Whether sizes, and the positions of a shared shingle, allow a link: `reach` is how many elements follow, itself included."""
    return (f"{100 + PERCENT} * least({a}reach, {b}reach) >= {PERCENT} * ({a}n + {b}n) and 100 * least({a}n, {b}n) >= {PERCENT} * greatest({a}n, {b}n)")


def _lists(entries: DataFrame, turn: int) -> DataFrame:
    """The lists that have more than one label, with their leader, who differs from round to round but is the same for lists of the same sets."""
    key = F.struct((F.col("reach") * 9 < F.col("n") * 8).alias("late"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "n", "reach", "label")
    lists = entries.groupBy("token").agg(F.min(key).alias("lead"), F.count(F.lit(1)).alias("c"), F.min("label").alias("least"), F.max("label").alias("most"))
    lists = lists.where("least <> most and c > 2" if turn else "least <> most")  # lists of two sets were decided by the first leader
    return written(lists.select("token", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"), F.col("lead.reach").alias("lead_reach"), F.col("lead.label").alias("lead_label")), "lists")


def _led(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """(lead, other, lead_label, label): the members of each list with its leader."""
    pairs = entries.join(lists, "token").where("label <> lead_label and " + _reachable("", "lead_"))
    return pairs.select("lead", F.col("node").alias("other"), "lead_label", "label").distinct()


def _star_links(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The labels of the pairs that are linked; the partners of a leader are dealt over cells."""
    pairs = written(pairs, "pairs")
    many = pairs.groupBy("lead").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CELL)
    pairs = pairs.join(many, "lead", "left").withColumn("cell", F.xxhash64("lead", F.pmod(F.xxhash64("other"), F.ceil(F.coalesce("c", F.lit(1)) / CELL))))
    needed = pairs.select("cell", F.explode(F.array("lead", "other")).alias("node")).distinct()
    asked = pairs.groupBy("cell").agg(F.collect_list(F.struct(F.col("lead").alias("a"), F.col("other").alias("b"), F.col("lead_label").alias("la"), F.col("label").alias("lb"))).alias("asked"))
    return asked.join(_given(needed, candidates), "cell").select("asked", "given").mapInArrow(_pairs_checked, "a long, b long")


def _block_links(entries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links across labels among the sets of the remaining lists, block against block."""
    size = written(entries.groupBy("token").agg(F.count(F.lit(1)).alias("c")), "sizes")
    banded = entries.join(size, "token").withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / PERCENT)))).withColumn("late", F.col("reach") * 9 < F.col("n") * 8)
    banded = banded.withColumn("block", F.xxhash64("token", "band", "late", F.pmod(F.xxhash64("node"), F.ceil(F.col("c") / BLOCK))))
    banded = written(banded.select("token", "block", "node", "n", "reach", "label"), "blocks")
    blocks = banded.groupBy("token", "block").agg(F.min("n").alias("small"), F.max("n").alias("large"), F.max("reach").alias("reach"), F.min("label").alias("least"), F.max("label").alias("most"))
    side = lambda s: blocks.select("token", *[F.col(c).alias(s + c) for c in ("block", "small", "large", "reach", "least", "most")])
    met = side("a_").join(side("b_"), "token").where(
        f"a_block <= b_block and least(a_least, b_least) <> greatest(a_most, b_most) and {100 + PERCENT} * least(a_reach, b_reach) >= {PERCENT} * (a_small + b_small)"
        f" and 100 * a_large >= {PERCENT} * b_small and 100 * b_large >= {PERCENT} * a_small")
    met = met.select("token", F.xxhash64("a_block", "b_block", "token").alias("cell"), F.expr(
        "if(a_block = b_block, array(struct(a_block as block, 3 as side)), array(struct(a_block as block, 1 as side), struct(b_block as block, 2 as side)))").alias("of"))
    met = written(met.select("token", "cell", F.explode("of").alias("of")).select("token", "cell", "of.*"), "met")
    members = written(met.join(banded, ["token", "block"]).select("cell", "side", "node", "n", "reach", "label"), "members")
    asked = members.groupBy("cell").agg(F.collect_list(F.struct("node", "n", "reach", "label", "side")).alias("asked"))
    return asked.join(_given(members.select("cell", "node").distinct(), candidates), "cell").select("asked", "given").mapInArrow(_blocks_checked, "a long, b long")


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links, itself included); one row per document."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    bits = keycounts.bucket_bits(spark, rows, "text")
    first = written(rows.mapInArrow(_counting(bits), "id long, n long, h1 long, h2 long, bucket int, keys binary"), "shingles")
    signed = first.where("bucket is null").select("id", "n", "h1", "h2")
    some = signed.where("n > 0 and id is not null")
    classes = written(some.groupBy("h1", "h2", "n").agg(F.min("id").alias("node")), "classes")
    frequent = keycounts.filters(first.where("bucket is not null").select("bucket", "keys"), FREQUENT, bits)
    candidates = rows.where("id is not null").mapInArrow(_candidates(frequent), CANDIDATE)
    candidates = written(candidates.join(classes, ["node", "h1", "h2", "n"], "left_semi"), "candidates")
    listed = candidates.select("node", "n", F.explode(F.arrays_zip("tokens", "places")).alias("e")).select(F.col("e.tokens").alias("token"), "node", "n", (F.col("n") - F.col("e.places")).alias("reach"))
    # rows that share an id
    several = written(some.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("least"), F.max(F.struct("h1", "h2")).alias("most")).where("least <> most").select("id"), "several")
    links, labels = [], None
    if not several.isEmpty():
        of_id = some.select("id", "h1", "h2").join(several, "id", "left_semi").join(classes, ["h1", "h2"]).select("id", "node").distinct()
        links.append(written(of_id.where("id <> node").select(F.col("id").alias("a"), F.col("node").alias("b")), "links"))
        labels = written(contracted(links[0]), "labels")
    # Equal labels mean connected sets, and links are found between labels; what labels do not show yet, only costs comparisons.
    entries = listed.withColumn("label", F.col("node"))
    for turn in range(ROUNDS + 1):
        labelled = _labelled(entries, labels)
        lists = _lists(labelled, turn)
        entries = written(labelled.join(lists.select("token"), "token", "left_semi"), "entries")  # written, so that a long list can be split
        if entries.isEmpty():
            break
        new = written(_star_links(_led(entries, lists), candidates) if turn < ROUNDS else _block_links(entries, candidates), "links")
        labels = None
        if not new.isEmpty():
            links.append(new)
            labels = written(contracted(new), "labels") if turn < ROUNDS else None
    roots = components(reduce(DataFrame.unionByName, links)) if links else None
    of = classes if roots is None else classes.join(roots, "node", "left").withColumn("node", F.coalesce("root", "node"))
    out = signed.join(of.select("h1", "h2", F.col("node").alias("component")), ["h1", "h2"], "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
