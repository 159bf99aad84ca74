"""Near-duplicates by a chosen-path set similarity join over minwise signatures.

In each of `TREES` independent trees a node chooses sets of one to three coordinates of the signature, the more the larger it is (for sets
of c coordinates 1 / similarity ** c on average, at every level, so that a pair at the threshold keeps one shared branch), and its documents
branch by their minwise tokens there. A node of at most `NODE` documents is compared exhaustively and ends; a larger one branches on.

Documents that verified links connect already have one label, and pairs within a label are settled. Every node is first compared with its
smallest document, which connects most of a group of copies. What is left is dealt into blocks of documents, and pairs of blocks that hold
different labels go to tasks of their own: signatures tell which documents there have a possible partner, and the full sets of those
are compared block against block by products of incidence matrices. Tasks emit links that connect labels, never pairs. A larger node of which
one label holds all but `OTHERS` documents does not branch: those others meet the whole node, block by block. Signatures travel with one
byte of each coordinate, and only of documents that a filter of fixed size lets through.

Defined results: documents with equal sets are one class, whose smallest id joins; a document without words has an empty set and no
links; a null id has its size, a null component, and is kept; rows that share an id share a component. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitefold.llm import shingles
from sitefold.llm.common import MIX1, lean, mix64, written
from sitefold.llm.graph import relabelled
from sitefold.runtime import ship_package

WIDTH, PERCENT = 5, 75      # words of a shingle; 100 * intersection >= PERCENT * union
SIGNATURE, TREES = 96, 16
DEEPER = (300, 1000)        # a node of more documents branches by two coordinates at once, or by three
LENIENT = 47                # of 96 coordinates: six standard deviations below 0.75 * 96
CELL = 200                  # partners of one document that verification brings together, about
NODE, BLOCK = 2048, 1024    # documents of a node that is compared exhaustively, and of a block of those
OTHERS = 256                # documents outside a larger node's main label that are compared with all of it
ROWS = 1000                 # documents whose sets a task holds at once
COLUMNS = 4096              # shingles of an incidence matrix at once
FILTER_WORDS = 1 << 17      # 64-bit words of the filter that spares documents without candidates the join; its size is fixed


@lean
def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    minhash, salt = shingles.MinHash(SIGNATURE), MIX1
    for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        texts = [t.encode() if t else b"" for t in b.column("text").to_pylist()]
        sizes, h1, h2, sig = [], [], [], []
        for s in shingles.sets(texts, WIDTH):
            sizes.append(len(s))
            h1.append(int(mix64(s).sum(dtype=np.uint64).view(np.int64)))
            h2.append(int(mix64(s ^ salt).sum(dtype=np.uint64).view(np.int64)))
            sig.append(minhash(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(sizes, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.list_(pa.int32()))], names=["id", "n", "h1", "h2", "sig"])


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, h1, h2, sig): set size, two hashes of the whole set, minwise signature (null for an empty set)."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_signatures, "id long, n long, h1 long, h2 long, sig array<int>")


@lean
def _shrunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([z.compress((t or "").encode()) for t in b.column("text").to_pylist()], pa.binary())], names=["id", "packed"])


def _close(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both > 0 and 100 * both >= PERCENT * (len(x) + len(y) - both)


@lean
def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    z = zstandard.ZstdDecompressor()
    for b in batches:
        for asked, given in zip(b.column("asked"), b.column("given")):
            texts = given.as_py()
            of: dict[int, list[np.ndarray]] = {}  # rows that share an id have a set each
            for x, s in zip(texts, shingles.sets([z.decompress(x["packed"]) for x in texts], WIDTH)):
                of.setdefault(x["id"], []).append(s)
            ok = [p for p in asked.as_py() if any(_close(x, y) for x in of.get(p["a"], ()) for y in of.get(p["b"], ()))]
            if ok:
                yield pa.RecordBatch.from_arrays([pa.array([p["a"] for p in ok], pa.int64()), pa.array([p["b"] for p in ok], pa.int64())], names=["a", "b"])


def _among(rows: DataFrame, ids: DataFrame, c: str) -> DataFrame:
    """The rows whose `c` is in `ids`, and a few others: those that a fixed-size filter lets through."""
    names = rows.columns
    words = ids.select(F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS * 64)).alias("bit")).groupBy(F.expr("bit div 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    rows = rows.withColumn("word", F.expr(f"pmod(xxhash64({c}), {FILTER_WORDS * 64}) div 64")).join(F.broadcast(words), "word")
    return rows.where(F.expr(f"(bits & shiftleft(1L, cast(pmod(xxhash64({c}), {FILTER_WORDS * 64}) % 64 as int))) <> 0")).select(*names)


def _packed(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, packed): the compressed texts of the documents of `ids` (id), and of a few others."""
    rows = _among(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), ids, "id")
    return written(rows.mapInArrow(_shrunk, "id long, packed binary"), "candidates")


def verified(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b, cell) whose full sets are similar enough: a cell's documents are brought together, each once."""
    packed = _packed(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))), docs, id_col, text_col)
    needed = pairs.select("cell", F.explode(F.array("a", "b")).alias("id")).distinct().join(packed, "id")
    given = needed.groupBy("cell").agg(F.collect_list(F.struct("id", "packed")).alias("given"))
    asked = pairs.groupBy("cell").agg(F.collect_list(F.struct("a", "b")).alias("asked"))
    return asked.join(given, "cell").select("asked", "given").mapInArrow(_agree, "a long, b long").distinct()


@lean
def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each cell that have a partner across labels which sizes and signatures allow."""
    names = ["cell", "node", "label", "side"]
    for b in batches:
        for cell, held in zip(b.column("cell").to_pylist(), b.column("held")):
            rows = held.values
            node, label, side, n = (rows.field(c).to_numpy() for c in ("node", "label", "side", "n"))
            sig = rows.field("brief").flatten().to_numpy().reshape(len(node), -1)
            left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
            some = np.zeros(len(node), bool)
            for i in left:
                fits = (label[right] != label[i]) & (100 * np.minimum(n[right], n[i]) >= PERCENT * np.maximum(n[right], n[i]))
                near = right[fits][(sig[right[fits]] == sig[i]).sum(1) >= LENIENT]
                some[near] = True
                some[i] |= len(near) > 0
            some = np.flatnonzero(some)
            yield pa.RecordBatch.from_arrays([pa.array([cell] * len(some), pa.int64()), pa.array(node[some]), pa.array(label[some]), pa.array(side[some])], names=names)


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of x shares with each of y: products of incidence matrices, some columns at once."""
    every, column, times = np.unique(np.concatenate([*x, *y, np.zeros(0, np.uint64)]), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    shared = times[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)), np.float32)  # exact up to 2**24 a product, and added up in steps of COLUMNS
    total = np.zeros((len(x), len(y)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, z = np.searchsorted(column, [at, at + COLUMNS])
        dense = np.zeros((len(x) + len(y), COLUMNS), np.float32)
        dense[row[a:z], column[a:z] - at] = 1
        np.matmul(dense[:len(x)], dense[len(x):].T, out=out)
        total += out.astype(np.int64)
    return total


@lean
def _connected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the labels of each cell."""
    z = zstandard.ZstdDecompressor()
    for b in batches:
        for given in b.column("given"):
            rows = given.as_py()
            sets = shingles.sets([z.decompress(r["packed"]) for r in rows], WIDTH)
            size, side, label = np.array([len(s) for s in sets]), np.array([r["side"] for r in rows]), [r["label"] for r in rows]
            left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
            both = overlaps([sets[i] for i in left], [sets[j] for j in right])
            close = (both > 0) & (100 * both >= PERCENT * (size[left][:, None] + size[right] - both))
            up = {k: k for k in label}

            def top(k: int) -> int:
                while up[k] != k:
                    up[k] = k = up[up[k]]
                return k

            found = []
            for i, j in zip(*np.nonzero(close)):
                p, q = top(label[left[i]]), top(label[right[j]])
                if p != q:
                    up[max(p, q)] = min(p, q)
                    found.append((rows[left[i]]["node"], rows[right[j]]["node"]))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _block_cells(few: DataFrame) -> DataFrame:
    """(cell, side, node, label) for the nodes of rows (key, node, label, n): blocks of a node against each other, a cell for a pair of blocks."""
    dealt = written(few.select("key", "node", "label", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)).alias("block")), "blocks")
    blocks = dealt.groupBy("key", "block").agg(F.min("label").alias("least"), F.max("label").alias("most"))
    side = lambda s: blocks.select("key", *[F.col(c).alias(s + c) for c in ("block", "least", "most")])
    met = side("a_").join(side("b_"), "key").where("a_block <= b_block and least(a_least, b_least) <> greatest(a_most, b_most)")
    met = met.select("key", F.xxhash64("key", "a_block", "b_block").alias("cell"), F.explode(F.expr(
        "if(a_block = b_block, array(struct(a_block as block, 3 as side)), array(struct(a_block as block, 1 as side), struct(b_block as block, 2 as side)))")).alias("of"))
    return written(met.select("key", "cell", "of.*"), "met").join(dealt, ["key", "block"]).select("cell", "side", "node", "label")


def _with_main(large: DataFrame) -> DataFrame:
    """The rows (key, node, label, n) with the main label of their node, and how many documents have another."""
    labels = large.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    main = labels.groupBy("key").agg(F.max_by("label", F.struct("c", "label")).alias("main"), (F.sum("c") - F.max("c")).alias("others"))
    return large.join(main, "key")


def _other_cells(large: DataFrame) -> DataFrame:
    """(cell, side, node, label) of rows with few others: those against each block of their node."""
    blocks = F.ceil(F.col("n") / BLOCK)
    own, other = F.pmod(F.xxhash64("node"), blocks), F.col("label") != F.col("main")
    rows = large.select("key", "node", "label", other.alias("other"), own.alias("own"), F.explode(F.when(other, F.sequence(F.lit(0).cast("long"), blocks - 1)).otherwise(F.array(own))).alias("block"))
    side = F.when(~F.col("other"), 2).when(F.col("block") == F.col("own"), 3).otherwise(1)
    return rows.select(F.xxhash64("key", F.lit("others"), "block").alias("cell"), side.alias("side"), "node", "label")


def _cell_links(members: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Links across labels in the cells (cell, side, node, label), a task for a cell."""
    members = written(members, "cells")
    held = members.join(_among(classes.select("node", "n", "brief"), members, "node"), "node").groupBy("cell").agg(F.collect_list(F.struct("node", "label", "side", "n", "brief")).alias("held"))
    asked = written(held.mapInArrow(_possible, "cell long, node long, label long, side int"), "possible")
    packed = _packed(asked.select(F.col("node").alias("id")), docs, id_col, text_col)
    given = asked.join(packed.withColumnRenamed("id", "node"), "node").groupBy("cell").agg(F.collect_list(F.struct("node", "label", "side", "packed")).alias("given"))
    return given.select("given").mapInArrow(_connected, "a long, b long")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs that sizes allow and signatures do not rule out."""
    side = lambda c: _among(classes.select(F.col("node").alias(c), F.col("n").alias("n" + c), F.col("brief").alias("s" + c)), pairs, c)
    equal = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, e: s + e)
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
    return both.where(equal >= LENIENT).select("a", "b").distinct()


def _brief(sig):
    """A byte of each coordinate: where coordinates agree these do, and few others do."""
    return F.transform(sig, lambda x: (x.bitwiseAND(F.lit(255)) - 128).cast("tinyint"))


def _child(key, sig, j):
    return F.xxhash64(key, j, F.element_at(sig, (j + 1).cast("int")))


def _branched(many: DataFrame, level: int) -> DataFrame:
    """(node, key) of the children of the nodes with rows (node, key, n, sig). A set of c coordinates is chosen (100 / PERCENT) ** c times."""
    many = many.withColumn("c", F.lit(1) + sum((F.col("n") > size).cast("int") for size in DEEPER))
    rate = F.pow(F.lit(100 / PERCENT), F.col("c"))
    part = F.pmod(F.xxhash64("key", F.lit(f"times {level}")), F.lit(1 << 20)) / (1 << 20)
    times = F.floor(rate) + (part < rate - F.floor(rate)).cast("long")
    branching = many.withColumn("branch", F.explode(F.sequence(F.lit(0).cast("long"), times - 1)))
    draw = lambda what, n: F.pmod(F.xxhash64("key", F.lit(f"{what} {level}")), F.lit(n))
    # the up to three branches of a node differ in each coordinate
    place = lambda i: F.pmod(draw(f"a{i}", SIGNATURE) + F.col("branch") * (draw(f"b{i}", SIGNATURE // 3) + 1), F.lit(SIGNATURE))
    child = _child("key", "sig", place(0))
    for i in range(1, len(DEEPER) + 1):
        child = F.when(F.col("c") > i, _child(child, "sig", place(i))).otherwise(child)
    return branching.select("node", child.alias("key"))


def _unsettled(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(key, node, label, n, lead) of the nodes (key) that hold more than one label: n documents, the smallest of which leads."""
    labelled = members.withColumn("label", F.col("node")) if roots is None else members.join(roots, "node", "left").select("node", "key", F.coalesce("root", "node").alias("label"))
    nodes = labelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead"), F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    return written(labelled.join(written(nodes.select("key", "n", "lead"), "nodes"), "key"), "members")


def joined(docs: DataFrame, signed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Classes of documents with equal sets (h1, h2, node, n), and (node, root) for the nodes that links join to others: root is
    the smallest node reachable."""
    classes = written(signed.where("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("node"), F.min_by("sig", "id").alias("sig")).withColumn("brief", _brief("sig")), "classes")
    members = classes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    members = members.select("node", _child(F.lit("root"), "sig", F.col("tree")).alias("key"))
    roots, level = None, 0
    while True:
        inside = _unsettled(members, roots)
        # every document with the smallest of its node, in all trees at once
        stars = written(inside.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "stars")
        likely = written(_likely(stars, classes), "likely")
        many = likely.groupBy("a").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > CELL)
        wanted = likely.join(many, "a", "left").select("a", "b", F.xxhash64("a", F.pmod(F.xxhash64("b"), F.ceil(F.coalesce("c", F.lit(1)) / CELL))).alias("cell"))
        new = written(verified(written(wanted, "pairs"), docs, id_col, text_col), "links")
        if not new.isEmpty():
            roots = relabelled(roots, new)
        # nodes of two are decided; the others up to NODE documents are compared as far as labels still differ, and larger ones with one main label
        left = _unsettled(inside.where("n > 2").select("node", "key"), roots)
        cells, large = _block_cells(left.where(F.col("n") <= NODE)), left.where(F.col("n") > NODE)
        some = not large.isEmpty()
        if some:
            large = written(_with_main(large), "large")
            cells = cells.unionByName(_other_cells(large.where(F.col("others") <= OTHERS)))
            large = large.where(F.col("others") > OTHERS).select("node", "key", "n")
        new = written(_cell_links(cells, classes, docs, id_col, text_col), "links")
        if not new.isEmpty():
            roots = relabelled(roots, new)
        if not some or large.isEmpty():
            break
        # the documents of larger nodes branch
        level += 1
        members = written(_branched(large.join(_among(classes.select("node", "sig"), large, "node"), "node"), level), "branches")
    if roots is None:
        roots = docs.sparkSession.createDataFrame([], "node long, root long")
    return classes.select("h1", "h2", "node", "n"), roots


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id reachable over links, itself included), kept; one row per document."""
    signed = written(signatures(docs, id_col, text_col), "signatures")
    classes, roots = joined(docs, signed, id_col, text_col)
    of = classes.join(roots, "node", "left").select("h1", "h2", F.coalesce("root", "node").alias("component_id"))
    rows = signed.select("id", "n", "h1", "h2").join(of, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
