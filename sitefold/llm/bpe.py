"""Byte-level BPE through a table of distinct words.

encode: texts are split into words by the tokenizer's own rule inside blocks of documents; a block keeps each document as positions
in its list of distinct words. The lists, dealt by a hash of the word, meet in the distinct-word table, where each word of the
corpus is encoded once; the ids go back to the block and are joined to the documents by position.

decode: ids are joined to the pieces of the vocabulary (its size is fixed by the tokenizer's file) and the pieces concatenated.

Defined results: a null or empty text has no ids; null ids decode to a null text, ids outside the vocabulary to nothing, bytes that are
not UTF-8 to replacement characters. Special strings inside a text become their token. Rows are independent: repeated rows and
null ids of documents change nothing. Other columns pass through, except one named like the output.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitefold.llm.blocks import block_id, from_small_bytes, in_blocks, offsets, packed, packed_lists, small_bytes, unpacked, unpacked_lists, whole
from sitefold.llm.common import give_back, lean, map_columns, written
from sitefold.runtime import ship_package

BLOCK_BYTES = 32 << 20
# The published word pattern of this family of tokenizers (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Below this code point `regex` and the tokenizers library classify all characters alike (tests compare them); texts with
# others are split by the library itself.
SAFE_BELOW = "ɐ"


def read_tokenizer(path: str) -> str:
    """The file's JSON, for closures: executors need not see the path. Kinds of tokenizers whose words do not split this way are refused."""
    with open(path, encoding="utf-8") as f:
        said = f.read()
    j = json.loads(said)
    pre, model = j["pre_tokenizer"] or {}, j["model"]
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in j["added_tokens"])
    if j["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or model["type"] != "BPE" or model.get("dropout") or not plain:
        raise ValueError(f"{path}: only byte-level BPE without normaliser, prefix space and dropout")
    return json.dumps(j | {"truncation": None, "padding": None})


@lru_cache(maxsize=2)
def library(said: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(said)


@lru_cache(maxsize=2)
def special_tokens(said: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in json.loads(said)["added_tokens"]}


@lru_cache(maxsize=2)
def splitter(said: str):
    """text -> list of words, special strings being words of their own."""
    import regex

    words, pre = regex.compile(PATTERN).findall, library(said).pre_tokenizer
    special = "|".join(re.escape(t) for t in sorted(special_tokens(said), key=len, reverse=True))
    cut = re.compile(f"({special})").split if special else lambda t: [t]

    def plain(text: str) -> list[str]:
        if text.isascii() or max(text) < SAFE_BELOW:
            return words(text)
        return [text[a:b] for _, (a, b) in pre.pre_tokenize_str(text)]

    def split(text: str | None) -> list[str]:
        if not text:
            return []
        parts = cut(text)
        if len(parts) == 1:
            return plain(text)
        return [w for i, part in enumerate(parts) if part for w in ([part] if i % 2 else plain(part))]

    return split


@lean
def _split_blocks(batches, said, text_col, ids_col, n_buckets, target) -> Iterator[pa.RecordBatch]:
    split = splitter(said)
    for seq, block in enumerate(in_blocks(batches, text_col, target)):
        place: dict[str, int] = defaultdict(count().__next__)
        get, parts, sizes = place.__getitem__, [], []
        for chunk in block.column(text_col).chunks:
            for text in chunk:
                ws = split(text.as_py())
                parts.append(np.fromiter(map(get, ws), np.uint32, len(ws)))
                sizes.append(len(ws))
        words = list(place)
        del place, get
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        # the most frequent words get the smallest numbers, so that positions take little room
        by_use = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[by_use] = np.arange(len(words))
        words = pa.array(words, pa.string()).take(pa.array(by_use))
        words = [w.encode() for w in words.to_pylist()]
        bucket = np.fromiter((zlib.crc32(w) % n_buckets for w in words), np.int32, len(words))
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(n_buckets + 1))
        dealt = []
        for b in np.flatnonzero(np.diff(edges)):
            mine = [words[i] for i in order[edges[b]:edges[b + 1]]]
            dealt.append({"bucket": int(b), "words": packed_lists(np.array([len(w) for w in mine]), b"".join(mine))})
        rest = block.drop_columns([c for c in dict.fromkeys((text_col, ids_col)) if c in block.column_names])
        shape = pa.table({"sizes": pa.array(sizes, pa.int32())} | {f"c{i}": c for i, c in enumerate(rest.columns)})
        inside = pa.table({"bucket": pa.array([bucket], pa.list_(pa.int32())), "positions": pa.array([small_bytes(rank[flat]).tobytes()], pa.binary())})
        yield pa.RecordBatch.from_arrays(
            [pa.array([block_id(seq)], pa.int64()), pa.array([packed(shape)], pa.binary()), pa.array([packed(inside)], pa.binary()),
             pa.array([dealt], pa.list_(pa.struct([("bucket", pa.int32()), ("words", pa.binary())])))], names=["block", "documents", "positions", "dealt"])


def encode_words(words: pa.Array, said: str) -> pa.ListArray:
    """Ids of each word, the library doing each once."""
    tok, special = library(said), special_tokens(said)
    todo, flat, sizes = words.to_pylist(), [], []
    for at in range(0, len(todo), 20_000):
        part = todo[at:at + 20_000]
        for w, e in zip(part, tok.encode_batch_fast(part, add_special_tokens=False)):
            ids = [special[w]] if w in special else e.ids
            flat += ids
            sizes.append(len(ids))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat, pa.int32()))


def _encode_bucket(group: pa.Table, said: str) -> pa.Table:
    lists = []
    for data in group.column("words").to_pylist():
        sizes, content = unpacked_lists(data)
        lists.append(pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets(sizes).astype(np.int32)), pa.py_buffer(content)))
    both = pa.concat_arrays(lists).dictionary_encode()
    ids, where, at, out = encode_words(both.dictionary, said), both.indices, 0, []
    for x in lists:
        mine = ids.take(where.slice(at, len(x)))
        out.append(packed_lists(mine.value_lengths().to_numpy(), small_bytes(mine.flatten().to_numpy()).tobytes()))
        at += len(x)
    return pa.table({"block": group.column("block"), "bucket": group.column("bucket"), "ids": pa.array(out, pa.binary())})


@lru_cache(maxsize=2)
def pieces(said: str) -> pa.Array:
    """The bytes of each id. The letters that stand for bytes are the printable ones of Latin-1, and those from U+0100 on for the rest."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    j = json.loads(said)
    ids = j["model"]["vocab"] | {t["content"]: t["id"] for t in j["added_tokens"]}
    out = [b""] * (max(ids.values()) + 2)  # the last stands for ids outside
    for piece, i in ids.items():
        out[i] = bytes(map(byte_of.__getitem__, piece)) if all(c in byte_of for c in piece) else piece.encode()
    return pa.array(out, pa.binary())


def forget() -> None:
    """The tokenizer is read again where it is needed again: the last step of `encode` leaves none in a Python worker."""
    for cached in (library, special_tokens, splitter, pieces):
        cached.cache_clear()
    give_back()


def spelt(lists: pa.ListArray, said: str) -> pa.Array:
    """Ids joined to their pieces, and those of a list put together."""
    table = pieces(said)
    flat = pc.fill_null(lists.flatten(), -1).to_numpy(zero_copy_only=False)
    flat = np.where((flat < 0) | (flat >= len(table)), np.int32(len(table) - 1), flat)
    sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False)
    out = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets(sizes).astype(np.int32)), table.take(pa.array(flat))), b"")
    out = pc.if_else(lists.is_null(), pa.scalar(None, pa.binary()), out)
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", block_bytes: int = BLOCK_BYTES, decoded_col: str | None = None) -> DataFrame:
    """`docs` without `text_col` and with `ids_col` (array<int>), what the tokenizers library gives for each whole text.

    With `decoded_col` the ids are decoded as by `decode` in the same pass."""
    spark = docs.sparkSession
    ship_package(spark)
    said = read_tokenizer(tokenizer_path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keep = [f for f in docs.schema.fields if f.name not in (text_col, ids_col, decoded_col)]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in keep], F.col(f"`{text_col}`").cast("string").alias(text_col))

    blocks = written(docs.mapInArrow(lambda it: _split_blocks(it, said, text_col, ids_col, n, block_bytes),
                                     "block long, documents binary, positions binary, dealt array<struct<bucket:int,words:binary>>"), "word-blocks")
    dealt = blocks.select("block", F.explode("dealt").alias("d")).select("block", "d.bucket", "d.words")
    answers = dealt.groupBy("bucket").applyInArrow(lambda t: _encode_bucket(t, said), "block long, bucket int, ids binary")
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "ids")).alias("answers"))  # at most one per bucket
    schema = T.StructType(keep + [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] + [T.StructField(c, T.StringType()) for c in [decoded_col] if c])

    def join_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from joined(batches)
        finally:
            forget()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data, where, found in zip(b.column("documents"), b.column("positions"), b.column("answers")):
                block, inside = unpacked(data.as_py()), unpacked(where.as_py())
                answers = sorted(found.as_py() or [], key=lambda x: x["bucket"])
                lists = [unpacked_lists(a["ids"]) for a in answers]
                flat = np.concatenate([np.zeros(0, np.int32), *(from_small_bytes(np.frombuffer(c, np.uint8)) for _, c in lists)])
                each = np.concatenate([np.zeros(0, np.int32), *(n for n, _ in lists)])
                ids = pa.ListArray.from_arrays(pa.array(offsets(each).astype(np.int32)), pa.array(flat))
                order = np.argsort(inside.column("bucket")[0].values.to_numpy(), kind="stable")
                answer_of = np.empty(len(order), np.int32)
                answer_of[order] = np.arange(len(order))
                words = answer_of[from_small_bytes(np.frombuffer(inside.column("positions")[0].as_py(), np.uint8))]
                sizes = block.column("sizes").to_numpy()
                cols = [whole(c) for c in block.drop_columns(["sizes"]).columns]
                edges = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
                for at in range(0, len(sizes), 128):
                    to = min(len(sizes), at + 128)
                    lists = ids.take(pa.array(words[edges[at]:edges[to]]))
                    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)])
                    out = pa.ListArray.from_arrays(pa.array(ends[edges[at:to + 1] - edges[at]].astype(np.int32)), lists.flatten())
                    yield pa.RecordBatch.from_arrays([*(c.slice(at, to - at) for c in cols), out, *([spelt(out, said)] if decoded_col else [])], names=schema.names)

    return blocks.select("block", "documents", "positions").join(by_block, "block", "left").select("documents", "positions", "answers").mapInArrow(join_back, schema)


def decode(df: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """`df` with `text_col`, the concatenated pieces of `ids_col`; special tokens are written out."""
    said = read_tokenizer(tokenizer_path)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        lists = batch.column(ids_col)
        return {text_col: pa.concat_arrays([pa.array([], pa.string()), *(spelt(lists.slice(at, 128), said) for at in range(0, len(lists), 128))])}

    return map_columns(df, run, [T.StructField(text_col, T.StringType())])
