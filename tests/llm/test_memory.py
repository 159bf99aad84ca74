"""What a task of the pipeline holds at once."""

import tracemalloc

import corpus_pipeline
import numpy as np
import pyarrow as pa

from sitefold.llm import bpe, common, latent, queries, shingles


def peak(fn):
    tracemalloc.start()
    try:
        out = fn()
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_decontamination_holds_little_of_a_batch():
    rng = np.random.default_rng(4)
    item = [f"i{k}" for k in range(40)]
    items = latent.Items.of([(7, " ".join(item))])
    noise = [" ".join(f"n{k}" for k in rng.integers(0, 500, 400)) for _ in range(4000)]
    for k in (5, 2000, 3999):
        noise[k] += " " + " ".join(item)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(4000), pa.int64()), "text": noise})
    vectors = rng.standard_normal((len(items.hashes), 128)).astype(np.float32)
    coded, most = peak(lambda: list(latent._coded([batch], items)))
    assert most < 40
    together = pa.Table.from_batches(coded).combine_chunks().to_batches()
    assert len(together) == 1 and together[0].nbytes > 5e6
    rows, most = peak(lambda: [r for b in latent._matches(together, items, vectors, 1.0) for r in b.to_pylist()])
    assert most < 80 and {(r["id"], r["item"]) for r in rows} == {(5, 7), (2000, 7), (3999, 7)}


def test_shingles_are_hashed_from_little_text():
    texts = [b" ".join(b"w%d" % k for k in range(i, i + 400)) for i in range(1000)]
    sets, most = peak(lambda: shingles.sets(texts))
    assert most < 40 and [len(s) for s in sets] == [396] * 1000
    assert all((s == t).all() for s, t in zip(sets[:3], (shingles.sets([t])[0] for t in texts[:3])))


def test_stages_take_small_arrow_batches_unless_the_session_says_otherwise(spark):
    key, stage = corpus_pipeline.BATCH_KEY, corpus_pipeline.in_small_batches(lambda spark, docs, sf_dir: docs)
    assert all(hasattr(f, "__wrapped__") for _, f in corpus_pipeline.STAGES)
    assert key not in spark.conf.getAll
    try:
        stage(spark, None, "")
        assert spark.conf.get(key) == "4m"
        spark.conf.set(key, "9m")
        stage(spark, None, "")
        assert spark.conf.get(key) == "9m"
    finally:
        spark.conf.unset(key)


def test_a_task_leaves_no_freed_memory_behind():
    def resident():
        with open("/proc/self/smaps_rollup") as f:
            return sum(int(x.split()[1]) for x in f if x.startswith("Pss_Anon")) / 1e3

    def task(kept):
        held = [bytes(100_000) for _ in range(1000)]
        kept.append(bytes(100_000))  # above the others, so that the heap cannot shrink from its end
        yield len(held)

    kept, before = [], resident()
    assert list(common.lean(task)(kept)) == [1000]
    assert resident() < before + 30


def test_the_tokenizer_is_forgotten():
    said = bpe.read_tokenizer(queries.tokenizer_file())
    bpe.library(said), bpe.pieces(said)
    bpe.forget()
    assert not any(c.cache_info().currsize for c in (bpe.library, bpe.special_tokens, bpe.splitter, bpe.pieces))


def test_windows_are_summed_in_small_pieces():
    rng = np.random.default_rng(5)
    v = 2000
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(3000), pa.int64()), "terms": [rng.integers(0, 1900, 400).astype("<i4").tobytes() for _ in range(3000)]})
    items = latent.Items.of([(i, " ".join(f"w{k}" for k in rng.integers(0, v, 40))) for i in range(300)])
    assert len(items.hashes) > 1900
    _, most = peak(lambda: list(latent._matches([batch], items, rng.standard_normal((len(items.hashes), 128)).astype(np.float32), 1.0)))
    assert most < 25


def test_stages_read_few_rows_at_once_unless_the_session_says_otherwise(spark):
    key, stage = "spark.sql.parquet.columnarReaderBatchSize", corpus_pipeline.in_small_batches(lambda spark, docs, sf_dir: docs)
    spark.conf.unset(key)
    try:
        stage(spark, None, "")
        assert spark.conf.get(key) == "512"
        spark.conf.set(key, "99")
        stage(spark, None, "")
        assert spark.conf.get(key) == "99"
    finally:
        spark.conf.unset(key)
        spark.conf.unset(corpus_pipeline.BATCH_KEY)
