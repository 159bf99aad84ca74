"""Operators that compare documents, against brute force."""

import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitefold.llm import ann, chosen_path, graph, keycounts, latent, paragraphs, queries, shingles, suffixes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def roots(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def table(spark):
    return [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]


def test_shingle_hashes_equal_exactly_where_shingles_do(table):
    texts = [t or "" for _, t in table][:60] + ["a", "a b", "A b", "b a", "", "a b c d e f"]
    hashed, real = shingles.sets([t.encode() for t in texts]), [shingle_set(t) for t in texts]
    assert [len(x) for x in hashed] == [len(x) for x in real]
    for i in range(0, len(texts), 3):
        for j in range(0, len(texts), 5):
            assert len(np.intersect1d(hashed[i], hashed[j])) == len(real[i] & real[j])


def test_near_duplicates_over_the_whole_table(spark, table):
    sets = {i: shingle_set(t) for i, t in table}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and (n := len(sets[a] & sets[b])) and 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]
    want = roots(sets, links)
    got = {r.doc_id: r for r in queries.QUERIES["op2_minhash_near_dedup"](spark, SF).collect()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}


def test_near_duplicates_in_one_dense_group_and_awkward_rows(spark, docs):
    base = [f"word{i}" for i in range(120)]
    rows = [(1000 + k, " ".join("changed" + str(k) if i == k else w for i, w in enumerate(base))) for k in range(120)]  # neighbours in all directions, in large nodes
    both = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))
    got = chosen_path.near_duplicates(both).collect()
    assert {r.component_id for r in got if r.doc_id and r.doc_id >= 1000} == {1000}
    other = {r.doc_id: r for r in got}
    assert other[6].component_id == 1 and other[5].component_id == 4 and other[10].component_id == 9 and other[2].component_id == 2 and other[2].n_shingles == 0
    assert other[None].component_id is None and other[None].kept and len(got) == 132
    assert chosen_path.near_duplicates(docs.limit(0)).collect() == []


def test_near_duplicates_by_blocks_and_by_branches(spark, monkeypatch):
    """Documents near the threshold in chains and in half-similar groups, with small blocks; then with nodes that must branch."""
    rng = np.random.default_rng(12)
    base, rows = [f"word{i}" for i in range(100)], []
    for k in range(90):
        changed = set(rng.choice(100, int(rng.integers(2, 6)), replace=False).tolist())
        rows.append(" ".join(f"c{k}x{i}" if i in changed else w for i, w in enumerate(base)))
    chain = [f"v{i}" for i in range(100)]
    for k in range(60):
        chain = chain[3:] + [f"v{k}y{j}" for j in range(3)]
        rows.append(" ".join(chain))
    rows = [(int(i), rows[i]) for i in rng.permutation(len(rows))]
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = roots(sets, links)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    monkeypatch.setattr(chosen_path, "BLOCK", 16)
    for node in (chosen_path.NODE, 40):
        monkeypatch.setattr(chosen_path, "NODE", node)
        got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(frame).collect()}
        assert {i: c for i, c in got.items() if c != want[i]} == {}, node


def test_overlaps_are_counted_exactly(monkeypatch):
    monkeypatch.setattr(chosen_path, "COLUMNS", 7)
    rng = np.random.default_rng(2)
    x, y = ([np.unique(rng.integers(0, 60, int(rng.integers(0, 40)), np.uint64)) for _ in range(n)] for n in (5, 8))
    assert chosen_path.overlaps(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
    assert chosen_path.overlaps([], y).shape == (0, 8) and chosen_path.overlaps(x, []).shape == (5, 0)


def test_a_pair_at_the_threshold_keeps_one_shared_branch_on_every_level(spark):
    rng = np.random.default_rng(6)
    rows = []
    for key in range(3000):
        x = rng.integers(0, 1 << 30, chosen_path.SIGNATURE)
        y = np.where(rng.permutation(chosen_path.SIGNATURE) < 72, x, x + 1)
        rows += [(2 * key, key, x.tolist()), (2 * key + 1, key, y.tolist())]
    pairs = spark.createDataFrame(rows, "node long, key long, sig array<int>").cache()
    for level in (1, 2, 3, 9):
        for n in (200, 500, 5000):
            children = chosen_path._branched(pairs.withColumn("n", F.lit(n)), level)
            shared = children.groupBy("key").count().where("count = 2").count()
            assert 0.88 < shared / 3000 < 1.12, (level, n, shared)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 130)] + [(7, 7), (3, 2), (2, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: r for n, r in roots({x for p in links for x in p}, links).items()}


def brute_removal(docs):
    seen = {}
    for i, t in sorted(docs):
        for p in range(len(t) - 49):
            seen.setdefault(t[p:p + 50], i)
    out = {}
    for i, t in docs:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - 49):
            if seen[t[p:p + 50]] < i:
                gone[p:p + 50] = True
        out[i] = (len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("bucket", [2 << 20, 1 << 11])
def test_later_copies_over_the_whole_table(spark, table, monkeypatch, bucket):
    monkeypatch.setattr(keycounts, "BUCKET_BYTES", bucket)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.QUERIES["op1_suffix_array_dedup"](spark, SF).collect()}
    assert got == brute_removal([(i, (t or "").encode()) for i, t in table])


def test_later_copies_of_periodic_and_frequent_text(spark, docs, monkeypatch):
    from sitefold.llm import keyfilter

    monkeypatch.setattr(keyfilter, "OFTEN", 6)
    rows = [(1, "a" * 300), (2, "a" * 120 + "b" + "a" * 49), (3, "ab" * 100), (4, "x" + "ab" * 60), *((10 + i, f"start {i} " + "a common line that very many documents hold, word for word and byte for byte " + f"end {i}") for i in range(30))]
    got = {r.doc_id: r for r in suffixes.remove_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == brute_removal([(i, t.encode()) for i, t in rows])
    awkward = {r.doc_id: r for r in suffixes.remove_copies(docs).collect()}
    assert awkward[2].n_bytes == 0 and awkward[None].n_removed == 0 and awkward[6].n_removed == 50 and awkward[5].kept.endswith(b"tail") and awkward[4].n_removed == 0
    assert suffixes.remove_copies(docs.limit(0)).collect() == []


def test_a_long_text_is_anchored_in_pieces_whose_places_fit(monkeypatch):
    monkeypatch.setattr(suffixes, "PIECE", 2000)
    monkeypatch.setattr(suffixes, "AT_ONCE", 1000)
    monkeypatch.setattr(suffixes, "_PLACE", np.uint64((1 << 12) - 1))
    text = bytes(np.random.default_rng(8).integers(97, 123, 12_000, np.uint8))
    batch = pa.table({"id": [1, 2], "th": [1, 2], "text": [text.decode(), text[9000:11_000].decode()]}).to_batches()
    keys, seen = {}, {1: set(), 2: set()}
    for data, edges, about in suffixes._pieces(batch):
        assert len(data) < 1 << 12
        for begin, piece, place, key in zip(*(x.tolist() for x in suffixes._anchors(data, edges))):
            assert 0 <= place - begin <= suffixes.WINDOW - suffixes.GRAM
            window = data[begin:begin + suffixes.WINDOW].tobytes()
            assert keys.setdefault(window, key) == key
            i, _, off = about[piece]
            seen[i].add(begin - int(edges[piece]) + off)
    assert seen == {1: set(range(12_000 - 49)), 2: set(range(2000 - 49))}


def test_previous_factors_against_all_pairs():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50):
        rank, lcp = rng.integers(0, 6, n), np.concatenate([[0], rng.integers(0, 60, max(0, n - 1))])[:n]
        want = [max([min(lcp[min(i, j) + 1:max(i, j) + 1]) for j in range(n) if rank[j] < rank[i]], default=0) for i in range(n)]
        assert suffixes.previous_factors(rank, lcp).tolist() == want


def test_paragraphs_repeated_across_documents_go_and_others_stay(spark, docs):
    passage = " ".join(f"Sentence {k} has quite a few words that nobody else would put in this order {k * 7}." for k in range(8))
    rows = [(100, "Own words begin here. " + passage + " And some end."), (101, "Other words come first, and then\n" + passage), (102, passage.replace("nobody", "somebody")), (103, "A clean document. It says nothing of the kind.")]
    got = {r.doc_id: r for r in paragraphs.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text"))).collect()}
    assert got[100].n_removed == 0 and got[103].kept == rows[3][1] and got[101].n_removed >= 7 and got[102].n_removed >= 7
    assert got[2].kept == "" and got[None].n_removed == 0 and got[1].n_removed == 0
    assert paragraphs.remove_repeats(docs.limit(0)).collect() == []
    assert paragraphs.edit_distance("a b c d".split(), "a x c".split(), 5) == 2 and paragraphs.edit_distance(list("abcdef"), list("uvwxyz"), 2) == 3


def varied_paragraphs(n, seed=7):
    """Paragraphs that all hold one passage, in chains whose neighbours alone are similar: few of them like any given few others."""
    rng = np.random.default_rng(seed)
    core, out = [f"core{k}" for k in range(24)], []
    while len(out) < n:
        tail = [f"t{len(out)}x{k}" for k in range(16)]
        for step in range(int(rng.integers(2, 7))):
            out.append(" ".join(core + tail))
            tail = tail[2:] + [f"t{len(out)}y{k}" for k in range(2)]
    return [out[k] for k in rng.permutation(len(out))]


def paragraph_clusters(said):
    cut = paragraphs.Cut([t.encode() for t in said])
    bands, sets = cut.bands(np.arange(len(said)), *paragraphs._functions()), [shingle_set(t) for t in said]
    links = []
    for a in range(len(said)):
        for b in np.flatnonzero((bands[a] == bands[a + 1:]).any(1)) + a + 1:
            n = len(sets[a] & sets[b])
            if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n) or paragraphs.edit_distance(said[a].split(), said[b].split(), 6) <= int(0.15 * max(len(said[a].split()), len(said[b].split()))):
                links.append((a, int(b)))
    return roots(range(len(said)), links)


def test_paragraphs_of_a_large_bucket_are_all_compared(spark, monkeypatch):
    said = varied_paragraphs(300)
    want = paragraph_clusters(said)
    rows = spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")
    for cell in (paragraphs.CELL, 40):
        monkeypatch.setattr(paragraphs, "CELL", cell)
        got = {r.doc_id: r.n_removed for r in paragraphs.remove_repeats(rows).collect()}
        assert got == {i: int(want[i] < i) for i in want}


def test_benchmark_passages_are_found_and_nothing_else(spark, table, docs):
    items = [(r.item_id, r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    words = {i: latent.words(t) for i, t in items}
    joined = lambda w: b" " + b" ".join(w) + b" "
    true = {(d, i) for d, t in table for i, w in words.items() if joined(w) in joined(latent.words(t))}
    assert {(r.doc_id, r.item_id) for r in queries.QUERIES["op9_benchmark_decontamination"](spark, SF).collect()} == true
    bench = spark.createDataFrame([(1, "What did the cat with the hat and the bat sit on today? Answer: the mat by the door"), (2, None), (3, ""), (4, "one two")], "item_id long, text string")
    said = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(50, "Somebody wrote: what did the cat with the hat and the small bat sit on today? The answer: the mat by the door, I think.")], "doc_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in latent.leaks(said, bench).collect()} == {(50, 1), (9, 4), (10, 4)}
    assert latent.leaks(docs.limit(0), bench).collect() == [] and latent.leaks(docs, bench.limit(0)).collect() == []


def test_benchmark_passage_that_breaks_off_is_found(spark):
    item = [f"word{k}" for k in range(59)]
    rows = [(1, "some text before " + " ".join(item[:54])), (2, " ".join(item[:46]) + " and then another end"), (3, " ".join(item[:40])), (4, " ".join(item[:50]) + " answer: no")]
    bench = [(1, " ".join(item)), (2, " ".join(item[:50]) + " Answer: nine of the seven")]
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in rows], "doc_id long, text string"))
    found = latent.leaks(docs, spark.createDataFrame(bench, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(10_001, 1), (10_002, 1), (10_004, 1)}


def test_paraphrased_benchmark_passages_are_found(spark, table):
    rng, others = np.random.default_rng(9), [t for _, t in table if t]
    items = [(r.item_id, latent.words(r.text)) for r in queries.table(spark, SF, "benchmark").collect()]
    said, planted = [], set()
    for n, (i, w) in enumerate((i, w) for i, w in items * 4 if len(w) >= latent.SHORT):
        new = [b"reworded" + str(k).encode() if k in changed else x for changed in [set(rng.permutation(len(w))[:len(w) // 5].tolist())] for k, x in enumerate(w)]
        before, after = (" ".join(others[int(rng.integers(len(others)))].split()[:60]) for _ in range(2))
        said.append((10_000 + n, f"{before} {b' '.join(new).decode()} {after}"))
        planted.add((10_000 + n, i))
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(said, "doc_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in latent.leaks(docs, queries.table(spark, SF, "benchmark")).collect()}
    print("planted", len(planted), "found", len(planted & found))
    assert len(planted & found) >= 0.99 * len(planted)


def best_run(item, said):
    """The largest share of the item's words in common order with a run of as many words."""
    places = [k for k, w in enumerate(said) if w in set(item)]
    return max((latent.common(item, said[k:k + len(item)]) / len(item) for k in places), default=0.0)


def test_the_cosine_keeps_what_the_common_words_of_all_pairs_show(spark, table):
    rng, others = np.random.default_rng(3), [t.split() for _, t in table if t]
    items = [(r.item_id, latent.words(r.text)) for r in queries.table(spark, SF, "benchmark").collect()]
    said = []
    for n, (_, w) in enumerate(items * 3):
        w = [x.decode() for x in w]
        keep = set(rng.permutation(len(w))[:len(w) - len(w) // 5].tolist())
        new = [w[:-(-4 * len(w) // 5)], [x for k, x in enumerate(w) if k in keep], [x if k in keep else f"other{k}" for k, x in enumerate(w)]][n % 3]
        before, after = (others[int(rng.integers(len(others)))][:int(rng.integers(60))] for _ in range(2))
        said.append((10_000 + n, " ".join(before + new + after)))
    docs = queries.table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(said, "doc_id long, text string"))
    found = {(r.doc_id, r.item_id) for r in latent.leaks(docs, queries.table(spark, SF, "benchmark")).collect()}
    texts = {i: latent.words(t) for i, t in [*table, *said]}
    true = {(d, i) for d, t in texts.items() for i, w in items if 2 * len(set(w) & set(t)) >= len(set(w)) and best_run(w, t) >= latent.COMMON}
    print("pairs", len(true), "found", len(true & found))
    assert len(true) >= len(said) and len(true & found) >= 0.95 * len(true)
    for d, i in found - true:
        w, t = dict(items)[i], texts[d]
        assert latent.common(w, t) >= latent.LOOSE * len(w)


def test_long_texts_are_searched_in_pieces(monkeypatch):
    rng = np.random.default_rng(8)
    item = [f"i{k}" for k in range(40)]
    items = latent.Items.of([(7, " ".join(item)), (8, "i1 i2 i3")])
    noise = [f"n{k}" for k in rng.integers(0, 500, 20_000)]
    at = rng.permutation(19_000)[:60]
    for k in at:
        noise[k:k + 1] = [f"{noise[k]} " + " ".join(item)]
    texts = [None, "", " ".join(noise), " ".join(noise[:at.min()]), " ".join(item)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array([1, 2, 3, None, 5], pa.int64()), "text": texts})
    vectors = rng.standard_normal((len(items.hashes), 128)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    for size in (1 << 20, 1 << 13):
        monkeypatch.setattr(latent, "AT_ONCE", size)
        coded = list(latent._coded([batch], items))
        whole = [t for b in coded for t in b.column("terms").to_pylist()]
        assert [len(t) // 4 for t in whole] == [len(latent.words(t)) for t in texts]
        rows = [r for b in latent._matches(coded, items, vectors, 1.0) for r in b.to_pylist()]
        assert {(r["id"], r["item"]) for r in rows} == {(3, 7), (3, 8), (5, 7), (5, 8)} and all(r["share"] == 1.0 for r in rows)
        counted = {}
        for b in latent._frequencies(coded, len(items.hashes)):
            counted = dict(zip(b.column("term").to_pylist(), b.column("n").to_pylist()))
        if size == 1 << 20:
            want = counted
        assert counted == want and counted[-1] == sum(max(1, -(-len(latent.words(t)) // latent.PASSAGE)) for t in texts)


def test_longest_common_subsequence():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = ([bytes([x]) for x in rng.integers(97, 102, n)] for n in rng.integers(0, 12, 2))
        row = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                row[i + 1][j + 1] = row[i][j] + 1 if x == y else max(row[i][j + 1], row[i + 1][j])
        assert latent.common(a, b) == row[-1][-1]


def test_nearest_neighbours_recall_and_awkward_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 24))
    x[100:400] = x[100]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(frame, every=200).toPandas()
    hits = 0
    for q, g in got.groupby("query_id"):
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(6000), -s)) if i != q][:20]
        g = g.sort_values("rank")
        assert g["rank"].tolist() == list(range(1, 21)) and np.allclose(g["score"], s[g["vec_id"]], rtol=1e-12)
        hits += len(set(best) & set(g["vec_id"]))
    assert hits >= 0.9 * 20 * got["query_id"].nunique() and got["query_id"].nunique() == 30
    odd = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, None), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (3, [float("nan"), 1.0]), (None, [1.0, 1.0]), (4, [1.0]), (5, [1.0, None]), (6, [0.5, 0.5])]
    rows = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(odd, "vec_id long, embedding array<double>")).collect()}
    assert rows == {(0, 1): (6, 0.5), (0, 2): (20, 0.5), (20, 1): (0, 0.5), (20, 2): (6, 0.5)}
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).collect() == []


def test_chat_query_against_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    want = con.execute(queries.SQL["op4_chat_formatting"]).df().sort_values("conv_id").reset_index(drop=True)
    got = queries.QUERIES["op4_chat_formatting"](spark, SF).toPandas().sort_values("conv_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_pipeline_stages_keep_columns_and_act(spark, docs):
    import corpus_pipeline

    frame = queries.table(spark, SF, "documents")
    columns, kept = frame.columns, frame
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.written(stage(spark, kept, SF), "stage")
        assert after.columns == columns and after.count() <= kept.count()
        kept = after
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF)
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert {r.doc_id: r.text for r in last.collect()} == texts and 0 < len(texts) < frame.count()
    odd = docs.withColumn("source", F.lit(None).cast("string")).withColumn("n_chars", F.length("text").cast("long")).withColumn("root", F.lit(1)).withColumn("kept", F.lit(False))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        assert stage(spark, odd, SF).columns == odd.columns, name
    assert corpus_pipeline.near_dedup(spark, odd, SF).where("doc_id in (5, 6, 10)").count() == 0
    assert corpus_pipeline.tokens(spark, odd.limit(0), SF).count() == 0
