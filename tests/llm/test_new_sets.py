"""Phrases, filter interactions and the n-gram join, against brute force."""

import math
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sitefold.llm import interactions, keycounts, phrases, queries, relations, shingles

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def against_sql(spark, name, **tables):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'") if t not in tables else con.register(t, tables[t])
    want, got = con.execute(queries.SQL[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    key = list(want.columns)
    pd.testing.assert_frame_equal(got[key].sort_values(key).reset_index(drop=True), want.sort_values(key).reset_index(drop=True), check_dtype=False)
    return got


# n-gram join

def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = [(i, shingle_set(t)) for i, t in rows]
    up = {i: i for i, _ in rows if i is not None}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (a, x) in enumerate(sets):
        for b, y in sets[k + 1:]:
            if a is not None and b is not None and x and y and (a == b or 100 * len(x & y) >= 80 * len(x | y)):
                u, v = top(a), top(b)
                up[max(u, v)] = min(u, v)
    return sorted(((i, len(s), None if i is None else top(i) if s else i) for i, s in sets), key=repr)


def joined(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in relations.join_components(frame).collect()), key=repr)


def test_join_over_the_whole_table(spark):
    rows = [(r.doc_id, r.text) for r in queries.table(spark, SF, "documents").collect()]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in queries.QUERIES["op13_ngram_jaccard_join"](spark, SF).collect()), key=repr)
    assert got == brute_components(rows) and len({c for _, _, c in got}) < len(rows)


def related(rng, n=120, words=90):
    """Chains whose neighbours alone are linked, sets around a common one near the threshold, and sets that share one passage only."""
    base, out = [f"w{i}" for i in range(words)], []
    for k in range(n // 3):
        changed = set(rng.choice(words, int(rng.integers(1, 4)), replace=False).tolist())
        out.append(" ".join(f"c{k}x{i}" if i in changed else w for i, w in enumerate(base)))
    chain = [f"v{i}" for i in range(words)]
    for k in range(n // 3):
        chain = chain[2:] + [f"v{k}y{j}" for j in range(2)]
        out.append(" ".join(chain))
    for k in range(n // 3):
        out.append(" ".join(base[:40] + [f"u{k}z{i}" for i in range(int(rng.integers(3, 60)))]))
    return [(1000 + int(i), out[i]) for i in rng.permutation(len(out))]


@pytest.mark.parametrize("rounds, block", [(3, 256), (1, 16), (0, 8), (0, 256)])
def test_join_of_related_sets_by_leaders_and_by_blocks(spark, monkeypatch, rounds, block):
    monkeypatch.setattr(relations, "ROUNDS", rounds)
    monkeypatch.setattr(relations, "BLOCK", block)
    rows = related(np.random.default_rng(rounds + block))
    assert joined(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute_components(rows)


def test_join_of_awkward_rows(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(6, "another text with the same id as two others have"), (20, "another text with the same id as two others have")]
    odd = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows[-2:], "doc_id long, text string")).withColumns({"node": F.lit(1), "id": F.lit("x"), "component": F.lit(2), "n_shingles": F.lit(0)})
    assert joined(odd) == brute_components(rows)
    assert relations.join_components(docs.limit(0)).collect() == []


def test_families_decide_as_full_sets_do():
    rng = np.random.default_rng(5)
    for _ in range(200):
        pivot = np.unique(rng.integers(0, 1 << 60, int(rng.integers(5, 60)), np.uint64))
        near = [np.unique(np.concatenate([rng.permutation(pivot)[:int(len(pivot) * rng.uniform(.6, 1))], rng.choice(np.arange(20, dtype=np.uint64), int(rng.integers(0, 9)))])) for _ in range(2)]
        family = relations.Family(pivot)
        x, y = near
        both = len(np.intersect1d(x, y))
        assert relations.overlap(x, y) == both
        assert family.linked(family.differences(x), family.differences(y)) == (100 * both >= 80 * (len(x) + len(y) - both))


def test_first_places_meet_for_every_linked_pair():
    rng = np.random.default_rng(2)
    for _ in range(100):
        x = np.unique(rng.integers(0, 1 << 64, int(rng.integers(1, 80)), np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[:max(1, math.ceil(.85 * len(x)))], rng.integers(0, 1 << 64, int(rng.integers(0, 8)), np.uint64)]))
        keys = np.sort(keycounts.keys_of(np.intersect1d(x, y)))
        bits = np.zeros(1 << 20, np.uint8)
        bits[(keys >> np.uint64(24)).astype(np.int64)] = 1
        some = keycounts.Filters((2,), [np.packbits(bits, bitorder="little")])
        both = len(np.intersect1d(x, y))
        if 100 * both >= 80 * (len(x) + len(y) - both):
            (a, p), (b, q) = relations.first_places(x, some), relations.first_places(y, some)
            common = [(len(x) - i, len(y) - j) for s, i in zip(a, p) for t, j in zip(b, q) if s == t]
            assert common and any(180 * min(c) >= 80 * (len(x) + len(y)) for c in common)


def test_filters_have_every_key_that_reaches_a_threshold(spark):
    rng = np.random.default_rng(3)
    parts = [np.sort(rng.choice(1 << 44, 3000, replace=False).astype(np.uint64)) for _ in range(3)]
    shared = np.unique(np.concatenate([p[:500] for p in parts[:2]]))
    rows = []
    for p in parts:
        keys = np.unique(np.concatenate([p, shared]))
        rows += list(zip(*keycounts.dealt(keys, np.where(np.isin(keys, shared), 40, 1), 5)))
    frame = spark.createDataFrame([(int(b), bytearray(k)) for b, k in rows], "bucket int, keys binary")
    found = keycounts.filters(frame, (2, 100, 1000), 5)
    assert found.reach(shared).all() and found.reach(shared, 1).all() and not found.reach(shared, 2).any()
    assert found.reach(parts[2], 0).mean() < 0.1 and (found.level(shared) == 2).all()


# phrases

def brute_phrases(rows, least=30, top=2000):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(w)
            own = counts.setdefault(lang, Counter())
            own.update(w[i:i + k] for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        some = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = {}
        for p, a in some.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i:i + k]] = max(a, longer.get(p[i:i + k], 0))
        scored = []
        for p, a in some.items():
            if 100 * longer.get(p, 0) < 80 * a:
                score, _, left, right = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, r, p.decode(), -a, left, right, total[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def found_phrases(frame, **more):
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in phrases.collocations(frame, **more).collect())


def test_phrases_over_the_whole_table(spark):
    assert len(against_sql(spark, "op11_phrase_collocations")) > 20
    rows = [(r.lang, r.text) for r in queries.table(spark, SF, "documents").collect()]
    assert found_phrases(queries.table(spark, SF, "documents")) == brute_phrases(rows)


def test_phrases_of_awkward_rows(spark, docs):
    rng = np.random.default_rng(1)
    said = ["alpha", "Beta", "gamma,", "delta", "epsilon.", "ζ", "x\ty", "😀"]
    rows = [(i, " ".join(said[int(k)] for k in rng.integers(0, 3 + i % 6, 60)), [None, "und", "en", ""][i % 4], 0) for i in range(120)] + [(500, "a " * 5000, "xx", 0), (501, ".,;:\n", "yy", 0)]
    odd = docs.unionByName(spark.createDataFrame(rows, docs.schema)).repartition(4).withColumns({"words": F.lit(1), "a": F.lit(2), "n": F.lit("z"), "h": F.lit(0)})
    want = brute_phrases([(r.lang, r.text) for r in odd.collect()])
    assert found_phrases(odd) == want and {"und", "en", "", "xx"} <= {w[0] for w in want}
    assert found_phrases(odd, top=5) == [w for w in want if w[1] <= 5]
    assert found_phrases(docs.limit(0)) == []


def test_words_of_chunks(monkeypatch):
    text = " ".join(f"word{i % 71}" + [",", " ", ".\n", ""][i % 4] for i in range(3000)).encode() + b"x" * 900 + b". end\n"
    whole = phrases.words(np.frombuffer(text, np.uint8))
    monkeypatch.setattr(phrases, "CHUNK", 64)
    assert all((a == b).all() for a, b in zip(phrases.words(np.frombuffer(text, np.uint8)), whole))
    assert [text[a:z] for a, z in zip(whole[2], whole[3])] == re.findall(rb"[^\x20\x09.,;:!?\x0A-\x0D]+", text)
    assert len(np.unique(whole[1])) == len([p for p in re.split(rb"[.,;:!?\x0A-\x0D]", text) if p.strip()])


def test_equal_parts_are_the_frequent_phrases():
    rng = np.random.default_rng(4)
    table, count = rng.integers(0, 4, (4, 800)).astype(np.int32), rng.integers(1, 5, 800)
    for d in range(1, 4):
        table[d] *= table[d - 1] > 0
    for least in (1, 30, 200):
        want = Counter()
        for p in range(800):
            for d in range(2, 5):
                if table[d - 1, p]:
                    want[tuple(table[:d, p].tolist())] += int(count[p])
        got = {tuple(table[:d, p].tolist()): many for d, p, many in phrases.equal_parts(table, count, range(2, 5), least)}
        assert got == {k: v for k, v in want.items() if v >= least}


# filter interactions

def test_interactions_over_the_whole_table(spark):
    got = against_sql(spark, "op12_filter_interactions")
    assert len(got) == 600 * got["part"].nunique()


def test_paths_through_the_lattice():
    for k in range(1, 6):
        reaching, leaving = interactions.paths(k)
        for state in range(1 << k):
            n = bin(state).count("1")
            assert reaching[state] == math.factorial(n) and leaving[state] == math.factorial(k - n)


def test_interactions_of_awkward_rows(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, None, 1), (6, 1, 1), (None, 1, 1), (4, 0, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    extra = spark.createDataFrame([(30, "$ " * 300, None, 1), (31, "$ " * 300, "", 1), (None, "$ " * 300, "", 1), (32, "WORD " * 250, "en", 0), (33, None, "en", 0)], docs.schema)
    odd = docs.unionByName(extra).withColumns({"id": F.lit("q"), "mask": F.lit(7), "t": F.lit("t"), "quality": F.lit(1), "part": F.lit("p")})
    rows = [(r.doc_id, "" if r.lang is None else r.lang, r.text or "") for r in odd.collect()]
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[t] = min(i, first.get(t, i))
    facts = []
    for i, part, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {c for c, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and first[t] < i)) if bad}
        facts.append((part, f, i in (1, 6), i in (1, 6, 4)))
    want = {}
    for part in {p for p, *_ in facts}:
        own, total = [x for x in facts if x[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, c in enumerate(order, 1):
                gone = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                total[c] += len(gone)
                want[part, "".join(order), step] = [len(left), len(gone), sum(c in x[1] for x in own) - len(gone), sum(x[1] == {c} for x in own), sum(x[2] for x in gone), sum(x[3] for x in gone)]
        for (p, order, step), v in want.items():
            if p == part:
                v.append(total[order[step - 1]])
    got = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in interactions.audit(odd, labels).collect()}
    assert got == want
    assert interactions.audit(odd.limit(0), labels).collect() == []
    assert {r.good_lost for r in interactions.audit(odd, labels.limit(0)).collect()} == {0}
    with pytest.raises(ValueError):
        interactions.audit(odd, labels, lambda t: {str(k): t == str(k) for k in range(7)})
