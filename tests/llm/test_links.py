"""Work that connects links: large groups with one main label, and links that come after components are known."""

import numpy as np
import pytest

from sitefold.llm import chosen_path, graph, paragraphs, relations


def shingle_set(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def roots(nodes, links):
    up = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            up[a] = up[b] = min(up[a], up[b])
    return up


def group(n_near, n_far):
    """Near copies of one text, and others that share half of it with them, two by two alike."""
    base = [f"word{i}" for i in range(100)]
    rows = [" ".join(f"c{k}" if i == k else w for i, w in enumerate(base)) for k in range(n_near)]
    for k in range(n_far):
        far = base[:60] + [f"far{k // 2}x{i}" for i in range(40)]
        far[70] = f"own{k}"
        rows.append(" ".join(far))
    return [(int(i), rows[i]) for i in np.random.default_rng(5).permutation(len(rows))]


def test_a_large_group_with_one_main_label_does_not_branch(spark, monkeypatch):
    rows = group(60, 6)
    sets = {i: shingle_set(t) for i, t in rows}
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])])
    assert len(set(want.values())) == 4
    monkeypatch.setattr(chosen_path, "NODE", 20)
    monkeypatch.setattr(chosen_path, "BLOCK", 8)
    monkeypatch.setattr(chosen_path, "_branched", lambda *_: pytest.fail("a level more"))
    got = {r.doc_id: r.component_id for r in chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == want


def test_signatures_meet_as_one_byte_a_coordinate(spark):
    sig = [0, 255, 256, -1, -(1 << 31), (1 << 31) - 1]
    got = spark.createDataFrame([(sig,)], "sig array<int>").select(chosen_path._brief("sig").alias("brief"))
    assert got.schema["brief"].dataType.simpleString() == "array<tinyint>"
    assert got.first()[0] == [-128, 127, -128, 127, -128, 127]


def test_components_are_formed_once_and_carried_on(spark):
    first = [(i, i + 1) for i in range(1, 20)] + [(50, 60), (70, 80)]
    new = [(15, 60), (80, 90), (100, 101)]
    of = graph.components(spark.createDataFrame(first, "a long, b long"))
    got = {r.node: r.root for r in graph.relabelled(of, spark.createDataFrame(new, "a long, b long")).collect()}
    assert got == {n: r for n, r in roots({x for p in first + new for x in p}, first + new).items()}


def test_links_of_a_large_bucket_are_not_connected_again(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base, said = [f"word{i}" for i in range(60)], []
    for k in range(120):
        at = set(rng.choice(60, 4 if k % 2 else 9, replace=False).tolist())
        said.append(" ".join(f"c{k}x{i}" if i in at else w for i, w in enumerate(base)) + ".")
    seen = []
    monkeypatch.setattr(paragraphs, "CELL", 20)
    monkeypatch.setattr(paragraphs, "components", lambda links: seen.append(links.count()) or graph.components(links))
    more = []
    monkeypatch.setattr(paragraphs, "relabelled", lambda of, new: more.append(new.count()) or graph.relabelled(of, new))
    paragraphs.remove_repeats(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect()
    assert len(seen) == 1 and all(n < seen[0] for n in more)


def test_the_join_connects_its_links_once(spark, monkeypatch):
    words = [f"word{i}" for i in range(90)]
    rng, said = np.random.default_rng(3), []
    for k in range(60):
        at = set(rng.choice(90, 1 + k % 3, replace=False).tolist())
        said.append(" ".join(f"c{k}x{i}" if i in at else w for i, w in enumerate(words)))
    calls, rounds = [], []
    monkeypatch.setattr(relations, "components", lambda links: calls.append(links.count()) or graph.components(links))
    monkeypatch.setattr(relations, "contracted", lambda links: rounds.append(links.count()) or graph.contracted(links))
    got = {r.doc_id: r.component_id for r in relations.join_components(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string")).collect()}
    sets = [shingle_set(t) for t in said]
    assert got == roots(range(60), [(a, b) for b in range(60) for a in range(b) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])])
    assert len(calls) == 1 and len(rounds) > 1


def test_one_pass_of_contraction_joins_connected_nodes_only(spark):
    links = [(50, n) for n in range(40, 60) if n != 50] + [(n, n + 1) for n in range(100, 110)] + [(7, 7)]
    of = roots({x for p in links for x in p}, links)
    got = {r.node: r.to for r in graph.contracted(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(to < node and of[to] == of[node] for node, to in got.items())
    assert {n: got[n] for n in range(41, 60)} == dict.fromkeys(range(41, 60), 40)
