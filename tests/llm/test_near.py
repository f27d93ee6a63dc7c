import random
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pagewright.llm import near_documents, simhash
from pagewright.llm.bktree import BKTree, shard_links
from pagewright.llm.components import connected_components


def slow_print(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(links, nodes):
    over = {n: n for n in nodes}

    def top(n):
        while over[n] != n:
            n = over[n]
        return n

    for a, b in links:
        x, y = sorted((top(a), top(b)))
        over[y] = x
    return {n: top(n) for n in nodes}


def test_fingerprints(docs):
    got = sorted((str(r.doc_id), r.fp % (1 << 64)) for r in simhash.fingerprints(docs).collect())
    assert got == sorted((str(r.doc_id), slow_print(r.text)) for r in docs.collect())


def test_components_against_all_pairs(spark):
    base = [(7 * k) ** 9 % (1 << 62) for k in range(1, 40)]
    prints = [p ^ m for k, p in enumerate(base) for m in (0, 1 << k, (1 << k) | (1 << 63), 7 << k)] + [0, 3, 3]
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)] + [(None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, fp long")
    got = {r.doc_id: r.component_id for r in simhash.near_groups(df).collect()}
    near = [(i, j) for i, j in combinations(range(len(prints)), 2) if (prints[i] ^ prints[j]).bit_count() <= 2]
    want = groups(near, range(len(prints)))
    assert {k: v for k, v in got.items() if k is not None} == want
    assert got[None] == want[prints.index(0)]


def test_tree_finds_all_within_the_radius():
    values = [(31 * k) ** 7 % (1 << 40) for k in range(300)]
    tree = BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50]:
        assert sorted(tree.near(v, 14)) == [i for i, w in enumerate(values) if (v ^ w).bit_count() <= 14]
    assert len(shard_links([1, 3, 7, 1 << 30], 1)) == 2


def test_long_chain(spark):
    links = spark.range(200).selectExpr("id AS a", "id + 1 AS b")
    assert {r.root for r in connected_components(links).collect()} == {0}
    assert connected_components(links.where("false")).count() == 0


def test_one_of_each(docs, no_docs):
    kept = near_documents.one_of_each(docs)
    assert kept.columns == docs.columns
    # 1, 2, 2 and 3 are near copies, 4, 5 and 6 have no words: 4 and 5 are equal, 6 has another text.
    rows = sorted(str(r.doc_id) for r in kept.collect())
    assert rows == ["1", "4", "7", "8", "None"]
    assert near_documents.one_of_each(no_docs).count() == 0


@pytest.mark.parametrize("shard_rows", [near_documents.SHARD_ROWS, 3])
def test_near_copies_against_all_pairs(spark, sf_dir, monkeypatch, shard_rows):
    monkeypatch.setattr(near_documents, "SHARD_ROWS", shard_rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sets = {r.doc_id: set(simhash.shingle_hashes(r.text, 5).tolist()) for r in docs.collect()}
    links = [(a, b) for a, b in combinations(sorted(sets), 2)
             if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = sorted(n for n, top in groups(links, sets).items() if n == top)
    assert sorted(r.doc_id for r in near_documents.one_of_each(docs).collect()) == want


def test_a_large_shard_loses_no_link(spark, monkeypatch):
    """A chain of 60 texts, each like the next one only, and rows that are like one text of a cut shard."""
    monkeypatch.setattr(near_documents, "SHARD_ROWS", 4)
    texts = [" ".join(f"w{k}" for k in range(6 * i, 6 * i + 120)) for i in range(60)]
    docs = spark.createDataFrame([*enumerate(texts), (60, "something else")], "doc_id long, text string")
    assert sorted(r.doc_id for r in near_documents.one_of_each(docs).collect()) == [0, 60]


@pytest.mark.parametrize("shard_rows", [near_documents.SHARD_ROWS, 8])
def test_groups_that_straddle_the_least_similarity(spark, monkeypatch, shard_rows):
    """Edited copies of templates: of the texts that share a shard, all similar enough are joined, whatever other links fail."""
    monkeypatch.setattr(near_documents, "SHARD_ROWS", shard_rows)
    dice, texts = random.Random(3), []
    for g in range(60):
        template = [f"t{g}w{i}" for i in range(200)]
        for v in range(20):
            words = list(template)
            for place in dice.sample(range(200), dice.randrange(9)):
                words[place] = f"e{g}v{v}p{place}"
            texts.append(" ".join(words))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = near_documents.sketches(docs, 5).collect()
    sets = {r.doc_id: set(simhash.shingle_hashes(texts[r.doc_id], 5).tolist()) for r in rows}
    links = [(x.doc_id, y.doc_id) for x, y in combinations(sorted(rows, key=lambda r: r.doc_id), 2)
             if x.doc_id // 20 == y.doc_id // 20 and any(a == b for a, b in zip(x["keys"], y["keys"], strict=True))
             and len(sets[x.doc_id] & sets[y.doc_id]) >= 0.8 * len(sets[x.doc_id] | sets[y.doc_id])]
    want = sorted(n for n, top in groups(links, sets).items() if n == top)
    assert sorted(r.doc_id for r in near_documents.one_of_each(docs).collect()) == want


def edited(dice, count, edits, size=200):
    """Sets of shingles of a template with words exchanged."""
    out = []
    for v in range(count):
        words = [f"w{i}" for i in range(size)]
        for place in dice.sample(range(size), edits):
            words[place] = f"e{v}p{place}"
        out.append(np.unique(simhash.shingle_hashes(" ".join(words), 5)).view(np.int64))
    return out


@pytest.mark.parametrize("count", [150, 300, 600])
def test_failing_pairs_leave_no_trace(count):
    """Texts like a template, but below the least similarity to one another: no row for any of the pairs."""
    sets = edited(random.Random(5), count, 9)
    assert sum(len(np.intersect1d(sets[0], x)) / len(np.union1d(sets[0], x)) >= .8 for x in sets[1:]) == 0
    nodes = np.arange(count)
    assert near_documents.joining_links(nodes, nodes, pa.array([x.tolist() for x in sets], pa.list_(pa.int64())), .8) == []


@pytest.mark.parametrize("seed", range(4))
def test_joining_links_against_all_pairs(seed):
    dice = random.Random(seed)
    sets = [x for edits in (0, 1, 3, 5, 8) for x in edited(dice, 12, edits)] + [np.empty(0, np.int64)] * 3
    roots = np.array([dice.randrange(25) * 100 for _ in sets])
    links = near_documents.joining_links(np.arange(len(sets)), roots, pa.array([x.tolist() for x in sets], pa.list_(pa.int64())), .8)
    true = [(i, j) for i, j in combinations(range(len(sets)), 2) if len(sets[i]) and len(sets[j])
            and len(np.intersect1d(sets[i], sets[j])) >= .8 * len(np.union1d(sets[i], sets[j]))]
    same = [(i, j) for i, j in combinations(range(len(sets)), 2) if roots[i] == roots[j]]
    assert groups(links + same, range(len(sets))) == groups(true + same, range(len(sets)))
    assert len(links) < len(set(roots.tolist())) and {tuple(sorted(x)) for x in links} <= set(true)
