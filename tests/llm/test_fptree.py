"""Ranked search over the FP-tree against a plain scan."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import fptree

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return PATTERN.findall((text or "").translate(LOWER))


def plain(rows, items, k):
    docs = [(i, Counter(t)) for i, t in ((i, terms_of(text)) for i, text in rows) if t]
    total, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in docs:
            m = 25 + 75 * sum(c.values()) * total // length
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms_of(text) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, n + 1, None if none else doc, -score) for n, (score, none, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def search(spark, table, rows, items, k=10):
    asked = spark.createDataFrame([(i, t, 0.5, 3) for i, t in items], "item_id bigint, text string, score double, rank int")
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in fptree.rank_documents(table(rows), asked, k).collect()), key=repr)


def corpus(seed, size):
    rng = random.Random(seed)
    words = ["the", "of", "in", *(f"w{i}" for i in range(60)), "É", "éa", "a1", "日本", "x_y", "don't"]
    rows = [(i, " ".join(rng.choices(words, [200 / (1 + j) for j in range(len(words))], k=rng.choice([1, 5, 40, 200])))) for i in range(size)]
    rows += [(1000 + i, None if i % 3 else "") for i in range(5)] + [(2000, " .,;"), (2001, "THE the The"), (2001, "the same id"), (None, "w3 no id of"), (None, "w3 no id of")]
    rows += [(3000 + i, "the of w1 w2 w40 w41") for i in range(50)]  # equal texts
    items = [(i, " ".join(rng.choices(words, k=rng.choice([1, 3, 30])))) for i in range(12)]
    items += [(90, None), (91, ""), (92, "nowhere to be found zzz"), (93, "w40 w41 w41 W41"), (94, "the"), (94, "w3"), (None, "w5 of")]
    return rows, items


@pytest.mark.parametrize("leaf, postings, group", [(128, 2_000_000, 500_000), (2, 300, 40), (1, 50_000, 500_000)])
def test_equal_to_a_plain_scan(spark, table, monkeypatch, leaf, postings, group):
    for name, value in (("LEAF", leaf), ("TREE_POSTINGS", postings), ("GROUP_TERMS", group)):
        monkeypatch.setattr(fptree, name, value)
    rows, items = corpus(leaf, 300)
    assert search(spark, table, rows, items) == plain(rows, items, 10)


def test_few_documents_and_empty_tables(spark, table):
    rows, items = corpus(5, 3)
    assert search(spark, table, rows, items, k=3) == plain(rows, items, 3)
    assert search(spark, table, [], items) == [] == search(spark, table, rows, []) == search(spark, table, [(1, None)], items)


def test_one_very_long_text(spark, table):
    rows = [(1, "w1 w2 " * 300_000), (2, "w1"), (3, "x" * 1_000_000 + " w2")]
    items = [(1, "w1 w2"), (2, "x" * 1_000_000)]
    assert search(spark, table, rows, items) == plain(rows, items, 10)


def random_tree(seed, n=500):
    rng = np.random.default_rng(seed)
    lists = [np.flatnonzero(rng.random(40) < 1 / (1 + np.arange(40) * 0.3)) for _ in range(n)]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])])
    tfs = rng.integers(1, 9, starts[-1])
    return fptree.Tree(starts, np.concatenate(lists), tfs, rng.integers(30, 300, n)), rng


def test_bounds_hold_and_subtrees_are_left_out(monkeypatch):
    monkeypatch.setattr(fptree, "LEAF", 4)
    tree, rng = random_tree(1)
    seen = 0
    for _ in range(20):
        terms = np.sort(rng.choice(40, 6, replace=False))
        weights = rng.integers(1, 5000, 6)
        leaves, stack = {}, [tree.root]
        while stack:
            node = stack.pop()
            stack += node.children
            if not node.children:
                leaves[node.lo] = tree.scores(node, terms, weights)
                assert leaves[node.lo].max() <= tree.bound(node, terms, weights)
            elif not all(tree.bound(c, terms, weights) <= tree.bound(node, terms, weights) for c in node.children):
                raise AssertionError("a child may not promise more than its parent")
        every = np.concatenate([leaves[lo] for lo in sorted(leaves)])
        best = np.sort(every)[::-1][:10]
        scored = []
        real = tree.scores
        tree.scores = lambda *a: scored.append(1) or real(*a)  # noqa: B023
        _, scores = tree.search(terms, weights, 10)
        tree.scores = real
        assert np.sort(scores)[::-1][:10].tolist() == [s for s in best.tolist() if s > 0]
        seen += len(scored) < len(leaves)
    assert seen > 10


def test_paths_are_shared():
    tree, _ = random_tree(2, 3000)
    sizes, stack = [], [tree.root]
    while stack:
        node = stack.pop()
        stack += node.children
        sizes.append((node.hi - node.lo, bool(node.children)))
    assert all(children or size <= fptree.LEAF for size, children in sizes)
    assert sum(size for size, children in sizes if not children) == 3000 and len(sizes) < 400
