"""Ranked lexical search over a document FP-tree.

Documents are reduced to the terms that some item asks for. A document's vector lists them by falling
document frequency, so documents share the paths of frequent terms in a prefix tree; a path ends in a
leaf where few documents are left. Every subtree knows the largest tf of each of its terms and the
smallest m (length norm). Both bound the score of any document below it, because a term's part of the
score grows with tf and falls with m. An item goes down the tree depth first, best child first, and
leaves out subtrees whose bound is below its tenth best score: the ranking is exact.

Each task builds trees over its own documents, at most TREE_POSTINGS postings each, and returns its
best documents for each item. Items come in groups of at most GROUP_TERMS terms; one group is one
scan of the texts and one broadcast, written out before the next one begins.

Every item row is ranked for itself, also when ids repeat or are null; every document row is a document.
Null and empty texts have no terms. Among equal scores ids ascend, null last.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm.batches import pieces
from tidemark.llm.store import keep
from tidemark.llm.tokens import Tokens, byte_set

#: ASCII signs that separate terms: all but letters and digits.
SEPARATORS = byte_set(*[b for b in range(0x80) if not chr(b).isalnum()])
#: Terms (with repeats) of the items of one scan; postings of one tree; documents of a leaf.
GROUP_TERMS, TREE_POSTINGS, LEAF = 500_000, 2_000_000, 128


@dataclass
class Node:
    """A subtree: documents lo:hi of the tree's order; each of its terms with the largest tf; the smallest m."""

    lo: int
    hi: int
    children: list[Node] = field(default_factory=list)
    terms: np.ndarray | None = None
    most: np.ndarray | None = None
    least_m: int = 0
    postings: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None  # of a leaf: term, tf, document, by term


def gain(tf: np.ndarray, m) -> np.ndarray:
    """A term's part of the score for a weight of 1."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Tree:
    """FP-tree of the documents of a slab. `terms` are ranks: 0 is the most frequent term of all."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, m: np.ndarray) -> None:
        doc = np.repeat(np.arange(len(m)), np.diff(starts))
        order = np.lexsort((terms, doc))
        terms, tfs = terms[order], tfs[order]
        paths = terms.astype(">u4").tobytes()
        ends = (starts * 4).tolist()
        keys = [paths[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        self.order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)  # paths side by side
        sizes = np.diff(starts)[self.order]
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(starts[:-1][self.order] - self.starts[:-1], sizes) + np.arange(self.starts[-1])
        self.terms, self.tfs, self.m = terms[at].astype(np.int64), tfs[at].astype(np.int64), m[self.order]
        self.root = self.grow() if len(m) else None

    def close(self, node: Node) -> None:
        """What a node knows of its documents, from its children or, in a leaf, from the postings."""
        if node.children:
            node.terms, node.most = largest(np.concatenate([c.terms for c in node.children]), np.concatenate([c.most for c in node.children]))
            node.least_m = min(c.least_m for c in node.children)
            return
        a, b = self.starts[node.lo], self.starts[node.hi]
        order = np.argsort(self.terms[a:b], kind="stable")
        docs = np.repeat(np.arange(node.lo, node.hi), np.diff(self.starts[node.lo : node.hi + 1]))
        node.postings = self.terms[a:b][order], self.tfs[a:b][order], docs[order]
        node.terms, node.most = largest(*node.postings[:2])
        node.least_m = int(self.m[node.lo : node.hi].min())

    def split(self, lo: int, hi: int) -> list[tuple[int, int]]:
        """Ranges of the children: where the paths of lo:hi part; small neighbours share one leaf."""
        first, last = self.terms[self.starts[lo] : self.starts[lo + 1]], self.terms[self.starts[hi - 1] : self.starts[hi]]
        short = min(len(first), len(last))
        differ = np.flatnonzero(first[:short] != last[:short])
        depth = int(differ[0]) if len(differ) else short  # the shared path
        at = self.starts[lo:hi] + depth
        term = np.where(at < self.starts[lo + 1 : hi + 1], self.terms[np.minimum(at, len(self.terms) - 1)] if len(self.terms) else -1, -1)
        cuts = [lo, *(np.flatnonzero(term[1:] != term[:-1]) + lo + 1).tolist(), hi]
        if len(cuts) == 2:  # equal paths to their ends
            return [(a, min(a + LEAF, hi)) for a in range(lo, hi, LEAF)]
        out: list[tuple[int, int]] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            if out and b - out[-1][0] <= LEAF:
                out[-1] = (out[-1][0], b)
            else:
                out.append((a, b))
        return out

    def grow(self) -> Node:
        """Nodes from the root down, then what they know from the leaves up."""
        root = Node(0, len(self.m))
        made, todo = [root], [root]
        while todo:
            node = todo.pop()
            if node.hi - node.lo > LEAF:
                node.children = [Node(lo, hi) for lo, hi in self.split(node.lo, node.hi)]
                made += node.children
                todo += node.children
        for node in reversed(made):
            self.close(node)
        return root

    def bound(self, node: Node, terms: np.ndarray, weights: np.ndarray) -> int:
        """No document of the subtree scores more."""
        at = np.searchsorted(node.terms, terms)
        held = np.flatnonzero(at < len(node.terms))
        held = held[node.terms[at[held]] == terms[held]]
        return int((weights[held] * gain(node.most[at[held]], node.least_m)).sum())

    def scores(self, node: Node, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Exact scores of a leaf's documents."""
        held, tfs, docs = node.postings
        first, last = np.searchsorted(held, terms, "left"), np.searchsorted(held, terms, "right")
        sizes = last - first
        at = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64), sizes) + np.arange(sizes.sum())
        out = np.zeros(node.hi - node.lo, np.int64)
        np.add.at(out, docs[at] - node.lo, np.repeat(weights, sizes) * gain(tfs[at], self.m[docs[at]]))
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, floor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """(documents of the slab, scores): all of at least the k-th best score and `floor`; ties stay."""
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        stack = [(self.bound(self.root, terms, weights), self.root)] if self.root else []
        while stack:
            bound, node = stack.pop()
            if bound < floor:
                continue
            if node.children:
                below = [(b, c) for c in node.children if (b := self.bound(c, terms, weights)) >= floor]
                stack += sorted(below, key=lambda x: x[0])  # the best is taken first
                continue
            found = self.scores(node, terms, weights)
            good = np.flatnonzero(found >= floor)
            if len(good):
                docs, scores = np.concatenate([docs, self.order[good + node.lo]]), np.concatenate([scores, found[good]])
                if len(scores) >= k:
                    floor = max(floor, int(np.partition(scores, -k)[-k]))
                    docs, scores = docs[scores >= floor], scores[scores >= floor]
        return docs, scores


def largest(terms: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different terms, ascending, with the largest value of each."""
    if not len(terms):
        return terms.astype(np.int64), values.astype(np.int64)
    order = np.argsort(terms, kind="stable")
    terms, values = terms[order], values[order]
    at = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]]))
    return terms[at], np.maximum.reduceat(values, at)


def vectors(docs: DataFrame, terms: list[str]) -> DataFrame:
    """Every document as id, n (terms with repeats) and its share of `terms` (ascending) as lists of numbers and tfs."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)
    schema = f"id {docs.schema['id'].dataType.simpleString()}, n bigint, terms array<int>, tfs array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = pa.array(sent.value, pa.large_string())
        for batch in batches:
            for piece in pieces(batch):
                tokens = Tokens(piece.column("text"), SEPARATORS)
                coded = tokens.strings.dictionary_encode()
                number = pc.fill_null(pc.index_in(coded.dictionary, asked), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                term = number[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
                kept = term >= 0
                pair, tf = np.unique(tokens.text_of()[kept] * len(asked) + term[kept], return_counts=True)
                ends = pa.array(np.searchsorted(pair, np.arange(piece.num_rows + 1) * len(asked)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(v.astype(np.int32))) for v in (pair % max(1, len(asked)), tf)]
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(tokens.counts.astype(np.int64)), *lists], names=["id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, schema)


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_groups(items: DataFrame) -> Iterator[list[tuple[object, Counter]]]:
    """(id, its terms with repeats) of item rows, in groups of at most GROUP_TERMS terms (or a single item)."""
    group, size = [], 0
    for row in items.toLocalIterator():
        strings = Tokens(pa.array([row.text], pa.large_string()), SEPARATORS).strings.to_pylist()
        if group and size + len(strings) > GROUP_TERMS:
            yield group
            group, size = [], 0
        group.append((row.id, Counter(strings)))
        size += len(strings)
    if group:
        yield group


def _best(kept: DataFrame, group: list[tuple[object, Counter]], names: list[str], k: int, item_type: pa.DataType, schema: str) -> DataFrame:
    """The k best documents of every item of a group, each with the position of the item in it."""
    n_docs, length = kept.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(names), np.int64)
    for term, count in kept.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # one row for each of the group's terms
        df[term] = count
    rank = np.empty(len(names), np.int64)
    rank[np.lexsort((np.arange(len(names)), -df))] = np.arange(len(names))
    number = {name: i for i, name in enumerate(names)}
    asked = []
    for item, terms in group:
        found = sorted((int(rank[i]), count * weight(n_docs, int(df[i]))) for t, count in terms.items() if df[i := number[t]])
        asked.append((item, np.array([r for r, _ in found], np.int64), np.array([w for _, w in found], np.int64)))
    spark = kept.sparkSession
    sent = spark.sparkContext.broadcast((rank, asked))
    id_type = to_arrow_type(kept.schema["id"].dataType)

    def slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += len(batch.column("terms").flatten())
            if size >= TREE_POSTINGS:
                yield pa.Table.from_batches(held)
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, asked = sent.value
        floors = np.ones(len(asked), np.int64)  # the k-th best score of an item in earlier trees
        for slab in slabs(batches):
            lists, tfs = slab.column("terms").combine_chunks(), slab.column("tfs").combine_chunks()
            starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
            m = np.array([25 + 75 * n * n_docs // max(1, length) for n in slab.column("n").to_pylist()], np.int64)
            tree = Tree(starts, rank[lists.flatten().to_numpy()], tfs.flatten().to_numpy(), m)
            for at, (item, terms, weights) in enumerate(asked):
                found, scores = tree.search(terms, weights, k, int(floors[at]))
                if len(found):
                    if len(found) >= k:
                        floors[at] = max(floors[at], scores.min())
                    ids = slab.column("id").combine_chunks().take(pa.array(found))
                    top = pa.table({"id": ids, "score": scores}).sort_by([("score", "descending"), ("id", "ascending")]).slice(0, k)  # null ids come last
                    size = top.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([at] * size, pa.int64()), pa.array([item] * size, item_type), top["id"].combine_chunks().cast(id_type), top["score"].combine_chunks()], names=["at", "item", "id", "score"])

    found = kept.filter(F.size("terms") > 0).mapInArrow(run, schema)
    order = Window.partitionBy("at").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The `k` best documents of every item, scores above 0: item id, rank (from 1), document id, score (long)."""
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()
    schema = f"at bigint, item {item_kind}, id {kind}, score bigint"
    parts = []
    for group in item_groups(items.select(F.col(item_col).alias("id"), F.col(item_text).alias("text"))):
        names = sorted(set().union(*[terms for _, terms in group]))
        kept = keep(vectors(source, names), "vectors")
        parts.append(keep(_best(kept, group, names, k, to_arrow_type(items.schema[item_col].dataType), schema), "ranked"))
    out = spark.createDataFrame([], schema + ", rank int")
    for part in parts:
        out = out.unionByName(part)
    return out.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")
