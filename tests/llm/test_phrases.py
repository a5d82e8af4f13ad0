"""Phrase mining against a plain count of every phrase."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import types as T

from tidemark.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, least, share, top):
    counts, words = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for size in range(1, 5):
                counts[lang].update(tuple(w[i : i + size]) for i in range(len(w) - size + 1))
    out = []
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in cand.items():
            inside = any(len(q) > len(p) and 100 * b >= share * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in cand.items())
            if not inside:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, n + 1, p.decode(), -a, l, r, words[lang], -score) for n, (score, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mine(spark, rows, **options):
    fields = [("text", T.StringType()), ("lang", T.StringType()), ("phrase", T.StringType()), ("n", T.LongType()), ("a", T.StringType())]
    docs = spark.createDataFrame([(t, l, "x", 1, "y") for t, l in rows], T.StructType([T.StructField(n, t) for n, t in fields]))
    found = phrases.mine_phrases(docs, **options)
    assert [f.dataType.simpleString() for f in found.schema] == ["string", "bigint", "string", "bigint", "bigint", "bigint", "bigint", "bigint"]
    return sorted(tuple(r) for r in found.collect())


def corpus(seed, size=200):
    rng = random.Random(seed)
    words = ["the", "of", "New", "york", "City", "É", "a\x00b", "\xa0", "x-y", "z" * 50, *(f"w{i}" for i in range(25))]
    fixed = ["new york city hall", "of the", "É É É É É", "w1 w2 w3 w4 w5", "the the the"]
    rows = []
    for _ in range(size):
        parts = []
        for _ in range(rng.randint(0, 30)):
            parts.append(rng.choice(fixed) if rng.random() < 0.3 else rng.choice(words))
            parts.append(rng.choice([" ", " ", " ", "  ", "\t", ". ", ", ", "\n", "\x0b", "!"]))
        rows.append(("".join(parts), rng.choice(["en", "en", "fr", None, "und"])))
    return rows + [(None, "en"), ("", "en"), (" \t ", None), ("lonely", "xx"), (None, "none"), ("NEW YORK NEW YORK", "en"), ("NEW YORK NEW YORK", "en")]


@pytest.mark.parametrize("least, top, piece, bits", [(30, 2000, 8_000_000, 1 << 27), (3, 50, 300, 64), (5, 7, 100, 1 << 10), (1, 2000, 2000, 1 << 20)])
def test_equal_to_a_plain_count(spark, monkeypatch, least, top, piece, bits):
    """Small pieces, and filters so full that they let everything through, change nothing."""
    monkeypatch.setattr(phrases, "PIECE", piece)
    monkeypatch.setattr(phrases, "FILTER_BITS", bits)
    monkeypatch.setattr(phrases, "ROWS", 37)
    rows = corpus(least, 200 if least > 1 else 20)
    got, want = mine(spark, rows, least=least, top=top), plain(rows, least, 80, top)
    assert got == want and (len(want) > 10 or least == 30)


def test_a_long_text_is_cut_between_pieces(spark, monkeypatch):
    monkeypatch.setattr(phrases, "PIECE", 1000)
    rows = [("one two three four, five six seven. " * 400, "en"), ("one two three four " * 700, None)]
    assert mine(spark, rows) == plain(rows, 30, 80, 2000) != []


def test_nothing(spark):
    assert mine(spark, []) == [] == mine(spark, [(None, None), ("", "en"), ("a b", "en")])


def test_large_counts_stay_exact(spark):
    """A count near 2^60: the score and the share of a longer phrase are products beyond 64 bits."""
    big = (1 << 60) + 12345
    none = "CAST(array() AS array<bigint>)"
    words = spark.createDataFrame([("en", "a", big + 7), ("en", "b", big + 1)], "lang string, phrase string, a bigint").selectExpr("*", f"{none} AS lefts", f"{none} AS rights")
    pair = spark.createDataFrame([("en", "a b", big)], "lang string, phrase string, a bigint")
    row = phrases._parts(phrases._stream(pair, 2), words).select("lang", "phrase", "a", phrases.weakest_cut().alias("cut")).first()
    assert row.cut.score == 2_000_000 * big // (2 * big + 8) and (row.cut.l, row.cut.r) == (big + 7, big + 1)
