"""Byte-pair encoding by halves against the tiktoken library."""

import hashlib
import random
import time

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import bytebpe
from tidemark.llm.queries import byte_ranks

PATH, PATTERN = byte_ranks()
RANKS = bytebpe.parse_ranks(bytebpe.read_ranks(PATH))
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
MINE = bytebpe.ByteBpe(RANKS, PATTERN)
ALPHABETS = ["ab", "x", "aeinrst", "abcdefghijklmnopqrstuvwxyz", "éàüßœ", " \n\t\r", "0123456789", "=-_*#", "日本語中文", "😀👍a‍", "'sdtrevm l"]


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.sampled_from(ALPHABETS).flatmap(lambda a: st.text(a, max_size=120))))
def test_equal_to_the_library(text):
    ids = MINE.encode(text)
    assert ids == LIBRARY.encode_ordinary(text)
    assert MINE.decode(ids) == text.encode()


def random_table(rng):
    """Ranks in any order, so that merges can open lower ranks: the boundary argument must not need trained ranks."""
    strings = {bytes([b]) for b in range(97, 101)}
    while len(strings) < 40:
        strings.add(bytes(rng.choice(range(97, 101)) for _ in range(rng.randint(2, 6))))
    order = sorted(strings)
    rng.shuffle(order)
    return {raw: rank for rank, raw in enumerate(order)}


def test_any_table_of_ranks():
    for seed in range(60):
        rng = random.Random(seed)
        ranks = random_table(rng)
        library, mine = tiktoken.Encoding("t", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}), bytebpe.ByteBpe(ranks, r"[\s\S]+")
        for _ in range(30):
            text = "".join(rng.choice("abcd") for _ in range(rng.randint(0, 150)))
            assert mine.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("unit", ["x", "ab", "abc", "thnd", " ", "=", "é", "0"])
def test_long_matches(unit):
    text = unit * 40_001
    start = time.time()
    assert MINE.encode(text) == LIBRARY.encode_ordinary(text)
    assert time.time() - start < 20


def test_texts_taken_bit_by_bit(monkeypatch):
    text = "Some words, 12 of them.  \n\n And 'll more" * 50
    whole = MINE.encode(text)
    monkeypatch.setattr(bytebpe, "LONG_TEXT", 10)
    monkeypatch.setattr(bytebpe, "MATCHES", 7)
    assert MINE.encode(text) == whole == LIBRARY.encode_ordinary(text)


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bytebpe, "CACHE_SIZE", 5)
    mine = bytebpe.ByteBpe(RANKS, PATTERN)
    text = " ".join("word" + chr(97 + i % 26) * (i % 40) for i in range(300))
    assert mine.encode(text) == LIBRARY.encode_ordinary(text)
    assert max(len(m) for m in (mine.words, mine.leaves, mine.fits)) <= 5


def test_rows(spark, table):
    rows = [(1, None), (2, ""), (2, "again the same id"), (None, "no id"), (None, "no id"), (3, "<|endoftext|> is text"), (4, "y" * 5000 + " end"), (5, "ß\u0000 x")]
    got = bytebpe.encode_texts(table(rows), PATH, PATTERN).collect()

    def want(doc, text):
        ids = LIBRARY.encode_ordinary(text or "")
        body = b"".join(i.to_bytes(4, "little") for i in ids)
        return doc, len(ids), hashlib.sha256(body).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest(), ids, (text or "").encode()

    assert sorted(map(repr, ((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256, r.ids, bytes(r.decoded)) for r in got))) == sorted(map(repr, (want(*r) for r in rows)))
    assert bytebpe.encode_texts(table([]), PATH, PATTERN, with_ids=False).count() == 0
