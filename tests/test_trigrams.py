"""The trigram index after changes, deletions and compaction against plain containment."""

import random

from pyspark.sql import functions as F

from tidemark.operators import lexical, trigrams

SCHEMA = "session_key string, seq bigint, role string, content string"
TERMS = ["the", "The cat", "q", "ou", "cat sat on", "记忆检索", "zzz", "", "é", "aaaa"]


def test_search_equals_containment_after_any_changes(spark, tmp_path):
    rng, held = random.Random(4), {}
    index = trigrams.TrigramIndex(spark, str(tmp_path / "t"), ["session_key", "seq"])
    words = ["the", "THE cat", "sat", "on", "out", "aaaaa", "长期记忆检索系统", "É", "xy", "the cat sat on"]
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    for n in range(6):
        keys = [(rng.choice("ab"), rng.randint(0, 9)) for _ in range(8)]
        rows = {k: rng.choice([None, "", " ".join(rng.choices(words, k=rng.randint(1, 5)))]) for k in keys}
        gone = [k for k in rng.sample(sorted(held), min(2, len(held))) if k not in rows]
        index.change(spark.createDataFrame([(a, b, "user", t) for (a, b), t in rows.items()], SCHEMA), spark.createDataFrame(gone, "session_key string, seq bigint"), batch=str(n))
        held |= rows
        for k in gone:
            held.pop(k)
        if n in (2, 5):
            got = {(r.term, r.session_key, r.seq) for r in index.search(terms).collect()}
            assert got == {(t, *k) for t in TERMS if t for k, text in held.items() if text and t.lower() in text.lower()}
    assert len(index.grams.snapshot()["deltas"]) < 6


def test_indexed_messages_rank_as_the_scan_does(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.choice("abc"), i, rng.choice(["user", "assistant"]), " ".join(rng.choices(["the", "thing", "out", "in", "of", "a", "ring"], k=rng.randint(0, 9)))) for i in range(150)]
    log = spark.createDataFrame(rows, SCHEMA)
    index = trigrams.TrigramIndex(spark, str(tmp_path / "m"), ["session_key", "seq"])
    index.change(log)
    for text, options in (("the ing ou", {}), ("ring", {"session_key": "a"}), ("zz thing", {"role": "user", "limit": 7, "offset": 2})):
        terms = spark.createDataFrame([(w,) for w in lexical.message_words(text)], "term string")
        among = index.search(terms).select(*log.columns).distinct()
        got = lexical.search_messages(index.texts.read(), text, among=among, **options)
        want = lexical.search_messages(log, text, **options)
        key = lambda rows: [(r.session_key, r.seq, r.match_score, round(r.rank_score or 0, 8), r.total) for r in rows]
        assert key(got.collect()) == key(want.collect())


def test_postings_hold_no_texts(spark, tmp_path):
    index = trigrams.TrigramIndex(spark, str(tmp_path / "p"), ["session_key", "seq"])
    index.change(spark.createDataFrame([("s", 1, "user", "Words words"), ("s", 2, "user", "ab")], SCHEMA))
    assert sorted((r.seq, r.gram) for r in index.grams.read().collect()) == sorted((1, g) for g in {"wor", "ord", "rds", "ds ", "s w", " wo"})


def test_few_and_many_terms_find_alike(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    index = trigrams.TrigramIndex(spark, str(tmp_path / "f"), ["session_key", "seq"])
    texts = {("s", i): "".join(rng.choices("abÉé\U0001f600 \U0001f601记", k=rng.randint(0, 12))) for i in range(60)}
    make = lambda held: spark.createDataFrame([(a, b, "user", t) for (a, b), t in held.items()], SCHEMA)
    index.change(make({k: "old " + t for k, t in texts.items()}), batch="0")
    index.change(make(texts), batch="1")
    words = ["ab", "É", "\U0001f600", "a\U0001f600", "\U0001f600 \U0001f601", "éab", "old", "记"]
    terms = spark.createDataFrame([(w,) for w in words], "term string")
    want = {(w, *k) for w in words for k, t in texts.items() if w.lower() in t.lower()}
    grams = {(*k, t.lower()[i : i + 3]) for k, t in texts.items() for i in range(len(t) - 2)}
    assert {tuple(r) for r in index.grams.read().select("session_key", "seq", "gram").collect()} == grams
    for asked, scanned in ((1_000, 64), (0, 0)):
        monkeypatch.setattr(trigrams, "ASKED", asked)
        monkeypatch.setattr(trigrams, "SCANNED", scanned)
        assert {(r.term, r.session_key, r.seq) for r in index.search(terms).collect()} == want
