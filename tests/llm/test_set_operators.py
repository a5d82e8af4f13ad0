"""Near duplicates, leaks, URLs, chats, repeated strings and the pipeline against plain versions."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bloom, chat, decontaminate, graph, neardup, repeats, urls

ODD = [None, "", " \n ", "one", "One", "a b", "x" * 4000]


def odd_rows():
    return list(enumerate(ODD)) + [(20, "same text here now again"), (21, "same text here now again"), (22, "SAME text  here now again")]


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(0, 40)] + [(rng.randint(100, 200), rng.randint(100, 200)) for _ in range(60)] + [(500, 500)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert got == {i: find(i) for p in pairs if p[0] != p[1] for i in p}


def plain_components(rows, size):
    sets = {i: neardup.word_set(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if neardup.linked(sets[i], sets[j], 80):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(table, size):
    rng = random.Random(size)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 4) + rng.choice("mnopqr")
    rows = odd_rows()
    for group in range(4):
        base = [word() for _ in range(rng.choice([40, 120]))]
        for copy in range(rng.choice([2, 6, 90])):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[word()], [], [word(), words[at]]])
            rows.append((1000 * group + 100 + copy, " ".join(words)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table(rows), size=size).collect()}
    assert got == plain_components(rows, size)


def test_links_between_rings_are_found(table):
    """A chain of documents that drifts away from every centre: neighbours are linked, ends share nothing."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[6 * i : 6 * i + 100])) for i in range(50)]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(table(rows), size=2).collect()}
    assert set(got.values()) == {0}


def test_near_copies_too_different_to_be_linked_meet_nobody(table, monkeypatch):
    """One text in which every copy changes a tenth of the words for itself: pairs share buckets, few are candidates."""
    rng, found = random.Random(3), []
    rows = []
    for copy in range(80):
        words = [f"w{i}" for i in range(200)]
        for at in rng.sample(range(200), rng.randint(18, 24)):
            words[at] = f"c{copy}x{at}"
        rows.append((copy, " ".join(words)))
    pairs = neardup._open_pairs
    monkeypatch.setattr(neardup, "_open_pairs", lambda *given: found.append(pairs(*given)) or found[0])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(table(rows), size=2).collect()}
    assert got == plain_components(rows, 2)
    assert found[0].count() == 0


def test_rows_without_or_with_the_same_id(table):
    """Every row is linked and kept or not for itself; of a group the row with the smallest id stays."""
    base = [f"w{i}" for i in range(40)]
    near, other, alone = " ".join([*base[:-1], "x"]), " ".join(f"v{i}" for i in range(30)), "nothing like it at all here"
    rows = [(7, near), (1, " ".join(base)), (None, near), (5, other), (5, alone), (None, other), (None, "q " * 9), (None, "q " * 9), (8, None), (None, None)]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(table(rows), size=2).collect()), key=repr)
    want = [(7, 39, 1, False), (1, 39, 1, True), (None, 39, 1, False), (5, 29, 5, True), (5, 5, 5, True), (None, 29, 5, False), (None, 1, None, True), (None, 1, None, False), (8, 0, 8, True), (None, 0, None, True)]
    assert got == sorted(want, key=repr)


def test_strings_that_collide_in_polynomial_hashes(table):
    text = "a"
    for _ in range(10):
        text += text.translate(str.maketrans("ab", "ba"))
    rows = [(1, text), (2, text.translate(str.maketrans("ab", "ba"))), (3, text)]
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(table(rows), size=2).collect()} == {1: 1, 2: 2, 3: 1}


def test_near_duplicates_of_nothing(table):
    assert neardup.near_duplicates(table([]), size=2).count() == 0
    assert [r.kept for r in neardup.near_duplicates(table([(1, None)]), size=2).collect()] == [True]


def test_leaks(spark, table):
    rng = random.Random(3)
    word = lambda: "w" + str(rng.randint(0, 3000))
    items = [(i, " ".join(word() for _ in range(rng.randint(6, 50)))) for i in range(30)] + [(90, "too short"), (91, ""), (92, None), (93, "too short")]
    rows = odd_rows() + [(200, "this is TOO Short indeed")]
    for i in range(60):
        body = [word() for _ in range(rng.randint(0, 200))]
        cut = items[rng.randrange(30)][1].split()
        cut = cut[rng.randint(0, 2) : len(cut) - rng.randint(0, 2)]
        if rng.random() < 0.5 and len(cut) > 20:
            cut[rng.randrange(len(cut))] = word()
        at = rng.randint(0, len(body))
        rows.append((300 + i, " ".join(body[:at] + cut + body[at:])))
    want = {}
    for doc, text in rows:
        words = (text or "").lower().split()
        for item, passage in items:
            target = (passage or "").lower().split()
            size = min(5, len(target))
            if not size or len(words) < size:
                continue
            bag = lambda w: Counter(tuple(w[k : k + size]) for k in range(len(w) - size + 1))  # noqa: E731,B023
            wide = min(len(target), len(words))
            best = max(sum((a & b).values()) / sum((a | b).values()) for b in [bag(target)] for a in (bag(words[k : k + wide]) for k in range(len(words) - wide + 1)))
            if best >= 0.8:
                want[doc, item] = round(best, 9)
    items = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id bigint, text string, similarity double")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.find_leaks(table(rows), items).collect()}
    assert got == want and len(want) > 20
    assert decontaminate.find_leaks(table(rows), items.limit(0)).count() == 0
    assert decontaminate.find_leaks(table([]), items).count() == 0


def test_many_items_take_several_scans(spark, table, monkeypatch):
    items = spark.createDataFrame([(i, " ".join(f"p{i}q{k}" for k in range(12))) for i in range(40)], "item_id bigint, text string")
    rows = table([(i, " ".join(f"p{i}q{k}" for k in range(12))) for i in range(0, 40, 7)])
    monkeypatch.setattr(decontaminate, "CHUNK_ITEMS", 10)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(rows, items).collect()} == {(i, i) for i in range(0, 40, 7)}


def test_hamming_search_finds_all_within_the_radius():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 2**63, 200, dtype=np.int64).astype(np.uint64)
    masks = np.flatnonzero(decontaminate._ONES <= decontaminate.INNER)
    for p in prints[:50]:
        flips = rng.choice(64, decontaminate.RADIUS, replace=False)
        other = p ^ np.bitwise_or.reduce(np.uint64(1) << flips.astype(np.uint64))
        assert decontaminate.distance(np.array([p]), np.array([other]))[0] == decontaminate.RADIUS
        blocks = [(int(p) >> 16 * b & 0xFFFF) ^ (int(other) >> 16 * b & 0xFFFF) for b in range(4)]
        assert any(x in set(masks.tolist()) for x in blocks)


RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def test_urls(spark):
    seen = ["http://A.Example.NET/en/1?x", "https://net/", "https://net", "http://planet/x", "ftp://q.example.com/de/", "http://q.example.com/DE/", "x.org/fr/", "http://x.org/fr/a://b", "http://w.io/p?utm_a=1&b=2&a=1#z", "http://www.w.io/p/?a=1&b=2", "://", None, "", "http://w.io/p?b=3", "http://ö.org/fr/ü\n?q"]
    pages = spark.createDataFrame([(i, u, "h", True) for i, u in enumerate(seen)], "page_id bigint, url string, host string, maybe boolean")
    listed = spark.createDataFrame([("https://m.w.io:443/p?b=2&a=1&ref=q",), (None,), ("",)], "url string")
    got = {r.page_id: r for r in urls.judge(pages, listed, RULES).collect()}
    assert [got[i].rule for i in range(9)] == ["example.net/en/", "net/", None, None, "example.com/de/", None, None, "org/fr/", None]
    assert [got[i].verdict for i in (0, 1, 2, 4, 8, 9, 10, 11, 13)] == ["allow", "block", "allow", "block", "block", "block", "allow", "allow", "allow"]
    assert got[0].host == "a.example.net" and got[0].path == "/en/1" and got[11].host == "" == got[6].path and got[14].path == "/fr/ü\n"
    assert urls.judge(pages.limit(0), listed, RULES).count() == 0 and urls.judge(pages, listed.limit(0), RULES).filter("listed").count() == 0


def test_small_filters_only_cost_false_hits(spark):
    listed = spark.range(3000).select(F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"))
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://h/"), F.col("id").cast("string")).alias("url"))
    out = urls.judge(pages, listed, [], most_blocks=4)
    assert out.filter("listed").count() == 3000 == out.filter("verdict = 'block'").count()
    asked = bloom.ask(pages, "url", listed, "url")
    assert asked.join(listed, "url").filter("NOT maybe").isEmpty() and asked.filter("maybe").count() < 3100


def test_escapes_are_reversible():
    rng = random.Random(4)
    for _ in range(3000):
        text = "".join(rng.choice(["<|im_end|>", "<|im_start|>", "<", "|", "\\", "\n", "a", "<\\|", "n"]) for _ in range(rng.randint(0, 9)))
        assert chat.unescape(chat.escape(text)) == text and "<|" not in chat.escape(text)
        block, lo, hi = chat.format_turn("assistant", text)
        assert chat.parse_turns(block) == [("assistant", text)] and chat.unescape(block[lo:hi]) == text
        assert chat.parse_turns(chat.format_turn(text, "x")[0] + chat.format_turn("y", text)[0]) == [(text, "x"), ("y", text)]


def test_layouts(spark):
    records = [
        {"prompt": "p", "completion": "c"}, {"prompt": "p", "response": "r"}, {"instruction": "i", "input": "q", "output": "o"}, {"instruction": "i", "output": "o"},
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"unknown": 1}, None, {"prompt": None},
    ]
    df = spark.createDataFrame([(i, 0, json.dumps(r) if r else None, "x") for i, r in enumerate(records)] + [(90, 0, "{broken", "x")], "conv_id bigint, turn bigint, record string, block string")
    rows = chat.format_records(df, "conv_id", "turn").collect()
    turns = {}
    for r in sorted(rows, key=lambda r: (r.conv_id, r.place)):
        turns.setdefault(r.conv_id, []).append((r.layout, r.role) if r.layout else None)
    assert turns[0] == [("completion", "user"), ("completion", "assistant")] and [x[1] for x in turns[2]] == ["system", "user", "assistant"]
    assert [x[1] for x in turns[5]] == ["user", "assistant"] and turns[6] == turns[7] == turns[90] == [None]
    out = {r.conv_id: r for r in chat.digest(chat.format_records(df, "conv_id", "turn"), "conv_id", "turn").collect()}
    assert set(out) == {0, 1, 2, 3, 4, 5, 8} and out[8].n_turns == 1 and out[4].loss_chars == 1
    assert out[4].turns_sha256 == out[5].turns_sha256 == hashlib.sha256(b"user\na\nassistant\nb\n").hexdigest()


def test_chat_query_with_nulls_and_ties(spark, tmp_path):
    from tidemark.llm import queries

    rows = [(1, 0, "user", None), (1, 1, "assistant", "<|im_end|>"), (1, 1, "assistant", "again"), (2, 0, None, "x"), (2, 1, "tool\nbox", "y")]
    spark.createDataFrame([(*r, "k") for r in rows], "conv_id bigint, turn bigint, role string, text string, ord string").write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r.conv_id: r for r in queries.op6_chat_format(spark, str(tmp_path)).collect()}
    assert set(out) == {-1, 1, 2} and out[1].n_turns == 3 and out[1].loss_chars == len("<|im_end|>again")
    assert out[2].turns_sha256 == hashlib.sha256(b"\nx\ntool\nbox\ny\n").hexdigest() and out[2].loss_sha256 == hashlib.sha256(b"").hexdigest()


def plain_repeats(rows, length=200):
    seen = Counter(raw[k : k + length] for _, t in rows for raw in [(t or "").encode()] for k in range(len(raw) - length + 1))
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = [False] * len(raw)
        for k in range(len(raw) - length + 1):
            if seen[raw[k : k + length]] > 1:
                gone[k : k + length] = [True] * length
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def repeat_rows():
    rng = random.Random(12)
    noise = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [noise(rng.randint(190, 500)) for _ in range(5)]
    rows = odd_rows() + [(30, "ab" * 300), (31, shared[0]), (32, noise(150) + "z" * 250)]
    rows += [(40 + i, "".join(rng.choice([noise(rng.randint(0, 300)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 90) :]]) for _ in range(rng.randint(1, 5)))) for i in range(50)]
    return rows


@pytest.mark.parametrize("most", [512, 1])
def test_repeats(table, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_SEGMENTS", most)  # 1: every shared file is counted by window hash
    rows = repeat_rows()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.remove_repeats(table(rows)).collect()}
    assert got == plain_repeats(rows)


def test_repeats_of_nothing(table):
    assert repeats.remove_repeats(table([])).count() == 0
    assert repeats.remove_repeats(table([(1, None)])).first().n_bytes == 0


def test_merged_shards_equal_counting():
    rng = random.Random(3)
    for _ in range(40):
        base = bytes(rng.choice(b"ab") for _ in range(400))
        texts = [base[a : a + rng.randint(24, 90)] + bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 30))) for a in (rng.randint(0, 300) for _ in range(rng.randint(1, 9)))] + [b"a" * 60] * (rng.random() < 0.3)
        count = Counter(t[i : i + 24] for t in texts for i in range(len(t) - 23))
        for text, hit in zip(texts, repeats.repeated_windows(texts, 24, 100)):
            assert hit.tolist() == [count[text[i : i + 24]] > 1 for i in range(len(text) - 23)]


def test_merge_orders_suffixes_and_bounds_common_prefixes():
    rng = random.Random(8)
    parts = [bytes(rng.choice(b"ab") for _ in range(300)) for _ in range(2)]
    parts[1] = parts[1][:100] + parts[0][20:120] + parts[1][100:]
    shards = [repeats.sort_shard(np.frombuffer(p, np.uint8), np.full(len(p), len(p)), 64) for p in parts]
    merged, common = repeats.merge(*shards, 64)
    data = merged.text.tobytes()
    full = [int(p) for p in merged.order if p + 64 <= merged.ends[p]]
    assert [data[p : p + 64] for p in full] == sorted(data[p : p + 64] for p in full)
    assert merged.transform.tolist() == [int(merged.text[p - 1]) if p else 0 for p in merged.order]
    checked = 0
    for i in range(1, len(merged.order)):
        a, b = int(merged.order[i - 1]), int(merged.order[i])
        if common[i] >= 0 and a + 64 <= merged.ends[a] and b + 64 <= merged.ends[b]:
            assert data[a : a + common[i]] == data[b : b + common[i]]
            checked += common[i] > 0
    assert checked > 10 and (common == 64).sum() >= 30


def test_repeats_in_rows_without_or_with_the_same_id(table):
    rng = random.Random(8)
    body = "".join(rng.choice("abcdefgh ") for _ in range(700))
    rows = [(1, body), (2, "x" + body), (1, "short"), (None, body + "yy"), (None, "z" * 5 + body), (2, None), (None, "")]
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in repeats.remove_repeats(table(rows)).collect()]
    want = [(1, 700, 700), (2, 701, 700), (1, 5, 0), (None, 702, 700), (None, 705, 700), (2, 0, 0), (None, 0, 0)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_pipeline_drops_rows_not_ids(spark, tmp_path):
    import corpus_pipeline

    body = " ".join(f"word{k % 17} thing{k}" for k in range(60))
    leak = " ".join(f"passage{k}" for k in range(30))
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, body), (5, body), (5, "a text of its own that nothing else resembles at all"), (None, body), (None, "another one without an id but with words"), (None, leak), (1, leak + " and more")]
    docs = spark.createDataFrame([(i, t, "en", None, len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    left = corpus_pipeline.near_dedup(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.text[:9]) for r in left.collect() if r.doc_id) == sorted([(1, body[:9]), (1, leak[:9]), (5, "a text of")])
    assert [r.text[:9] for r in left.collect() if r.doc_id is None] == ["another o"]
    left = corpus_pipeline.decontaminated(spark, docs, str(tmp_path))
    assert sorted((repr(r.doc_id), r.text[:5]) for r in left.collect()) == sorted([("1", body[:5]), ("5", body[:5]), ("5", "a tex"), ("None", body[:5]), ("None", "anoth")])


def test_pipeline(spark, table, tmp_path):
    import corpus_pipeline

    items = spark.createDataFrame([(1, " ".join(f"passage{k}" for k in range(30)))], "item_id bigint, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    body = " ".join(f"word{k % 17} thing{k}" for k in range(80))
    rows = odd_rows() + [(50, body), (51, body + " more"), (52, " ".join(f"passage{k}" for k in range(30)) + " and what follows it"), (53, "mail me at anna.1@mail3.example.com please")]
    table(rows).select("doc_id", "text", F.lit("en").alias("lang"), "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    docs, left = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        left[name] = {r.doc_id: r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    assert set(left["language"]) == {3, 4, 5, 6, 20, 21, 22, 50, 51, 52, 53}
    assert set(left["near_dedup"]) == {3, 5, 6, 20, 50, 52, 53} and set(left["decontaminate"]) == {3, 5, 6, 20, 50, 53}
    assert left["pii"][53].text == "mail me at <EMAIL> please" and left["pii"][53].n_chars == len("mail me at <EMAIL> please")
    assert set(left["bpe"]) == set(left["pii"]) == {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}


def test_pipeline_keeps_texts_of_many_languages_and_unlabelled_ones(spark):
    import corpus_pipeline

    words = {"aa": "thing other thesh andon ", "bb": "schle unger keitz derch ", "ru": "привет слово мир "}
    rows = [(n, text * 10, lang, None, 1) for n, (lang, text) in enumerate(words.items())]
    rows += [(10, "".join(text * 10 for text in words.values()), None, None, 1), (11, "12 % — …", None, None, 1), (12, None, None, None, 1), (13, "", None, None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = {r.doc_id: r for r in corpus_pipeline.language(spark, docs, "").collect()}
    assert set(found) == {0, 1, 2, 10} and found[10].lang in words and found[10].text == rows[3][1]
    left = corpus_pipeline.language(spark, docs.withColumn("lang", F.lit(None).cast("string")), "")
    assert left.columns == list(corpus_pipeline.COLUMNS) and {(r.doc_id, r.lang) for r in left.collect()} == {(i, None) for i in (0, 1, 2, 10)}


def test_queries_on_the_small_table(spark):
    import verify_sql
    from tidemark.llm import queries

    root = "/root/testdata/sf0.001"
    db = verify_sql.connect(root)
    for name in ("op4_url_filter", "op11_phrases", "op13_ranked_search"):
        line = verify_sql.compare(spark, db, root, name)
        assert line.startswith("ok"), line
    names = ("pii", "bpe", "decontaminate", "url_filter", "repeats", "chat_format", "fingerprint", "lm_score", "language", "near_dedup", "phrases", "byte_bpe", "ranked_search")
    assert set(queries.QUERIES) == {f"op{n}_{name}" for n, name in enumerate(names, 1)}
