"""Personal data, tokens, languages, fingerprints and language-model scores against plain versions."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import batches, bpe, fingerprint, langid, lm, pii

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \n\t ", "é", "a" * 3000, "x\ny\nx", "<|endoftext|>", "Σίσυφος ΟΔΟΣ 1٣ 𝟘 中文", "it's I'LL <|startoftext|>don't"]


def odd_rows():
    return [(i, t) for i, t in enumerate(ODD)] + [(20, "same text"), (21, "same text")]


def test_hashes_depend_on_content_only():
    words = batches.Words(pa.array(["ab cd", None, "", "cd  AB", "abcd"]))
    h = words.hashes()
    assert words.counts.tolist() == [2, 0, 0, 2, 1] and h[0] == h[3] and h[1] == h[2] and len(set(h.tolist())) == 3


def test_shingles_of_short_texts():
    h, bounds = batches.shingles(batches.Words(pa.array(["a", "", "a b c", "a b"])), 2)
    assert bounds.tolist() == [0, 1, 1, 3, 4] and h[1] == h[3] != h[0]


@pytest.mark.parametrize("seed", range(4))
def test_bpe_equals_the_library(seed):
    rng = random.Random(seed)
    mine, theirs = bpe.WordBpe(open(WORD_BPE, encoding="utf-8").read()), Tokenizer.from_file(WORD_BPE)
    letters = "aAbBéÉßΣςσİ's't'll12٣½\n\t\r\x0b\x1c\x85　!?<|>中ñthe "
    for text in [t for t in ODD if t] + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(800)]:
        want = theirs.encode(text, add_special_tokens=False)
        assert mine.encode(text) == want.ids
        assert mine.decode(want.ids) == theirs.decode(want.ids, skip_special_tokens=False)


def test_bpe_of_a_very_long_word():
    mine, theirs = bpe.WordBpe(open(WORD_BPE, encoding="utf-8").read()), Tokenizer.from_file(WORD_BPE)
    text = "abcab" * 30_000
    assert mine.encode(text) == theirs.encode(text, add_special_tokens=False).ids


def test_encode_texts(table):
    got = {r.doc_id: r for r in bpe.encode_texts(table(odd_rows()), WORD_BPE).collect()}
    theirs = Tokenizer.from_file(WORD_BPE)
    for i, text in odd_rows():
        ids = theirs.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert bpe.encode_texts(table([]), WORD_BPE).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card":
                twice = [int(d) * (1 + i % 2) for i, d in enumerate(digits[::-1])]
                if not 13 <= len(digits) <= 19 or sum(d - 9 * (d > 9) for d in twice) % 10:
                    continue
            if kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_base_spans_follow_the_patterns():
    rng = random.Random(2)
    bits = ["a.b", "@", "x-y.com", ".", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8.9", "4539 1488 0343 6467", "4539148803436467", "+1 (988) 555-2485", "+1", "12", " ", "-", "é", "\n", "(", "+49 171"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(text) == plain_base(text), text


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000, "1" * 200_000, "a@" * 50_000, "1." * 100_000, "+1" * 100_000, "+1" + "(" * 200_000):
        pii.base_spans(text)


def test_field_finds_what_patterns_miss():
    field = pii.default_field()
    held = pii.labelled_table(300, seed=77)
    hit = missed = wrong = 0
    for text, spans in held:
        found = set(pii.field_spans(field, field.reach, pa.array([text]))[0])
        assert found == set(pii.field_spans(field, 10**9, pa.array([text]))[0])  # the windows lose nothing
        hit, missed, wrong = hit + len(found & set(spans)), missed + len(set(spans) - found), wrong + len(found - set(spans))
    assert hit / (hit + missed) > 0.7 and hit / (hit + wrong) > 0.85


def test_find_pii(table):
    rows = odd_rows() + [(30, "mail anna.1@mail3.example.com or call (269) 555-3296 now"), (31, "42.144.35.254 é 4041894974608795")]
    got = {r.doc_id: r for r in pii.find_pii(table(rows), with_text=True).collect()}
    assert len(got) == len(rows) and got[0].spans == "" and got[0].masked == ""
    assert got[30].n_email == 1 and got[30].spans.startswith("email:5:")
    assert got[31].n_ip == 1 and "ip:0:13" in got[31].spans and got[31].masked.startswith("<IP> é")
    base = pii.base_spans(rows[-1][1])
    assert got[31].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert pii.find_pii(table([])).count() == 0


# -- languages --------------------------------------------------------------------------------

WORDS = {"aa": ["thing", "other", "thesh", "andon"], "bb": ["schle", "unger", "keitz", "derch"], "ru": ["привет", "слово", "мир"]}


def talk(rng, lang, n=30):
    return " ".join(rng.choice(WORDS[lang]) + rng.choice(["", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(4)
    rows = [(talk(rng, lang), lang) for lang in WORDS for _ in range(40)] + [("nothing", None), (None, "aa"), ("", "bb")]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_languages_and_spans(table, model):
    rng = random.Random(5)
    mixed = talk(rng, "aa", 20) + " " + talk(rng, "bb", 40)
    rows = odd_rows() + [(40, talk(rng, "aa")), (41, talk(rng, "bb")), (42, talk(rng, "ru")), (43, mixed), (44, "— … 12 %"), (45, "x" * 5000), (46, "3 × 4 ÷ 2"), (47, "é × 2")]
    got = {r.doc_id: r for r in langid.identify(table(rows), model, with_spans=True).collect()}
    assert [got[i].lang_pred for i in (40, 41, 42, 43)] == ["aa", "bb", "ru", "bb"]
    assert [(s.lang, s.words) for s in got[43].spans] == [("aa", 20), ("bb", 40)] and 0.5 < got[43].score < 1
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (0, 1, 2, 44, 46))
    assert got[47].lang_pred != "und" and len(got) == len(rows)


def test_viterbi_equals_a_plain_one(model):
    rng = random.Random(6)
    texts = [" ".join(talk(rng, rng.choice(list(WORDS)), rng.randint(1, 9)) for _ in range(rng.randint(0, 6))) for _ in range(60)]
    runs = langid.letter_runs(pa.array(texts))
    label = model.label(runs, len(texts))
    score = model.word_scores(runs).astype(float)
    for i in range(len(texts)):
        mine = [k for k in range(len(label)) if runs.text[k] == i]
        best = None
        for k in mine:
            best = list(score[k]) if best is None else [score[k][j] + max(b - (langid.SWITCH if j != m else 0) for m, b in enumerate(best)) for j in range(len(best))]
        path = sum(score[k][label[k]] for k in mine) - langid.SWITCH * sum(label[a] != label[b] for a, b in zip(mine, mine[1:]))
        assert not mine or math.isclose(path, max(best), abs_tol=1e-6)


def test_two_halves_with_a_third_language_between_them(model, monkeypatch):
    runs = langid.letter_runs(pa.array(["one two three four", "five six"]))
    a, b, c = [-2.9] * 4, [0.0, 0.0, -6.0, -6.0], [-6.0, -6.0, 0.0, 0.0]
    scores = np.array([*zip(a, b, c), (0.0, -1.0, -1.0), (0.0, -1.0, -1.0)])
    monkeypatch.setattr(model, "word_scores", lambda runs: scores)
    assert model.label(runs, 2).tolist() == [1, 1, 2, 2, 0, 0]  # one switch costs 9, language 0 alone 11.6
    rng = np.random.default_rng(3)
    for _ in range(300):
        scores = -rng.choice([0.0, 1.5, 2.9, 6.0], (6, 3))
        label = model.label(runs, 2)
        for at in (range(4), range(4, 6)):
            worth = lambda path, at=at: sum(scores[k][j] for k, j in zip(at, path)) - langid.SWITCH * sum(x != y for x, y in zip(path, path[1:]))
            assert math.isclose(worth(label[list(at)].tolist()), max(map(worth, itertools.product(range(3), repeat=len(at)))), abs_tol=1e-6)


def test_no_training_rows(spark, table):
    empty = langid.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in langid.identify(table(odd_rows()), empty).collect()} == {"und"}


# -- fingerprints -----------------------------------------------------------------------------


def test_fingerprints_against_sets(table):
    rng = random.Random(7)
    line = lambda: rng.choice(["", "alpha", "beta", "gamma"]) + str(rng.randint(0, 400))
    rows = odd_rows() + [(50 + i, "\n".join(line() for _ in range(rng.choice([1, 5, 40, 400])))) for i in range(12)]
    got = {r.doc_id: r for r in fingerprint.compare_versions(table(rows)).collect()}
    order = sorted(rows, reverse=True, key=lambda r: r[0])
    lines = lambda t: {x for x in t.split("\n") if x}
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        alike = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
        assert got[i].n_chars == len(text) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(got[i].near_edited, alike(lines(text), lines(edited))) and math.isclose(got[i].near_next, alike(lines(text), lines(after)))
        assert len(got[i].only_text) == len(lines(text) - lines(edited))
    assert got[20].fingerprint == got[21].fingerprint != got[50].fingerprint
    assert max(r.level for r in got.values()) > 0  # larger sketches were needed
    assert fingerprint.compare_versions(table([])).count() == 0
    assert fingerprint.compare_versions(table([(1, "a\nb")])).first().near_next == 1.0


def test_fingerprints_of_rows_without_or_with_the_same_id(table):
    rows = [(9, "a\nb\nc"), (1, "d\ne"), (1, "d\ne"), (None, "f\ng"), (None, "f\ng")]
    got = sorted(((r.doc_id is None, -(r.doc_id or 0), r.n_chars, r.near_next, r.edited_sha256) for r in fingerprint.compare_versions(table(rows)).collect()))
    order = [rows[0], rows[1], rows[2], rows[3], rows[4]]
    want = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        want.append((i is None, -(i or 0), len(text), float(text == after), hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()))
    assert got == sorted(want)


# -- language model ---------------------------------------------------------------------------


def test_unigram_score_and_model(table):
    rng = random.Random(8)
    word = lambda: rng.choice(["an", "der", "on"]) * rng.randint(1, 3)
    rows = odd_rows() + [(100 + i, " ".join(word() for _ in range(rng.randint(1, 60)))) for i in range(80)]
    df = table(rows)
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 1
    got = {r.doc_id: r for r in lm.score_texts(df, ~held).collect()}
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    tokens = {i: [w for w in re.split(r"[\x20\x09-\x0d]+", (t or "").translate(lower)) if w] + ["\n"] for i, t in rows}
    counts = Counter(w for i, ws in tokens.items() if not got[i].held_out for w in ws)
    n, v = sum(counts.values()), len(counts)
    for i, ws in tokens.items():
        assert got[i].n_tokens == len(ws) and got[i].train_tokens == n and got[i].n_known == sum(counts[w] > 0 for w in ws)
        assert math.isclose(got[i].base_score, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert got[i].score < 0 and math.isclose(got[i].perplexity, 10 ** (-got[i].score / len(ws)), rel_tol=1e-9)
    again = {r.doc_id: r.score for r in lm.score_texts(df, ~held).collect()}
    assert all(math.isclose(again[i], r.score, rel_tol=1e-9) for i, r in got.items())  # a second run draws the same


def test_order_of_words_counts(table):
    rng = random.Random(10)
    pairs = [(f"first{k}", f"second{k}") for k in range(40)]
    rows = [(2 * i, " ".join(w for pair in rng.sample(pairs, 15) for w in pair)) for i in range(60)]
    tested = [" ".join(w for pair in rng.sample(pairs, 15) for w in pair) for _ in range(5)]
    rows += [(1001 + 4 * i, text) for i, text in enumerate(tested)]
    rows += [(1003 + 4 * i, " ".join(rng.sample(text.split(), 30))) for i, text in enumerate(tested)]
    got = {r.doc_id: r for r in lm.score_texts(table(rows), F.col("doc_id") % 2 == 0).collect()}
    for i in range(len(tested)):
        kept, shuffled = got[1001 + 4 * i], got[1003 + 4 * i]
        assert kept.held_out and math.isclose(kept.base_score, shuffled.base_score, rel_tol=1e-9)
        assert kept.perplexity < 0.6 * shuffled.perplexity


def test_contexts_are_averaged_over_several_draws(table):
    rng = random.Random(11)
    rows = [(i, " ".join([f"w{rng.randint(0, 15)}" for _ in range(30)] + [f"only{i}"])) for i in range(60)]
    pairs = lm.train_contexts(table(rows))[0][2].collect()
    discount = next(1 - r.p for r in pairs if r.c == 1)
    tables = [(r.c - r.p) / discount for r in pairs if r.c > 2]
    assert all(1 <= round(t, 6) <= r.c for t, r in zip(tables, [r for r in pairs if r.c > 2]))
    assert any(abs(t - round(t)) > 0.1 for t in tables)  # one draw gives whole tables only


def test_spelling_is_a_distribution():
    rng = random.Random(9)
    words = pa.array(["".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(300)])
    codes, owner = lm._triples(words)
    import numpy as np

    found, n = np.unique(codes, return_counts=True)
    speller = lm.spell(found, n.astype(float), 1)
    assert np.allclose(speller.table.sum(1), 1)
    assert (speller.table > 0).all()


def test_no_training_texts(table):
    out = lm.score_texts(table([(1, "a b"), (2, None)]), F.lit(False)).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score < 0 for r in out)


def test_frequent_words_and_joined_words_score_alike(table, monkeypatch):
    rows = [(i, "the cat sat on the mat " * (i % 3 + 1) + f"word{i}") for i in range(30)]
    score = lambda: {r.doc_id: (r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lm.score_texts(table(rows), F.col("doc_id") % 2 == 0).collect()}
    whole = score()
    monkeypatch.setattr(lm.frequent, "__defaults__", (0,))
    assert score() == whole


def test_passes_score_alike_and_leave_only_scores(table, monkeypatch):
    import os
    import pickle

    rows = [(i, " ".join(f"w{i * k % 13}" for k in range(1, 20)) + f" only{i}") for i in range(40)]
    kept, keep = [], lm.keep
    monkeypatch.setattr(lm, "keep", lambda df, *more: kept.append(keep(df, *more)) or kept[-1])
    score = lambda: {r.doc_id: (r.n_tokens, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in lm.score_texts(table(rows), F.col("doc_id") % 4 > 0).collect()}
    monkeypatch.setattr(lm.frequent, "__defaults__", (5,))  # most is looked up
    whole = score()
    folders = {file.rsplit("/", 1)[0].removeprefix("file:") for df in kept for file in df.inputFiles()}
    assert len(whole) == 40 and {os.path.basename(x).split("-")[0] for x in folders if os.path.exists(x) and any(f.endswith(".parquet") for f in os.listdir(x))} == {"scores"}
    monkeypatch.setattr(lm, "PASS_BYTES", 1_000)
    monkeypatch.setattr(lm, "LEAST_DEALS", 3)
    assert score() == whole
    speller = lm.spell(lm._triples(pa.array(["ab", "abc", "b"]))[0], lm.np.ones(9), 1)
    again = pickle.loads(pickle.dumps(speller))
    assert (again.table == speller.table).all() and (again.row == speller.row).all() and len(pickle.dumps(speller)) < speller.table.nbytes + speller.row.nbytes
