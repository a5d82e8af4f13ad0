"""Language identification of mixed texts: script ranges, per-word scores and a Viterbi over languages.

A word (run of letters) first meets the script ranges: only languages that write in its script stay
candidates. Its score per language is the summed log likelihood of its letter pairs and triples.
A Viterbi with a penalty for every switch then labels spans; the language with most letters is the
text's, its share of the letters the score. Counts come from all labelled texts given, by Spark.

Texts without letters (also empty and null ones) are `und` with score 0, as is everything when no
labelled text is given. Of languages with equally many letters the alphabetically first wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import LOWER, carrying, pieces, text_bytes

PAIRS, TRIPLES = 1 << 16, 1 << 17
#: Bytes of text in one numpy pass; a byte needs about 150 bytes of arrays.
PIECE = 500_000
#: Cost of changing the language between two words, and the most that one word may say.
SWITCH, WORD_LIMIT = 9.0, 6.0
#: Share of a language's words that makes a script one of its own.
SCRIPT_SHARE = 0.01

# Lead byte of UTF-8 (and second byte where one lead has several scripts) -> script.
SCRIPTS = ("latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "georgian", "kana", "han", "hangul", "other")
_LEADS = {"latin": (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)), "greek": (0xCD, 0xCE, 0xCF), "cyrillic": tuple(range(0xD0, 0xD5)), "armenian": (0xD5,), "hebrew": (0xD6, 0xD7), "arabic": tuple(range(0xD8, 0xDC)), "han": tuple(range(0xE4, 0xEA)), "hangul": (0xEA, 0xEB, 0xEC, 0xED)}
_SCRIPT = np.full((256, 256), SCRIPTS.index("other"), np.int8)
for _name, _bytes in _LEADS.items():
    _SCRIPT[list(_bytes)] = SCRIPTS.index(_name)
_SCRIPT[0xE0] = SCRIPTS.index("indic")
_SCRIPT[0xE0, 0xB8:0xBA] = SCRIPTS.index("thai")
_SCRIPT[0xE1, 0x82:0x84] = SCRIPTS.index("georgian")
_SCRIPT[0xE1, 0xB8:0xBC] = SCRIPTS.index("latin")
_SCRIPT[0xE1, 0xBC:0xC0] = SCRIPTS.index("greek")
_SCRIPT[0xE3, 0x81:0x84] = SCRIPTS.index("kana")

_LETTER = np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@dataclass
class Runs:
    """Letter runs of a batch: text number, bytes, script, and the features of every letter byte."""

    text: np.ndarray
    size: np.ndarray
    start: np.ndarray
    script: np.ndarray
    pair: np.ndarray
    triple: np.ndarray
    first: np.ndarray


def letter_runs(column: pa.Array) -> Runs:
    data, offsets = text_bytes(column)
    low = LOWER[data]
    after_c3 = np.zeros(len(data), bool)
    after_c3[1:] = data[:-1] == 0xC3
    low = np.where(after_c3 & (data >= 0x80) & (data <= 0x9E), data + 0x20, low).astype(np.int64)  # capital accents
    letter = _LETTER[data]
    head = letter.copy()
    head[1:] &= ~letter[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    head[inner] = letter[inner]
    at = np.flatnonzero(letter)
    heads = np.flatnonzero(head[at])
    joined = np.zeros(len(at), bool)
    joined[1:] = ~head[at[1:]]
    now = low[at]
    before = np.where(joined, np.concatenate([[0], now[:-1]]), 0) if len(at) else now
    after = np.where(np.concatenate([joined[1:], [False]]), np.concatenate([now[1:], [0]]), 0) if len(at) else now
    start = at[heads]
    nxt = data[np.minimum(start + 1, len(data) - 1)] if len(start) else start
    triple = ((before * 256 + now) * 256 + after) * 0x9E3779B1 >> 13 & (TRIPLES - 1)
    return Runs(np.searchsorted(offsets, start, side="right") - 1, np.diff(np.append(heads, len(at))), start, _SCRIPT[data[start], nxt] if len(start) else np.zeros(0, np.int8), before * 256 + now, triple, heads)


def ascii_letters(column: pa.Array) -> np.ndarray:
    """Whether a text has a letter A-Z or a-z."""
    data, offsets = text_bytes(column)
    sums = np.concatenate([[0], np.cumsum(_LETTER[data] & (data < 0x80), dtype=np.int64)])
    return sums[offsets[1:]] > sums[offsets[:-1]]


class Model:
    """Log likelihoods of features per language, centred over the languages."""

    def __init__(self, languages: list[str], counts: np.ndarray) -> None:
        """counts: languages x (pairs + triples + scripts)."""
        self.languages = languages
        parts = counts[:, :PAIRS], counts[:, PAIRS : PAIRS + TRIPLES]
        logs = [np.log((c + 0.5) / (c.sum(1, keepdims=True) + 0.5 * c.shape[1])) for c in parts]
        self.pair, self.triple = [np.ascontiguousarray((x - x.mean(0)).T.astype(np.float32)) for x in logs] if languages else (None, None)
        scripts = counts[:, PAIRS + TRIPLES :]
        self.writes = (scripts >= SCRIPT_SHARE * np.maximum(1, scripts.sum(1, keepdims=True))).T  # script x language
        self.writes[~self.writes.any(1)] = True  # a script nobody writes narrows nothing

    def word_scores(self, runs: Runs) -> np.ndarray:
        if not len(runs.first):
            return np.zeros((0, len(self.languages)), np.float32)
        score = np.add.reduceat(self.pair[runs.pair] + self.triple[runs.triple], runs.first, axis=0)
        score = np.clip(score - score.max(1, keepdims=True), -WORD_LIMIT, 0)
        return np.where(self.writes[runs.script], score, np.float32(-2 * WORD_LIMIT))

    def label(self, runs: Runs, n_texts: int, switch: float = SWITCH) -> np.ndarray:
        """Best language number of every word."""
        score = self.word_scores(runs).astype(np.float64)
        out = np.zeros(len(score), np.int64)
        bounds = np.searchsorted(runs.text, np.arange(n_texts + 1))
        full = np.flatnonzero(np.diff(bounds))
        if not len(full):
            return out
        total = np.add.reduceat(score, bounds[full], axis=0)
        best = total.argmax(1)
        counts = np.diff(bounds)[full]
        out[:] = np.repeat(best, counts)
        # One language is best for the whole text if no other one gains more than a switch in any stretch, and the
        # best start and the best end in other languages together gain no more than a switch. Paths that use the
        # language have as many switches as stretches in others; those that never do have one fewer, so their first
        # and last stretch share one (a path of a single other language has no better total).
        number = np.repeat(np.arange(len(full)), counts)
        own = score[np.arange(len(score)), out]
        mixed = np.zeros(len(full), bool)
        head, tail = np.zeros(len(full)), np.zeros(len(full))
        for k in range(len(self.languages)):
            gain = score[:, k] - own
            run = np.cumsum(gain)
            drop = number * (4 * WORD_LIMIT * (counts.max() + 1))  # texts never see each other's minimum
            low = np.minimum.accumulate(run - gain - drop) if len(run) else run
            mixed |= np.maximum.reduceat(run - drop - low, bounds[full]) > switch
            before = run - gain
            head = np.maximum(head, np.maximum.reduceat(run, bounds[full]) - before[bounds[full]])
            tail = np.maximum(tail, run[bounds[full] + counts - 1] - np.minimum.reduceat(before, bounds[full]))
        mixed |= head + tail > switch
        hard = np.flatnonzero(mixed)
        if len(hard):
            self._viterbi(score, out, bounds[full[hard]], counts[hard], switch)
        return out

    def _viterbi(self, score: np.ndarray, out: np.ndarray, starts: np.ndarray, counts: np.ndarray, switch: float) -> None:
        """Many texts at once, the longest first."""
        order = np.argsort(-counts, kind="stable")
        starts, counts = starts[order], counts[order]
        value = score[starts].copy()
        origin = np.zeros(score.shape, np.int8)
        final = value.copy()
        same = np.arange(score.shape[1])
        for t in range(1, int(counts[0])):
            live = int(np.searchsorted(-counts, -t, side="left"))
            top = value[:live].argmax(1)
            jump = value[np.arange(live), top] - switch
            stay = value[:live] >= jump[:, None]
            value[:live] = np.where(stay, value[:live], jump[:, None]) + score[starts[:live] + t]
            origin[starts[:live] + t] = np.where(stay, same, top[:, None])
            final[:live] = value[:live]
        at = final.argmax(1)
        for t in range(int(counts[0]) - 1, -1, -1):
            live = int(np.searchsorted(-counts, -t, side="left"))
            out[starts[:live] + t] = at[:live]
            if t:
                at[:live] = origin[starts[:live] + t, at[:live]]


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Feature counts of all rows with a language; rows come back summed, at most one per language and feature."""
    rows = df.filter(F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    size = PAIRS + TRIPLES + len(SCRIPTS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                langs = np.array(piece.column("lang").to_pylist(), object)
                runs = letter_runs(piece.column("text"))
                of_run = langs[runs.text] if len(runs.text) else np.zeros(0, object)
                of_byte = np.repeat(of_run, runs.size)
                for lang in dict.fromkeys(langs.tolist()):
                    mine, words = of_byte == lang, of_run == lang
                    total = sums.setdefault(lang, np.zeros(size, np.int64))
                    total[:PAIRS] += np.bincount(runs.pair[mine], minlength=PAIRS)
                    total[PAIRS : PAIRS + TRIPLES] += np.bincount(runs.triple[mine], minlength=TRIPLES)
                    total[PAIRS + TRIPLES :] += np.bincount(runs.script[words], minlength=len(SCRIPTS))
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["lang", "feature", "n"])

    found = rows.mapInArrow(count, "lang string, feature bigint, n bigint").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique().tolist())
    counts = np.zeros((len(languages), size))
    counts[np.searchsorted(np.array(languages, object), found["lang"].to_numpy()), found["feature"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    return Model(languages, counts)


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_spans: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Language of every text.

    Output: the id, lang_pred, score (share of letters), n_langs and, with `with_spans`, spans
    (array of language and number of words, in order). `carry` names columns to pass on.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, lang_pred string, score double, n_langs int" + ", spans array<struct<lang: string, words: int>>" * with_spans
    named, more = carrying(df, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned = sent.value
        width = len(learned.languages)
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                n = piece.num_rows
                runs = letter_runs(piece.column("text"))
                names, scores, many = ["und"] * n, np.zeros(n), np.zeros(n, np.int32)
                spans: list[list] = [[] for _ in range(n)]
                if width and len(runs.text):
                    label = learned.label(runs, n)
                    letters = np.bincount(runs.text * width + label, runs.size, n * width).reshape(n, width)
                    total, top = letters.sum(1), letters.argmax(1)
                    many = (letters > 0).sum(1).astype(np.int32)
                    scores = np.where(total > 0, letters[np.arange(n), top] / np.maximum(total, 1), 0.0)
                    names = [learned.languages[k] if t else "und" for k, t in zip(top.tolist(), total.tolist())]
                    for i in np.flatnonzero((total > 0) & ~ascii_letters(piece.column("text"))).tolist():  # bytes above ASCII may be no letters
                        if not any(c.isalpha() for c in piece.column("text")[i].as_py()):
                            names[i], scores[i], many[i] = "und", 0.0, 0
                    if with_spans:
                        cut = np.flatnonzero(np.concatenate([[True], (label[1:] != label[:-1]) | (runs.text[1:] != runs.text[:-1])]))
                        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(label)]):
                            spans[runs.text[a]].append({"lang": learned.languages[label[a]], "words": b - a})
                columns = [piece.column("id"), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(many, pa.int32())]
                if with_spans:
                    columns.append(pa.array(spans, pa.list_(pa.struct([("lang", pa.string()), ("words", pa.int32())]))))
                columns += [piece.column(f"c{i}") for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "lang_pred", "score", "n_langs", *["spans"] * with_spans, *carry])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *named).mapInArrow(run, schema + more)
