"""Personal data in texts: fixed patterns, and a linear-chain conditional random field that adds spans.

The field reads word shapes (letters by case, digits by length, single marks, blank before or not) of
a token and its neighbours. It is trained from a small labelled table by maximum likelihood
(forward-backward, Adam) and decoded by Viterbi over numpy batches of token windows. It finds what
the patterns miss: telephone numbers without a country sign, split or masked mail addresses, spaced
out internet addresses, card numbers with odd separators.

Only windows around tokens that can start personal data (digits, @, +, brackets, "dot") are decoded.
`Field.reach` proves from the weights how far a span can run into plain tokens, so all other tokens
have the label O on the best path of the whole text. Null texts count as empty.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.batches import carrying, pieces, text_bytes

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base spans.
MAIL_TAIL = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
NOT_MAIL_HEAD = re.compile(r"[^A-Za-z0-9._%+-]")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def is_card(text: str) -> bool:
    digits = digits_of(text)
    return CARD_DIGITS[0] <= len(digits) <= CARD_DIGITS[1] and luhn(digits)


def is_phone(text: str) -> bool:
    return PHONE_DIGITS[0] <= len(digits_of(text)) <= PHONE_DIGITS[1]


def mails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from each @ outwards, in time linear in the text."""
    free, at = 0, text.find("@")
    while at >= 0:
        stop = NOT_MAIL_HEAD.search(text[free:at][::-1])
        start = at - stop.start() if stop else free
        found = MAIL_TAIL.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        free = found.end() if found else at + 1
        at = text.find("@", free)


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Each four dot-joined numbers of a dotted run, left to right."""
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        numbers = list(re.finditer("[0-9]+", run.group()))
        for i in range(0, len(numbers) - 3, 4):
            if all(len(n.group().lstrip("0")) <= 3 and int(n.group().lstrip("0") or 0) <= 255 for n in numbers[i : i + 4]):
                yield run.start() + numbers[i].start(), run.start() + numbers[i + 3].end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The pattern spans, by kind and start."""
    out = [("email", a, b) for a, b in mails(text)]
    out += [("ip", a, b) for a, b in addresses(text)]
    out += [("card", *m.span()) for m in CARD.finditer(text) if is_card(m.group())]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if is_phone(m.group())]
    return out


# ---------------------------------------------------------------- tokens

LETTER, DIGIT, SPACE = 1, 2, 0
MARKS = "@.-+()[]_:/,;|#$%&*!?\"'="
_CLASS = np.full(256, 3 + len(MARKS), np.uint8)
_CLASS[0x80:] = LETTER
for _c in range(256):
    if chr(_c).isascii() and chr(_c).isalpha():
        _CLASS[_c] = LETTER
    elif 0x30 <= _c <= 0x39:
        _CLASS[_c] = DIGIT
    elif _c < 0x80 and chr(_c).isspace():
        _CLASS[_c] = SPACE
for _k, _m in enumerate(MARKS):
    _CLASS[ord(_m)] = 3 + _k
WORDS = ("dot", "at")
#: Shapes: 0 text border, 1-4 letters by case, 5-6 the words above, 7-14 digits by length, marks after that.
N_SHAPES = 15 + len(MARKS) + 1
_LENGTHS = np.array([0, 7, 8, 9, 10, 11, *[12] * 7, *[13] * 7, 14], np.int64)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, shapes, text numbers): runs of letters or of digits and single marks; shapes count twice, by a blank before."""
    kind = _CLASS[data]
    run = (kind == LETTER) | (kind == DIGIT)
    first = kind != SPACE
    first[1:] &= ~(run[1:] & (kind[1:] == kind[:-1]))
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    first[inner] = kind[inner] != SPACE
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, starts, starts, starts
    edge = first | (kind == SPACE)
    edge_at = np.append(np.flatnonzero(edge), len(data))
    ends = edge_at[np.searchsorted(edge_at, starts, side="right")]
    text = np.searchsorted(offsets, starts, side="right") - 1
    size, k = ends - starts, kind[starts].astype(np.int64)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    capitals, head = upper[ends] - upper[starts], (data[starts] >= 65) & (data[starts] <= 90)
    letters = np.where(capitals == 0, 1, np.where(head & (capitals == 1) & (size > 1), 2, np.where(capitals == size, 3, 4)))
    for number, word in enumerate(WORDS):
        at = np.flatnonzero((k == LETTER) & (size == len(word)))
        same = np.ones(len(at), bool)
        for j, c in enumerate(word.encode()):
            same &= (data[starts[at] + j] | 32) == c
        letters[at[same]] = 5 + number
    shape = np.where(k == LETTER, letters, np.where(k == DIGIT, _LENGTHS[np.minimum(size, 19 + 1)], 15 + k - 3))
    blank = np.zeros(len(starts), np.int64)
    blank[1:] = (starts[1:] > ends[:-1]) | (text[1:] != text[:-1])
    blank[0] = 1
    return starts, ends, shape * 2 + blank, text


ROOTS = np.zeros(2 * N_SHAPES, bool)
for _s in (5, *range(7, 15), *(15 + MARKS.index(m) for m in "@+([")):
    ROOTS[2 * _s : 2 * _s + 2] = True

LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))


class Field:
    """Weights of the conditional random field and its Viterbi decoder."""

    def __init__(self, around: np.ndarray, left: np.ndarray, right: np.ndarray, step: np.ndarray) -> None:
        self.around, self.left, self.right, self.step = around, left, right, step

    def unary(self, shape: np.ndarray, before: np.ndarray, after: np.ndarray) -> np.ndarray:
        return self.around[shape] + self.left[before, shape] + self.right[shape, after]

    @property
    def reach(self) -> int:
        """Tokens that a best span can run into plain tokens, counted from the last root token.

        Every edge between plain tokens is scored relative to leaving both O. The best relative score
        of an excursion of n plain tokens is carried on edge by edge (max-plus); once it is negative,
        and stays so for 200 tokens, such an excursion is never part of a best path.
        """
        plain, root = np.flatnonzero(~ROOTS), np.flatnonzero(ROOTS)
        n, k = len(plain), len(self.step) - 1
        node = (self.around[plain, 1:] - self.around[plain, :1]).ravel()
        relative = lambda w: w[..., 1:] - w[..., :1]
        left, right = relative(self.left), relative(self.right)
        step = self.step[1:, 1:] - self.step[0, 0]
        edge = right[np.ix_(plain, plain)][:, :, :, None] + left[np.ix_(plain, plain)][:, :, None, :] + step  # s, s', l, l'
        edge = edge.transpose(0, 2, 1, 3).reshape(n * k, n * k) + node
        enter = (self.step - self.step[:, :1]).max(0)[1:]
        leave = (self.step - self.step[:1]).max(1)[1:]
        border_in = (left[np.ix_(root, plain)].max(0) + enter).ravel() + node
        border_out = (right[np.ix_(plain, root)].max(1) + leave).ravel()
        from_o = (left[np.ix_(plain, plain)].max(0) + self.step[0, 1:] - self.step[0, 0]).ravel() + node
        to_o = (np.maximum(right[plain].max(1), 0) + self.step[1:, 0] - self.step[0, 0]).ravel()
        reach = 0
        for start, end in ((border_in, to_o), (from_o, border_out), (from_o, to_o)):
            score, last = start, 0
            for length in range(1, 201):
                if (score + end).max() >= 0:
                    last = length
                score = (score[:, None] + edge).max(0)
            if last == 200 or (end is to_o and start is from_o and last):
                return 10**9
            reach = max(reach, last)
        return reach + 2

    def decode(self, unary: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best labels of many windows, unary: windows x positions x labels, longest first."""
        n, size, k = unary.shape
        back = np.zeros((n, size, k), np.int8)
        score = unary[:, 0].copy()
        last = score.copy()
        for t in range(1, size):
            live = int(np.searchsorted(-lengths, -t, side="left"))  # windows longer than t
            paths = score[:live, :, None] + self.step[None]
            back[:live, t] = paths.argmax(1)
            score[:live] = paths.max(1) + unary[:live, t]
            last[:live] = score[:live]
        out = np.zeros((n, size), np.int8)
        at = last.argmax(1)
        rows = np.arange(n)
        for t in range(size - 1, -1, -1):
            here = t < lengths
            out[here, t] = at[here]
            if t:
                at = np.where(here, back[rows, t, at], at)
        return out


# ---------------------------------------------------------------- training

#: Rows of the labelled table, its seed, and the passes over it.
TRAINING_ROWS, TRAINING_SEED, EPOCHS, L2 = 500, 11, 90, 1e-3
#: Plain tokens next to a root token that a span may take in.
REACH = 60


def labelled_table(rows: int = TRAINING_ROWS, seed: int = TRAINING_SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small table of (text, spans): filled-in sentences with and without personal data."""
    rng = random.Random(seed)
    syllables = ("an", "der", "la", "que", "ti", "on", "sch", "ment", "re", "ou", "é", "ing", "os", "ci")
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    octet = lambda: str(rng.randint(1, 254))

    def card() -> str:
        body = rng.choice("45") + number(14)
        return body + next(c for c in "0123456789" if luhn(body + c))

    def grouped(text: str, mark: str) -> str:
        return mark.join(text[i : i + 4] for i in range(0, len(text), 4))

    mail = lambda at, dot: f"{word()}{rng.choice(('', '.', '_'))}{number(rng.randint(0, 2))}{at}{word()}{rng.choice(('', number(1)))}{dot}{rng.choice(('com', 'org', 'net', 'de'))}"
    makers = {
        "email": [lambda: f"{word()}.{number(2)}@mail{number(1)}.example.com", lambda: mail("@", "."), lambda: mail(" (at) ", " dot "), lambda: mail(" [at] ", " [dot] "), lambda: mail("@", " dot "), lambda: mail(" @ ", "."), lambda: mail(" [at] ", ".")],
        "ip": [lambda: ".".join(octet() for _ in range(4)), lambda: ".".join(octet() for _ in range(4)), lambda: " . ".join(octet() for _ in range(4)), lambda: " dot ".join(octet() for _ in range(4)), lambda: "[.]".join(octet() for _ in range(4))],
        "card": [card, card, lambda: grouped(card(), " "), lambda: grouped(card(), "-"), lambda: grouped(card(), "."), lambda: grouped(card(), " - ")],
        "phone": [lambda: f"+1 ({number(3)}) 555-{number(4)}", lambda: f"+49 {number(3)} {number(7)}", lambda: f"({number(3)}) 555-{number(4)}", lambda: f"{number(3)}-{number(3)}-{number(4)}", lambda: f"+ {number(2)} {number(3)} {number(4)} {number(2)}", lambda: f"+1.{number(3)}.{number(3)}.{number(4)}"],
    }
    clean = [lambda: f"{rng.randint(1990, 2030)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}", lambda: f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}", lambda: number(rng.randint(1, 8)), lambda: f"{rng.randint(10, 23)}:{rng.randint(10, 59)}", lambda: f"${number(2)}.{number(2)}", lambda: f"({word()})", lambda: f"[{number(1)}]", lambda: f"{word()} dot {word()}", lambda: f"{word()}+{word()}", lambda: f"@{word()}", lambda: f"{number(2)}%", lambda: f"No. {number(5)}", lambda: f"{word()} at {word()}", lambda: f"token=\"{number(3)}{word()}{number(2)}{word()}\"", lambda: f"password={word()}{number(3)}{word()}{number(2)}", lambda: f"AKIA{number(2)}AB{number(1)}X", lambda: f"{word()}### {word()}*** {word()}&&&", lambda: f"{word()} | {word()} |"]
    table = []
    for row in range(rows):
        text, spans = "", []
        for part in range(rng.randint(1, 3)):
            text += " ".join(rng.choice((word(), word(), word(), word().capitalize(), word().upper() + "!!", word() + ",")) for _ in range(rng.randint(0, 6)))
            text += rng.choice((". ", " ", ": ", "\n")) if text else ""
            if rng.random() < 0.55:
                kind = rng.choice(KINDS)
                value = rng.choice(makers[kind])()
                spans.append((kind, len(text), len(text) + len(value)))
            else:
                value = rng.choice(clean)()
            text += value + rng.choice((" ", ", ", ". ", "", "\n", " and "))
            if text[-1].isalnum():
                text += " "
        table.append((text + word() + rng.choice(("", ".", " ")), spans))
    return table


def _encode(table: list[tuple[str, list[tuple[str, int, int]]]]) -> tuple[np.ndarray, ...]:
    """Padded shapes, neighbours and labels of the labelled table."""
    rows = []
    for text, spans in table:
        data, offsets = text_bytes(pa.array([text]))
        starts, ends, shape, _ = tokens(data, offsets)
        place = np.cumsum((data & 0xC0) != 0x80) - 1  # byte -> code point
        label = np.zeros(len(starts), np.int64)
        for kind, a, b in spans:
            inside = np.flatnonzero((place[starts] >= a) & (place[starts] < b))
            label[inside] = 2 + 2 * KINDS.index(kind)
            label[inside[:1]] -= 1
        rows.append((shape, np.concatenate([[1], shape[:-1]]), np.concatenate([shape[1:], [1]]), label))
    size = max(len(r[0]) for r in rows)
    out = [np.zeros((len(rows), size), np.int64) for _ in range(4)]
    mask = np.zeros((len(rows), size), bool)
    for i, r in enumerate(rows):
        for k in range(4):
            out[k][i, : len(r[k])] = r[k]
        mask[i, : len(r[0])] = True
    return *out, mask


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def fit(table: list[tuple[str, list[tuple[str, int, int]]]], epochs: int = EPOCHS, l2: float = L2) -> Field:
    """Maximum likelihood with a quadratic penalty, over the whole (small) table."""
    shape, before, after, label, mask = _encode(table)
    n, size = shape.shape
    k, s = len(LABELS), 2 * N_SHAPES
    weights = [np.zeros((s, k)), np.zeros((s, s, k)), np.zeros((s, s, k)), np.zeros((k, k))]
    moments = [[np.zeros_like(w), np.zeros_like(w)] for w in weights]
    hit = np.eye(k)[label] * mask[..., None]
    pairs = mask[:, 1:]
    for epoch in range(1, epochs + 1):
        around, left, right, step = weights
        unary = around[shape] + left[before, shape] + right[shape, after]
        alpha, beta = np.zeros((n, size, k)), np.zeros((n, size, k))
        alpha[:, 0] = unary[:, 0]
        for t in range(1, size):
            new = _log_sum(alpha[:, t - 1, :, None] + step, 1) + unary[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        total = _log_sum(alpha[:, -1], 1)
        for t in range(size - 2, -1, -1):
            new = _log_sum(step + (unary[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        expected = np.exp(alpha + beta - total[:, None, None]) * mask[..., None]
        error = (expected - hit) / n
        both = np.exp(alpha[:, :-1, :, None] + step + (unary + beta)[:, 1:, None, :] - total[:, None, None, None]) * pairs[..., None, None]
        gradient = [np.zeros_like(w) for w in weights]
        for w, at in ((0, shape), (1, before * s + shape), (2, shape * s + after)):
            for c in range(k):
                gradient[w].reshape(-1, k)[:, c] = np.bincount(at.ravel(), error[..., c].ravel(), gradient[w].size // k)
        np.add.at(gradient[3], (label[:, :-1][pairs], label[:, 1:][pairs]), -1.0 / n)
        gradient[3] += both.sum((0, 1)) / n
        for w, g, (m, v) in zip(weights, gradient, moments, strict=True):
            g += l2 * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= 0.15 * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    # plain words side by side count as clean text, just as much as keeps spans within REACH of a root token
    plain = ~ROOTS
    weights[0][plain & (np.abs(weights[0]).sum(1) < 0.05), 0] += 4.0
    field = Field(*weights)
    while field.reach > REACH:
        for w in weights[1:3]:
            w[..., 0] += 0.5 * (plain[:, None] & plain[None, :])
    return field


@lru_cache(maxsize=1)
def default_field() -> Field:
    return fit(labelled_table())


# ---------------------------------------------------------------- decoding


def field_spans(field: Field, reach: int, column: pa.Array) -> list[list[tuple[str, int, int]]]:
    """Spans of the field per text, in code points."""
    data, offsets = text_bytes(column)
    starts, ends, shape, text = tokens(data, offsets)
    out: list[list[tuple[str, int, int]]] = [[] for _ in range(len(column))]
    if not len(starts):
        return out
    root = np.flatnonzero(ROOTS[shape])
    if not len(root):
        return out
    first = np.searchsorted(text, np.arange(len(column)))  # token range of every text
    bound = np.append(first, len(text))
    low, high = np.maximum(root - reach, bound[text[root]]), np.minimum(root + reach + 1, bound[text[root] + 1])
    new = np.ones(len(root), bool)
    new[1:] = (low[1:] > high[:-1]) | (text[root[1:]] != text[root[:-1]])
    begin = low[new]
    end = high[np.append(np.flatnonzero(new)[1:] - 1, len(root) - 1)]
    before, after = np.concatenate([[1], shape[:-1]]), np.concatenate([shape[1:], [1]])
    before[first[first < len(shape)]] = 1
    last = bound[1:][bound[1:] > 0] - 1
    after[last] = 1
    order = np.argsort(begin - end, kind="stable")
    begin, end = begin[order], end[order]
    labels = np.zeros(len(starts), np.int8)
    at = 0
    while at < len(begin):
        longest = int(end[at] - begin[at])
        take = slice(at, at + max(1, 200_000 // longest))
        at = take.stop
        size = end[take] - begin[take]
        where = np.minimum(begin[take, None] + np.arange(longest), len(starts) - 1)
        best = field.decode(field.unary(shape[where], before[where], after[where]), size)
        inside = np.arange(longest) < size[:, None]
        labels[where[inside]] = best[inside]
    hit = np.flatnonzero(labels)
    kind = (labels[hit] + 1) // 2
    opens = (labels[hit] % 2 == 1) | np.concatenate([[True], (hit[1:] != hit[:-1] + 1) | (kind[1:] != kind[:-1]) | (text[hit[1:]] != text[hit[:-1]])])
    heads = np.flatnonzero(opens)
    tails = np.append(heads[1:], len(hit)) - 1
    for a, b in zip(heads.tolist(), tails.tolist()):
        i = int(text[hit[a]])
        lo, hi = int(starts[hit[a]]), int(ends[hit[b]])
        points = lambda x, o=offsets[i]: int(np.count_nonzero((data[o:x] & 0xC0) != 0x80))
        out[i].append((KINDS[kind[a] - 1], points(lo), points(hi)))
    return out


def plausible(kind: str, value: str) -> bool:
    """What a span of the field must hold: the counts and sums that its kind always has."""
    if kind == "card":
        return is_card(value)
    if kind == "phone":
        return is_phone(value) and not any(c.isalpha() for c in value)
    if kind == "ip":
        parts = re.findall("[0-9]+", value)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    words = re.findall(r"[^\W_]+", value)
    return len(words) >= 3 and ("@" in value or re.search(r"[(\[]\s*at\s*[)\]]", value, re.I) is not None)


def all_spans(text: str, base: list[tuple[str, int, int]], found: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans and the field's spans that overlap none of them, by kind and start."""
    taken = sorted((a, b) for _, a, b in base)
    out = list(base)
    for kind, a, b in found:
        if plausible(kind, text[a:b]) and not any(x < b and a < y for x, y in taken):
            out.append((kind, a, b))
            taken.append((a, b))
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """`text` with every span replaced by its kind; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def find_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False, field: Field | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Personal data of every text.

    Output: the id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans ("kind:start:end"
    joined by commas, base and field together, code points), n_spans and, with `with_text`, masked. `carry` names columns to pass on.
    """
    model = df.sparkSession.sparkContext.broadcast(field or default_field())
    reach = model.value.reach
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint" + ", masked string" * with_text
    named, more = carrying(df, carry)
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                rows = []
                for text, found in zip(texts, field_spans(model.value, reach, piece.column("text")), strict=True):
                    base = base_spans(text)
                    spans = all_spans(text, base, found) if found else base
                    counts = [sum(s[0] == k for s in base) for k in KINDS]
                    rows.append([*counts, hashlib.sha256(line(base).encode()).hexdigest(), line(spans), len(spans)] + ([masked(text, spans)] if with_text else []))
                columns = list(zip(*rows, strict=True))
                types = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.int64()] + [pa.string()] * with_text
                arrays = [piece.column("id")] + [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
                arrays += [piece.column(f"c{i}") for i in range(len(carry))]
                yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans", *["masked"] * with_text, *carry])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *named).mapInArrow(run, schema + more)
