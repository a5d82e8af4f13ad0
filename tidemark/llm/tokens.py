"""Tokens of a text column as one Arrow array: maximal runs of bytes outside a set of separators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.llm.batches import LOWER, text_bytes


def byte_set(*codes: int) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


class Tokens:
    """Tokens of a batch of texts with A-Z lowered; null counts as an empty text.

    strings: the tokens in order; starts: their first bytes; bounds: tokens of text i are
    bounds[i]:bounds[i + 1].
    """

    def __init__(self, column: pa.Array, separators: np.ndarray) -> None:
        self.data, self.offsets = text_bytes(column)
        data = LOWER[self.data]
        solid = ~separators[data]
        first, last = solid.copy(), solid.copy()
        first[1:] &= ~solid[:-1]
        last[:-1] &= ~solid[1:]
        inner = self.offsets[(self.offsets > 0) & (self.offsets < len(data))]  # texts may touch
        first[inner] = solid[inner]
        last[inner - 1] = solid[inner - 1]
        self.starts = np.flatnonzero(first)
        ends = np.concatenate([[0], np.cumsum(np.flatnonzero(last) + 1 - self.starts)]).astype(np.int64)
        self.strings = pa.LargeStringArray.from_buffers(len(self.starts), pa.py_buffer(ends), pa.py_buffer(data[solid]))
        self.bounds = np.searchsorted(self.starts, self.offsets)
        self.counts = np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)
