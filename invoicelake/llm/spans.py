"""Spans of bytes in many texts at once: word borders for any set of word bytes, and hashes in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from invoicelake.llm.words import run_hashes

BLOCK = 4 << 20


def byte_set(*parts: int | tuple[int, int]) -> np.ndarray:
    """A table of 256 booleans: the given bytes, and ranges of bytes with both ends."""
    table = np.zeros(256, bool)
    for part in parts:
        low, high = part if isinstance(part, tuple) else (part, part)
        table[low:high + 1] = True
    return table


def word_borders(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every longest run of bytes that the table `inside` holds."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside[data], [False]]).view(np.int8)))
    return edge[::2], edge[1::2]


def span_hashes(data: np.ndarray, table: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each span; the values of `table` are looked up for BLOCK bytes at a time, as they take eight bytes each."""
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        base = start[i]
        j = max(i + 1, int(np.searchsorted(end, base + BLOCK, "right")))
        out[i:j] = run_hashes(table[data[base:end[j - 1]]], start[i:j] - base, end[i:j] - base)
        i = j
    return out


def joined(texts: Iterable[bytes]) -> tuple[np.ndarray, bytes, np.ndarray]:
    """All texts in one buffer, each followed by a line break; the buffer as bytes; where each text begins."""
    texts = list(texts)
    buffer = b"".join(t + b"\n" for t in texts)
    sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    return np.frombuffer(buffer, np.uint8), buffer, np.concatenate([[0], np.cumsum(sizes)])[:-1]
