"""Words of a batch of texts as one sequence of numbers."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import numpy as np


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space (bytes split at space, tab to carriage return, and nothing else)."""
    return text.encode().split() if isinstance(text, str) else []


def word_numbers(texts: Iterable[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """``(numbers, edges)``: equal words have equal numbers, text ``i`` is ``numbers[edges[i]:edges[i + 1]]``."""
    seen: defaultdict[bytes, int] = defaultdict()
    seen.default_factory = seen.__len__
    parts = [np.fromiter(map(seen.__getitem__, ws), np.int64, len(ws)) for ws in texts]
    edges = np.concatenate(([0], np.cumsum([len(p) for p in parts], dtype=np.int64)))
    return (np.concatenate(parts) if parts else np.zeros(0, np.int64)), edges


def pair_numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs ``(a[i], b[i])`` of non-negative numbers (exact, not hashed)."""
    if not len(a):
        return np.zeros(0, np.int64)
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)
