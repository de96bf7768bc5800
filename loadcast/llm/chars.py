"""Texts of a batch as arrays of code points."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Characters that are worked on together; a longer text is a chunk of its own.
CHUNK_CHARS = 1 << 18


@lru_cache(1)
def letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def chunks(texts: Sequence[str | None], lower: bool = True) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, code points, starts): texts, lower-cased if asked for, one behind the other, a zero after each.

    ``starts`` has one more entry than texts. Null texts count as empty.
    """
    first, size, held = 0, 0, []
    for i, text in enumerate(texts):
        low = (text or "").lower() if lower else text or ""
        held.append(low)
        size += len(low) + 1
        if size >= CHUNK_CHARS or i + 1 == len(texts):
            joined = "\0".join(held) + "\0"
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
            starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in held])])
            yield first, i + 1, points, starts
            first, size, held = i + 1, 0, []
