"""Encoding of text blocks through a table of distinct chunks.

A chunk runs from a space before a non-space up to the next such space. Byte-level pre-tokenization
always starts a new piece there, so a chunk's ids do not depend on its neighbours: each distinct chunk
is encoded once, and a text is the concatenation of its chunks' ids. The table lives as long as the
Python worker and is emptied when it holds more than `limit` chunks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np

#: A space at which splitting at every space would not give chunks.
_UNEVEN = re.compile(r" (?:\s|\Z)")
_AT_SPACE = re.compile(r" (?=\S)")


class _Codes(dict):
    """Numbers keys in the order they come; `fresh` lists those not yet encoded."""

    def __init__(self, owner: ChunkTable, lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, key: str) -> int:
        code = self[key] = self.owner.known + len(self.owner.fresh)
        self.owner.fresh.append(self.lead + key)
        return code


class ChunkTable:
    """encode: list of distinct chunk strings -> (ids, ends), ids of all of them and where each ends."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 300_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.known, self.fresh = 0, []
        self.first, self.later = _Codes(self, ""), _Codes(self, " ")
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _learn(self) -> None:
        if self.fresh:
            ids, ends = self.encode(self.fresh)
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            self.ends = np.concatenate([self.ends, ends + self.ends[-1]])
            self.known += len(self.fresh)
            self.fresh = []

    def __call__(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and for each text where its ids end. Null counts as empty."""
        if self.known > self.limit:
            self.clear()
        parts, counts = [], []
        for text in texts:
            if not text:
                counts.append(0)
                continue
            pieces = _AT_SPACE.split(text) if _UNEVEN.search(text) else text.split(" ")
            codes = np.empty(len(pieces), np.int32)
            codes[0] = self.first[pieces[0]]
            codes[1:] = np.fromiter(map(self.later.__getitem__, pieces[1:]), np.int32, len(pieces) - 1)
            parts.append(codes)
            counts.append(len(pieces))
        self._learn()
        codes = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        lengths = self.ends[codes + 1] - self.ends[codes]
        out_ends = np.cumsum(lengths)
        total = int(out_ends[-1]) if len(out_ends) else 0
        index = np.arange(total, dtype=np.int32)
        index += np.repeat((self.ends[codes] - (out_ends - lengths)).astype(np.int32), lengths)
        ends = np.concatenate([[0], out_ends])[np.cumsum(np.array(counts, np.int64))]
        return self.ids[index], ends


def blocks(batch, column: str, chars: int = 3_000_000):
    """Slices of an Arrow record batch whose text is about so long at most (one row at least)."""
    import pyarrow.compute as pc

    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), np.int64)
    if not len(lengths):
        return
    marks = np.cumsum(lengths) // chars
    starts = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1]])
    for lo, hi in zip(starts, np.r_[starts[1:], len(lengths)], strict=True):
        yield batch.slice(int(lo), int(hi - lo))
