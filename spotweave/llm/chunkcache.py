"""Ids of pieces of text, each distinct one encoded once while it is remembered."""

from __future__ import annotations

import numpy as np

from . import textkernel as tk

SLOTS = 1 << 21
CACHE_IDS = 1 << 23


class ChunkCache:
    """Encodes texts chunk by chunk. A subclass cuts (chunks) and encodes (encode_chunks).

    The chunk with hash h is remembered at h % SLOTS, the last one seen of those that meet there, so memory has a bound.
    """

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.key = np.zeros(SLOTS, np.uint64)
        self.first = np.zeros(SLOTS, np.int32)
        self.length = np.zeros(SLOTS, np.int32)
        self.ids = np.zeros(1 << 16, np.uint32)
        self.used = 0

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the chunks, and of each row its first chunk (one more than rows)."""
        raise NotImplementedError

    def encode_chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks one after the other, and each one's number of ids."""
        raise NotImplementedError

    def _learn(self, keys: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        got, lengths = self.encode_chunks(texts)
        while self.used + len(got) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : self.used + len(got)] = got
        first = self.used + np.cumsum(lengths) - lengths
        slot = (keys % np.uint64(SLOTS)).astype(np.int64)
        self.key[slot], self.length[slot], self.first[slot] = keys, lengths, first
        self.used += len(got)
        return first, lengths

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows one after the other, and each row's offsets in them."""
        starts, firsts = self.chunks(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.used > CACHE_IDS:
            self.clear()
        ends = np.append(starts[1:], len(data))
        keys = tk.span_hash(data, starts, ends)
        slot = (keys % np.uint64(SLOTS)).astype(np.int64)
        first, lengths = self.first[slot].astype(np.int64), self.length[slot].astype(np.int64)
        miss = np.flatnonzero(self.key[slot] != keys)
        if len(miss):
            raw = data.tobytes()
            new, some, which = np.unique(keys[miss], return_index=True, return_inverse=True)
            begin, size = self._learn(new, [raw[a:b] for a, b in zip(starts[miss[some]].tolist(), ends[miss[some]].tolist())])
            first[miss], lengths[miss] = begin[which], size[which]
        upto = np.concatenate([[0], np.cumsum(lengths)])
        return self.ids[tk.ragged(first, lengths)], upto[firsts]
