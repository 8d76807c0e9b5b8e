"""Texts as numbered words, in Arrow arrays: only the distinct words of a slice become Python objects."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that are handled at once; a single longer text is a slice of its own.
SLICE_BYTES = 4 << 20


def slices(batch: pa.RecordBatch, text: int = 1, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most size bytes of the column of that number (or one row, where that has more)."""
    column = batch.column(text)
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, end - at)
        at = end


class Words:
    """The words (runs of bytes other than ASCII white space) of some texts.

    distinct: the different words, as bytes; codes: each word's number among these; first: where each text's words begin
    in codes, and their end. A null text has no words.
    """

    def __init__(self, texts: pa.Array, lower: bool):
        texts = pc.fill_null(texts, "")
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        coded = parts.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        self.codes = coded.indices.to_numpy(zero_copy_only=False)
        self.first = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        self.distinct: list[bytes] = words.to_numpy(zero_copy_only=False).tolist()
        if b"" in self.distinct:  # from white space at a text's ends
            stays = self.codes != self.distinct.index(b"")
            self.first = np.concatenate(([0], np.cumsum(stays)))[self.first]
            self.codes = self.codes[stays]

    @property
    def lengths(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """Each word's 64-bit hash."""
        one = xxhash.xxh3_64_intdigest
        return np.array([one(w) for w in self.distinct], np.uint64)[self.codes]

    def rows(self) -> np.ndarray:
        """The text that each word is of."""
        return np.repeat(np.arange(len(self.first) - 1), self.lengths)


class Memo(dict):
    """A dict from words whose entries only save work; past its bound of bytes the half that was met last goes.

    An entry counts as weight bytes for each of its word's, for the values made of it, and a fixed overhead.
    """

    def __init__(self, bound: int, weight: int, overhead: int = 200):
        self.bound, self.weight, self.overhead, self.size = bound, weight, overhead, 0

    def cost(self, keys) -> int:
        return self.weight * sum(map(len, keys)) + self.overhead * len(keys)

    def add(self, keys: list, values: list) -> None:
        self.update(zip(keys, values, strict=True))
        self.size += self.cost(keys)
        if self.size > self.bound:
            for key in list(self)[len(self) // 2 :]:  # the words met first are the frequent ones
                del self[key]
            self.size = self.cost(self)
            if self.size > self.bound:  # a few very long words
                self.clear()
                self.size = 0


def joined(pieces: list[bytes], codes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """pieces[codes], one after the other in one buffer, and where each begins (and the last one ends)."""
    taken = pa.array(pieces, pa.large_binary()).take(pa.array(codes))
    return taken, np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(codes) + 1]
