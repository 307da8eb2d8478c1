"""Words of whole batches of texts and their hashed subwords, for the trained models."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from protolake.llm.kernels import BYTE_VALUES, distinct, first_places, mixed, ragged, span_hashes, word_spans

#: Bytes that stand between words: ASCII but letters (digits carry no language).
_BREAK = np.array([c < 0x80 and not chr(c).isalpha() for c in range(256)])
_FOLD = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)


def subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int, sizes: tuple[int, ...] = (1, 2, 3, 4), ordered: bool = False, block: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subword of each word, and the word it belongs to (ordered: word by word). data: bytes, folded, a break after each word.

    Subwords: the whole word, and all n-grams of bytes of the word between two marks.
    Words are worked on in blocks, so the memory beside the result is bounded.
    """
    spots, whose = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for a in range(0, len(starts), block):
        part, of = _subwords(data, starts[a : a + block], ends[a : a + block], buckets, sizes)
        if ordered:
            order = np.argsort(of, kind="stable")
            part, of = part[order], of[order]
        spots.append(part.astype(np.int32))
        whose.append((of + a).astype(np.int32))
    return np.concatenate(spots), np.concatenate(whose)


def _subwords(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    first = int(starts.min()) - 1  # words stand near each other: only their bytes are looked at
    data, starts, ends = data[first : int(ends.max()) + 1], starts - first, ends - first
    spots, whose = [span_hashes(BYTE_VALUES[data], starts, ends)], [np.arange(len(starts))]
    lengths = ends - starts + 2
    at = ragged(starts - 1, lengths)
    owner = np.repeat(np.arange(len(starts)), lengths)
    mark = np.ones(len(at), bool)
    edge = np.cumsum(lengths)
    mark[edge - 1] = mark[edge - lengths] = False
    marked = np.where(mark, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint64) + np.uint64(1)
    rest = edge[owner] - np.arange(len(at))  # bytes to the end of the word, this one included
    code = np.zeros(len(at), np.uint64)
    for n in range(1, min(max(sizes), len(at)) + 1):
        code[: len(at) - n + 1] = code[: len(at) - n + 1] * np.uint64(257) + marked[n - 1 :] if n > 1 else marked
        if n in sizes:
            keep = np.flatnonzero(rest >= n) if n > 1 else np.flatnonzero(mark)
            spots.append(mixed(code[keep] + np.uint64(n << 48)))
            whose.append(owner[keep])
    return (np.concatenate(spots) % np.uint64(buckets)).astype(np.int64), np.concatenate(whose)


@dataclass
class Words:
    """All words of a batch of texts: the text and the distinct word of each; data, starts, ends: the distinct words' bytes."""

    doc: np.ndarray
    code: np.ndarray
    hashes: np.ndarray
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def n(self) -> int:
        return len(self.hashes)

    def subwords(self, buckets: int, sizes: tuple[int, ...], which: np.ndarray | slice = slice(None), ordered: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the subwords of distinct words, and the place in ``which`` of the word of each (ordered: word by word)."""
        return subwords(self.data, self.starts[which], self.ends[which], buckets, sizes, ordered)


def _slices(data: np.ndarray, is_break: np.ndarray, most: int):
    """(first, last) ranges of about ``most`` bytes that cut no word."""
    a = 0
    while a < len(data):
        b = min(a + most, len(data))
        while b < len(data) and not is_break[data[b - 1]]:
            ahead = np.flatnonzero(is_break[data[b : b + most]])
            b = b + int(ahead[0]) + 1 if len(ahead) else min(b + most, len(data))
        yield a, b
        a = b


def read_words(texts: list[str | None], is_break: np.ndarray = _BREAK, most: int = 400_000) -> Words:
    """Words in lower case; texts are worked on ``most`` bytes at a time, so the memory beside them and their words is bounded."""
    blobs = [(x or "").lower().encode() for x in texts]
    data = _FOLD[np.frombuffer(b" " + b" ".join([*blobs, b""]), np.uint8)]
    ends = np.cumsum(np.fromiter((len(x) + 1 for x in blobs), np.int64, len(blobs))) + 1
    del blobs
    docs, hashes, firsts, lasts = [], [], [], []
    for a, b in _slices(data, is_break, most):
        starts, stops = word_spans(data[a:b], is_break)
        docs.append(np.searchsorted(ends, starts + a, side="right"))
        hashes.append(span_hashes(BYTE_VALUES[data[a:b]], starts, stops))
        firsts.append(starts + a)
        lasts.append(stops + a)
    every = np.concatenate(hashes)
    known, code = distinct(every)
    at = first_places(code, len(known))
    starts, stops = np.concatenate(firsts)[at], np.concatenate(lasts)[at]
    lengths = stops - starts + 1  # with the break behind the word
    own = np.concatenate([data[:1], data[ragged(starts, lengths)]])
    stops = np.cumsum(lengths)
    return Words(np.concatenate(docs), code, known, own, stops - lengths + 1, stops)
