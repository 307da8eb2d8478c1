"""Byte-level BPE encoding of whole texts, fast on corpora that repeat words.

A byte-level BPE cuts a text into pieces (words with the space before them,
numbers, punctuation, white space) and merges within pieces only. Here numpy
finds the pieces of a whole batch at once, equal pieces are found by 64-bit
hashes, and the tokenizers library encodes each distinct piece that the worker
has not met. The ids of all texts are then gathered from the store. Texts with
characters beyond Latin script and common punctuation, or with the name of the
special token, are encoded whole by the library.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cached_property

import numpy as np
import pyarrow as pa

from protolake.llm.kernels import chunks, distinct, first_places, mixed, ragged, span_hashes

_SPACE, _LETTER, _NUMBER, _OTHER, _BEYOND = range(5)
_SPECIAL = "<|endoftext|>"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _class_of(c: int) -> int:
    if not (c < 0x250 or 0x2010 <= c <= 0x2027 or 0x2030 <= c <= 0x205E):
        return _BEYOND
    if 9 <= c <= 13 or c in (0x20, 0x85, 0xA0):
        return _SPACE
    return {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)


_CLASSES = np.array([_class_of(c) for c in range(0x2060)], np.uint8)
_VALUES = mixed(np.arange(0x2061))


def piece_starts(points: np.ndarray, kinds: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """True where a piece begins. firsts: where texts begin (none empty)."""
    n = len(points)
    new_text = np.zeros(n + 1, bool)
    new_text[firsts] = True
    new_text[n] = True
    start = new_text[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    space = kinds == _SPACE
    # the last white space before anything else in a text is a piece of its own, or begins the next if it is a plain space
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~new_text[1:n])
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    # contractions: an apostrophe that begins a piece and stands alone before letters
    marks = np.flatnonzero((points[:-1] == 0x27) & start[:-1] & (kinds[1:] == _LETTER) & ~new_text[1:n])
    if len(marks):
        one = points[marks + 1]
        two = np.where((marks + 2 < n) & ~new_text[np.minimum(marks + 2, n)], points[np.minimum(marks + 2, n - 1)], 0)
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        short = np.isin(one, [ord(c) for c in "stmd"])
        hit = short | long
        marks, size = marks[hit], np.where(short[hit], 1, 2)
        start[marks + 1] = False
        after = marks + 1 + size
        after = after[after < n]
        start[after] |= (kinds[after] == _LETTER) & ~new_text[after]
    return start


class PieceEncoder:
    """Encodes Arrow arrays of texts; keeps the ids of at most ``max_pieces`` pieces.

    literal: the special token's name in a text is ordinary text; else it gives the special id.
    """

    def __init__(self, path: str | None = None, literal: bool = False, max_pieces: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.path = path or tokenizer_path()
        self.by_piece = Tokenizer.from_file(self.path)
        self.by_piece.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.literal = literal
        self.max_pieces = max_pieces
        self._forget()

    @cached_property
    def whole(self):
        """The tokenizer as it is; loaded when a text needs it."""
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.encode_special_tokens = self.literal
        return whole

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.places = np.zeros(0, np.int32)  # of those in starts and lengths
        self.starts = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids, lengths = [self.ids], [self.lengths]
        for k in range(0, len(pieces), 1000):
            part = pieces[k : k + 1000]
            got = self.by_piece.encode_batch([part], is_pretokenized=True, add_special_tokens=False)[0]
            ids.append(np.array(got.ids, np.uint32))
            lengths.append(np.bincount(np.array(got.word_ids, np.int64), minlength=len(part)).astype(np.int32))
        known = len(self.lengths)
        self.ids, self.lengths = np.concatenate(ids), np.concatenate(lengths)
        self.starts = (np.cumsum(self.lengths, dtype=np.int64) - self.lengths).astype(np.int32)
        every = np.concatenate([self.hashes, hashes])
        places = np.concatenate([self.places, np.arange(known, known + len(hashes), dtype=np.int32)])
        order = np.argsort(every, kind="stable")
        self.hashes, self.places = every[order], places[order]

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(0, len(self.hashes) - 1))
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        return self.places[at], self.hashes[at] == hashes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and len(texts) + 1 offsets. Null counts as empty."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        flats, counts = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)]
        for a, b in chunks(texts):
            flat, n = self._encode([x or "" for x in texts.slice(a, b - a).to_pylist()])
            flats.append(flat)
            counts.append(n)
        return np.concatenate(flats), np.cumsum(np.concatenate(counts))

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        text = "".join(texts)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        ends = np.cumsum(sizes)
        points = np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0x2060).astype(np.int64)
        kinds = np.append(_CLASSES, np.uint8(_BEYOND))[points]
        beyond = np.zeros(len(texts), bool)
        beyond[np.searchsorted(ends, np.flatnonzero(kinds == _BEYOND), side="right")] = True
        if not self.literal and _SPECIAL in text:
            beyond |= np.array([_SPECIAL in x for x in texts])
        start = piece_starts(points, kinds, (ends - sizes)[sizes > 0]) if len(points) else np.zeros(0, bool)
        starts = np.flatnonzero(start)
        stops = np.append(starts[1:], len(points))
        owner = np.searchsorted(ends, starts, side="right")
        if beyond.any():
            keep = ~beyond[owner]
            starts, stops, owner = starts[keep], stops[keep], owner[keep]
        hashes, codes = distinct(span_hashes(_VALUES[points], starts, stops))
        places, found = self._find(hashes)
        if not found.all():
            if len(self.hashes) + int((~found).sum()) > self.max_pieces:
                self._forget()
                found[:] = False
            at = first_places(codes, len(hashes))[~found]
            self._learn(hashes[~found], [text[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist())])
            places, _ = self._find(hashes)
        pieces = places[codes]
        lengths = self.lengths[pieces].astype(np.int64)
        flat = self.ids[ragged(self.starts[pieces].astype(np.int64), lengths)]
        counts = np.bincount(owner, lengths, len(texts)).astype(np.int64)
        if beyond.any():
            cuts = np.concatenate([[0], np.cumsum(counts)])
            whole = {int(k): np.array(self.whole.encode(texts[k], add_special_tokens=False).ids, np.uint32) for k in np.flatnonzero(beyond)}
            flat = np.concatenate([whole.get(k, flat[cuts[k] : cuts[k + 1]]) for k in range(len(texts))])
            for k, ids in whole.items():
                counts[k] = len(ids)
        return flat, counts


_encoders: dict[tuple[str, bool], PieceEncoder] = {}


def worker_encoder(path: str, literal: bool = False) -> PieceEncoder:
    """One encoder for each Python worker and tokenizer file."""
    if (path, literal) not in _encoders:
        _encoders[path, literal] = PieceEncoder(path, literal)
    return _encoders[path, literal]
