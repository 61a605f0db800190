"""Ids of a byte-level BPE tokenizer for many texts, each different piece encoded once.

The tokenizer cuts a text into pieces by a fixed pattern and encodes every piece for
itself, so the ids of a text are those of its pieces in a row. Pieces of texts whose
characters lie below ``PLAIN_LIMIT`` are found with array operations, and the ids of
pieces are kept; all other texts go to the tokenizer as they are.
"""

from __future__ import annotations

import os
import unicodedata
from functools import cache, cached_property

import numpy as np

from ledgerline.llm.text import span_hashes

DEFAULT_TOKENIZER = "byte_bpe_50k.json"
# Latin letters with their accents, whose classes are the same in every Unicode version.
PLAIN_LIMIT = 0x0370
# Different pieces kept in a Python worker; the table is emptied beyond that.
KEPT_PIECES = 250_000
# Pieces encoded as one text.
JOINED_PIECES = 512

_LETTER, _NUMBER, _SPACE, _OTHER, _END = range(5)
_WHITE = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0)
_APOSTROPHE = ord("'")


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def _classes() -> np.ndarray:
    table = np.full(PLAIN_LIMIT + 1, _OTHER, np.uint8)
    for code in range(PLAIN_LIMIT):
        kind = unicodedata.category(chr(code))[0]
        if kind in "LN":
            table[code] = _LETTER if kind == "L" else _NUMBER
    table[list(_WHITE)] = _SPACE
    table[PLAIN_LIMIT] = _END
    return table


@cache
def _code_values() -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 64, PLAIN_LIMIT + 1, dtype=np.uint64)


def piece_starts(codes: np.ndarray) -> np.ndarray:
    """Where pieces begin in code points of texts that each end with ``PLAIN_LIMIT``.

    The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?other+|space+(?!other than space)|space+.
    """
    kinds = _classes()[codes]
    n = len(codes)
    before = np.full(n, _END, np.uint8)
    before[1:] = kinds[:-1]
    after = np.full(n, _END, np.uint8)
    after[:-1] = kinds[1:]
    blank = codes == 0x20
    blank_before = np.zeros(n, dtype=bool)
    blank_before[1:] = blank[:-1]
    space = kinds == _SPACE
    # A run of one kind begins a piece, but a blank right before it is part of that piece.
    starts = (kinds != before) & ~(blank_before & ~space)
    # The last of several spaces stands apart if something follows.
    starts |= space & (after != _SPACE) & (after != _END)
    starts |= kinds == _END
    marks = np.flatnonzero((codes[:-1] == _APOSTROPHE) & starts[:-1])
    if len(marks):
        padded = np.concatenate([codes, np.full(3, PLAIN_LIMIT, codes.dtype)])
        one, two = padded[marks + 1], padded[marks + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(marks), dtype=bool)
        for ending in ("re", "ve", "ll"):
            long |= (one == ord(ending[0])) & (two == ord(ending[1]))
        for at, length in ((marks[short], 2), (marks[long], 3)):
            starts[at + 1] = False
            if length == 3:
                starts[at + 2] = False
            follows = at + length
            # A letter after it would otherwise be in the same run.
            starts[follows[kinds[follows] == _LETTER]] = True
    return np.flatnonzero(starts)


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, each from ``begin`` on, in a row."""
    before = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(begin - before, count)


class _Growing:
    """An array that grows at its end."""

    def __init__(self, start: np.ndarray):
        self._room = start
        self.size = len(start)

    @property
    def values(self) -> np.ndarray:
        return self._room[: self.size]

    def extend(self, more: np.ndarray) -> None:
        end = self.size + len(more)
        if end > len(self._room):
            room = np.empty(max(end, 2 * len(self._room)), self._room.dtype)
            room[: self.size] = self.values
            self._room = room
        self._room[self.size : end] = more
        self.size = end


class Encoder:
    """Encodes texts with one tokenizer; keeps the ids of pieces between calls."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted
        self.rank = np.zeros(0, np.int64)  # of each key's piece, in the order of arrival
        self.offsets = _Growing(np.zeros(1, np.int64))
        self.ids = _Growing(np.zeros(0, np.uint32))

    @cached_property
    def id_bytes(self) -> np.ndarray:
        """How many bytes of text each id stands for."""
        # A byte is one character in the vocabulary of a byte-level tokenizer.
        lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            lengths[i] = len(token)
        return lengths

    def _direct(self, texts: list[str]) -> list[np.ndarray]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, np.uint32) for x in encoded]

    def _encoded_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each).

        A blank and letters stay one piece wherever they stand, so many of them are
        encoded as one text, whose ids are then cut by the bytes they stand for.
        """
        worded = np.array([p[0] == " " and p[1:].isalpha() for p in pieces], dtype=bool)
        order = np.concatenate([np.flatnonzero(worded), np.flatnonzero(~worded)])
        split = int(worded.sum())
        texts = [pieces[i] for i in order[:split].tolist()]
        joined = ["".join(texts[i : i + JOINED_PIECES]) for i in range(0, split, JOINED_PIECES)]
        found = self._direct(joined + [pieces[i] for i in order[split:].tolist()])
        flat = np.concatenate(found)
        sizes = np.array([len(pieces[i].encode()) for i in order.tolist()], np.int64)
        reached = np.cumsum(self.id_bytes[flat])
        last = np.searchsorted(reached, np.cumsum(sizes))
        counts = np.diff(last + 1, prepend=0)
        begin = np.cumsum(counts) - counts
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        counts, begin = counts[back], begin[back]
        return flat[_ranges(begin, counts)], counts

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> None:
        """Keeps the ids of new pieces; ``keys`` are sorted."""
        ids, counts = self._encoded_pieces(pieces)
        base = self.offsets.size - 1
        self.offsets.extend(self.offsets.values[-1] + np.cumsum(counts))
        self.ids.extend(ids)
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.rank = np.insert(self.rank, at, base + np.arange(len(pieces)))

    def _ranks(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), dtype=bool)
        return at, known

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
        sizes = np.array([len(t) for t in texts], np.int64)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        strange = np.concatenate([[0], np.cumsum(codes >= PLAIN_LIMIT)])
        plain = strange[bounds[1:]] == strange[bounds[:-1]]
        out: list[np.ndarray | None] = [None] * len(texts)
        others = np.flatnonzero(~plain).tolist()
        if others:
            for i, ids in zip(others, self._direct([texts[i] for i in others]), strict=True):
                out[i] = ids
        chosen = np.flatnonzero(plain)
        if len(chosen):
            kept = [texts[i] for i in chosen]
            for i, ids in zip(chosen.tolist(), self._plain(kept, sizes[chosen]), strict=True):
                out[i] = ids
        return out

    def _plain(self, texts: list[str], sizes: np.ndarray) -> list[np.ndarray]:
        mark = chr(PLAIN_LIMIT)
        joined = mark.join(texts) + mark
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        starts = piece_starts(codes)
        ends = np.append(starts[1:], len(codes))
        real = codes[starts] != PLAIN_LIMIT
        starts, ends = starts[real], ends[real]
        keys = span_hashes(_code_values()[codes], starts, ends)
        different, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_PIECES:
            self._forget()
        at, known = self._ranks(different)
        if not known.all():
            new = np.flatnonzero(~known)
            spans = first[new]
            self._learn(
                different[new],
                [joined[a:b] for a, b in zip(starts[spans].tolist(), ends[spans].tolist(), strict=True)],
            )
            at, _ = self._ranks(different)
        rank = self.rank[at][which]
        begin = self.offsets.values[rank]
        count = self.offsets.values[rank + 1] - begin
        total = np.concatenate([[0], np.cumsum(count)])
        flat = self.ids.values[_ranges(begin, count)]
        text_ends = np.cumsum(sizes + 1)
        cuts = total[np.searchsorted(starts, np.concatenate([[0], text_ends]))]
        return [flat[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@cache
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and tokenizer file."""
    return Encoder(path)
