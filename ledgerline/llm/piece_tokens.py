"""Ids of a SentencePiece BPE tokenizer for many texts, each different segment encoded once.

A segment is a run of blanks with what follows up to the next blank. Where no piece of the
vocabulary has a blank behind another character, merges never reach from one segment into
the next, so the ids of a text are those of its segments in a row. With any other
vocabulary, texts go to the processor whole.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np

from ledgerline.llm.text import byte_span_hashes
from ledgerline.llm.tokens import KEPT_PIECES, Encoder, _ranges

DEFAULT_PIECES = "piece_bpe_32k.model"
_BLANK = "▁"


class PieceEncoder(Encoder):
    """Encodes texts that begin with the blank which the tokenizer would put before them."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.divisible = not any(re.search(f"[^{_BLANK}]{_BLANK}", piece) for piece in pieces)
        self.blank = self.processor.piece_to_id(_BLANK)
        self._forget()

    @property
    def piece_bytes(self) -> list[bytes]:
        """What each id stands for; control and unknown pieces stand for nothing."""
        p = self.processor
        out = []
        for i in range(p.get_piece_size()):
            piece = p.id_to_piece(i)
            if p.is_byte(i):
                out.append(bytes([int(piece[3:5], 16)]))
            elif p.is_control(i) or p.is_unknown(i):
                out.append(b"")
            else:
                out.append(piece.replace(_BLANK, " ").encode())
        return out

    def _ids(self, spaced: list[str]) -> list[list[int]]:
        """Ids of texts that begin with a blank, without it; the blank alone is its own piece."""
        found = self.processor.encode([s[1:] for s in spaced], num_threads=1)
        return [ids or [self.blank] for ids in found]

    def _encoded_pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self._ids(pieces)
        counts = np.array([len(ids) for ids in found], np.int64)
        return np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts

    def encode_spaced(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); ``data`` holds their UTF-8 bytes in a row.

        Every text begins with a blank.
        """
        if len(bounds) < 2:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.divisible:
            texts = [bytes(data[a:b]).decode() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            return self._encoded_pieces(texts)
        blank = data == 0x20
        begins = blank.copy()
        begins[1:] &= ~blank[:-1]
        begins[bounds[:-1]] = True
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], len(data))
        keys = byte_span_hashes(data, starts, ends)
        different, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.keys) > KEPT_PIECES:
            self._forget()
        at, known = self._ranks(different)
        if not known.all():
            new = np.flatnonzero(~known)
            spans = zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)
            whole = data.tobytes()
            self._learn(different[new], [whole[a:b].decode() for a, b in spans])
            at, _ = self._ranks(different)
        rank = self.rank[at][which]
        begin = self.offsets.values[rank]
        count = self.offsets.values[rank + 1] - begin
        total = np.concatenate([[0], np.cumsum(count)])
        per_text = np.diff(total[np.searchsorted(starts, bounds)])
        return self.ids.values[_ranges(begin, count)], per_text


@cache
def piece_encoder(path: str) -> PieceEncoder:
    """One encoder per Python worker and model file."""
    return PieceEncoder(path)
