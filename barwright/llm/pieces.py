"""Pieces of a public subword vocabulary and the lattice of all ways to cut a text into them.

The scores of the vocabulary file are merge ranks; Zipf's law turns a rank into a log probability. A
character that no piece covers is spelled in byte pieces, so every text has a segmentation. Spaces are
written as the mark U+2581, which opens words; a literal mark in a text is spelled in bytes, so that
decoding gives the text back exactly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    """entries: every prefix of every piece -> (id, log probability), or None if it is no piece itself."""

    entries: dict[str, tuple[int, float] | None]
    byte_ids: list[int]
    spelled: list[bytes]  # what each id decodes to; the mark is a space
    scores: list[float]  # log probability of each id, minus infinity for control pieces

    def spell(self, char: str) -> tuple[tuple[int, ...], float]:
        """Byte pieces of a character and their log probability."""
        ids = tuple(self.byte_ids[b] for b in char.encode())
        return ids, sum(self.scores[i] for i in ids)

    def with_scores(self, scores: list[float]) -> Vocabulary:
        entries = {p: e and (e[0], scores[e[0]]) for p, e in self.entries.items()}
        return Vocabulary(entries, self.byte_ids, self.spelled, scores)


def load(path: str = DEFAULT_MODEL) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    byte_ids = [-1] * 256
    pieces: dict[str, int] = {}
    ranks, spelled = [math.inf] * n, [b""] * n
    for i in range(n):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:-1], 16)] = i
            spelled[i] = bytes([int(piece[3:-1], 16)])
            ranks[i] = n
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[piece] = i
            spelled[i] = piece.replace(MARK, " ").encode()
            ranks[i] = min(max(-model.get_score(i), 0), n)
    total = sum(1 / (r + 2) for r in ranks if r < math.inf)
    scores = [-math.log((r + 2) * total) if r < math.inf else -math.inf for r in ranks]
    entries: dict[str, tuple[int, float] | None] = {}
    for piece in pieces:
        for k in range(1, len(piece)):
            entries.setdefault(piece[:k], None)
    for piece, i in pieces.items():
        entries[piece] = (i, scores[i])
    return Vocabulary(entries, byte_ids, spelled, scores)
