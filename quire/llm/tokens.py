"""Token ids of whole texts by the ``tokenizers`` library, with a bounded memo of pieces."""

from __future__ import annotations

import os
import re
from array import array

#: Letters that the byte-level pre-tokenizer's ``\p{L}`` and Python agree on.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ſ"
#: The pre-tokenizer's split, written for texts of these letters and printable ASCII only.
_PIECES = re.compile(rf" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+")
_OTHER = re.compile(rf"[^\t\n\r\x20-\x7e{_LETTERS}]")
#: Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on.
_PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(_PRINTABLE))}
#: Bits that tell pieces seen once.
_SIGHTS = 1 << 23


class Encoder:
    """``ids(text)``: the ids as little-endian unsigned 32-bit integers.

    The library splits a text into pieces and has its model encode each on its own, so the ids of
    a piece can be kept, and a new piece goes to the library's model alone. Texts with other
    characters than those above, or with a special token's string, go to the library whole.
    ``memo`` bounds the pieces kept, which are those met twice; when it is full, it begins anew.
    """

    def __init__(self, path: str, memo: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenize = self._tokenizer.model.tokenize
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        kind = type(self._tokenizer.pre_tokenizer).__name__
        self._by_piece = kind == "ByteLevel" and self._tokenizer.normalizer is None and not self._tokenizer.pre_tokenizer.add_prefix_space
        self._memo: dict[str, bytes] = {}
        self._seen = bytearray(_SIGHTS // 8)
        self._limit = memo

    def _whole(self, text: str) -> bytes:
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _new(self, piece: str) -> bytes:
        """Ids of a piece that is not kept; from its second sight on it is."""
        letters = piece.replace(" ", "Ġ") if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(_ALPHABET)
        ids = array("I", [t.id for t in self._tokenize(letters)]).tobytes()
        at = hash(piece) % _SIGHTS
        bit = 1 << (at & 7)
        if self._seen[at >> 3] & bit:
            if len(self._memo) >= self._limit:
                self._memo.clear()
                self._seen = bytearray(_SIGHTS // 8)
            self._memo[piece] = ids
        else:
            self._seen[at >> 3] |= bit
        return ids

    def ids(self, text: str) -> bytes:
        if not self._by_piece or _OTHER.search(text) or any(s in text for s in self._special):
            return self._whole(text)
        pieces = _PIECES.findall(text)
        found = list(map(self._memo.get, pieces))
        at = -1
        try:
            while True:
                at = found.index(None, at + 1)
                found[at] = self._new(pieces[at])
        except ValueError:
            return b"".join(found)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and vocabulary, kept from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
