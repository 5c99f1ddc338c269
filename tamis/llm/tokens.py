"""Token ids by a public byte-level BPE vocabulary."""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

#: The vocabulary's own way of splitting a text, for the characters that PLAIN holds: there, what `re` calls a letter,
#: digit or white space is what the tokenizers library calls so.
_SPLIT = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_NOT_PLAIN = re.compile("[^\x00-\x1b\x20-\x7f\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ]")

#: How a byte-level vocabulary spells bytes: printable ones as themselves, the others as characters from 256 on.
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class Encoder:
    """Whole texts to ids. A text is split as the vocabulary splits it, and each distinct piece is encoded once by the
    tokenizers library and kept; `most` pieces are kept at a time. Texts with characters on which `re` and the library
    might differ, or with a special token spelled out, go to the library whole."""

    def __init__(self, path: str, most: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.not_plain = re.compile("|".join([_NOT_PLAIN.pattern, *special]))
        self.merge = self.whole.model.tokenize  # of one piece, without splitting it
        self.most, self.known = most, {}

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.not_plain.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        pieces = _SPLIT.findall(text)
        try:
            return b"".join(map(self.known.__getitem__, pieces))
        except KeyError:
            if len(self.known) > self.most:
                self.known.clear()
            for piece in {p for p in pieces if p not in self.known}:
                made = self.merge(piece.encode().decode("latin1").translate(_BYTE_CHARACTERS))
                self.known[piece] = np.array([t.id for t in made], "<u4").tobytes()
            return b"".join(map(self.known.__getitem__, pieces))


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """One a process; None: the 50k byte-level vocabulary of public_tokenizers."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return Encoder(path)
