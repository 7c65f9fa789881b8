"""Byte-level BPE ids of whole texts, inside Python workers.

The vocabulary files come from a path that the caller gives; the rank form of a vocabulary gives the same ids as its
JSON form and encodes several times as fast.
"""

from __future__ import annotations

import base64
import os
import re
from array import array

#: From this length on a run of white space is cut out before the text is split: the library splits by recursion, which
#: ends the process at a run of about a million. Python counts four control characters as white space that the pattern doesn't.
LONG_BLANK = 50_000
_BLANK = re.compile(rf"[^\S\x1c-\x1f]{{{LONG_BLANK},}}")

SPECIAL = "<|endoftext|>"
SPECIAL_ID = 50256


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PackedEncoder:
    """encode(text) gives the ids as unsigned 32-bit numbers.

    ``special``: whether the string of the vocabulary's special token counts as that token, as the tokenizers library
    has it unless told otherwise; else it is ordinary text.
    """

    def __init__(self, path: str, special: bool = True):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        kinds = {SPECIAL: SPECIAL_ID} if special else {}
        bpe = tiktoken.Encoding(os.path.basename(path), pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=kinds)
        self.special = special
        self.plain, self.piece = bpe.encode_ordinary, bpe._encode_single_piece
        self.whole = lambda text: bpe.encode(text, allowed_special="all")

    def encode(self, text: str | None) -> array:
        if not text:
            return array("I")
        if len(text) >= LONG_BLANK and _BLANK.search(text):
            return array("I", self._in_parts(text))
        return array("I", self.whole(text) if self.special and SPECIAL in text else self.plain(text))


    def _in_parts(self, text: str) -> list[int]:
        """A run of white space is one piece but for its last character, which may go with what follows; so the text is cut
        before and after that piece."""
        out, at = [], 0
        encode = self.whole if self.special else self.plain
        for run in _BLANK.finditer(text):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += encode(text[at : run.start()])
            out += self.piece(text[run.start() : end].encode())
            at = end
        return out + encode(text[at:])


_ENCODERS: dict = {}


def encoder(path: str, special: bool = True) -> PackedEncoder:
    """One encoder for each vocabulary and worker process."""
    if (path, special) not in _ENCODERS:
        _ENCODERS[path, special] = PackedEncoder(path, special)
    return _ENCODERS[path, special]
