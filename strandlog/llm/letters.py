"""Terms and letter runs of whole texts, as UTF-8 bytes inside Python workers."""

from __future__ import annotations

import re
from collections.abc import Iterator

_LOWER = {b: b + 32 for b in range(ord("A"), ord("Z") + 1)}
_LETTERS = [*range(ord("a"), ord("z") + 1)]


def _folding(kept: list[int]) -> bytes:
    """A-Z become lower case, other ASCII that isn't kept becomes a space, bytes of longer code points stay."""
    return bytes(_LOWER.get(b, b if b in kept or b >= 0x80 else 0x20) for b in range(256))


TERM_FOLD = _folding([*_LETTERS, *range(ord("0"), ord("9") + 1)])
RUN_FOLD = _folding(_LETTERS)
#: In UTF-8 the letters U+00C0 to U+00FF start with the byte C3; no other code point does.
_OTHERS = re.compile(rb"(?:[\xc2\xc4-\xf4][\x80-\xbf]+)+")


def _slices(folded: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of folded, at most about ``size`` bytes at a time, so that a long text makes no long list."""
    at = 0
    while at < len(folded):
        end = folded.find(b" ", at + size)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def terms(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Maximal runs of ASCII letters, ASCII digits and code points over U+007F, only A-Z lower-cased."""
    return _slices(raw.translate(TERM_FOLD), size)


def runs(raw: bytes, size: int = 1 << 20) -> Iterator[list[bytes]]:
    """Maximal runs of [A-Za-z\\u00C0-\\u00FF], only A-Z lower-cased."""
    folded = raw.translate(RUN_FOLD)
    return _slices(folded if folded.isascii() else _OTHERS.sub(b" ", folded), size)


def n_letters(run: bytes) -> int:
    """Code points of a run: those over U+007F have two bytes, the first of which is C3."""
    return len(run) - run.count(b"\xc3")
