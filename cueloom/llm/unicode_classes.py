"""Character classes for ``re`` patterns, and symbols for bytes, built by rules."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata

#: What the tokenizers' patterns mean by ``\\s``.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _every() -> str:
    """The characters of the planes that Unicode assigns characters in: 0 to 3 and 14."""
    return "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xF0000)]))


@functools.cache
def _runs(first: str) -> tuple[tuple[int, int], ...]:
    """First and last code point of every run of characters whose category begins with ``first``.

    The tokenizers library is asked, so its Unicode version counts and not that of this Python.
    """
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split

    # Runs are cut at the gap of the surrogates by themselves, as none of the characters beside it is in a class.
    text = _every()
    pieces = Split(Regex(rf"[^\p{{{first}}}]+"), "removed").pre_tokenize_str(text)
    return tuple((ord(piece[0]), ord(piece[-1])) for piece, _ in pieces)


@functools.cache
def category(first: str) -> str:
    """The inside of a character class with every character whose category begins with ``first``."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" if b > a else f"\\U{a:08x}" for a, b in _runs(first))


@functools.cache
def odd() -> frozenset[str]:
    """The characters for which ``\\w``, ``\\d`` and ``\\s`` of ``re`` differ from letters, numbers and ``SPACE``."""
    kind = {}
    for first in "LN":
        for a, b in _runs(first):
            kind.update(dict.fromkeys(range(a, b + 1), first))
    space = re.compile(f"[{SPACE}]").fullmatch
    return frozenset(c for c in _every() if kind.get(ord(c)) != (
        "N" if c.isdecimal() else "L" if c.isalnum() else None
    ) or (c.isspace() and not space(c)))


def new_characters() -> str:
    """The inside of a class of the characters this Python does not know, which a newer library may."""
    parts, start = [], None
    for code in range(sys.maxunicode + 2):
        unknown = code <= sys.maxunicode and unicodedata.category(chr(code)) == "Cn"
        if unknown and start is None:
            start = code
        elif not unknown and start is not None:
            parts.append(f"\\U{start:08x}-\\U{code - 1:08x}")
            start = None
    return "".join(parts)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]
