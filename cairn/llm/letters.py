"""Which characters the installed tokenizers library takes for letters, numbers and white space; other modules follow other versions of Unicode."""

from __future__ import annotations

import functools
import re

import regex

#: What a pattern of a tokenizer's file may name.
KINDS = (r"\p{L}", r"\p{N}", r"\s")


@functools.cache
def ranges(kind: str) -> tuple[tuple[int, int], ...]:
    """The runs of code points (first, last) that the library's patterns take for `kind`; worked out once a process."""
    from tokenizers import Regex, pre_tokenizers

    points = [*range(0xD800), *range(0xE000, 0x110000)]
    split = pre_tokenizers.Split(Regex(f"{kind}+"), "removed", invert=True)
    found = []
    for _, (a, b) in split.pre_tokenize_str("".join(map(chr, points))):
        if points[b - 1] - points[a] == b - 1 - a:
            found.append((points[a], points[b - 1]))
        else:  # on both sides of the surrogates
            found += [(points[a], 0xD7FF), (0xE000, points[b - 1])]
    return tuple(found)


def inside(kind: str) -> str:
    """The kind's characters for use within brackets of a pattern."""
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in ranges(kind))


@functools.cache
def pattern(text: str) -> re.Pattern:
    """The library's pattern with each kind spelt out; a kind must stand within brackets or alone."""
    out, depth, k = [], 0, 0
    while k < len(text):
        kind = next((x for x in KINDS if text.startswith(x, k)), None)
        if kind:
            out.append(inside(kind) if depth else f"[{inside(kind)}]")
            k += len(kind)
            continue
        if text.startswith(r"\S", k):
            out.append(f"[^{inside(KINDS[2])}]")
            k += 2
            continue
        depth += (text[k] == "[") - (text[k] == "]")
        out.append(text[k])
        k += 1
    return re.compile("".join(out))


class Pieces:
    """Finds a pattern's matches as the library does. Below FIRST the regex module agrees with it, whatever version of Unicode either follows."""

    FIRST = "\u0250"

    def __init__(self, text: str):
        self.text, self.plain = text, regex.compile(text).findall

    def __call__(self, piece: str) -> list[str]:
        return self.plain(piece) if piece.isascii() or max(piece) < self.FIRST else pattern(self.text).findall(piece)
